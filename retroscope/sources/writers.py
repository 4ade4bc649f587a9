"""Tables to layers, results and keyed stores."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions.text import null_if_not_finite


def write_layer(df: DataFrame, folder: str, layer: str, version: int, partition_by: Sequence[str] = ()) -> str:
    """Write a new version of a layer next to the old ones and note its row count.

    A path that may be read in the same plan is never overwritten.
    """
    path = f"{folder.rstrip('/')}/{layer}/v{version}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    spark = df.sparkSession
    spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit(layer).alias("layer"), F.lit(version).alias("version"), "rows"
    ).write.mode("append").json(f"{folder.rstrip('/')}/_manifest")
    return path


def read_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame:
    """The newest version according to the manifest."""
    notes = spark.read.schema("layer string, version int, rows long").json(f"{folder.rstrip('/')}/_manifest")
    newest = notes.where(F.col("layer") == layer).agg(F.max("version")).first()[0]
    return spark.read.parquet(f"{folder.rstrip('/')}/{layer}/v{newest}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, quote='"', escape='"')


def write_vectors(df: DataFrame, key: str, vector: str, path: str) -> None:
    df.select(key, F.col(vector).cast("array<float>").alias("vector")).write.parquet(path)


def result_document(results: DataFrame, key: str, digits: int = 4) -> DataFrame:
    """Result rows as (key, JSON) with numbers rounded."""
    cols = [
        F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c)
        for c, t in results.dtypes if c != key
    ]
    return results.select(key, F.to_json(F.struct(*cols)).alias("document"))


def write_results(results: DataFrame, path: str) -> None:
    results.write.mode("errorifexists").json(path)


def publishable(df: DataFrame, columns: Sequence[str] = lex.PUBLISH_COLUMNS) -> DataFrame:
    """Allowed columns that exist, in order; NaN and infinities become null."""
    floats = {c for c, t in df.dtypes if t in ("double", "float")}
    return df.select(*[
        null_if_not_finite(F.col(c)).alias(c) if c in floats else F.col(c)
        for c in columns if c in df.columns
    ])


def upsert(df: DataFrame, open_writer: Callable[[], Callable[[list[tuple[str, dict]]], None]],
           key: str = "id", chunk: int = 450) -> None:
    """Send (key, document) batches from every partition.

    ``open_writer`` connects on the executor and returns the function that commits a batch.
    Batches are keyed sets, so a repeated task writes the same documents again.
    """
    def send(rows: Iterable) -> None:
        rows = iter(rows)
        commit = None
        while batch := list(islice(rows, chunk)):
            commit = commit or open_writer()
            commit([(str(r[key]), r.asDict(recursive=True)) for r in batch])

    df.foreachPartition(send)


def append_log(scored: DataFrame, path: str) -> None:
    """Append scored rows with the time they were scored."""
    scored.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def log_batch(scored: DataFrame, path: str, number: int) -> None:
    """The same for a numbered batch, whose rows a repeat replaces."""
    scored.withColumn("logged_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={number}")


def put_batch(df: DataFrame, path: str, number: int) -> None:
    """A keyed store in Parquet: each batch is a version, which a repeat replaces."""
    df.write.mode("overwrite").parquet(f"{path}/batch={number}")


class Ledger:
    """Which batches are done: one empty file per batch number, made when all its writes are."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.jvm = path.rstrip("/"), spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _place(self, number: int):
        place = self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{number}")
        return place, place.getFileSystem(self.conf)

    def holds(self, number: int) -> bool:
        place, fs = self._place(number)
        return fs.exists(place)

    def note(self, number: int) -> None:
        place, fs = self._place(number)
        fs.create(place, True).close()

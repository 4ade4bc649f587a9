"""Structured Streaming forms of the batch projections."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from retroscope.plans import posts, scoring
from retroscope.session import scratch_path
from retroscope.sources import writers


def file_stream(spark: SparkSession, folder: str, schema, pattern: str | None = None, kind: str = "parquet",
                files_per_trigger: int | None = None) -> DataFrame:
    """Files of a folder as they land; ``pattern`` restricts their names."""
    reader = spark.readStream.format(kind).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of part files."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(target)
    if status.isDirectory():
        return file_stream(spark, path, schema)
    folder, _, name = path.rpartition("/")
    return file_stream(spark, folder, schema, name)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  partition_by: Sequence[str] = ()) -> None:
    """Handle what has landed, write Parquet, stop. The checkpoint makes a re-run resume."""
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option(
        "checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start()
    query.awaitTermination()


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Handle what has landed in update mode: each micro-batch writes the rows it changed under its
    number, so a batch that runs again replaces its own rows."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def latest_versions(spark: SparkSession, path: str, schema, keys: Sequence[str]) -> DataFrame:
    """The last version of each key that a stream in update mode has written."""
    rows = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/batch=*").select(
        "*", F.regexp_extract(F.col("_metadata.file_path"), r"/batch=(\d+)/", 1).cast("bigint").alias("_batch"))
    rest = [c for c in rows.columns if c not in keys and c != "_batch"]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_v"))
    return last.select(*keys, "_v.*")


def structured_posts(documents: DataFrame) -> DataFrame:
    """Newly landed documents through the same keep and label projections."""
    return posts.structured_from_documents(documents)


def once_per_key(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Drop repeats of a key; state is forgotten ``delay`` after the row's event time."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_rates(stream: DataFrame, time: str, by: str, outcome: Column, width: str, delay: str) -> DataFrame:
    """Outcome rate and size per tumbling window and group; rows later than ``delay`` are dropped."""
    rows = stream.withWatermark(time, delay) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, width), by).agg(
        F.avg(outcome).alias("rate"), F.count(F.lit(1)).alias("n")
    ).select(F.col("window.start").alias("window_start"), by, "rate", "n")


def dealt(batch: DataFrame) -> DataFrame:
    """The rows of a micro-batch over all cores: a batch of one file is one task, whatever its rows cost."""
    return batch.repartition(4 * batch.sparkSession.sparkContext.defaultParallelism)


def once_per_batch(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], ledger: str | None = None) -> StreamingQuery:
    """Hand each micro-batch to ``handle`` and note its number once that has returned.

    A stream that stops between a batch's writes and its own checkpoint repeats the batch when it comes
    back: a noted batch is passed over, one that was not noted is handled again, so ``handle`` has to put its
    rows under the batch's number or their keys. The ledger lies in the checkpoint unless it is named, as
    batch numbers mean nothing without it.
    """
    notes = writers.Ledger(stream.sparkSession, ledger or f"{checkpoint.rstrip('/')}/ledger")

    def run(batch: DataFrame, number: int) -> None:
        if not notes.holds(number):
            handle(batch, number)
            notes.note(number)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_and_upsert(stream: DataFrame, text: str, checkpoint: str, open_writer: Callable | None = None, key: str = "id",
                     log_path: str | None = None, store: str | None = None, ledger: str | None = None, **score_options) -> StreamingQuery:
    """Score each micro-batch once, send it to the keyed store (a writer or a Parquet folder), note it in the log."""
    def handle(batch: DataFrame, number: int) -> None:
        scored = scoring.score(dealt(batch), text, **score_options).persist()
        try:
            ready = writers.publishable(scored, scored.columns)
            if open_writer:
                writers.upsert(ready, open_writer, key)
            if store:
                writers.put_batch(ready, store, number)
            if log_path:
                writers.log_batch(scored, log_path, number)
        finally:
            scored.unpersist()

    return once_per_batch(stream, checkpoint, handle, ledger)


def stream_to_table(spark: SparkSession, stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over what has landed and read its result back."""
    path = scratch_path(spark, label)
    run_available(stream, path, scratch_path(spark, f"{label}-progress"), mode)
    return spark.read.schema(stream.schema).parquet(path)

"""Landed files to tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.sources import schemas

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, in tasks that grow in number with the input.

    For per-row work that costs more than moving the rows. A split of the reader is one task whatever its
    rows cost: few splits leave cores idle, as many as cores or a few more end in a wave of long tasks.
    """
    cores, splits = df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()
    return df.repartition(max(2 * cores, 8 * splits if splits >= cores else 4 * splits))


def by_rows(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Deal narrow rows in tasks of at most about ``rows``: files of a compact layer are small, so the reader
    packs any number of rows into as many splits as there are cores."""
    tasks = -(-df.count() // rows)
    return df.repartition(tasks) if tasks > df.rdd.getNumPartitions() else df


def require(spark: SparkSession, paths: Sequence[str]) -> None:
    """Fail before any job is planned if an input is missing."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        found = path.getFileSystem(conf).globStatus(path)
        if found is None or len(found) == 0:
            raise FileNotFoundError(f"Missing: {p}")


def file_state(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of the files of a table: equal while the table has not changed."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return tuple(sorted((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in fs.listStatus(target)))


def listed(spark: SparkSession, pattern: str) -> list[tuple[str, str]]:
    """(name, path) of the files, and folders of part files, that a pattern names: the listing alone, nothing is opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted((s.getPath().getName(), s.getPath().toString()) for s in found or ())


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str = schemas.RAW_POST) -> DataFrame:
    """Quoted multi-line CSV with a header; ``_file`` keeps the name of the file, or folder of part files, a row came from."""
    paths = [path] if isinstance(path, str) else list(path)
    rows = spark.read.schema(schema).csv(
        paths, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False
    )
    place = F.col("_metadata.file_path")
    return rows.select("*", F.regexp_extract(place, r"([^/]+?)(/part-[^/]*)?$", 1).alias("_file"), place.alias("_path"))


def latest_snapshot(spark: SparkSession, pattern: str, number: str = r"_(\d+)\.csv$") -> str:
    """The snapshot with the largest number in its name, compared as a number."""
    numbered = [(int(m.group(1)), path) for name, path in listed(spark, pattern) if (m := re.search(number, name))]
    if not numbered:
        raise FileNotFoundError(f"Missing: {pattern}")
    return max(numbered)[1]


def read_latest(spark: SparkSession, pattern: str, number: str = r"_(\d+)\.csv$") -> DataFrame:
    """Rows of the latest snapshot; no other file is read."""
    return read_csv(spark, latest_snapshot(spark, pattern, number))


def named_files(spark: SparkSession, pattern: str, words: Sequence[str]) -> list[str]:
    """Files whose name holds one of the words, whatever the case."""
    found = [path for name, path in listed(spark, pattern) if any(w.lower() in name.lower() for w in words)]
    if not found:
        raise FileNotFoundError(f"Missing: {pattern} with one of {list(words)}")
    return found


def read_named(spark: SparkSession, pattern: str, words: Sequence[str]) -> DataFrame:
    """Rows of the files whose name holds one of the words; no other file is read."""
    return read_csv(spark, named_files(spark, pattern, words))


def name_head(file: str = "_file") -> Column:
    """What stands before the first underscore of the file name."""
    return F.split_part(F.col(file), F.lit("_"), F.lit(1))


def with_source_and_domain(rows: DataFrame, domains: dict[str, str]) -> DataFrame:
    """``source_subreddit`` from the file name and ``domain`` from an explicit table."""
    known = F.create_map(*[x for k, v in domains.items() for x in (F.lit(k.lower()), F.lit(v))])
    return rows.withColumn("source_subreddit", name_head()).withColumn(
        "domain", F.try_element_at(known, F.lower("source_subreddit"))
    )


def flatten_listing(pages: DataFrame) -> DataFrame:
    """One row per listed post; entries without an id are dropped."""
    post = F.col("_c.data")
    rows = pages.select(
        *[c for c in pages.columns if c != "data"], F.explode("data.children").alias("_c")
    ).where(post["id"].isNotNull() & (post["id"] != ""))
    keep = [c for c in pages.columns if c != "data"]
    made = F.date_format(F.timestamp_seconds(post["created_utc"]), "yyyy-MM-dd'T'HH:mm:ss")
    return rows.select(
        *keep, post["id"].alias("id"), post["subreddit"].alias("subreddit"),
        F.coalesce(post["title"], F.lit("")).alias("title"),
        F.coalesce(post["selftext"], F.lit("")).alias("selftext"),
        post["created_utc"].alias("created_utc"),
        F.when(post["created_utc"] != 0, made).alias("created_dt"),
        post["num_comments"].alias("num_comments"), post["score"].alias("score"),
        post["permalink"].alias("permalink"), post["url"].alias("url"),
    )


def read_landing(spark: SparkSession, folder: str, whole_files: bool = False) -> DataFrame:
    """All ``bucket=*/page=*`` listing files below ``folder``, one row per post id.

    A file holds one listing per line, or with ``whole_files`` one that may span lines. Text that is
    no listing fails the read, and so does anything behind the one listing of a whole file. A post
    found in several buckets or pages is kept where it came first.
    """
    from retroscope.operators.relational import dedupe_keep_first

    files = f"{folder.rstrip('/')}/*/*"
    if whole_files:
        # as the only entry of a list, so that a second object is a syntax error and not skipped
        texts = spark.read.schema("value string, bucket string, page int").option("basePath", folder).text(files, wholetext=True)
        entry = F.from_json(F.concat(F.lit("["), "value", F.lit("]")), f"array<struct<{schemas.LISTING}>>", {"mode": "FAILFAST"})
        pages = texts.select("bucket", "page", F.explode(entry).alias("_p")).select("_p.*", "bucket", "page")
    else:
        pages = spark.read.schema(schemas.LISTING + ", bucket string, page int").option(
            "basePath", folder).option("mode", "FAILFAST").json(files)
    posts = flatten_listing(pages)
    return dedupe_keep_first(posts, ["id"], ["bucket", "page", "created_utc"])


def sample_rows(rows: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first n rows in a stated order; repeats stay."""
    return rows.orderBy(*order).limit(n)


def parse_created(df: DataFrame) -> DataFrame:
    """``created_dt_parsed`` and ``post_year``.

    The text form is used for the whole table if any row has it, the epoch form otherwise.
    """
    has_text = (
        df.select("created_dt").where(F.col("created_dt").isNotNull()).limit(1).count() > 0
        if "created_dt" in df.columns else False
    )
    parsed = (
        F.col("created_dt").cast("string").try_cast("timestamp") if has_text
        else F.timestamp_seconds("created_utc")
    )
    return df.withColumn("created_dt_parsed", parsed).withColumn(
        "post_year", F.coalesce(F.year("created_dt_parsed"), F.lit(2024))
    )

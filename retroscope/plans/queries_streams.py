"""Queries that run a stream over a table's files and read its result back."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from retroscope.plans import oracle as sql
from retroscope.plans import posts, scoring
from retroscope.plans.catalogue import query
from retroscope.plans.queries_posts import BASE, _SCORED
from retroscope.session import scratch_path
from retroscope.sources import writers
from retroscope.sources.readers import table
from retroscope.streaming import streams


def _stream(spark, d, name):
    return streams.table_stream(spark, f"{d}/{name}.parquet", table(spark, d, name).schema)


@query("id:s domain:s reversal:i urgency_score:i time_to_regret_days:f", "SELECT * FROM structured", BASE)
def stream_structured_posts(spark, d):
    made = streams.structured_posts(_stream(spark, d, "documents"))
    return streams.stream_to_table(spark, made.select("id", "domain", "reversal", "urgency_score", "time_to_regret_days"), "structured")


@query("user_id:i event_type:s n:i", "SELECT user_id, event_type, 1 AS n FROM events GROUP BY ALL")
def stream_dedupe(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    once = streams.once_per_key(events, ["user_id", "event_type"], "ts", "365 days")
    kept = streams.stream_to_table(spark, once.select("user_id", "event_type"), "once")
    return kept.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("window_start:s event_type:s rate:f n:i", """
  SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS window_start, event_type, avg(CAST(value > 20 AS INT)) AS rate, count(*) AS n FROM events GROUP BY ALL""")
def stream_window_rates(spark, d):
    events = _stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    outcome = (F.col("value") > 20).cast("int")
    rates = streams.windowed_rates(events, "ts", "event_type", outcome, "1 day", "1 hour")
    # update mode also gives windows that are still open when the input ends
    path = scratch_path(spark, "windows")
    streams.run_updates(rates, path, scratch_path(spark, "windows-progress"))
    out = streams.latest_versions(spark, path, rates.schema, ["window_start", "event_type"])
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query("id:s emotion:s domain:s reversal_probability:f urgency_score:f has_time:i", *_SCORED)
def stream_scored_texts(spark, d):
    made = posts.posts_of_documents(_stream(spark, d, "documents")).select("id", "selftext")
    scored = scoring.score(made, "selftext").select("id", "emotion", "domain", "reversal_probability", "urgency_score", "has_time")
    return streams.stream_to_table(spark, scored, "scored")


class _Stopped(RuntimeError):
    pass


@query("id:s emotion:s domain:s reversal_probability:f urgency_score:f has_time:i versions:i logged:i",
       f"SELECT *, 1 AS versions, 1 AS logged FROM ({_SCORED[0]})", _SCORED[1])
def stream_resumed_store(spark, d):
    """A stream into a keyed store that is stopped twice, before and after a batch is noted, and taken up again."""
    landing, progress, store, log = (scratch_path(spark, f"resume-{x}") for x in ("landing", "progress", "store", "log"))
    made = posts.posts_of_documents(table(spark, d, "documents")).select("id", "selftext")
    made.repartition(6).write.parquet(landing)
    stream = streams.file_stream(spark, landing, made.schema, files_per_trigger=1)
    notes, ends = writers.Ledger(spark, f"{progress}/ledger"), {1: "before", 3: "after"}

    def handle(batch, number):
        scored = scoring.score(streams.dealt(batch), "selftext").persist()
        writers.put_batch(scored, store, number)
        writers.log_batch(scored, log, number)
        scored.unpersist()
        end = ends.pop(number, None)
        if end == "after":
            notes.note(number)
        if end:
            raise _Stopped(end)

    def run():
        try:
            streams.once_per_batch(stream, progress, handle).awaitTermination()
        except StreamingQueryException:
            return False
        return True

    while not run():
        pass
    written = spark.read.option("basePath", store).parquet(f"{store}/batch=*")
    versions = written.groupBy("id").agg(F.count(F.lit(1)).alias("versions"))
    logged = spark.read.option("basePath", log).parquet(f"{log}/batch=*").groupBy("id").agg(F.count(F.lit(1)).alias("logged"))
    latest = streams.latest_versions(spark, store, written.drop("batch").schema, ["id"])
    return latest.join(versions, "id").join(logged, "id")

"""Every operator as a query over the given tables, with the same question in plain SQL.

A query is registered with its result columns (``s`` text, ``i`` whole number, ``f`` number
rounded to six places, ``b`` flag). The same list shapes both sides, so they compare as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.plans import posts
from retroscope.session import scratch_path
from retroscope.sources import writers
from retroscope.sources.readers import by_rows, file_state, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_SPARK_TYPES = {"s": "string", "i": "bigint", "f": "double", "b": "boolean"}
_SQL_TYPES = {"s": "VARCHAR", "i": "BIGINT", "f": "DOUBLE", "b": "BOOLEAN"}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def _shape(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _columns(spec):
        c = F.col(name).cast(_SPARK_TYPES[kind])
        out.append((F.round(c, 6) + F.lit(0.0) if kind == "f" else c).alias(name))
    return df.select(*out)


def _shape_sql(sql: str, spec: str, ctes: list[str]) -> str:
    out = []
    for name, kind in _columns(spec):
        c = f'CAST("{name}" AS {_SQL_TYPES[kind]})'
        out.append((f"round({c}, 6) + 0.0" if kind == "f" else c) + f' AS "{name}"')
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM ({sql})"


def query(spec: str, sql: str | None = None, ctes: list[str] | None = None):
    """Register a function (spark, folder) -> DataFrame under its own name."""
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _shape(fn(spark, folder), spec)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = _shape_sql(sql, spec, ctes or [])
        return fn
    return register


def documents(spark, d):
    return spread(table(spark, d, "documents"))


def structured(spark, d):
    return posts.structured_from_documents(documents(spark, d))


def enriched(spark, d):
    return posts.enriched_from_documents(documents(spark, d))


_LAYERS: dict[tuple, str | tuple[str, str]] = {}


def layer(spark, d):
    """The enriched posts as an analysis reads them: written once per application and state of the
    table, without the long texts, then scanned column by column. Texts are parsed once, not once
    per analysis."""
    key = (spark.sparkContext.applicationId, d, file_state(spark, f"{d}/documents.parquet"))
    if key not in _LAYERS:
        folder = scratch_path(spark, "layers")
        slim = enriched(spark, d).drop("selftext", "full_text")
        _LAYERS[key] = writers.write_layer(slim, folder, "enriched", 1)
    return spark.read.parquet(_LAYERS[key])


def model_layer(spark, d):
    """The layer with ``topic`` and ``emb_`` columns, and the topics' terms; written once, like the layer."""
    from retroscope.plans import models

    key = (spark.sparkContext.applicationId, d, file_state(spark, f"{d}/documents.parquet"), "model")
    if key not in _LAYERS:
        folder = scratch_path(spark, "layers")
        rows, model = models.with_topics(by_rows(layer(spark, d)), "id")
        writers.write_layer(model.top_terms(spark), folder, "topics", 1)
        _LAYERS[key] = (writers.write_layer(models.with_vectors(by_rows(rows), "id"), folder, "enriched", 2), f"{folder}/topics/v1")
    rows, names = _LAYERS[key]
    return spark.read.parquet(rows), spark.read.parquet(names)


def load_all() -> None:
    """Import the modules that register queries."""
    from retroscope.plans import (  # noqa: F401
        queries_models, queries_posts, queries_relational, queries_statistics, queries_streams,
        queries_text,
    )

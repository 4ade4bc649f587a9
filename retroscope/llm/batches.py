"""How many rows reach a Python worker at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows for all that is run inside; a caller's smaller setting stays. Rows with
    whole texts or bitmaps are wide, and a batch is held by the JVM and by its worker."""
    before = spark.conf.get(_KEY)
    if 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_KEY, before)

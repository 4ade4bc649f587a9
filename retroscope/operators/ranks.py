"""Global order without a single-task sort.

Ranks, exact quantiles, AUC, at-risk counts and fold numbers all need "how many rows come
before this one". Here that is: pre-aggregate to distinct values (map-side), cut the value
range into buckets, take a running sum inside each bucket, and add the totals of the
buckets before it. No task ever holds more than one bucket of one group, and a value that
a third of all rows share is one row after the first step.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# below this many rows one sorted window per group is cheaper than bucketing; above, buckets hold about as many
SINGLE_WINDOW_ROWS = 200_000


def bucket_bounds(df: DataFrame, value: str, buckets: int | None = None,
                  single: int = SINGLE_WINDOW_ROWS) -> list[float]:
    """Ascending cut points with about ``single`` rows between them, however many that takes; [] if
    there are no more rows than that.

    A count, then a mergeable sketch of one column and one row to the driver. The cut points become
    literals, so a re-run task buckets its rows the same way.
    """
    x = F.col(value).cast("double")
    n = df.agg(F.count(x)).first()[0]
    if n <= single:
        return []
    buckets = max(2, buckets or 0, -(-n // max(1, single)))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = df.agg(F.percentile_approx(F.when(~F.isnan(x), x), steps, 20 * buckets).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def in_buckets(df: DataFrame, value: str, bounds: Sequence[float], out: str = "_bucket") -> DataFrame:
    if not bounds:
        return df.withColumn(out, F.lit(0))
    splits = [float("-inf"), *bounds, float("inf")]
    keyed = df.withColumn("_cut", F.col(value).cast("double"))
    cut = Bucketizer(splits=splits, inputCol="_cut", outputCol=out, handleInvalid="keep")
    return cut.transform(keyed).withColumn(out, F.col(out).cast("int")).drop("_cut")


def cumulate(
    df: DataFrame,
    value: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    domain: int | None = None,
    single: int = SINGLE_WINDOW_ROWS,
) -> DataFrame:
    """One row per (by, value): each measure, its sum over smaller values, its group total.

    ``measures`` are aggregate columns. ``domain`` says that values are whole numbers, nearly all of
    them below it (days below a cap, say): the range is then cut evenly, which spares the sketch.
    Columns out: by, value, m, m_before, m_total.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull())
    if domain:
        bounds = list(range(single, domain, single))
    else:
        bounds = bucket_bounds(rows, value, single=single)
    pre = rows.groupBy(*by, value).agg(*[m.alias(k) for k, m in measures.items()])
    return scan(pre, value, list(measures), by, bounds)


def scan(pre: DataFrame, value: str, measures: Sequence[str], by: Sequence[str] = (), bounds: Sequence[float] = ()) -> DataFrame:
    """Rows of distinct (by, value): each measure, its sum over smaller values, its group total.

    Two passes over segments of the value range: sums of whole segments first, then the rows of each
    segment on top of the segments before it. Without ``bounds`` a group is one segment. Columns of
    ``pre`` other than those named are dropped.
    """
    by = list(by)
    if not bounds:
        group = Window.partitionBy(*by)
        below = group.orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return pre.select(
            *by, value, *measures,
            *[F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"{k}_before") for k in measures],
            *[F.sum(k).over(group).alias(f"{k}_total") for k in measures],
        )
    cut = in_buckets(pre, value, bounds)
    inside = (
        Window.partitionBy(*by, "_bucket").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per bucket and group from here on
    totals = cut.groupBy(*by, "_bucket").agg(*[F.sum(k).alias(f"_t_{k}") for k in measures])
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, "_bucket",
        *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_o_{k}") for k in measures],
        *[F.sum(f"_t_{k}").over(group).alias(f"{k}_total") for k in measures],
    )
    local = cut.select(
        *by, value, "_bucket", *measures,
        *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"_l_{k}") for k in measures],
    )
    return local.join(offsets, [*by, "_bucket"]).select(
        *by, value, *measures,
        *[(F.col(f"_l_{k}") + F.col(f"_o_{k}")).alias(f"{k}_before") for k in measures],
        *[F.col(f"{k}_total") for k in measures],
    )


def midrank(n: str = "n") -> Column:
    """Average 1-based rank of the rows that share a value."""
    return F.col(f"{n}_before") + (F.col(n) + F.lit(1)) / F.lit(2.0)


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: Sequence[str] = (),
    domain: int | None = None,
    single: int = SINGLE_WINDOW_ROWS,
) -> DataFrame:
    """Exact linear-interpolated quantiles per group, one column per entry of ``probs``."""
    rows = cumulate(df, value, {"n": F.count(F.lit(1))}, by, domain, single)
    at, first = [], []
    for name, p in probs.items():
        h = (F.col("n_total") - F.lit(1)) * F.lit(p)
        for side, spot in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            held = (F.col("n_before") <= spot) & (spot < F.col("n_before") + F.col("n"))
            first.append(F.max(F.when(held, F.col(value))).alias(f"_{name}_{side}"))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        frac = (F.col("_n") - F.lit(1)) * F.lit(p)
        at.append((lo + (hi - lo) * (frac - F.floor(frac))).alias(name))
    picked = rows.groupBy(*by).agg(F.max("n_total").alias("_n"), *first)
    return picked.select(*by, F.col("_n").alias("n"), *at)


def hash_order(seed: int, key: str) -> Column:
    """A reproducible shuffle key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))


def hash_ordinals(
    df: DataFrame, key: str, strata: Sequence[str] = (), seed: int = 42, digits: int | None = None
) -> DataFrame:
    """1-based position of each row inside its stratum in shuffled order.

    The shuffle key is uniform, so its leading hex digits are ready-made equal buckets and
    one stratum spreads over 16**digits tasks: as many digits as keep a bucket below
    SINGLE_WINDOW_ROWS rows. Adds ``ordinal`` and ``stratum_size``.
    """
    strata = list(strata)
    if digits is None:
        n, digits = df.count(), 1
        while 16 ** digits * SINGLE_WINDOW_ROWS < n:
            digits += 1
    keyed = df.withColumn("_hash", hash_order(seed, key)).withColumn(
        "_bucket", F.substring("_hash", 1, digits)
    )
    sizes = keyed.groupBy(*strata, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*strata)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *strata, "_bucket",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_n").over(group).alias("stratum_size"),
    )
    inside = Window.partitionBy(*strata, "_bucket").orderBy("_hash", key)
    return (
        keyed.withColumn("_place", F.row_number().over(inside))
        .join(offsets, [*strata, "_bucket"])
        .withColumn("ordinal", F.col("_offset") + F.col("_place"))
        .drop("_hash", "_bucket", "_offset", "_place")
    )

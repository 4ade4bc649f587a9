"""Relational glue: dedupe, unions, enrichment joins, tallies, pivots, summaries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import bins
from retroscope.operators import ranks

FEW_GROUPS = 10_000


def vector_sum(c: str) -> Column:
    """Sum of equally long arrays, as one aggregate however long they are."""
    return vector_to_array(Summarizer.sum(array_to_vector(c))).alias(c)


# --- rows ---------------------------------------------------------------------------
def dedupe_keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the first in ``order``.

    An aggregate, not a window: copies collapse before the shuffle, so a key with a third
    of all rows sends one row per task.
    """
    first = F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row")
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(first).select("_row.*")


def union_with_drift(frames: Sequence[DataFrame]) -> DataFrame:
    """Append tables whose columns differ; what a table lacks is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def first_across_sources(frames: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """Union in list order and keep the first row of each key."""
    ranked = [f.withColumn("_source_rank", F.lit(i)) for i, f in enumerate(frames)]
    merged = union_with_drift(ranked)
    return dedupe_keep_first(merged, [key], ["_source_rank", order]).drop("_source_rank")


def enrich(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join on ``key``; the right table's columns replace the left's of the same name."""
    clash = [c for c in right.columns if c != key and c in left.columns]
    return left.drop(*clash).join(right, key, "left")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has not been handled."""
    return df.join(done.select(key), key, "left_anti")


def arrange(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first, the rest after them; none is lost."""
    ahead = [c for c in preferred if c in df.columns]
    return df.select(*ahead, *[c for c in df.columns if c not in preferred])


def fuller_column(df: DataFrame, first: str, second: str, out: str, fill: str = "unknown") -> DataFrame:
    """Whichever of two columns has more non-nulls (the second on a tie), nulls filled."""
    if first in df.columns and second in df.columns:
        n = df.agg(F.count(first).alias("a"), F.count(second).alias("b")).first()
        pick = first if n["a"] > n["b"] else second
    else:
        pick = first if first in df.columns else second
    return df.withColumn(out, F.coalesce(F.col(pick), F.lit(fill)))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows of each group; Spark trims each task to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def few_values(df: DataFrame, col: str, most: int = 1000) -> list:
    """The distinct values of a category, sorted; a column with more than ``most`` of them is refused."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} values; list the ones to use")
    return sorted(found)


# --- tallies ------------------------------------------------------------------------
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), col)


def shares(df: DataFrame, by: str, col: str) -> DataFrame:
    """Counts of ``col`` inside each ``by`` and their share of it."""
    counts = df.groupBy(by, col).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(by)))


def rates(df: DataFrame, by: Sequence[str], outcome: str, min_n: int = 0) -> DataFrame:
    """Mean outcome and size per group, groups below ``min_n`` left out."""
    out = df.groupBy(*by).agg(
        F.avg(F.col(outcome)).alias("rate"), F.count(F.lit(1)).alias("n")
    )
    return out.where(F.col("n") >= min_n) if min_n else out


def audit(df: DataFrame, by: str, outcome: str, optional: str) -> DataFrame:
    return df.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(outcome).alias("outcome_rate"),
        F.avg(F.col(optional).isNotNull().cast("int")).alias("known_rate"),
    )


def rates_with_overall(df: DataFrame, first: str, second: str, outcome: str) -> DataFrame:
    """Rates by (first, second) and by first alone, in one pass."""
    return df.groupingSets([[first, second], [first]], first, second).agg(
        F.avg(outcome).alias("rate"), F.count(F.lit(1)).alias("n")
    )


def crosstab(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("n"))


def row_shares(df: DataFrame, row: str, col: str, values: Sequence) -> DataFrame:
    """Share of each listed value per row; values that do not occur are 0."""
    wide = df.groupBy(row).agg(
        F.count(col).alias("_all"),
        *[F.count_if(F.col(col) == F.lit(v)).alias(f"share_{v}") for v in values],
    )
    return wide.select(row, *[(F.col(f"share_{v}") / F.col("_all")).alias(f"share_{v}") for v in values])


def mean_pivot(df: DataFrame, row: str, col: str, values: Sequence, outcome: str) -> DataFrame:
    """Mean outcome per row and listed column value, 0 where there is none."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.avg(outcome)).na.fill(0.0)


def moments(df: DataFrame, by: Sequence[str], value: str, domain: int | None = None) -> DataFrame:
    """Mean, sample deviation and exact median per group."""
    plain = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    middle = ranks.quantiles(df, value, {"median": 0.5}, by, domain)
    return plain.join(middle.drop("n"), list(by))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of each pair over the rows where both are known, as (a, b, r) rows."""
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}")
                   for a, b in pairs])
    cells = []
    for a, b in pairs:
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("r")))
        if a != b:
            cells.append(F.struct(F.lit(b).alias("a"), F.lit(a).alias("b"),
                                  F.col(f"`{a}|{b}`").alias("r")))
    return one.select(F.inline(F.array(*cells)))


def point_counts(df: DataFrame, x: str, y: str) -> DataFrame:
    """A scatter plot's points with how often each occurs."""
    return df.groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))


# --- summaries ----------------------------------------------------------------------
def histogram(df: DataFrame, value: str, n_bins: int) -> DataFrame:
    """Counts and densities of equal-width bins over the value's range, last bin closed."""
    known = df.where(F.col(value).isNotNull())
    span = known.agg(
        F.struct(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"),
                 F.count(value).alias("n"))
    ).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    # a single value gets a unit-wide range around it
    low = F.when(lo == hi, lo - F.lit(0.5)).otherwise(lo)
    high = F.when(lo == hi, hi + F.lit(0.5)).otherwise(hi)
    width = (high - low) / F.lit(float(n_bins))
    counted = (
        known.groupBy(bins.equal_width(F.col(value), low, high, n_bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(
        "bin", (low + F.col("bin") * width).alias("left_edge"), "n",
        (F.col("n") / (span.getField("n") * width)).alias("density"),
    )


def box_summary(df: DataFrame, by: Sequence[str], value: str, domain: int | None = None) -> DataFrame:
    """Quartiles, whiskers at the outermost values within 1.5 IQR, outlier count."""
    known = df.where(F.col(value).isNotNull())
    q = ranks.quantiles(known, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by, domain)
    fenced = q.withColumn("_low", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))).withColumn(
        "_high", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    )
    inside = F.col(value).between(F.col("_low"), F.col("_high"))
    # one row per group: sent to the rows where there are few groups, else joined on the group
    if known.select(*by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS:
        fenced = F.broadcast(fenced)
    return known.join(fenced, list(by)).groupBy(*by).agg(
        F.first("n").alias("n"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"),
        F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count_if(~inside).alias("outliers"),
    )


def quantile_bin_rates(df: DataFrame, value: str, outcome: str, q: int = 5) -> DataFrame:
    """Mean outcome per quantile bin, right-closed, equal edges merged."""
    filled = df.select(F.coalesce(F.col(value), F.lit(0)).cast("double").alias("_x"), outcome)
    probs = {f"_p{i}": i / q for i in range(q + 1)}
    edges = ranks.quantiles(filled, "_x", probs).select(
        F.array_distinct(F.array(*probs)).alias("edges")
    ).scalar()
    # the lowest edge belongs to the first bin
    index = F.greatest(bins.right_closed(F.col("_x"), F.col("_edges")), F.lit(0))
    filled = filled.withColumn("_edges", edges)
    return filled.groupBy(index.alias("bin")).agg(
        F.min("_x").alias("lowest"), F.max("_x").alias("highest"),
        F.avg(outcome).alias("rate"), F.count(F.lit(1)).alias("n"),
    )

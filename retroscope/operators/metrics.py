"""Exact evaluation of (label, score) tables, reduced to distinct scores first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import bins
from retroscope.operators import ranks

# fixed values: the thresholds that are tried, and the edges of the calibration bins
F1_THRESHOLDS = [0.1 + 0.05 * i for i in range(16)]
CALIBRATION_EDGES = [0.1 * i for i in range(1, 10)]


def _by_score(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    return ranks.cumulate(df.where(F.col(label).isNotNull()), score, {
        "pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)
    }, by)


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, ties averaged; .5 where a class is missing."""
    rows = _by_score(df, label, score, by)
    p, n = F.max("pos_total").cast("double"), F.max("neg_total").cast("double")
    won = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return rows.groupBy(*by).agg(
        F.when((p > 0) & (n > 0), won / (p * n)).otherwise(0.5).alias("auc"),
        p.cast("bigint").alias("n_pos"), n.cast("bigint").alias("n_neg"),
    )


def curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and PR points, one per distinct score used as "at least" threshold."""
    tp = F.col("pos_total") - F.col("pos_before")
    fp = F.col("neg_total") - F.col("neg_before")
    return _by_score(df, label, score, by).select(
        *by, F.col(score).alias("threshold"), tp.alias("tp"), fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        (tp / F.nullif("pos_total", F.lit(0))).alias("recall"),
        (fp / F.nullif("neg_total", F.lit(0))).alias("fpr"), "pos",
    )


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    points = curve(df, label, score, by)
    total = F.sum("pos")
    return points.groupBy(*by).agg(
        (F.sum(F.col("pos") * F.col("precision")) / F.nullif(total, F.lit(0))).alias("average_precision")
    )


def calibration(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mean score and share of positives per tenth, right-closed; empty bins do not appear."""
    return df.groupBy(bins.steps_passed(F.col(score), CALIBRATION_EDGES, strict=True).alias("bin")).agg(
        F.avg(score).alias("mean_score"), F.avg(label).alias("positive_share"), F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then macro and weighted rows, accuracy."""
    cells = df.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("n"))
    hit = F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0)
    # classes by classes cells from here on
    sides = cells.select(F.inline(F.array(
        F.struct(F.col(label).alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col(predicted).alias("class"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("said")),
    )))
    per = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("said").alias("said"))
    precision = F.coalesce(F.col("tp") / F.nullif("said", F.lit(0)), F.lit(0.0))
    recall = F.coalesce(F.col("tp") / F.nullif("support", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("said") + F.col("support"), F.lit(0)), F.lit(0.0))
    classes = per.select(F.col("class").cast("string").alias("class"), precision.alias("precision"),
                         recall.alias("recall"), f1.alias("f1"), "support", "tp")

    def weighted(c: str) -> Column:
        return (F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c)

    macro = classes.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
                        F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    mean = classes.agg(weighted("precision"), weighted("recall"), weighted("f1"), F.sum("support").alias("support"))
    accuracy = (F.sum("tp") / F.sum("support"))
    whole = classes.agg(accuracy.alias("precision"), accuracy.alias("recall"), accuracy.alias("f1"), F.sum("support").alias("support"))

    def named(f: DataFrame, name: str) -> DataFrame:
        return f.select(F.lit(name).alias("class"), "precision", "recall", "f1", "support")

    return (classes.drop("tp").unionByName(named(macro, "macro avg"))
            .unionByName(named(mean, "weighted avg")).unionByName(named(whole, "accuracy")))


def f1_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = F1_THRESHOLDS) -> DataFrame:
    """F1 of "score at least t" per threshold. Rows reduce to how many thresholds they pass."""
    passed = df.groupBy(bins.steps_passed(F.col(score), thresholds).alias("passed")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    listed = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(t).alias("threshold")) for i, t in enumerate(thresholds, 1)])
    grid = passed.select("passed", "pos", "n", F.inline(listed))
    reached = F.col("passed") >= F.col("step")
    per = grid.groupBy("step", "threshold").agg(
        F.sum(F.when(reached, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(reached, F.col("n")).otherwise(0)).alias("said"), F.sum("pos").alias("real"),
    )
    f1 = 2 * F.col("tp") / F.nullif(F.col("said") + F.col("real"), F.lit(0))
    return per.select("threshold", F.coalesce(f1, F.lit(0.0)).alias("f1"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """First threshold with the highest F1; .5 if all are 0."""
    best = sweep.orderBy(F.desc("f1"), "threshold").limit(1)
    return best.select(F.when(F.col("f1") > 0, F.col("threshold")).otherwise(0.5).alias("threshold"), "f1")


def high_low(df: DataFrame, value: str, out: str) -> DataFrame:
    """1 where the value reaches the median of the whole table."""
    middle = ranks.quantiles(df, value, {"m": 0.5}).select("m").scalar()
    return df.withColumn(out, (F.col(value) >= middle).cast("int"))


def cumulative_shares(df: DataFrame, order: str, share: str) -> DataFrame:
    run = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumulative", F.sum(share).over(run))

"""Test statistics as aggregations.

Every test reduces the data to a bounded table first (contingency cells, distinct values
with counts, sufficient statistics); tail probabilities are computed on the result rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.functions import tails
from retroscope.operators import ranks, resample
from retroscope.operators.relational import crosstab, few_values, vector_sum
from retroscope.session import cut_lineage


# --- contingency --------------------------------------------------------------------
def chi_square(df: DataFrame, row: str, col: str, by: Sequence[str] = (), p_value: bool = True,
               min_n: int = 0) -> DataFrame:
    """Independence test and Cramer's V per group; Yates' correction where dof is 1.

    Empty cells need no rows of their own: the statistic is n * (sum o^2 / (R C) - 1).
    """
    by = list(by)
    cells = crosstab(df.where(F.col(row).isNotNull() & F.col(col).isNotNull()), row, col, by)
    return chi_square_of_cells(cells, row, col, by, p_value, min_n)


def chi_square_of_cells(cells: DataFrame, row: str, col: str, by: Sequence[str] = (),
                        p_value: bool = True, min_n: int = 0) -> DataFrame:
    """The same from (by, row, col, n) cell counts."""
    by = list(by)
    whole = Window.partitionBy(*by)
    o = F.col("n").cast("double")
    marked = cells.select(
        *by, row, col, o.alias("o"),
        F.sum(o).over(Window.partitionBy(*by, row)).alias("r"),
        F.sum(o).over(Window.partitionBy(*by, col)).alias("c"),
        F.sum(o).over(whole).alias("total"),
    )
    e = F.col("r") * F.col("c") / F.col("total")
    # the two row margins of a 2x2 table are r and total - r, so every cell knows them all
    inverse_margins = (
        (1 / F.col("r") + 1 / (F.col("total") - F.col("r")))
        * (1 / F.col("c") + 1 / (F.col("total") - F.col("c")))
        * F.col("total")
    )
    gap = F.abs(F.col("o") - e)
    two_by_two = F.when(
        (F.col("total") > F.col("r")) & (F.col("total") > F.col("c")),
        F.pow(gap - F.least(gap, F.lit(0.5)), F.lit(2)) * inverse_margins,
    )
    agg = marked.groupBy(*by).agg(
        F.count_distinct(row).alias("_rows"), F.count_distinct(col).alias("_cols"),
        F.max("total").alias("_n"),
        F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("_ss"),
        F.max(two_by_two).alias("_yates"),
    )
    dof = ((F.col("_rows") - 1) * (F.col("_cols") - 1)).cast("int")
    plain = F.greatest(F.col("_n") * (F.col("_ss") - 1), F.lit(0.0))
    chi2 = F.when(dof == 1, F.col("_yates")).otherwise(plain)
    out = agg.select(*by, F.col("_n").cast("bigint").alias("n"), dof.alias("dof"),
                     F.when(dof > 0, chi2).alias("chi2"),
                     F.least("_rows", "_cols").alias("_k"))
    out = out.withColumn(
        "cramers_v", F.when(F.col("dof") > 0, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("_k") - 1))))
    ).drop("_k")
    if min_n:
        out = out.where(F.col("n") >= min_n)
    return out.withColumn("p_value", tails.chi2_p(F.col("chi2"), F.col("dof"))) if p_value else out


def cells_2x2(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Counts of (1,1), (1,0), (0,1), (0,0)."""
    def cell(x: int, y: int, name: str) -> Column:
        return F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(name)
    return df.groupBy(*by).agg(cell(1, 1, "n11"), cell(1, 0, "n10"), cell(0, 1, "n01"),
                               cell(0, 0, "n00"))


def fisher_exact(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Two-sided exact test of a 2x2 table, rows a=0 then a=1, columns b=0 then b=1."""
    counted = cells_2x2(df, a, b, by)
    test = tails.fisher(F.col("n00"), F.col("n01"), F.col("n10"), F.col("n11"))
    return counted.withColumn("_t", test).select("*", "_t.*").drop("_t")


def mcnemar(df: DataFrame, a: str, b: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Continuity-corrected test of paired binary outcomes."""
    off = F.col("n10") + F.col("n01")
    chi2 = F.when(
        off > 0, F.pow(F.abs(F.col("n10") - F.col("n01")) - F.lit(1.0), F.lit(2)) / off
    ).otherwise(0.0)
    out = cells_2x2(df, a, b, by).withColumn("chi2", chi2)
    if not p_value:
        return out
    p = F.when(off > 0, tails.chi2_p(F.col("chi2"), F.lit(1))).otherwise(1.0)
    return out.withColumn("p_value", p)


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    """Agreement, Cohen's kappa (0 unless both labels occur on both sides), confusion
    cells, the two rates and the one-sided disagreements."""
    counted = cells_2x2(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, b, by)
    n = (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).cast("double")
    a1, b1 = F.col("n11") + F.col("n10"), F.col("n11") + F.col("n01")
    observed = (F.col("n11") + F.col("n00")) / n
    expected = (a1 / n) * (b1 / n) + ((n - a1) / n) * ((n - b1) / n)
    both = (a1 > 0) & (a1 < n) & (b1 > 0) & (b1 < n)
    kappa = F.when(both & (expected < 1), (observed - expected) / (1 - expected)).otherwise(0.0)
    return counted.select(
        *by, n.cast("bigint").alias("n"), observed.alias("agreement"), kappa.alias("kappa"),
        "n00", "n01", "n10", "n11",
        (b1 / n).alias("rate_b"), (a1 / n).alias("rate_a"),
        F.col("n10").alias("only_a"), F.col("n01").alias("only_b"),
    )


# --- ranks --------------------------------------------------------------------------
def mann_whitney(df: DataFrame, value: str, label: str, first=0, second=1,
                 domain: int | None = None, p_value: bool = True,
                 single: int = ranks.SINGLE_WINDOW_ROWS) -> DataFrame:
    """U of the ``first`` group, two-sided, tie-corrected normal approximation with
    continuity; effect size 1 - 2U / (n1 n2); group means."""
    rows = ranks.cumulate(
        df.where(F.col(label).isin(first, second)), value,
        {"n": F.count(F.lit(1)), "n1": F.count_if(F.col(label) == F.lit(first))},
        domain=domain, single=single,
    )
    t = F.col("n").cast("double")
    agg = rows.agg(
        F.sum(F.col("n1") * ranks.midrank()).alias("_r1"),
        F.max("n1_total").cast("double").alias("_n1"),
        F.max("n_total").cast("double").alias("_n"),
        F.sum(t * t * t - t).alias("_ties"),
    )
    n1, n = F.col("_n1"), F.col("_n")
    n2 = n - n1
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("_ties") / (n * (n - 1))))
    z = F.greatest(F.abs(u - n1 * n2 / 2) - F.lit(0.5), F.lit(0.0)) / F.nullif(spread, F.lit(0.0))
    out = agg.select(
        u.alias("u"), z.alias("z"), (1 - 2 * u / (n1 * n2)).alias("effect"),
        n1.cast("bigint").alias("n_first"), n2.cast("bigint").alias("n_second"),
    )
    return out.withColumn("p_value", tails.normal_p(F.col("z"))) if p_value else out


def kruskal(df: DataFrame, value: str, group: str, groups: Sequence | None = None,
            domain: int | None = None, p_value: bool = True,
            single: int = ranks.SINGLE_WINDOW_ROWS) -> DataFrame:
    """Tie-corrected H over the groups (categories, discovered where not listed)."""
    if groups is None:
        groups = few_values(df, group)
    counts = {f"g{i}": F.count_if(F.col(group) == F.lit(g)) for i, g in enumerate(groups)}
    rows = ranks.cumulate(
        df.where(F.col(group).isNotNull()), value, {"n": F.count(F.lit(1)), **counts},
        domain=domain, single=single,
    )
    t = F.col("n").cast("double")
    agg = rows.agg(
        F.max("n_total").cast("double").alias("_n"), F.sum(t * t * t - t).alias("_ties"),
        *[F.sum(F.col(g) * ranks.midrank()).alias(f"_r_{g}") for g in counts],
        *[F.max(f"{g}_total").cast("double").alias(f"_n_{g}") for g in counts],
    )
    n = F.col("_n")
    parts = [F.when(F.col(f"_n_{g}") > 0, F.pow(f"_r_{g}", F.lit(2)) / F.col(f"_n_{g}")).otherwise(0.0)
             for g in counts]
    raw = F.lit(12.0) / (n * (n + 1)) * reduce(lambda a, b: a + b, parts) - 3 * (n + 1)
    fix = 1 - F.col("_ties") / (n * n * n - n)
    out = agg.select((raw / F.nullif(fix, F.lit(0.0))).alias("h"), F.lit(len(counts) - 1).alias("dof"),
                     n.cast("bigint").alias("n"))
    return out.withColumn("p_value", tails.chi2_p(F.col("h"), F.col("dof"))) if p_value else out


def point_biserial(df: DataFrame, features: Sequence[str], outcome: str, min_rows: int = 21,
                   p_value: bool = True) -> DataFrame:
    """r of each feature with a 0/1 outcome over complete pairs; null below ``min_rows``."""
    y = F.col(outcome).cast("double")
    one = df.agg(*[
        F.struct(
            F.lit(f).alias("feature"),
            F.corr(F.col(f).cast("double"), y).alias("r"),
            F.count_if(F.col(f).isNotNull() & y.isNotNull()).alias("n"),
        ).alias(f"_{i}") for i, f in enumerate(features)
    ])
    rows = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    rows = rows.withColumn("r", F.when(F.col("n") >= min_rows, F.col("r")))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0)))
    rows = rows.withColumn("t", t)
    return rows.withColumn("p_value", tails.t_p(F.col("t"), F.col("n") - 2)) if p_value else rows


# --- group comparisons --------------------------------------------------------------
def mean_difference(df: DataFrame, features: Sequence[str], treated: str) -> DataFrame:
    """Standardised mean difference of treated (1) and control (0), population variances."""
    def side(f: str, v: int) -> Column:
        return F.when(F.col(treated) == v, F.coalesce(F.col(f), F.lit(0)).cast("double"))

    one = df.agg(*[
        F.struct(
            F.lit(f).alias("feature"), F.avg(side(f, 1)).alias("m1"), F.avg(side(f, 0)).alias("m0"),
            F.var_pop(side(f, 1)).alias("v1"), F.var_pop(side(f, 0)).alias("v0"),
        ).alias(f"_{i}") for i, f in enumerate(features)
    ])
    rows = one.select(F.inline(F.array(*[F.col(f"_{i}") for i in range(len(features))])))
    pooled = F.greatest(F.sqrt((F.col("v1") + F.col("v0")) / 2), F.lit(1e-10))
    return rows.select("feature", ((F.col("m1") - F.col("m0")) / pooled).alias("smd"))


def two_group_report(df: DataFrame, flag: str, outcome: str) -> DataFrame:
    """Rates and sizes of both sides of a flag with Fisher's odds ratio and p."""
    test = fisher_exact(df, flag, outcome)
    n1 = F.col("n11") + F.col("n10")
    n0 = F.col("n01") + F.col("n00")
    return test.select(
        (F.col("n11") / n1).alias("rate_in"), n1.alias("n_in"),
        (F.col("n01") / n0).alias("rate_out"), n0.alias("n_out"), "odds_ratio", "p_value",
    )


def two_group_intervals(df: DataFrame, flag: str, outcome: str, key: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """(side, rate, n, ci_lower, ci_upper): the rates of the report, each with its bootstrap interval."""
    sided = df.where(F.col(flag).isNotNull()).withColumn("side", F.when(F.col(flag) == 1, "in").otherwise("out"))
    return resample.rate_interval(sided, "side", key, outcome, reps, seed)


def two_group_nested(df: DataFrame, flag: str, outcome: str, inner: str, more_than: int = 20) -> DataFrame:
    """Rates and sizes of both sides inside each value of ``inner`` with more than so many rows; no rate where a side is empty."""
    cells = cells_2x2(df, flag, outcome, [inner])
    n1, n0 = F.col("n11") + F.col("n10"), F.col("n01") + F.col("n00")
    return cells.where(n1 + n0 > more_than).select(
        inner, (F.col("n11") / F.nullif(n1, F.lit(0))).alias("rate_in"), n1.alias("n_in"),
        (F.col("n01") / F.nullif(n0, F.lit(0))).alias("rate_out"), n0.alias("n_out"))


# --- logistic models ----------------------------------------------------------------
def notable(df: DataFrame, order: Sequence, p: str = "p_value", level: float = 0.1, otherwise: int = 10, most: int = 15) -> DataFrame:
    """The rows of a result table to show: those below the level, or the first ``otherwise`` where none
    is; never more than ``most``, in the given order."""
    hits = df.where(F.col(p) < level)
    return df.orderBy(*order).limit(min(otherwise, most)) if hits.isEmpty() else hits.orderBy(*order).limit(most)


def dummies(df: DataFrame, col: str, prefix: str, values: Sequence | None = None) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all but the first value in sorted order."""
    if values is None:
        values = few_values(df, col)
    names = []
    for v in list(values)[1:]:
        name = f"{prefix}_{v}"
        df = df.withColumn(name, (F.col(col) == F.lit(v)).cast("double"))
        names.append(name)
    return df, names


def interactions(df: DataFrame, base: str, others: Sequence[str], prefix: str) -> tuple[DataFrame, list[str]]:
    names = []
    for o in others:
        df = df.withColumn(f"{prefix}_{o}", F.col(base) * F.col(o))
        names.append(f"{prefix}_{o}")
    return df, names


TINY = 1e-9  # share of a column's spread that must be left once the columns before it are taken out
APART = 0.1  # movement of a row's predictor under one more step, from which the row counts as told apart


def _design(df: DataFrame, outcome: str, names: Sequence[str]) -> DataFrame:
    """(y, x): complete rows, x an array in the order of the names."""
    rows = df.select(F.col(outcome).cast("double").alias("y"), *[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(names)]).na.drop()
    return rows.select("y", F.array(*[f"x{i}" for i in range(len(names))]).cast("array<double>").alias("x"))


def _row_sums(rows: DataFrame, p: int, sums, width: int, least: bool = False) -> np.ndarray:
    """One pass: ``sums(y, x)`` of ``width`` numbers per batch, added up in the task and then across tasks;
    with ``least`` the smallest of each instead."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.full(width, np.inf) if least else np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, p)
                part = sums(b.column(0).to_numpy(), x)
                total = np.minimum(total, part) if least else total + part
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    parts = rows.mapInArrow(partial, "v array<double>")
    if least:
        found = parts.agg(*[F.min(F.get("v", F.lit(i))) for i in range(width)]).first()
        return np.array(found, float)
    return np.array(parts.agg(vector_sum("v")).first()["v"], float)


def independent_columns(gram: np.ndarray) -> list[str]:
    """Per column of a design, from its Gram matrix with the constant first: ``kept``, or ``constant`` or
    ``collinear`` where it adds nothing to the constant and the kept columns before it. A Cholesky
    factorisation in the order of the columns that passes over pivots without a rest."""
    n = gram[0, 0]
    centred = gram[1:, 1:] - np.outer(gram[1:, 0], gram[0, 1:]) / max(n, 1)
    size = np.diag(gram)[1:]
    rest, out = centred.copy(), []
    for j in range(len(centred)):
        if centred[j, j] <= TINY * max(size[j], 1e-300):
            out.append("constant")
        elif rest[j, j] <= TINY * centred[j, j]:
            out.append("collinear")
        else:
            out.append("kept")
            rest = rest - np.outer(rest[:, j], rest[j]) / rest[j, j]
    return out


def _gram(rows: DataFrame, p: int) -> np.ndarray:
    def sums(y, x):
        wide = np.hstack([np.ones((len(x), 1)), x, y[:, None]])
        return (wide.T @ wide).ravel()

    return _row_sums(rows, p, sums, (p + 2) ** 2).reshape(p + 2, p + 2)


def _logit_sums(beta: np.ndarray, keep: np.ndarray, mean: np.ndarray, std: np.ndarray):
    """Log-likelihood, score and information at ``beta``, for the constant and the scaled kept columns."""
    def sums(y, x):
        z = np.hstack([np.ones((len(x), 1)), (x[:, keep] - mean) / std])
        eta = z @ beta
        chance = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
        weight = chance * (1 - chance)
        return np.concatenate([[(y * eta - np.logaddexp(0, eta)).sum()], z.T @ (y - chance), ((z * weight[:, None]).T @ z).ravel()])

    return sums


def _maximise(rows: DataFrame, p: int, keep: list[int], gram: np.ndarray, max_iter: int, tol: float) -> dict:
    """Newton's method on scaled columns, halving steps that lower the likelihood. ``step`` is the step
    that would come next: it vanishes at a maximum, and goes on where the likelihood has none."""
    n = gram[0, 0]
    mean = gram[0, 1:-1][keep] / n
    std = np.sqrt(np.diag(gram)[1:-1][keep] / n - mean ** 2)
    q = len(keep) + 1
    beta, step, last, converged = np.zeros(q), np.zeros(q), -np.inf, False
    for passes in range(1, max_iter + 1):
        found = _row_sums(rows, p, _logit_sums(beta, keep, mean, std), 1 + q + q * q)
        if found[0] < last - 1e-9 * abs(last):
            step = step / 2
            beta = beta - step
            continue
        score, info = found[1:q + 1], found[q + 1:].reshape(q, q)
        # without a maximum the likelihood creeps up by a factor a pass: a small gain of it ends the passes too
        converged = bool(abs(found[0] - last) <= tol * (abs(found[0]) + tol))
        last, step = found[0], np.linalg.pinv(info) @ score
        if converged:
            break
        beta = beta + step
    return {"llf": float(last), "beta": beta, "step": step, "score": score, "info": info, "mean": mean, "std": std, "passes": passes, "converged": converged}


def _told_apart(rows: DataFrame, p: int, keep: list[int], fit: dict):
    """(y, x) rows that the next step does not move, or None if it is no proof of separation.

    Along a direction that puts no row on its wrong side the likelihood rises for ever. The next step is
    such a direction if it moves each row to the side of its outcome or not at all.
    """
    step, mean, std = fit["step"], fit["mean"], fit["std"]

    def move(y, x):
        return np.where(y > 0.5, 1, -1) * (step[0] + ((x[:, keep] - mean) / std) @ step[1:])

    low, high = _row_sums(rows, p, lambda y, x: np.array([(m := move(y, x)).min(), -m.max()]), 2, least=True) * [1, -1]
    if not (high >= APART and low >= -APART * 0.1):
        return None

    def still(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, p)
                yield b.filter(pa.array(move(b.column(0).to_numpy(), x) < APART))

    return rows.mapInArrow(still, "y double, x array<double>")


def fit_logit(df: DataFrame, outcome: str, features: Sequence[str], max_iter: int = 60, tol: float = 1e-10) -> dict:
    """Maximum-likelihood logit with inference: a dict of fit figures and a coefficient list.

    Columns that the constant and earlier columns give already are found before the fit, from the Gram
    matrix, and left out (``constant``, ``collinear``). Where columns tell outcomes apart, the likelihood
    has no maximum: the rows that are told apart have probability one in the limit, terms that only they
    can tell are ``separated``, without a finite coefficient, and the others get the maximum over the rows
    that remain. ``status`` of every other term is ``estimated``; ``score`` is the likelihood's slope at the
    estimate over those rows. ``params`` counts the constant, estimated and separated terms. Complete rows
    only. Each pass sends one vector of sums per task.
    """
    names = list(features)
    p = len(names)
    rows = _design(df, outcome, names).persist()
    whole = rows
    try:
        gram = _gram(rows, p)
        n, hits = float(gram[0, 0]), float(gram[0, -1])
        status = independent_columns(gram[:-1, :-1])
        rank = 1 + status.count("kept")
        for _ in range(p + 1):
            keep = [j for j, s in enumerate(status) if s == "kept"]
            if gram[0, 0] == 0 or gram[0, -1] in (0, gram[0, 0]):  # one outcome only: nothing left to tell
                fit = None
                status = ["separated" if s == "kept" else s for s in status]
                break
            fit = _maximise(rows, p, keep, gram, max_iter, tol)
            rest = _told_apart(rows, p, keep, fit) if np.abs(fit["step"]).max() > 1e-4 else None
            if rest is None:
                break
            # each round starts from a written part of the rows, so plans do not pile up
            rows = cut_lineage(rest)
            gram = _gram(rows, p)
            # in the order of the names; a column these rows no longer need was told by the others
            left = independent_columns(gram[:-1, :-1][np.ix_([0, *[j + 1 for j in keep]], [0, *[j + 1 for j in keep]])])
            for j, s in zip(keep, left):
                if s != "kept":
                    status[j] = "separated"
        else:
            fit["converged"] = False
        share = hits / n if n else 0.5
        null = n * (share * math.log(share) + (1 - share) * math.log(1 - share)) if 0 < share < 1 else 0.0
        llf = fit["llf"] if fit else 0.0
        return {
            "n": int(n), "params": rank, "llf": llf, "aic": 2 * rank - 2 * llf, "pseudo_r2": 1 - llf / null if null else 0.0,
            "converged": bool(fit is None or fit["converged"]), "passes": fit["passes"] if fit else 0, "terms": _logit_terms(names, status, fit),
        }
    finally:
        whole.unpersist()


def _logit_terms(names: list[str], status: list[str], fit: dict | None) -> list[dict]:
    out = {name: {"term": name, "status": s, "coef": None, "se": None, "odds_ratio": None, "ci_lower": None, "ci_upper": None, "p_value": None,
                  "score": None} for name, s in [*zip(names, status), ("const", "estimated" if fit else "separated")]}
    if fit:
        kept = [n for n, s in zip(names, status) if s == "kept"]
        # from scaled columns back to the given ones
        back = np.diag([1.0, *1 / fit["std"]])
        back[0, 1:] = -fit["mean"] / fit["std"]
        cov = back @ np.linalg.pinv(fit["info"]) @ back.T
        score = [fit["score"][0], *(fit["score"][1:] * fit["std"] + fit["mean"] * fit["score"][0])]
        for name, b, se, g in zip(["const", *kept], back @ fit["beta"], np.sqrt(np.maximum(np.diag(cov), 0)), score):
            reach = 1.959963984540054 * se
            out[name].update(status="estimated", coef=float(b), se=float(se), odds_ratio=_exp(b), ci_lower=float(b - reach), ci_upper=float(b + reach),
                             p_value=float(tails.normal_two_sided(b / se)) if se > 0 else None, score=float(g))
    return list(out.values())


def _exp(b: float) -> float:
    return math.exp(min(float(b), 700.0))


def logit_score(df: DataFrame, outcome: str, beta: dict[str, float]) -> DataFrame:
    """(term, score, llf, n): log-likelihood and its slope at stated coefficients; ``const`` is the constant."""
    names = [f for f in beta if f != "const"]
    rows, p = _design(df, outcome, names), len(names)
    at = np.array([beta.get("const", 0.0), *[beta[f] for f in names]])
    found = _row_sums(rows, p, _logit_sums(at, np.arange(p), np.zeros(p), np.ones(p)), 1 + (p + 1) + (p + 1) ** 2)
    n = int(round(_gram(rows, p)[0, 0]))
    return df.sparkSession.createDataFrame([(t, float(g), float(found[0]), n) for t, g in zip(["const", *names], found[1:p + 2])],
                                           "term string, score double, llf double, n long")


def likelihood_ratio(small: dict, large: dict) -> dict:
    """Twice the gain in likelihood against the added parameters; no p value where none is added."""
    stat = 2 * (large["llf"] - small["llf"])
    dof = large["params"] - small["params"]
    return {"lr": stat, "dof": dof, "p_value": tails.chi2_tail(max(stat, 0.0), dof) if dof > 0 else None}


def logit_table(spark, fits: dict[str, dict]) -> DataFrame:
    """Coefficients of named fits as rows."""
    rows = [
        (name, fit["n"], fit["pseudo_r2"], fit["aic"], fit["llf"], t["term"], t["coef"], t["se"],
         t["odds_ratio"], t["ci_lower"], t["ci_upper"], t["p_value"], t["status"], t["score"], fit["converged"])
        for name, fit in fits.items() for t in fit["terms"]
    ]
    return spark.createDataFrame(
        rows, "model string, n long, pseudo_r2 double, aic double, llf double, term string, "
              "coef double, se double, odds_ratio double, ci_lower double, ci_upper double, "
              "p_value double, status string, score double, converged boolean")


def coefficient_stability(table: DataFrame, terms: Sequence[str], models: Sequence[str]) -> DataFrame:
    """Odds ratio of the same terms across models, one column per model."""
    return (
        table.where(F.col("term").isin(list(terms)))
        .groupBy("term").pivot("model", list(models)).agg(F.first("odds_ratio"))
    )

"""Survival analysis on (time, event) rows.

Everything reduces to one row per distinct time first; running sums over times go in two passes over
segments of the time range, so however many times there are, no task sees them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.functions import tails
from retroscope.operators import ranks
from retroscope.operators.relational import few_values, vector_sum

# distinct times of a segment: the running sums of a curve or a risk set never span more in one window or pass
SEGMENT = 1_024
# distinct times a task keeps sums for before it hands them on, and of one bucket of risk sums
TIMES = 20_000
MAX_BUCKETS = 1_024
# deaths of one time that are added one by one; more go through closed forms
DIRECT = 64
# digits of a time's rank: a level of the concordance merge tells so many parts of a block apart
FAN = 8


def kaplan_meier(df: DataFrame, time: str, event: str, by: Sequence[str] = (),
                 domain: int | None = None, min_n: int = 0, segment: int = SEGMENT) -> DataFrame:
    """Survival curve per group: time, at risk, events, estimate. Groups below ``min_n`` drop out.

    At-risk counts and the product of the steps are both taken in two passes over segments of the time
    range (``ranks.scan``): products of whole segments first, then the steps inside each.
    """
    rows = ranks.cumulate(
        df, time, {"n": F.count(F.lit(1)), "d": F.sum(F.col(event).cast("bigint"))}, by, domain, segment if domain else ranks.SINGLE_WINDOW_ROWS
    )
    at_risk = F.col("n_total") - F.col("n_before")
    # one row per distinct time from here on
    left = F.lit(1.0) - F.col("d") / at_risk
    steps = rows.select(
        *by, time, at_risk.alias("at_risk"), F.col("d").alias("events"), F.col("n_total").alias("n"),
        F.when(left > 0, F.ln(left)).otherwise(0.0).alias("log_step"), (left <= 0).cast("int").alias("last"))
    if domain:
        bounds = list(range(segment, domain, segment))
    else:
        bounds = ranks.bucket_bounds(steps, time, single=segment)
    product = ranks.scan(steps, time, ["log_step", "last"], by, bounds).select(
        *by, time, F.when(F.col("last_before") + F.col("last") > 0, 0.0).otherwise(F.exp(F.col("log_step_before") + F.col("log_step"))).alias("survival"))
    out = steps.select(*by, time, "at_risk", "events", "n").join(product, [*by, time])
    return out.where(F.col("n") >= min_n) if min_n else out


def curve_summary(df: DataFrame, time: str, event: str, by: str, domain: int | None = None,
                  min_n: int = 10) -> DataFrame:
    """Size, median time of the sample and event rate per group."""
    middle = ranks.quantiles(df, time, {"median_time": 0.5}, [by], domain)
    rate = df.where(F.col(time).isNotNull()).groupBy(by).agg(F.avg(event).alias("event_rate"))
    return middle.join(rate, by).where(F.col("n") >= min_n)


def log_rank_pairs(df: DataFrame, time: str, event: str, group: str, groups: Sequence | None = None,
                   domain: int | None = None, p_value: bool = True) -> DataFrame:
    """Two-group log-rank test of every pair of groups, from one pass over the data."""
    if groups is None:
        groups = few_values(df, group, 50)
    measures: dict[str, Column] = {}
    for i, g in enumerate(groups):
        own = F.col(group) == F.lit(g)
        measures[f"n{i}"] = F.count_if(own)
        measures[f"d{i}"] = F.count_if(own & (F.col(event) == 1))
    rows = ranks.cumulate(df.where(F.col(group).isin(list(groups))), time, measures, domain=domain)
    sums, cells = [], []
    for (i, a), (j, b) in combinations(enumerate(groups), 2):
        n1 = (F.col(f"n{i}_total") - F.col(f"n{i}_before")).cast("double")
        n2 = (F.col(f"n{j}_total") - F.col(f"n{j}_before")).cast("double")
        n = n1 + n2
        d = (F.col(f"d{i}") + F.col(f"d{j}")).cast("double")
        gap = F.when(n > 0, F.col(f"d{i}") - d * n1 / n)
        spread = F.when(n > 1, n1 * n2 * d * (n - d) / (n * n * (n - 1)))
        sums += [F.sum(gap).alias(f"_g{i}_{j}"), F.sum(spread).alias(f"_v{i}_{j}")]
        stat = F.pow(F.col(f"_g{i}_{j}"), F.lit(2)) / F.nullif(F.col(f"_v{i}_{j}"), F.lit(0.0))
        cells.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), stat.alias("chi2")))
    out = rows.agg(*sums).select(F.inline(F.array(*cells)))
    return out.withColumn("p_value", tails.chi2_p(F.col("chi2"), F.lit(1))) if p_value else out


# --- proportional hazards -----------------------------------------------------------
# fixed values: coefficients of the usual asymptotic series, Bernoulli numbers over their orders
_LOG_GAMMA = [1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360]
_DIGAMMA = [1 / 12, -1 / 120, 1 / 252, -1 / 240, 1 / 132, -691 / 32760]
_TRIGAMMA = [1 / 6, -1 / 30, 1 / 42, -1 / 30, 5 / 66, -691 / 2730]
_BERNOULLI = {0: 1.0, 1: -1 / 2, 2: 1 / 6, 4: -1 / 30, 6: 1 / 42, 8: -1 / 30, 10: 5 / 66, 12: -691 / 2730, 14: 7 / 6, 16: -3617 / 510, 18: 43867 / 798}
SMALL_SHARE, SERIES = 0.1, 17


def _gammas(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log gamma, digamma and trigamma of x >= 1: ten steps up, then the asymptotic series."""
    step = np.arange(10)[:, None]
    low_log, low_one, low_two = np.log(x + step).sum(axis=0), (1 / (x + step)).sum(axis=0), (1 / (x + step) ** 2).sum(axis=0)
    y = x + 10
    odd = [y ** -(2 * k + 1) for k in range(6)]
    log_gamma = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + sum(c * o for c, o in zip(_LOG_GAMMA, odd))
    digamma = np.log(y) - 0.5 / y - sum(c * o / y for c, o in zip(_DIGAMMA, odd))
    trigamma = 1 / y + 0.5 / y ** 2 + sum(c * o / y ** 2 for c, o in zip(_TRIGAMMA, odd))
    return log_gamma - low_log, digamma - low_one, trigamma + low_two


def _powers(m: np.ndarray, top: int) -> list[np.ndarray]:
    """Sums of (l / m)^j over l < m, for j up to ``top``."""
    return [sum(math.comb(j + 1, k) * _BERNOULLI[k] * m ** (1.0 - k) for k in range(j + 1) if k in _BERNOULLI) / (j + 1) for j in range(top + 1)]


def efron_sums(s: np.ndarray, d: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Per time, with w = s - d l / m over l < m: the sums of ln w, 1/w, (l/m)/w, 1/w^2, (l/m)/w^2 and
    (l/m)^2/w^2. Constant work per time: up to DIRECT terms are added, more deaths go through differences
    of log gamma, digamma and trigamma, or where they are a small share of the risk set through a power
    series in d / s, whose coefficients are sums of powers."""
    out = np.empty((6, len(m)))
    few = m <= DIRECT
    if few.any():
        share = np.arange(DIRECT)[None, :] / m[few, None]
        there = share < 1
        w = np.where(there, s[few, None] - share * d[few, None], 1.0)
        inv = there / w
        out[:, few] = [np.log(w).sum(axis=1), inv.sum(axis=1), (share * inv).sum(axis=1), (inv ** 2).sum(axis=1),
                       (share * inv ** 2).sum(axis=1), (share ** 2 * inv ** 2).sum(axis=1)]
    t = np.minimum(d / s, 1.0)
    thin = ~few & (t <= SMALL_SHARE)
    if thin.any():
        x, one = t[thin], s[thin]
        power = _powers(m[thin].astype(float), SERIES + 2)
        def series(weight, shift):
            return sum(weight(k) * x ** k * power[k + shift] for k in range(SERIES + 1))
        out[:, thin] = [m[thin] * np.log(one) - sum(x ** k * power[k] / k for k in range(1, SERIES + 1)), series(lambda k: 1, 0) / one, series(lambda k: 1, 1) / one,
                        series(lambda k: k + 1, 0) / one ** 2, series(lambda k: k + 1, 1) / one ** 2, series(lambda k: k + 1, 2) / one ** 2]
    wide = ~few & ~thin
    if wide.any():
        n, c = m[wide].astype(float), d[wide] / m[wide]
        r = n / t[wide]
        (log_hi, di_hi, tri_hi), (log_lo, di_lo, tri_lo) = _gammas(r + 1), _gammas(r - n + 1)
        one, two = di_hi - di_lo, tri_lo - tri_hi
        out[:, wide] = [n * np.log(c) + log_hi - log_lo, one / c, (r * one - n) / (n * c), two / c ** 2,
                        (r * two - one) / (n * c ** 2), (r * r * two - 2 * r * one + n) / (n * c) ** 2]
    return out


def _contributions(v: np.ndarray, risk: np.ndarray, p: int) -> np.ndarray:
    """Log-likelihood, gradient and information summed over times, flat. ``v``: sums of a time as
    ``_per_time_sums`` gives them, ``risk``: sums over its risk set."""
    q = 1 + p + p * (p + 1) // 2
    deaths = np.rint(v[:, 2 * q + p]).astype(np.int64)
    v, risk, deaths = v[deaths > 0], risk[deaths > 0], deaths[deaths > 0]
    if not len(v):
        return np.zeros(1 + p + p * p)
    d, x = v[:, q:2 * q], v[:, 2 * q:2 * q + p]
    log_sum, a, b, a2, b2, c2 = efron_sums(risk[:, 0], d[:, 0], deaths)
    s1, d1 = risk[:, 1:p + 1], d[:, 1:p + 1]
    upper = np.triu_indices(p)
    square = np.zeros((p, p))
    square[upper] = a @ risk[:, p + 1:] - b @ d[:, p + 1:]
    square += np.triu(square, 1).T
    cross = (s1 * b2[:, None]).T @ d1
    info = square - ((s1 * a2[:, None]).T @ s1 - cross - cross.T + (d1 * c2[:, None]).T @ d1)
    gradient = x.sum(axis=0) - (a @ s1 - b @ d1)
    return np.concatenate([[v[:, 2 * q + p + 1].sum() - log_sum.sum()], gradient, info.ravel()])


def _per_time_sums(data: DataFrame, names: Sequence[str], beta: np.ndarray, mean, std, bounds: Sequence[float]) -> DataFrame:
    """(bucket, time, v): vector sums per distinct time, combined inside each task first."""
    p = len(names)
    rows_i, cols_i = np.triu_indices(p)
    width = 2 * (1 + p + len(rows_i)) + p + 2

    def sums(times: np.ndarray, rows: np.ndarray):
        kinds, at = np.unique(times, return_inverse=True)
        order = np.argsort(at, kind="stable")
        return kinds, np.add.reduceat(rows[order], np.searchsorted(at[order], np.arange(len(kinds))), axis=0)

    def out(times: np.ndarray, rows: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"bucket": np.searchsorted(bounds, times, side="right"), "time": times, "v": list(rows)})

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        times, rows = np.empty(0), np.empty((0, width))
        for batch in batches:
            if not len(batch):
                continue
            z = (batch[names].to_numpy() - mean) / std
            eta = z @ beta
            dead = batch["event"].to_numpy()[:, None]
            wide = np.hstack([np.ones((len(z), 1)), z, z[:, rows_i] * z[:, cols_i]]) * np.exp(eta)[:, None]
            every = np.hstack([wide, wide * dead, z * dead, dead, eta[:, None] * dead])
            times, rows = sums(np.concatenate([times, batch["time"].to_numpy()]), np.vstack([rows, every]))
            if len(times) > TIMES:
                yield out(times, rows)
                times, rows = np.empty(0), np.empty((0, width))
        if len(times):
            yield out(times, rows)

    parts = data.mapInPandas(partial, "bucket int, time double, v array<double>")
    return parts.groupBy("bucket", "time").agg(vector_sum("v"))


def _likelihood(per_time: DataFrame, p: int, several: bool):
    """Log-likelihood, gradient and information over all event times.

    Risk sums are suffix sums of vectors over the times, taken segment by segment: sums of whole buckets
    go to the driver (at most MAX_BUCKETS of them), which returns to each bucket what lies after it; a
    task then goes through its buckets from the last time back and keeps one running vector.
    """
    q = 1 + p + p * (p + 1) // 2
    after: dict[int, np.ndarray] = {}
    if several:
        per_time = per_time.persist()
        totals = per_time.select("bucket", F.slice("v", 1, q).alias("v")).groupBy("bucket").agg(vector_sum("v")).collect()
        run = np.zeros(q)
        for row in sorted(totals, key=lambda r: -r["bucket"]):
            after[row["bucket"]] = run
            run = run + np.array(row["v"])

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, bucket, run = np.zeros(1 + p + p * p), None, np.zeros(q)
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)
            for at in np.split(np.arange(len(v)), np.flatnonzero(np.diff(buckets)) + 1):
                if buckets[at[0]] != bucket:
                    bucket = int(buckets[at[0]])
                    run = after.get(bucket, np.zeros(q))
                risk = run + v[at, :q].cumsum(axis=0)
                total += _contributions(v[at], risk, p)
                run = risk[-1]
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["v"])

    ordered = per_time.repartition("bucket").sortWithinPartitions("bucket", F.desc("time")).select("bucket", "v")
    summed = ordered.mapInArrow(contribute, "v array<double>").agg(vector_sum("v")).first()["v"]
    if several:
        per_time.unpersist()
    flat = np.array(summed, dtype=float)
    return flat[0], flat[1:p + 1], flat[p + 1:].reshape(p, p)


def _cox_rows(df: DataFrame, time: str, event: str, names: Sequence[str], times: int):
    """Complete cases, persisted; their figures; cut points between buckets of times."""
    data = df.select(
        F.col(time).cast("double").alias("time"), F.col(event).cast("double").alias("event"),
        *[F.col(c).cast("double") for c in names],
    ).na.drop().persist()
    head = data.agg(
        F.count(F.lit(1)), F.sum("event"), F.approx_count_distinct("time", 0.02),
        *[F.avg(c) for c in names], *[F.stddev_samp(c) for c in names],
    ).first()
    buckets = min(MAX_BUCKETS, int(head[2] * 1.1) // times)
    bounds = ranks.bucket_bounds(data, "time", buckets + 1, single=max(1, head[0] // (buckets + 1))) if buckets else []
    return data, head, bounds


def cox_score(df: DataFrame, time: str, event: str, covariates: Sequence[str], beta: Sequence[float], times: int = TIMES) -> DataFrame:
    """(term, score, log_likelihood, n, events): Efron partial likelihood and its gradient at stated coefficients."""
    names = list(covariates)
    data, head, bounds = _cox_rows(df, time, event, names, times)
    try:
        zero, one = np.zeros(len(names)), np.ones(len(names))
        ll, grad, _ = _likelihood(_per_time_sums(data, names, np.array(beta, float), zero, one, bounds), len(names), bool(bounds))
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame([(c, float(g), float(ll), int(head[0]), int(head[1])) for c, g in zip(names, grad)],
                                           "term string, score double, log_likelihood double, n long, events long")


def cox_fit(df: DataFrame, time: str, event: str, covariates: Sequence[str], penalizer: float = 0.0,
            max_iter: int = 50, tol: float = 1e-9, times: int = TIMES) -> dict:
    """Newton-Raphson with Efron ties on complete cases.

    Covariates are standardised inside; the L2 term subtracts n * penalizer / 2 * |b|^2 on
    that scale. One pass over the data per iteration. ``converged`` tells whether the last step
    changed the penalised likelihood by no more than ``tol`` of itself, ``score`` is the largest
    component of its gradient there, ``iterations`` counts the passes.
    """
    names = list(covariates)
    data, head, bounds = _cox_rows(df, time, event, names, times)
    try:
        p = len(names)
        n, events = head[0], head[1] or 0
        mean = np.array(head[3:3 + p], dtype=float)
        std = np.array(head[3 + p:3 + 2 * p], dtype=float)
        std[~(std > 0)] = 1.0
        beta, last = np.zeros(p), -np.inf
        step = np.zeros(p)
        converged, passes, grad, loglik, cov = False, 0, np.full(p, np.nan), float("nan"), np.zeros((p, p))
        for passes in range(1, max_iter + 1):
            ll, grad, info = _likelihood(_per_time_sums(data, names, beta, mean, std, bounds), p, bool(bounds))
            score = ll - n * penalizer / 2 * beta @ beta
            if score < last - 1e-9 * abs(last):  # overshot: halve the step
                step = step / 2
                beta = beta - step
                continue
            grad = grad - n * penalizer * beta
            info = info + n * penalizer * np.eye(p)
            converged = bool(abs(score - last) <= tol * (abs(score) + tol))
            last, loglik, cov = score, ll, np.linalg.pinv(info)
            if converged:
                break
            step = cov @ grad
            beta = beta + step
        coef, se = beta / std, np.sqrt(np.maximum(np.diag(cov), 0)) / std
        return {"n": int(n), "events": int(events), "log_likelihood": float(loglik), "converged": converged, "iterations": passes,
                "score": float(np.abs(grad).max(initial=0.0)), "terms": [
            {"term": c, "coef": float(b), "hazard_ratio": float(np.exp(b)), "se": float(s),
             "ci_lower": float(np.exp(b - 1.959963984540054 * s)),
             "ci_upper": float(np.exp(b + 1.959963984540054 * s)),
             "p_value": tails.normal_two_sided(b / s) if s > 0 else None}
            for c, b, s in zip(names, coef, se)
        ]}
    finally:
        data.unpersist()


def cox_table(spark, fit: dict) -> DataFrame:
    rows = [(fit["n"], fit["events"], t["term"], t["coef"], t["hazard_ratio"], t["se"], t["ci_lower"],
             t["ci_upper"], t["p_value"], fit["converged"], fit["iterations"]) for t in fit["terms"]]
    return spark.createDataFrame(rows, "n long, events long, term string, coef double, "
                                       "hazard_ratio double, se double, ci_lower double, "
                                       "ci_upper double, p_value double, converged boolean, iterations int")


def risk_score(fit: dict) -> Column:
    """Linear predictor of a fitted model."""
    total = F.lit(0.0)
    for t in fit["terms"]:
        total = total + F.col(t["term"]).cast("double") * F.lit(t["coef"])
    return total


def concordance(df: DataFrame, time: str, event: str, risk: str, single: int | None = None) -> DataFrame:
    """Share of comparable pairs in which the earlier event has the higher risk; ties half.

    A pair is comparable when the earlier time is an event (a censored row at the same time counts as
    later). Pairs are counted the way a merge sort counts inversions: the rank of a time is a number of
    base FAN, two different times part at exactly one digit, and the rows that share the digits before it
    are a block. In a block the deaths of each digit meet the rows of all larger digits in order of risk,
    by running sums cut at ``single`` rows (``ranks.cumulate``). Rows of one time are a block of their own,
    deaths against censored. Each (time, risk) goes out once a level, log(times) of them; no pair and no
    grid is made.
    """
    base = df.select(F.col(time).cast("double").alias("t"), F.col(event).cast("int").alias("e"),
                     F.col(risk).cast("double").alias("r")).na.drop()
    single = ranks.SINGLE_WINDOW_ROWS if single is None else single
    cells = base.groupBy("t", "e", "r").agg(F.count(F.lit(1)).alias("n")).persist()
    try:
        times = cells.select("t").distinct().withColumn("one", F.lit(1).cast("bigint"))
        kinds = times.count()
        levels = 0
        while FAN ** levels < kinds:
            levels += 1
        order = ranks.scan(times, "t", ["one"], (), ranks.bucket_bounds(times, "t", single=single)).select("t", F.col("one_before").alias("rank"))
        power = F.array(*[F.lit(FAN ** i).cast("bigint") for i in range(levels + 1)])
        level = F.col("level")
        spread = cells.join(order, "t").withColumn("level", F.explode(F.sequence(F.lit(-1), F.lit(levels - 1))))
        same = level < 0
        block = F.when(same, F.col("rank")).otherwise(F.floor(F.col("rank") / F.get(power, level + 1)))
        digit = F.floor(F.col("rank") / F.get(power, F.greatest(level, F.lit(0)))) % FAN
        dead = F.col("e") == 1
        # of one time, deaths are the smaller digit and censored rows the larger one
        split = spread.select("level", block.alias("block"), "r", "n", F.when(same, F.lit(0)).otherwise(digit).alias("left"), dead.alias("dead"),
                              F.when(same, F.when(dead, 0).otherwise(1)).otherwise(digit).alias("right"))
        count = lambda held: F.sum(F.when(held, F.col("n")).otherwise(0))
        measures = {}
        for a in range(FAN - 1):
            measures[f"d{a}"] = count(F.col("dead") & (F.col("left") == a))
            measures[f"o{a}"] = count(F.col("right") > a)
        rows = ranks.cumulate(split, "r", measures, ["level", "block"], single=single)
        both = lambda suffix: sum((F.col(f"d{a}").cast("double") * F.col(f"o{a}{suffix}") for a in range(FAN - 1)), F.lit(0.0))
        total = rows.agg(F.sum(both("_before")).alias("g"), F.sum(both("")).alias("t"), F.sum(both("_total")).alias("p")).collect()
    finally:
        cells.unpersist()
    return df.sparkSession.createDataFrame([tuple(total[0])], "g double, t double, p double").select(
        ((F.col("g") + F.col("t") / 2) / F.nullif(F.col("p"), F.lit(0.0))).alias("concordance"),
        F.coalesce("p", F.lit(0.0)).alias("pairs"),
    )

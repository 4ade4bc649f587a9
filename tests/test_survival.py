"""Survival operators against brute force: closed forms, segmented scans, many times, deaths and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.operators import survival


def added(s, d, m):
    share = np.arange(m) / m
    w = s - share * d
    return [np.log(w).sum(), (1 / w).sum(), (share / w).sum(), (1 / w ** 2).sum(), (share / w ** 2).sum(), (share ** 2 / w ** 2).sum()]


@pytest.mark.parametrize("m", [1, 2, 63, 64, 65, 100, 1000, 54_321, 1_000_000])
def test_efron_sums_equal_the_added_terms(m):
    shares = [1e-9, 1e-6, 1e-3, 0.05, 0.0999, 0.1001, 0.3, 0.9, 0.999999, 1.0]
    s = np.array([m * 1.7 / t for t in shares])
    d = np.full(len(shares), m * 1.7)
    got = survival.efron_sums(s, d, np.full(len(shares), m)).T
    for row, one, t in zip(got, s, shares):
        assert row == pytest.approx(added(one, m * 1.7, m), rel=2e-9), t


def test_a_million_deaths_at_one_time(spark):
    n = 1_200_000
    rows = spark.range(n).select(
        F.when(F.col("id") < 1_000_000, 5).otherwise(F.col("id") % 50 + 1).alias("t"), (F.col("id") < 1_000_000).cast("int").alias("e"),
        (F.col("id") % 11 / 11.0).alias("x"))
    got = survival.cox_score(rows, "t", "e", ["x"], [0.7]).first()
    i = np.arange(n)
    t, dead, x = np.where(i < 1_000_000, 5, i % 50 + 1), i < 1_000_000, i % 11 / 11.0
    w = np.exp(0.7 * x)
    at, now = t >= 5, dead
    share = np.arange(1_000_000) / 1_000_000
    below = w[at].sum() - share * w[now].sum()
    assert got["score"] == pytest.approx(x[now].sum() - (((w * x)[at].sum() - share * (w * x)[now].sum()) / below).sum(), rel=1e-6)
    assert got["log_likelihood"] == pytest.approx(0.7 * x[now].sum() - np.log(below).sum(), rel=1e-12)


def patients(seed, n, times, risks):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, times, n).astype(float)
    return t, rng.integers(0, 2, n), rng.integers(0, risks, n).astype(float) / 4, rng.normal(size=n)


@pytest.mark.parametrize("times", [20_000, 40, 3])
def test_cox_likelihood_in_buckets_of_times(spark, times):
    t, e, _, x = patients(1, 3000, 200, 4)
    z = x ** 2
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(t, e, x, z)], "t double, e double, x double, z double").repartition(5)
    beta = np.array([0.3, -0.2])
    cov = np.stack([x, z], axis=1)
    w = np.exp(cov @ beta)
    ll, grad = 0.0, np.zeros(2)
    for at in np.unique(t[e == 1]):
        now, risk = (t == at) & (e == 1), t >= at
        for k in range(now.sum()):
            f = k / now.sum()
            below = w[risk].sum() - f * w[now].sum()
            ll -= np.log(below)
            grad -= ((w[:, None] * cov)[risk].sum(axis=0) - f * (w[:, None] * cov)[now].sum(axis=0)) / below
        ll += (cov[now] @ beta).sum()
        grad += cov[now].sum(axis=0)
    got = {r["term"]: r for r in survival.cox_score(df, "t", "e", ["x", "z"], beta, times=times).collect()}
    assert got["x"]["log_likelihood"] == pytest.approx(ll)
    assert [got["x"]["score"], got["z"]["score"]] == pytest.approx(list(grad))
    fit = survival.cox_fit(df, "t", "e", ["x", "z"], times=times)
    assert fit["converged"] and fit["score"] < 1e-3
    short = survival.cox_fit(df, "t", "e", ["x", "z"], times=times, max_iter=1)
    assert not short["converged"] and survival.cox_table(spark, short).first()["converged"] is False


@pytest.mark.parametrize("segment, domain", [(1_024, None), (16, None), (8, 200), (1, 10)])
def test_kaplan_meier_in_segments(spark, segment, domain):
    t, e, g, _ = patients(2, 900, 150, 3)
    e[t == 149] = 1
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(t, e, g)], "t double, e double, g double").repartition(4)
    got = {(r["g"], r["t"]): (r["at_risk"], r["events"], r["survival"]) for r in survival.kaplan_meier(df, "t", "e", ["g"], domain, segment=segment).collect()}
    want = {}
    for one in np.unique(g):
        left = 1.0
        for at in np.unique(t[g == one]):
            risk, dead = int(((g == one) & (t >= at)).sum()), int(((g == one) & (t == at) & (e == 1)).sum())
            left *= 1 - dead / risk
            want[one, at] = (risk, dead, left)
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k])


def test_curve_plan_has_no_window_over_a_group(spark):
    df = spark.createDataFrame([(1, 1, "a")], "t int, e int, g string")
    plan = survival.kaplan_meier(df, "t", "e", ["g"], domain=3_651)._jdf.queryExecution().analyzed().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "t#" in line.split("], [")[-1]]
    assert windows and all("_bucket" in line for line in windows)


def brute_concordance(t, e, r):
    good = ties = pairs = 0
    for i in np.flatnonzero(e == 1):
        later = (t > t[i]) | ((t == t[i]) & (e == 0))
        pairs += later.sum()
        good += (later & (r < r[i])).sum()
        ties += (later & (r == r[i])).sum()
    return (good + ties / 2) / pairs, pairs


@pytest.mark.parametrize("times, risks, single", [(1, 5, 200_000), (9, 3, 50), (64, 1000, 20), (65, 40, 200_000), (5000, 700, 100)])
def test_concordance_by_merge_levels(spark, times, risks, single):
    t, e, r, _ = patients(times, 700, times, risks)
    df = spark.createDataFrame([(float(a), int(b), float(c)) for a, b, c in zip(t, e, r)], "t double, e int, r double").repartition(3)
    got = survival.concordance(df, "t", "e", "r", single=single).first()
    assert tuple(got) == pytest.approx(brute_concordance(t, e, r))


def test_concordance_of_nothing(spark):
    none = spark.createDataFrame([(1.0, 0, 2.0), (None, 1, 1.0)], "t double, e int, r double")
    assert tuple(survival.concordance(none, "t", "e", "r").first()) == (None, 0.0)


def test_concordance_over_a_million_times(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.col("id").alias("t"), (F.col("id") % 3 == 0).cast("int").alias("e"), (F.col("id") * 7919 % n).alias("r"))
    got = survival.concordance(rows, "t", "e", "r").first()
    t = np.arange(n)
    r, e = t * 7919 % n, t % 3 == 0
    good = blockwise(r, e)
    pairs = int((n - 1 - t[e]).sum())
    assert got["pairs"] == pairs and got["concordance"] == pytest.approx(good / pairs, abs=1e-12)


def blockwise(r, e):
    """Dead rows against later rows of smaller risk, level by level over blocks of doubling width."""
    n, good, width = len(r), 0, 1
    while width < n:
        for lo in range(0, n, 2 * width):
            mid, hi = min(lo + width, n), min(lo + 2 * width, n)
            if width >= 64 and mid < hi:
                good += int(np.searchsorted(np.sort(r[mid:hi]), r[lo:mid][e[lo:mid]]).sum())
        width *= 2
    for lo in range(0, n, 64):
        block, dead = r[lo:lo + 64], e[lo:lo + 64]
        good += int((np.triu(block[None, :] < block[:, None], 1) & dead[:, None]).sum())
    return good

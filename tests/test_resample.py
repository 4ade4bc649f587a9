"""Replicates against weights that are drawn out in full."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.operators import resample

REPS = 60


def weights(n):
    return resample.poisson_weights(np.arange(n), np.arange(1, REPS + 1), 42).astype(float)


def test_weights_follow_their_formula_and_law():
    keys, p = np.array([0, 1, 7, 10 ** 12, resample.PRIME, 2 ** 62]), resample.PRIME
    got = resample.poisson_weights(keys, np.arange(1, 4), 42)
    for i, k in enumerate(keys):
        for r in (1, 2, 3):
            h = ((int(k) % p) * 48271 + r * 69621 + 42 * 16807 + 12345) % p
            h = (h * h + h) % p
            h = (h * h + r + 7) % p
            assert got[i, r - 1] == sum(s <= h / p for s in resample.POISSON_STEPS)
    many = resample.poisson_weights(np.arange(20_000), np.arange(1, 51), 1)
    assert many.mean() == pytest.approx(1, abs=0.01) and many.var() == pytest.approx(1, abs=0.02)


@pytest.mark.parametrize("held", [resample.HELD, 1])
def test_any_expression_over_weighted_sums(spark, monkeypatch, held):
    monkeypatch.setattr(resample, "HELD", held)
    rng = np.random.default_rng(1)
    x, y, g = rng.normal(size=700), rng.normal(size=700), rng.integers(0, 3, 700)
    df = spark.createDataFrame([(i, int(a), float(b), float(c) if i % 9 else None) for i, (a, b, c) in enumerate(zip(g, x, y))], "id long, g int, x double, y double").repartition(5)
    got = {(r["g"], r["rep"]): r["stat"] for r in resample.bootstrap(
        df, ["g"], "id", {"x": F.col("x"), "y": F.col("y")}, F.col("x") - 2 * F.col("y"), REPS).collect()}
    w, y = weights(700), np.where(np.arange(700) % 9, y, 0)
    want = {(k, r + 1): ((x - 2 * y)[g == k] @ w[g == k])[r] for k in range(3) for r in range(REPS)}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_medians_per_replicate(spark):
    rng = np.random.default_rng(2)
    v, g = rng.integers(0, 12, 300), np.array(["a", "b", "c"])[np.minimum(np.arange(300) // 140, 2)]
    df = spark.createDataFrame([(i, str(a), int(b)) for i, (a, b) in enumerate(zip(g, v))], "id long, g string, v int").repartition(4)
    got = {(r["g"], r["rep"]): r["stat"] for r in resample.bootstrap_median(df, "g", "id", "v", REPS).collect()}
    w = weights(300).astype(int)
    for k in "abc":
        for r in range(REPS):
            drawn = np.repeat(v[g == k], w[g == k, r])
            assert got[k, r + 1] == (np.median(drawn) if len(drawn) else None)


@pytest.mark.parametrize("kinds, single", [(10 ** 6, 20_000), (10 ** 6, 50), (7, 20_000), (7, 60), (2, 100), (1, 10)])
def test_auc_per_replicate(spark, kinds, single, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 37)
    rng = np.random.default_rng(kinds)
    s, y = rng.integers(0, kinds, 400) / 7, rng.integers(0, 2, 400)
    s[:150] = s[0] if kinds > 10 else s[:150]
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(s, y))], "id long, s double, y int").repartition(4)
    got = {r["rep"]: r["stat"] for r in resample.bootstrap_auc(df, "y", "s", "id", REPS, single=single).collect()}
    w = weights(400)
    wins = (s[:, None] > s[None, :]) + (s[:, None] == s[None, :]) / 2
    for r in range(REPS):
        p, n = w[:, r] * y, w[:, r] * (1 - y)
        assert got[r + 1] == pytest.approx(p @ wins @ n / (p.sum() * n.sum()))


def test_replicates_without_rows_or_with_one_class(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, None, 0)], "id long, s double, y int")
    row = resample.auc_interval(df, "y", "s", "id", 20).first()
    assert tuple(row) == (0.5, 0.5, 0)
    assert resample.mean_interval(df.where("false"), "y", "id", "s", 20).count() == 0


def test_weights_follow_their_definition_in_little_memory():
    import tracemalloc

    keys, reps = np.array([0, 1, 7, 2147483646, 2147483647, 2 ** 40 + 5, *range(1000, 1500)]), np.arange(1, 2001)
    tracemalloc.start()
    found = resample.poisson_weights(keys, reps, 42)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # a byte per weight and blocks of a fixed size, so the work stays in a core's cache
    assert peak < 2 * found.size
    for i in (*range(6), 300):
        for r in (1, 2, 999, 2000):
            h = (int(keys[i]) % resample.PRIME * 48271 + r * 69621 + 42 * 16807 + 12345) % resample.PRIME
            h = (h * h + h) % resample.PRIME
            h = (h * h + r + 7) % resample.PRIME
            assert found[i, r - 1] == sum(h >= np.ceil(s * resample.PRIME) for s in resample.POISSON_STEPS)


@pytest.mark.parametrize("levels", [3, 40, 10 ** 6])
def test_pairs_in_order_against_plain_counts(levels):
    import pyarrow as pa

    rng = np.random.default_rng(levels)
    n, reps = 1300, 5
    bucket, score = np.sort(rng.integers(0, 2, n)).astype(np.int32), rng.integers(0, levels, n) / 8
    order = np.lexsort((score, bucket))
    score, label, key = score[order], rng.integers(0, 2, n).astype(np.int32), rng.integers(0, 10 ** 6, n)
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, score, label, key)], list("bslk"))
    rows = pa.Table.from_batches(list(resample._in_order(reps, 42)([batch]))).to_pylist()
    for row, b in zip(rows, (0, 1)):
        w = resample.poisson_weights(key[bucket == b], np.arange(1, reps + 1), 42).astype(float)
        s, y = score[bucket == b], label[bucket == b]
        won = np.where(s[:, None] > s, 1.0, np.where(s[:, None] == s, 0.5, 0.0)) * np.outer(y, 1 - y)
        assert row["bucket"] == b and row["pos"] == list(y @ w) and row["neg"] == list((1 - y) @ w)
        assert row["pairs"] == [w[:, r] @ won @ w[:, r] for r in range(reps)]

"""Statistics against published figures and against brute force, in one window and in buckets."""

import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.functions import tails
from retroscope.operators import metrics, ranks, relational, resample, stats, survival, terms


def cells(spark, counts):
    rows = [(i, j, n) for i, row in enumerate(counts) for j, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "a int, b int, n long")


@pytest.mark.parametrize("counts,chi2,p", [
    ([[1998 - 770, 770], [283 - 78, 78], [1309 - 517, 517]], 14.5726, 0.000685),
    ([[3, 13], [46, 190], [1, 9], [32, 299]], 11.6089, None),
])
def test_chi_square_published(spark, counts, chi2, p):
    row = stats.chi_square_of_cells(cells(spark, counts), "a", "b").first()
    assert row["chi2"] == pytest.approx(chi2, abs=1e-4)
    if p:
        assert row["p_value"] == pytest.approx(p, abs=1e-6)


def test_chi_square_with_empty_cell_and_yates(spark):
    row = stats.chi_square_of_cells(cells(spark, [[5, 0], [3, 4]]), "a", "b").first()
    e = np.outer([5, 7], [8, 4]) / 12
    o = np.array([[5, 0], [3, 4]])
    assert row["chi2"] == pytest.approx((((np.abs(o - e) - np.minimum(.5, np.abs(o - e))) ** 2) / e).sum())
    assert stats.chi_square_of_cells(cells(spark, [[5, 4]]), "a", "b").first()["chi2"] is None


def test_published_tails_and_exact_test():
    assert tails.fisher_two_sided(1068, 689, 160, 81) == pytest.approx((0.7847, 0.10444), abs=1e-4)
    assert tails.chi2_tail(3.2, 1) == pytest.approx(0.07364, abs=1e-5)
    assert tails.chi2_tail(6.0, 2) == pytest.approx(math.exp(-3))
    assert math.sqrt(19.6217 / 3604) == pytest.approx(0.0738, abs=1e-4)
    for table in itertools.product(range(4), repeat=4):
        if sum(table):
            a, b, c, d = table
            n, r, k = sum(table), a + b, a + c
            ps = {x: math.comb(r, x) * math.comb(n - r, k - x) / math.comb(n, k) for x in range(max(0, k - (n - r)), min(r, k) + 1)}
            assert tails.fisher_two_sided(*table)[1] == pytest.approx(sum(p for p in ps.values() if p <= ps[a] * (1 + 1e-7)))


def test_mcnemar_and_kappa_published(spark):
    def pairs(n11, n10, n01, n00):
        return spark.createDataFrame([(1, 1)] * n11 + [(1, 0)] * n10 + [(0, 1)] * n01 + [(0, 0)] * n00, "a int, b int")
    row = stats.mcnemar(pairs(40, 52, 73, 132), "a", "b").first()
    assert (row["chi2"], row["p_value"]) == pytest.approx((3.2, 0.07364), abs=1e-4)
    row = stats.agreement(pairs(21, 278, 18, 383), "a", "b").first()
    assert row["agreement"] == pytest.approx(0.5771, abs=1e-4) and row["kappa"] == pytest.approx(0.0285, abs=1e-4)
    assert stats.agreement(pairs(5, 5, 0, 0), "a", "b").first()["kappa"] == 0


@pytest.mark.parametrize("single", [10**6, 0])
def test_rank_tests_with_ties(spark, single):
    rng = random.Random(1)
    data = [(rng.randint(0, 2), float(rng.randint(0, 30)) if rng.random() < .7 else 7.0) for _ in range(400)]
    df = spark.createDataFrame(data, "g int, x double")
    xs = sorted(x for _, x in data)
    rank = {v: (xs.index(v) + 1 + xs.index(v) + xs.count(v)) / 2 for v in set(xs)}
    n = len(data)
    ties = sum(xs.count(v) ** 3 - xs.count(v) for v in set(xs))
    h = 12 / (n * (n + 1)) * sum(sum(rank[x] for g, x in data if g == k) ** 2 / sum(g == k for g, _ in data) for k in range(3)) - 3 * (n + 1)
    assert stats.kruskal(df, "x", "g", single=single).first()["h"] == pytest.approx(h / (1 - ties / (n ** 3 - n)))
    a, b = [x for g, x in data if g == 0], [x for g, x in data if g == 1]
    u = sum((x > y) + .5 * (x == y) for x in a for y in b)
    assert stats.mann_whitney(df, "x", "g", 0, 1, single=single).first()["u"] == pytest.approx(u)


@pytest.mark.parametrize("single", [10**6, 0])
def test_quantiles_match_numpy(spark, single):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(size=301), np.full(150, 0.25)])
    df = spark.createDataFrame([("a" if i % 3 else "b", float(v)) for i, v in enumerate(values)], "g string, x double")
    got = {r["g"]: r for r in ranks.quantiles(df, "x", {"q1": .25, "m": .5, "hi": .9}, ["g"], single=single).collect()}
    for g in "ab":
        mine = np.array([v for i, v in enumerate(values) if ("a" if i % 3 else "b") == g])
        assert [got[g]["q1"], got[g]["m"], got[g]["hi"]] == pytest.approx(list(np.quantile(mine, [.25, .5, .9])))


@pytest.mark.parametrize("single", [10**6, 0])
def test_running_sums_in_buckets(spark, single):
    df = spark.createDataFrame([(i % 2, (i * 37) % 50, i) for i in range(300)], "g int, v int, w int")
    got = ranks.cumulate(df, "v", {"s": F.sum("w")}, ["g"], single=single).collect()
    for r in got:
        assert r["s_before"] == sum(i for i in range(300) if i % 2 == r["g"] and (i * 37) % 50 < r["v"])
        assert r["s_total"] == sum(i for i in range(300) if i % 2 == r["g"])


def test_shuffled_ordinals_are_a_permutation(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id int, s int")
    rows = ranks.hash_ordinals(df, "id", ["s"]).collect()
    for s in range(3):
        mine = sorted(r["ordinal"] for r in rows if r["s"] == s)
        assert mine == list(range(1, len(mine) + 1))
    folds = resample.with_folds(df, "s", "id").groupBy("s", "fold").count().collect()
    assert max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 1


def test_auc_and_average_precision(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 1), round(rng.random(), 1)) for _ in range(200)]
    df = spark.createDataFrame(data, "y int, s double")
    pos, neg = [s for y, s in data if y], [s for y, s in data if not y]
    want = sum((p > q) + .5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert metrics.auc(df, "y", "s").first()["auc"] == pytest.approx(want)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in data}, reverse=True):
        said = [y for y, s in data if s >= t]
        recall = sum(said) / len(pos)
        ap, last = ap + (recall - last) * sum(said) / len(said), recall
    assert metrics.average_precision(df, "y", "s").first()["average_precision"] == pytest.approx(ap)
    assert metrics.auc(df.where("y = 1"), "y", "s").first()["auc"] == 0.5


@pytest.mark.parametrize("single", [10**6, 40])
def test_bootstrap_auc_centres_on_auc(spark, single):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 400)
    s = rng.normal(size=400) + y
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))], "id long, y int, s double")
    point = metrics.auc(df, "y", "s").first()["auc"]
    reps = [r["stat"] for r in resample.bootstrap_auc(df, "y", "s", "id", reps=200, single=single).collect()]
    assert len(reps) == 200 and abs(np.mean(reps) - point) < .01 and .01 < np.std(reps) < .04


def test_bootstrap_intervals(spark):
    df = spark.createDataFrame([(i, "a", i % 4 == 0) for i in range(1000)], "id long, g string, y boolean").withColumn("y", F.col("y").cast("int"))
    by_row = resample.mean_interval(df, "g", "id", "y", reps=400).first()
    by_count = resample.rate_interval(df, "g", "id", "y", reps=400).first()
    se = math.sqrt(.25 * .75 / 1000)
    for row in (by_row, by_count):
        assert row["ci_lower"] == pytest.approx(.25 - 1.96 * se, abs=.008)
        assert row["ci_upper"] == pytest.approx(.25 + 1.96 * se, abs=.008)
    again = resample.mean_interval(df.repartition(7), "g", "id", "y", reps=400).first()
    assert again["ci_lower"] == pytest.approx(by_row["ci_lower"])  # the draw ignores partitioning
    small = resample.rate_interval(df.limit(9), "g", "id", "y", reps=50, min_n=10).first()
    assert small["n"] == 9 and small["ci_lower"] is None


def test_log_odds_published(spark):
    """z of three terms from their log-odds and counts."""
    for delta, a, b, z in [(3.3832, 62, 2, 5.7251), (1.9969, 20, 3, 3.6604), (.5287, 51, 42, 2.565)]:
        assert delta / math.sqrt(1 / (a + 1) + 1 / (b + 1)) == pytest.approx(z, abs=2e-4)
    df = spark.createDataFrame([(1, ["x"] * 12 + ["y"]), (0, ["x"] * 3 + ["z"] * 20)], "side int, w array<string>")
    got = {r["term"]: r for r in terms.log_odds(df, F.col("w"), F.col("side")).collect()}
    assert set(got) == {"x", "z"}  # y is rare, but counts in the vocabulary
    assert got["x"]["log_odds"] == pytest.approx(math.log(13 / 16) - math.log(4 / 26))


def test_kaplan_meier_by_hand(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, 1)], "t int, e int")
    curve = [round(r["survival"], 6) for r in survival.kaplan_meier(df, "t", "e").orderBy("t").collect()]
    assert curve == [.75, .5, 0]


def _efron(x, t, e, beta):
    ll = 0.0
    for time in np.unique(t[e == 1]):
        dead, risk = (t == time) & (e == 1), t >= time
        s, d = np.exp(x[risk] @ beta).sum(), np.exp(x[dead] @ beta).sum()
        ll += (x[dead] @ beta).sum() - sum(math.log(s - k / dead.sum() * d) for k in range(dead.sum()))
    return ll


@pytest.mark.parametrize("times", [20_000, 7])
def test_cox_is_a_maximum_of_the_efron_likelihood(spark, times):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    t = np.ceil(rng.exponential(np.exp(-x @ [.6, -.4])) * 10).astype(int)
    e = (rng.random(200) < .8).astype(int)
    df = spark.createDataFrame([(int(a), int(b), float(c), float(d)) for a, b, (c, d) in zip(t, e, x)], "t int, e int, x0 double, x1 double")
    fit = survival.cox_fit(df, "t", "e", ["x0", "x1"], times=times)
    beta = np.array([k["coef"] for k in fit["terms"]])
    best = _efron(x, t, e, beta)
    assert fit["log_likelihood"] == pytest.approx(best)
    for step in itertools.product((-1e-3, 0, 1e-3), repeat=2):
        assert _efron(x, t, e, beta + np.array(step)) <= best + 1e-9


@pytest.mark.parametrize("single", [None, 25])
def test_concordance_brute_force(spark, single):
    rng = random.Random(9)
    data = [(rng.randint(1, 8), rng.randint(0, 1), float(rng.randint(0, 40))) for _ in range(150)]
    df = spark.createDataFrame(data, "t int, e int, r double")
    good = n = 0
    for (t1, e1, r1), (t2, e2, r2) in itertools.permutations(data, 2):
        if e1 and (t1 < t2 or (t1 == t2 and not e2)):
            n += 1
            good += (r1 > r2) + .5 * (r1 == r2)
    row = survival.concordance(df, "t", "e", "r", single=single).first()
    assert row["pairs"] == n and row["concordance"] == pytest.approx(good / n)


def test_histogram_and_quantile_bins(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)], "x double")
    h = {r["bin"]: r["n"] for r in relational.histogram(df, "x", 5).collect()}
    assert h == {0: 2, 1: 2, 2: 2, 3: 2, 4: 3}
    flat = spark.createDataFrame([(3.0, 1)] * 4 + [(9.0, 0)], "x double, y int")
    assert sorted(r["n"] for r in relational.quantile_bin_rates(flat, "x", "y").collect()) == [1, 4]


def test_first_source_wins(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2)], "id string, n int")
    b = spark.createDataFrame([("k1", 0, "x"), ("k3", 3, "y")], "id string, n int, extra string")
    got = {r["id"]: (r["n"], r["extra"]) for r in relational.first_across_sources([a, b], "id", "n").collect()}
    assert got == {"k1": (1, None), "k2": (2, None), "k3": (3, "y")}


def test_auc_replicates_do_not_depend_on_partitions(spark):
    from retroscope.operators import resample

    rows = [(i, float(i % 97) / 97, int((i * 7) % 11 < 4)) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, score double, label int")
    found = []
    for single, parts in ((20, "3"), (20, "16"), (10_000, "4")):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append({r["rep"]: round(r["stat"], 9) for r in resample.bootstrap_auc(df, "label", "score", "id", 50, single=single).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2]


def test_notable_rows(spark):
    from retroscope.operators import stats

    df = spark.createDataFrame([(i, i / 100) for i in range(40)], "i int, p_value double")
    assert [r["i"] for r in stats.notable(df, ["i"]).collect()] == list(range(10))
    assert [r["i"] for r in stats.notable(df.where("i < 30"), ["i"], level=0.2).collect()] == list(range(15))
    assert [r["i"] for r in stats.notable(df.where("i >= 20"), ["i"]).collect()] == list(range(20, 30))


def test_the_layer_follows_its_table(spark, tmp_path):
    from retroscope.plans import catalogue

    source = spark.read.parquet("/root/testdata/sf0.001/documents.parquet") if os.path.isdir("/root/testdata/sf0.001") else None
    if source is None:
        pytest.skip("tables not present")
    for n in (20, 60):
        source.limit(n).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        now = catalogue.enriched(spark, str(tmp_path)).count()
        assert now > n // 2 and catalogue.layer(spark, str(tmp_path)).count() == now

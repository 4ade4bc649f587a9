"""The forest on few columns: best splits, the same trees however rows are dealt, as good as Spark ML's."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retroscope.operators import forests, metrics, resample
from retroscope.plans import models

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.random((3000, 4))
    x[:, 1] = np.floor(x[:, 1] * 5)
    odds = 3 * x[:, 0] - 0.5 * x[:, 1] + 2 * (x[:, 2] > 0.7) - 1
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * odds))).astype(float)
    df = spark.createDataFrame([(i, float(y[i]), 1.0 + (i % 3) / 4, *map(float, x[i])) for i in range(3000)],
                               "id long, label double, weight double, a double, b double, c double, d double")
    return VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(df).persist()


@pytest.mark.parametrize("weight", [None, "weight"])
def test_splits_are_the_best_of_their_rows(rows, weight):
    model = forests.Forest(3, 4, "id", weight=weight).fit(rows)
    table = rows.orderBy("id").collect()
    x, y = np.array([r["features"].toArray() for r in table]), np.array([r["label"] for r in table])
    w = np.array([r["weight"] if weight else 1.0 for r in table])
    codes = forests._codes(x, model.cuts)
    drawn = resample.poisson_weights(np.array([r["id"] for r in table]), np.arange(1, 4), 42)
    def impurity(at: np.ndarray, full: np.ndarray) -> float:
        c = np.array([full[at & (y == v)].sum() for v in (0, 1)])
        return c.sum() - (c ** 2).sum() / c.sum() if c.sum() else 0.0

    checked = 0
    for t in range(3):
        full, node = drawn[:, t] * w, np.ones(len(x), int)
        for level in range(4):
            for n in range(1 << level, 2 << level):
                j = model.feature[t, n]
                if j < 0:
                    continue
                inside = (node == n) & (full > 0)
                left = [sum(impurity(inside & side, full) for side in (codes[:, j] <= cut, codes[:, j] > cut)) for cut in range(31)]
                assert left[model.cut[t, n]] < impurity(inside, full)
                assert left[model.cut[t, n]] <= min(left) + 1e-6
                assert model.share[t, n] == pytest.approx((full * y)[inside].sum() / full[inside].sum())
                checked += 1
            f = model.feature[t, node]
            node = np.where(f < 0, node, 2 * node + (codes[np.arange(len(x)), np.maximum(f, 0)] > model.cut[t, node]))
    assert checked > 10


def test_few_values_keep_all_their_cuts_many_get_quantiles(rows):
    cuts = forests.cut_points(rows)
    assert cuts[1].tolist() == [0.5, 1.5, 2.5, 3.5]
    assert len(cuts[0]) == 31 and np.allclose(cuts[0], np.arange(1, 32) / 32, atol=0.05)


def test_trees_do_not_depend_on_how_rows_are_dealt(rows, monkeypatch):
    cuts = forests.cut_points(rows)
    monkeypatch.setattr(forests, "cut_points", lambda df: cuts)
    one, many = (forests.Forest(5, 6, "id").fit(rows.repartition(n, "d")) for n in (1, 7))
    assert np.array_equal(one.feature, many.feature) and np.array_equal(one.share, many.share)


def test_as_good_as_the_library_forest(rows):
    train, held = rows.where("id % 3 > 0").persist(), rows.where("id % 3 = 0").persist()
    area = [metrics.auc(models.scores(models.forest(50, 6, **kw).fit(train), held, "id"), "label", "score").first()["auc"]
            for kw in ({}, {"key": "id"})]
    assert abs(area[0] - area[1]) < 0.01 and area[1] > 0.8


def test_one_class_and_one_value(spark):
    df = VectorAssembler(inputCols=["v"], outputCol="features").transform(
        spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)], "id long, label double, v double"))
    model = forests.Forest(10, 3, "id").fit(df)
    assert [r["score"] for r in models.scores(model, df, "id").collect()] == [1.0] * 20


def test_a_fold_scores_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    class Model:
        def transform(self, df):
            @F.udf(T.ArrayType(T.DoubleType()))
            def shares(v):
                seen.add(1)
                return [1 - v, v]
            from pyspark.ml.functions import array_to_vector
            return df.withColumn("probability", array_to_vector(shares(F.get(models.vector_to_array("features"), F.lit(0)))))

    class Stub:
        def fit(self, df):
            return Model()

    df = spark.range(400).select("id", (F.col("id") % 2).alias("y"), (F.col("id") / 400).alias("v"))
    models.cross_validate(df, "y", "id", {"stub": lambda n: Stub()}, k=4, numeric=["v"], text=False)
    assert seen.value == 400

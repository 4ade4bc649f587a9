"""Studies on small tables: the plan of the fits, and results that hang on no plan."""

import pytest
from pyspark.sql import functions as F

from retroscope.operators import metrics, resample
from retroscope.plans import models
from retroscope.sources import readers

TEXTS = ["I quit the old job", "They moved to a new town", "quit quit the job again", "", "a new job in the old town"]


@pytest.fixture(scope="module")
def told(spark):
    rows = [(f"p{i}", TEXTS[i % 5], int(i % 5 in (0, 2) or i % 11 == 0), float(i % 7)) for i in range(240)]
    return spark.createDataFrame(rows, "id string, spoken string, reversal int, x double").repartition(6)


def test_fits_pass_over_few_tasks_of_few_rows_and_more_of_more(told, monkeypatch):
    _, _, ready, _ = models.prepare(models._labelled(told, "reversal"), models._labelled(told, "reversal"), "id", numeric=["x"], min_df=1)
    assert ready.rdd.getNumPartitions() == 1 and ready.count() == 240
    monkeypatch.setattr(models, "ROWS", 50)
    assert models.dealt(told, "id", 240).rdd.getNumPartitions() == 5


def test_terms_made_once_give_the_same_features(told):
    rows = models._labelled(told, "reversal")
    _, names, plain, held = models.prepare(rows, rows, "id", numeric=["x"], min_df=1)
    once = models.studied(told, "reversal", "id", numeric=["x"])
    _, again, cut, held_cut = models.prepare(once, once, "id", numeric=["x"], min_df=1)

    def named(df, names):
        return {r["id"]: {names[i]: round(v, 9) for i, v in zip(r["features"].toArray().nonzero()[0].tolist(), r["features"].toArray()[r["features"].toArray().nonzero()].tolist())}
                for r in df.collect()}

    assert set(names) == set(again) and "_terms" in once.columns and "spoken" not in once.columns
    assert named(plain, names) == named(cut, again) and named(held, names) == named(held_cut, again)


def test_grid_has_the_areas_of_single_fits(told):
    found = {(r["c"], r["weighting"]): r["mean_auc"] for r in models.grid_search(told, "reversal", "id", (0.1, 1.0), 3, numeric=["x"], min_df=1).collect()}
    assert set(found) == {(c, w) for c in (0.1, 1.0) for w in ("none", "balanced")}
    data = resample.with_folds(models._labelled(told, "reversal"), "label", "id", 3, 42)
    areas = []
    for i in range(3):
        table, _, _ = models.fit_and_score(data.where(F.col("fold") != i), data.where(F.col("fold") == i), "id",
                                           lambda n: models.logistic(n, 0.1), numeric=["x"], min_df=1)
        areas.append(metrics.auc(table, "label", "score").first()["auc"])
    assert found[(0.1, "none")] == pytest.approx(sum(areas) / 3, abs=1e-6)


def test_narrow_rows_are_dealt_in_tasks_that_grow_with_them(spark, tmp_path):
    spark.range(1000).repartition(2).write.parquet(str(tmp_path / "narrow"))
    rows = spark.read.parquet(str(tmp_path / "narrow"))
    dealt = readers.by_rows(rows, 50)
    assert dealt.rdd.getNumPartitions() == 20 and dealt.agg(F.sum("id")).first()[0] == 499_500
    assert readers.by_rows(rows, 500).rdd.getNumPartitions() == rows.rdd.getNumPartitions()


def test_comparison_fits_side_by_side_with_a_folder_for_boosting(told):
    out, best, model, names = models.compare_models(
        told, "reversal", "id", {"logistic": lambda n: models.logistic(n), "boosted": lambda n: models.boosted(2, 2)}, k=2, reps=20, numeric=["x"], min_df=1)
    rows = {r["model"]: r for r in out.collect()}
    assert set(rows) == {"logistic", "boosted"} and rows[best]["best"] and model.stages[-1].numFeatures == len(names)
    assert all(r["test_auc"] > 0.5 and r["cv_auc_mean"] > 0.5 for r in rows.values())
    assert told.sparkSession.sparkContext.getCheckpointDir() is not None

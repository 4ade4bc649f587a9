"""The model queries ask for the whole study: folds, trees, replicates and vocabulary of the reference."""

from retroscope.operators import resample
from retroscope.plans import catalogue, models, queries_models, queries_statistics


def test_queries_ask_for_full_settings(monkeypatch):
    catalogue.load_all()
    seen = {}

    def asked(name, result=None):
        def call(*args, **kw):
            seen[name] = args, kw
            return result
        return call

    monkeypatch.setattr(queries_models, "_posts", lambda spark, d: None)
    monkeypatch.setattr(queries_models, "layer", lambda spark, d: None)
    monkeypatch.setattr(queries_models, "model_layer", lambda spark, d: (None, None))
    monkeypatch.setattr(models, "spoken", lambda df: None)
    monkeypatch.setattr(models, "filled", lambda df, numeric: None)
    monkeypatch.setattr(queries_statistics, "table", lambda spark, d, name: None)
    monkeypatch.setattr(queries_statistics, "_scores", lambda spark, d: None)
    monkeypatch.setattr(models, "_labelled", lambda df, label: None)
    monkeypatch.setattr(models, "importances", lambda *a: None)
    monkeypatch.setattr(models, "forest", lambda trees, depth, **kw: (trees, depth))
    monkeypatch.setattr(models, "boosted", lambda rounds, depth: (rounds, depth))
    for name, result in (("compare_models", (None,)), ("fit_and_score", (None, None, None)), ("grid_search", None),
                         ("leave_one_group_out", None), ("nested_feature_sets", None)):
        monkeypatch.setattr(models, name, asked(name, result))
    for name in ("mean_interval", "auc_interval"):
        monkeypatch.setattr(resample, name, asked(name))
    for name in ("model_comparison", "top_features", "grid_search", "leave_one_domain_out", "engagement_gain"):
        getattr(queries_models, name)(None, None)
    queries_statistics.bootstrap_means(None, None)
    queries_statistics.auc_interval(None, None)

    args, kw = seen["compare_models"]
    assert (kw["k"], kw["reps"], kw["max_features"]) == (5, 2000, 20_000)
    assert args[3]["forest"](0) == (300, 20) and args[3]["boosted"](0) == (200, 5)
    args, kw = seen["fit_and_score"]
    assert args[3](0) == (300, 20) and kw["max_features"] == 20_000
    assert seen["grid_search"][1]["max_features"] == 25_000
    args, kw = seen["leave_one_group_out"]
    assert args[5](0) == (300, 20) and (kw["reps"], kw["max_features"]) == (2000, 15_000)
    assert kw["numeric"][-10:] == [f"emb_{i}" for i in range(10)]
    args, kw = seen["nested_feature_sets"]
    assert args[5](0) == (200, 10) and kw["k"] == 5
    assert seen["mean_interval"][1]["reps"] == seen["auc_interval"][1]["reps"] == 2000

"""Queries that fit models. They are checked on rows only; tests check the parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from retroscope.operators import matching, metrics, stats
from retroscope.plans import models, scoring
from retroscope.plans import oracle as sql
from retroscope.plans import posts as post_plans
from retroscope.plans.catalogue import documents, layer, model_layer, query
from retroscope.plans.queries_posts import RICH
from retroscope.session import scratch_path
from retroscope.sources.readers import by_rows

NUMERIC = ["vader_compound", "vader_neg", "urgency_score", "has_time"]
PSM = ["vader_compound", "vader_neg", "urgency_score", "log_post_length", "post_year", "agency_score", "hedging_score",
       "causal_reasoning_score", "future_orient_score"]
DOMAINS = ["career", "immigration", "relationships"]


EMBEDDED = [f"emb_{i}" for i in range(10)]


def _posts(spark, d):
    return models.filled(models.spoken(by_rows(layer(spark, d))), NUMERIC)


LOGIT = "model:s n:i pseudo_r2:f aic:f llf:f term:s status:s coef:f se:f odds_ratio:f ci_lower:f ci_upper:f p_value:f converged:b"


@query(LOGIT)
def logit_year_by_domain(spark, d):
    """Outcome on centred year, domain and their products."""
    rows = layer(spark, d).select("reversal", "post_year", "domain")
    from retroscope.operators import ranks
    centre = ranks.quantiles(rows, "post_year", {"m": 0.5}, domain=500).first()["m"]
    rows = rows.withColumn("year_centered", F.col("post_year") - F.lit(centre))
    rows, dummies = stats.dummies(rows, "domain", "d", DOMAINS)
    rows, products = stats.interactions(rows, "year_centered", dummies, "year_x")
    fit = stats.fit_logit(rows, "reversal", ["year_centered", *dummies, *products])
    return stats.logit_table(spark, {"year_domain": fit})


# coefficients at which likelihood and slope are compared with plain SQL
STATED = {"const": -0.3, "vader_compound": 0.4, "vader_neg": -1.2, "urgency_score": 0.15, "has_time": -0.25}
_ETA = " + ".join(["-0.3::DOUBLE", *(f"{b!r}::DOUBLE * {t}" for t, b in STATED.items() if t != "const")])


@query("term:s score:f llf:f n:i", f"""
  WITH x AS (SELECT reversal AS y, coalesce(compound, 0) AS vader_compound, coalesce(neg, 0) AS vader_neg, urgency_score, CAST(e.time_to_regret_days IS NOT NULL AS INT) AS has_time
      FROM enriched e JOIN sentiment USING (id)),
    p AS (SELECT *, {_ETA} AS eta, y - 1 / (1 + exp(-({_ETA}))) AS gap FROM x)
  """ + " UNION ALL ".join(f"SELECT '{t}' AS term, sum(gap{'' if t == 'const' else ' * ' + t}) AS score, sum(y * eta - ln(1 + exp(eta))) AS llf, count(*) AS n FROM p" for t in STATED),
       [*RICH, sql.sentiment("structured", "id", "spoken")])
def logit_score_posts(spark, d):
    """Likelihood of the logit on the features and its slope, at stated coefficients."""
    return stats.logit_score(_posts(spark, d), "reversal", STATED)


# one fit of the three models per application and layer, as several questions are put to them
_FITS: dict[tuple, dict] = {}


def _nested(spark, d):
    """Features alone, with domain, with subreddit (which in the posts' world names the domain too)."""
    rows = _posts(spark, d).select("id", "reversal", "domain", F.coalesce("source_subreddit", F.lit("unknown")).alias("source_subreddit"), *NUMERIC)
    key = (spark.sparkContext.applicationId, *rows.inputFiles())
    if key not in _FITS:
        rows = rows.persist()
        wide, dummies = stats.dummies(rows, "domain", "domain", DOMAINS)
        wide, sources = stats.dummies(wide, "source_subreddit", "sub")
        _FITS[key] = {"features": stats.fit_logit(rows, "reversal", NUMERIC), "with_domain": stats.fit_logit(wide, "reversal", [*NUMERIC, *dummies]),
                      "with_subreddit": stats.fit_logit(wide, "reversal", [*NUMERIC, *sources])}
        rows.unpersist()
    return _FITS[key]


@query(LOGIT)
def nested_logits(spark, d):
    return stats.logit_table(spark, _nested(spark, d))


@query("model:s flat:b", "SELECT * FROM (VALUES ('features', true), ('with_domain', true), ('with_subreddit', true)) v(model, flat)")
def logit_slopes_at_estimate(spark, d):
    """Whether the likelihood of each model is flat at its estimate."""
    rows = stats.logit_table(spark, _nested(spark, d))
    return rows.groupBy("model").agg((F.coalesce(F.max(F.abs("score")), F.lit(0.0)) < 1e-4).alias("flat"))


@query("step:s lr:f dof:i p_value:f")
def likelihood_ratio_domain(spark, d):
    """Domain beyond the features, then subreddit beyond domain."""
    fits = _nested(spark, d)
    rows = []
    for step, small, large in (("domain", "features", "with_domain"), ("subreddit", "with_domain", "with_subreddit")):
        test = stats.likelihood_ratio(fits[small], fits[large])
        rows.append((step, test["lr"], test["dof"], test["p_value"]))
    return spark.createDataFrame(rows, "step string, lr double, dof int, p_value double")


@query("term:s features:f with_domain:f with_subreddit:f")
def coefficient_stability(spark, d):
    return stats.coefficient_stability(stats.logit_table(spark, _nested(spark, d)), NUMERIC, ["features", "with_domain", "with_subreddit"])


@query("model:s cv_auc_mean:f cv_auc_std:f test_auc:f ci_lower:f ci_upper:f best:b")
def model_comparison(spark, d):
    out, *_ = models.compare_models(
        _posts(spark, d), "reversal", "id",
        {"logistic": lambda n: models.logistic(n, weight="weight"),
         "forest": lambda n: models.forest(300, 20, weight="weight"),
         "boosted": lambda n: models.boosted(200, 5)},
        k=5, reps=2000, numeric=NUMERIC, categorical=["domain", "source_subreddit"], min_df=5, max_features=20_000)
    return out


@query("rank:i feature:s importance:f")
def top_features(spark, d):
    data = models._labelled(_posts(spark, d), "reversal")
    _, model, names = models.fit_and_score(data, data, "id", lambda n: models.forest(300, 20, weight="weight"), numeric=NUMERIC,
                                           categorical=["domain"], min_df=5, max_features=20_000)
    return models.importances(spark, model, names)


@query("c:f weighting:s mean_auc:f best:b")
def grid_search(spark, d):
    return models.grid_search(_posts(spark, d), "reversal", "id", numeric=NUMERIC, min_df=5, max_features=25_000)


@query("held_out:s test_auc:f ci_lower:f ci_upper:f n_train:i n_test:i rate_test:f")
def leave_one_domain_out(spark, d):
    columns = [*NUMERIC, *EMBEDDED]
    rows = models.filled(models.spoken(model_layer(spark, d)[0]), columns)
    return models.leave_one_group_out(rows, "reversal", "id", "domain", DOMAINS, lambda n: models.forest(300, 20, weight="weight"),
                                      reps=2000, numeric=columns, min_df=3, max_features=15_000)


@query("features:s mean_auc:f std_auc:f gain:f")
def engagement_gain(spark, d):
    base = ["vader_compound", "vader_neg", "urgency_score", "agency_score", "hedging_score", "causal_reasoning_score", "future_orient_score", "social_embed_score"]
    return models.nested_feature_sets(layer(spark, d), "reversal", "id", base, ["comment_count_log", "score_log"],
                                      lambda n: models.forest(200, 10, key="id"), k=5)


@query("threshold:f f1:f auc:f")
def early_outcome_classifier(spark, d):
    table, _, _ = models.early_outcome(models.spoken(layer(spark, d)), "id")
    table = table.persist()
    best = metrics.best_threshold(metrics.f1_sweep(table, "label", "score"))
    return best.withColumn("auc", metrics.auc(table, "label", "score").select("auc").scalar())


@query("side:s rank:i feature:s coefficient:f")
def early_outcome_terms(spark, d):
    _, model, names = models.early_outcome(models.spoken(layer(spark, d)), "id")
    return models.signed_terms(spark, model, names)


def _matched(spark, d, other: str):
    rows = layer(spark, d).where(F.col("domain").isin("career", other)).withColumn("treated", (F.col("domain") == other).cast("int"))
    units = models.propensity(rows.select("doc_id", "treated", "reversal", *PSM), "treated", PSM).persist()
    pairs = matching.match_nearest(units, "doc_id", "treated", "propensity", 0.10).persist()
    if pairs.count() < 20:
        pairs = matching.match_nearest(units, "doc_id", "treated", "propensity", 0.20).persist()
    return units, matching.matched_frame(units, pairs, "doc_id", "treated", ["reversal", *PSM])


@query("sample:s control_rate:f treated_rate:f n:i gap:f")
def matched_domain_gap(spark, d):
    units, matched = _matched(spark, d, "immigration")
    return matching.effect_of_matching(matched, units, "treated", "reversal")


@query("n11:i n10:i n01:i n00:i chi2:f p_value:f")
def matched_mcnemar(spark, d):
    _, matched = _matched(spark, d, "relationships")
    return stats.mcnemar(matched, "reversal_t", "reversal_c")


@query("feature:s smd:f")
def matched_balance(spark, d):
    units, matched = _matched(spark, d, "immigration")
    sides = F.array(*[F.struct(F.lit(v).alias("treated"), *[F.col(f"{c}_{tag}").alias(c) for c in PSM]) for v, tag in ((1, "t"), (0, "c"))])
    return stats.mean_difference(matched.select(F.inline(sides)), PSM, "treated")


@query("treated_index:i control_index:i", """
  WITH RECURSIVE u AS (SELECT doc_id AS i, CAST(quality = 1 AND toxic = 0 AS INT) = 0 AS treated, (n_chars % 1000) / 1000.0::DOUBLE AS s FROM documents JOIN labels USING (doc_id)),
    t AS (SELECT i, s, row_number() OVER (ORDER BY i) AS turn FROM u WHERE treated),
    step(turn, used, pairs) AS (
      SELECT 0::BIGINT, []::BIGINT[], []::STRUCT(t BIGINT, c BIGINT)[]
      UNION ALL
      SELECT step.turn + 1, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END, CASE WHEN c IS NULL THEN pairs ELSE list_append(pairs, {'t': ti, 'c': c}) END FROM (
        SELECT step.turn, step.used, step.pairs, t.i AS ti, (SELECT arg_min(u.i, (abs(t.s - u.s), u.i)) FROM u WHERE NOT u.treated AND abs(t.s - u.s) <= 0.05::DOUBLE AND NOT list_contains(step.used, u.i)) AS c
        FROM step JOIN t ON t.turn = step.turn + 1) step)
  SELECT p.t AS treated_index, p.c AS control_index FROM (SELECT unnest(pairs) AS p FROM (SELECT pairs FROM step ORDER BY turn DESC LIMIT 1))""")
def nearest_pairs(spark, d):
    """The matching rule on a given score, so that another engine can take the same turns."""
    from retroscope.sources.readers import table
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    units = rows.select("doc_id", (~((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int").alias("treated"), (F.col("n_chars") % 1000 / 1000.0).alias("s"))
    return matching.match_nearest(units, "doc_id", "treated", "s", 0.05)


@query("id:s domain:s reversal_probability:f")
def exported_model_scores(spark, d):
    """Fit, save, load and score with the saved pipelines."""
    folder = scratch_path(spark, "models")
    names = models.train_and_export(_posts(spark, d), folder)
    return scoring.score(
        post_plans.posts_of_documents(documents(spark, d)).select("id", "selftext"), "selftext",
        reversal_model=scoring.load_model(f"{folder}/reversal_model"), domain_model=scoring.load_model(f"{folder}/domain_model"),
        domain_names=names)

"""Queries on tests, intervals, survival, agreement and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from retroscope.functions import bins
from retroscope.operators import metrics, ranks, resample, stats, survival
from retroscope.plans import oracle as sql
from retroscope.plans.catalogue import layer, model_layer, query
from retroscope.plans.queries_posts import BASE, EMOTION, PSY, RICH, SENTIMENT
from retroscope.plans.queries_relational import ERA
from retroscope.sources.readers import by_rows, table

CHI = "n:i dof:i chi2:f cramers_v:f p_value:f"


# --- contingency --------------------------------------------------------------------
@query(CHI, sql.chi_square("cells", "domain", "reversal"),
       [*BASE, "cells AS (SELECT domain, reversal, count(*) AS n FROM structured GROUP BY ALL)"])
def chi_square_domain(spark, d):
    return stats.chi_square(layer(spark, d), "domain", "reversal")


@query("domain:s " + CHI, sql.chi_square("cells", "era", "reversal", "domain"),
       [*BASE, f"cells AS (SELECT domain, {ERA} AS era, reversal, count(*) AS n FROM structured GROUP BY ALL)"])
def chi_square_era_by_domain(spark, d):
    return stats.chi_square(layer(spark, d).withColumn("era", bins.era(F.col("post_year"))), "era", "reversal", ["domain"])


@query("domain:s " + CHI, "SELECT * FROM (" + sql.chi_square("cells", "event_type", "reversal", "domain") + ") WHERE n >= 20",
       [*RICH, "cells AS (SELECT domain, event_type, reversal, count(*) AS n FROM enriched WHERE event_type <> 'unknown' GROUP BY ALL)"])
def chi_square_known_events(spark, d):
    return stats.chi_square(layer(spark, d).where("event_type <> 'unknown'"), "event_type", "reversal", ["domain"], min_n=20)


@query(CHI, sql.chi_square("cells", "emotion", "domain"),
       [*EMOTION, "cells AS (SELECT emotion, domain, count(*) AS n FROM emotions JOIN structured USING (id) GROUP BY ALL)"])
def chi_square_emotion(spark, d):
    return stats.chi_square(layer(spark, d), "emotion", "domain")


@query(CHI, sql.chi_square("cells", "l_returnflag", "l_linestatus"),
       ["cells AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)"])
def chi_square_lineitem(spark, d):
    return stats.chi_square(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query(CHI, sql.chi_square("cells", "quality", "toxic"), ["cells AS (SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL)"])
def chi_square_yates(spark, d):
    return stats.chi_square(table(spark, d, "labels"), "quality", "toxic")


FISHER = """
  SELECT a / (a + b) AS rate_in, a + b AS n_in, c / (c + e) AS rate_out, c + e AS n_out, (CAST(e AS DOUBLE) * a) / (CAST(c AS DOUBLE) * b) AS odds_ratio, least(p, 1.0) AS p_value FROM (
    SELECT *, list_sum(list_transform(list_filter(list_transform(range(greatest(0, (c + a) - (a + b)), least(c + e, c + a) + 1),
        lambda k: lgamma(c + e + 1) - lgamma_(c + e - k) - lgamma_(k) + lgamma(a + b + 1) - lgamma_(c + a - k) - lgamma_(a + b - (c + a) + k) - lgamma(a + b + c + e + 1) + lgamma(c + a + 1) + lgamma(b + e + 1)), lambda l: l <= seen + 1e-7), lambda l: exp(l))) AS p
    FROM (SELECT *, lgamma(c + e + 1) - lgamma_(e) - lgamma_(c) + lgamma(a + b + 1) - lgamma_(a) - lgamma_(b) - lgamma(a + b + c + e + 1) + lgamma(c + a + 1) + lgamma(b + e + 1) AS seen
      FROM (SELECT CAST(count(*) FILTER ({flag} = 1 AND {outcome} = 1) AS BIGINT) AS a, CAST(count(*) FILTER ({flag} = 1 AND {outcome} = 0) AS BIGINT) AS b, CAST(count(*) FILTER ({flag} = 0 AND {outcome} = 1) AS BIGINT) AS c, CAST(count(*) FILTER ({flag} = 0 AND {outcome} = 0) AS BIGINT) AS e FROM {source})))"""


def _fisher_sql(source: str, flag: str, outcome: str) -> str:
    import re
    text = FISHER.replace("{source}", source).replace("{flag}", flag).replace("{outcome}", outcome)
    return re.sub(r"lgamma_\(([^()]*(?:\([^()]*\)[^()]*)*)\)", r"lgamma((\1) + 1)", text)


GREAT = "(SELECT CAST(post_year IN (2021, 2022) AS INT) AS great, reversal, doc_id, event_type FROM enriched WHERE domain = 'career')"


@query("side:s rate:f n:i ci_lower:f ci_upper:f", f"""
  WITH g AS (SELECT CASE WHEN great = 1 THEN 'in' ELSE 'out' END AS side, reversal, doc_id FROM {GREAT}), {sql.replicates('g', 'side, reversal', 'doc_id', 2000)},
       m AS (SELECT side, rep, sum(w * reversal) / sum(w) AS stat FROM drawn GROUP BY ALL)
  SELECT side, rate, n, ci_lower, ci_upper FROM (SELECT side, avg(reversal) AS rate, count(*) AS n FROM g GROUP BY 1)
    JOIN (SELECT side, quantile_cont(stat, 0.025) AS ci_lower, quantile_cont(stat, 0.975) AS ci_upper FROM m GROUP BY 1) USING (side)""", RICH)
def two_group_intervals(spark, d):
    """The two rates of the report with their intervals."""
    return stats.two_group_intervals(_great(spark, d), "great", "reversal", "doc_id")


@query("event_type:s rate_in:f n_in:i rate_out:f n_out:i",
       f"""SELECT event_type, avg(reversal) FILTER (great = 1) AS rate_in, count(*) FILTER (great = 1) AS n_in, avg(reversal) FILTER (great = 0) AS rate_out,
             count(*) FILTER (great = 0) AS n_out FROM {GREAT} WHERE event_type <> 'unknown' GROUP BY event_type HAVING count(*) > 20""", RICH)
def two_group_nested(spark, d):
    """The report's comparison once more inside each kind of event that has more than 20 posts."""
    return stats.two_group_nested(_great(spark, d).where("event_type <> 'unknown'"), "great", "reversal", "event_type")


def _great(spark, d):
    return layer(spark, d).where("domain = 'career'").withColumn("great", F.col("post_year").isin(2021, 2022).cast("int"))


@query("rate_in:f n_in:i rate_out:f n_out:i odds_ratio:f p_value:f",
       _fisher_sql("(SELECT CAST(post_year IN (2021, 2022) AS INT) AS great, reversal FROM structured WHERE domain = 'career')", "great", "reversal"), BASE)
def two_group_report(spark, d):
    return stats.two_group_report(_great(spark, d), "great", "reversal")


@query("n11:i n10:i n01:i n00:i chi2:f p_value:f",
       f"SELECT *, {sql.chi2_p('chi2', '1')} AS p_value FROM (SELECT *, CASE WHEN n10 + n01 > 0 THEN (abs(n10 - n01) - 1.0) ** 2 / (n10 + n01) ELSE 0 END AS chi2 FROM (" +
       "SELECT " + ", ".join(f"count(*) FILTER (quality = {a} AND toxic = {b}) AS n{a}{b}" for a in (1, 0) for b in (1, 0)) + " FROM labels))")
def mcnemar_labels(spark, d):
    return stats.mcnemar(table(spark, d, "labels"), "quality", "toxic")


@query("n:i agreement:f kappa:f n00:i n01:i n10:i n11:i rate_a:f rate_b:f only_a:i only_b:i", """
  SELECT *, n10 AS only_a, n01 AS only_b, (n11 + n00) / n AS agreement, ((n11 + n00) / n - pe) / (1 - pe) AS kappa FROM (
    SELECT *, (n11 + n10) / n AS rate_a, (n11 + n01) / n AS rate_b, ((n11 + n10) / n) * ((n11 + n01) / n) + ((n00 + n01) / n) * ((n00 + n10) / n) AS pe FROM (
      SELECT CAST(count(*) AS DOUBLE) AS n, """ + ", ".join(f"count(*) FILTER (quality = {a} AND toxic = {b}) AS n{a}{b}" for a in (1, 0) for b in (1, 0)) + " FROM labels))")
def label_kappa(spark, d):
    return stats.agreement(table(spark, d, "labels"), "quality", "toxic")


# --- ranks --------------------------------------------------------------------------
MW = "u:f z:f effect:f n_first:i n_second:i p_value:f"


@query(MW, sql.mann_whitney("(SELECT n_chars, quality FROM documents JOIN labels USING (doc_id))", "n_chars", "quality", 0, 1))
def mann_whitney_length(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return stats.mann_whitney(rows, "n_chars", "quality", 0, 1)


@query(MW, sql.mann_whitney("(SELECT compound, reversal FROM sentiment JOIN structured USING (id))", "round(compound, 9)", "reversal", 0, 1), SENTIMENT)
def mann_whitney_sentiment(spark, d):
    # equal sums in another order differ in the last digits, so ties are made at nine digits
    return stats.mann_whitney(layer(spark, d).withColumn("x", F.round("vader_compound", 9)), "x", "reversal", 0, 1)


@query(MW, sql.mann_whitney("lineitem_f", "l_extendedprice", "flag", 1, 0), ["lineitem_f AS (SELECT l_extendedprice, CAST(l_returnflag = 'R' AS INT) AS flag FROM lineitem)"])
def mann_whitney_price(spark, d):
    rows = table(spark, d, "lineitem").select("l_extendedprice", (F.col("l_returnflag") == "R").cast("int").alias("flag"))
    return stats.mann_whitney(rows, "l_extendedprice", "flag", 1, 0)


@query(MW + " median_gap:f", "SELECT w.*, (SELECT median(time_to_regret_days) FILTER (reversal = 0) - median(time_to_regret_days) FILTER (reversal = 1) FROM enriched) AS median_gap FROM ("
       + sql.mann_whitney("enriched", "time_to_regret_days", "reversal", 1, 0) + ") w", RICH)
def duration_by_outcome(spark, d):
    rows = layer(spark, d).where("time_to_regret_days IS NOT NULL").select("time_to_regret_days", "reversal")
    middle = ranks.quantiles(rows, "time_to_regret_days", {"m": 0.5}, ["reversal"])
    gap = middle.agg((F.max(F.when(F.col("reversal") == 0, F.col("m"))) - F.max(F.when(F.col("reversal") == 1, F.col("m")))).alias("g")).scalar()
    return stats.mann_whitney(rows, "time_to_regret_days", "reversal", 1, 0).withColumn("median_gap", gap)


def _kruskal_sql(source: str, value: str, group: str) -> str:
    return f"""SELECT h, k - 1 AS dof, n, {sql.chi2_p('h', '(k - 1)')} AS p_value FROM (
      SELECT (12.0 / (n * (n + 1)) * sum(r * r / m) - 3 * (n + 1)) / (1 - any_value(ties) / (n * n * n - n)) AS h, count(*) AS k, n FROM (
        SELECT {group}, sum(rk) AS r, CAST(count(*) AS DOUBLE) AS m, any_value(n) AS n, any_value(ties) AS ties FROM (
          SELECT *, CAST(count(*) OVER () AS DOUBLE) AS n, sum(CAST(t AS DOUBLE) * t - 1) OVER () AS ties FROM ({sql.midranks(source, value)})) GROUP BY {group}) GROUP BY n)"""


@query("h:f dof:i n:i p_value:f", _kruskal_sql("events", "value", "event_type"))
def kruskal_events(spark, d):
    return stats.kruskal(table(spark, d, "events"), "value", "event_type")


@query("h:f dof:i n:i p_value:f", _kruskal_sql("enriched", "social_embed_score", "domain"), RICH)
def kruskal_social(spark, d):
    return stats.kruskal(layer(spark, d), "social_embed_score", "domain", ["career", "immigration", "relationships"])


def _points(feature: str) -> str:
    return f"SELECT '{feature}' AS feature, corr({feature}, reversal) AS r, count(*) AS n FROM enriched"


@query("feature:s r:f n:i t:f p_value:f", f"SELECT *, {sql.t_p('abs(t)', '(n - 2)')} AS p_value FROM (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM ({' UNION ALL '.join(map(_points, PSY))}))", RICH)
def point_biserial_features(spark, d):
    return stats.point_biserial(layer(spark, d), PSY, "reversal")


@query("event_type:s domain:s chi2:f p_value:f", f"""
  WITH c AS (SELECT domain, event_type, CAST(count(*) FILTER (reversal = 1) AS DOUBLE) AS hits, CAST(count(*) AS DOUBLE) AS n FROM enriched GROUP BY ALL),
    r AS (SELECT *, n - hits AS miss, sum(n) OVER w AS total, sum(hits) OVER w AS all_hits FROM c WINDOW w AS (PARTITION BY domain)),
    t AS (SELECT domain, event_type, greatest(0, abs(hits - e) - least(abs(hits - e), 0.5)) ** 2 * (1 / n + 1 / (total - n)) * (1 / all_hits + 1 / (total - all_hits)) * total AS chi2
      FROM (SELECT *, n * all_hits / total AS e FROM r) WHERE total > n AND all_hits > 0 AND total > all_hits),
    p AS (SELECT *, {sql.chi2_p('chi2', '1')} AS p_value FROM t)
  SELECT * FROM (SELECT * FROM p WHERE p_value < 0.1 ORDER BY round(p_value, 9), domain, event_type LIMIT 15)
  UNION ALL SELECT * FROM (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p WHERE p_value < 0.1) ORDER BY round(p_value, 9), domain, event_type LIMIT 10)""", RICH)
def notable_event_types(spark, d):
    """Each kind of event against all others of its domain: the tests to show."""
    counts = layer(spark, d).groupBy("domain", "event_type").agg(F.sum("reversal").alias("hits"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("domain")
    counts = counts.withColumn("all_hits", F.sum("hits").over(whole)).withColumn("all", F.sum("n").over(whole))
    cells = ((1, 1, "hits"), (1, 0, "n - hits"), (0, 1, "all_hits - hits"), (0, 0, "all - all_hits - n + hits"))
    sides = counts.select("domain", "event_type", F.inline(F.array(*[
        F.struct(F.lit(own).alias("own"), F.lit(hit).alias("hit"), F.expr(c).cast("bigint").alias("n")) for own, hit, c in cells]))).where("n > 0")
    tests = stats.chi_square_of_cells(sides, "own", "hit", ["domain", "event_type"]).where("chi2 IS NOT NULL")
    return stats.notable(tests, [F.round("p_value", 9), "domain", "event_type"])


@query("feature:s smd:f", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, (avg({f}) FILTER (seg = 1) - avg({f}) FILTER (seg = 0)) / greatest(sqrt((var_pop({f}) FILTER (seg = 1) + var_pop({f}) FILTER (seg = 0)) / 2), 1e-10) AS smd FROM (SELECT *, CAST(l_returnflag = 'R' AS INT) AS seg FROM lineitem)"
    for f in ("l_quantity", "l_extendedprice", "l_discount")))
def covariate_balance(spark, d):
    rows = table(spark, d, "lineitem").withColumn("seg", (F.col("l_returnflag") == "R").cast("int"))
    return stats.mean_difference(rows, ["l_quantity", "l_extendedprice", "l_discount"], "seg")


# --- intervals ----------------------------------------------------------------------
REPLICATES = 2_000


def _ends(by: str, source: str = "m") -> str:
    return f"SELECT {by}, quantile_cont(stat, 0.025) AS ci_lower, quantile_cont(stat, 0.975) AS ci_upper FROM {source} GROUP BY 1"


@query("event_type:s mean:f n:i ci_lower:f ci_upper:f", f"""
  WITH {sql.replicates('events', 'event_type, value', 'event_id', REPLICATES)},
       m AS (SELECT event_type, rep, sum(w * value) / sum(w) AS stat FROM drawn GROUP BY ALL)
  SELECT event_type, mean, n, ci_lower, ci_upper FROM (SELECT event_type, avg(value) AS mean, count(value) AS n FROM events GROUP BY 1) JOIN ({_ends('event_type')}) USING (event_type)""")
def bootstrap_means(spark, d):
    return resample.mean_interval(table(spark, d, "events"), "event_type", "event_id", "value", reps=REPLICATES)


@query("domain:s ci_lower:f ci_upper:f", f"""
  WITH {sql.replicates('(SELECT domain, doc_id, urgency_score AS x, reversal AS y FROM enriched)', 'domain, x, y', 'doc_id', REPLICATES)},
       s AS (SELECT domain, rep, CAST(sum(w) AS DOUBLE) AS n, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * y * y) AS yy, sum(w * x * y) AS xy FROM drawn GROUP BY ALL),
       m AS (SELECT domain, rep, (xy - x * y / n) / nullif(sqrt((xx - x * x / n) * (yy - y * y / n)), 0) AS stat FROM s) {_ends('domain')}""", RICH)
def bootstrap_correlations(spark, d):
    """A statistic that is none of the ready ones: urgency against outcome, as an expression over weighted sums."""
    x, y, s = F.col("urgency_score"), F.col("reversal"), F.col
    spread = (s("xx") - s("x") * s("x") / s("n")) * (s("yy") - s("y") * s("y") / s("n"))
    stat = (s("xy") - s("x") * s("y") / s("n")) / F.nullif(F.sqrt(spread), F.lit(0.0))
    drawn = resample.bootstrap(layer(spark, d), ["domain"], "doc_id", {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}, stat, REPLICATES)
    return resample.interval(drawn, ["domain"])


@query("domain:s rate:f n:i ci_lower:f ci_upper:f", f"""
  WITH {sql.replicates('enriched', 'domain, reversal', 'doc_id', REPLICATES)}, m AS (SELECT domain, rep, sum(w * reversal) / sum(w) AS stat FROM drawn GROUP BY ALL)
  SELECT domain, rate, n, CASE WHEN n >= 10 THEN ci_lower END AS ci_lower, CASE WHEN n >= 10 THEN ci_upper END AS ci_upper
  FROM (SELECT domain, avg(reversal) AS rate, count(*) AS n FROM enriched GROUP BY 1) JOIN ({_ends('domain')}) USING (domain)""", RICH)
def reversal_rate_intervals(spark, d):
    return resample.rate_interval(layer(spark, d), "domain", "doc_id", "reversal", REPLICATES, min_n=10)


@query("domain:s median:f n:i ci_lower:f ci_upper:f", f"""
  WITH known AS (SELECT domain, doc_id, time_to_regret_days AS v FROM enriched WHERE time_to_regret_days IS NOT NULL), {sql.replicates('known', 'domain, v', 'doc_id', REPLICATES)},
       run AS (SELECT domain, rep, v, sum(sum(w)) OVER (PARTITION BY domain, rep ORDER BY v) AS upto, sum(sum(w)) OVER (PARTITION BY domain, rep) AS total FROM drawn GROUP BY domain, rep, v),
       m AS (SELECT domain, rep, (min(v) FILTER (upto > (total - 1) // 2) + min(v) FILTER (upto > total // 2)) / 2.0 AS stat FROM run GROUP BY ALL)
  SELECT domain, median, n, CASE WHEN n >= 10 THEN ci_lower END AS ci_lower, CASE WHEN n >= 10 THEN ci_upper END AS ci_upper
  FROM (SELECT domain, median(v) AS median, count(*) AS n FROM known GROUP BY 1) JOIN ({_ends('domain')}) USING (domain)""", RICH)
def duration_median_intervals(spark, d):
    return resample.median_interval(layer(spark, d), "domain", "doc_id", "time_to_regret_days", REPLICATES)


# --- survival -----------------------------------------------------------------------
TIMES = """times AS (SELECT o_orderstatus AS grp, date_diff('day', o_orderdate, l_shipdate) AS days, CAST(l_returnflag = 'R' AS INT) AS event, l_quantity, l_discount
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE date_diff('day', o_orderdate, l_shipdate) > 0)"""
# days between two dates of a calendar: a few thousand distinct values
MAX_DAYS = 40_000


def _times(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate").join(
        table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", "l_returnflag", "l_quantity", "l_discount"), F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.select(F.col("o_orderstatus").alias("grp"), F.datediff("l_shipdate", "o_orderdate").alias("days"),
                       (F.col("l_returnflag") == "R").cast("int").alias("event"), "l_quantity", "l_discount").where("days > 0")


def _km_sql(source: str, time: str, event: str, by: str) -> str:
    return f"""SELECT {by}, {time}, at_risk, events, CASE WHEN min(1 - events / at_risk) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN events < at_risk THEN ln(1 - events / at_risk) ELSE 0 END) OVER w) END AS survival
      FROM (SELECT {by}, {time}, events, sum(n) OVER (PARTITION BY {by} ORDER BY {time} DESC) AS at_risk FROM (SELECT {by}, {time}, count(*) AS n, CAST(sum({event}) AS DOUBLE) AS events FROM {source} WHERE {time} IS NOT NULL GROUP BY 1, 2))
      WINDOW w AS (PARTITION BY {by} ORDER BY {time})"""


@query("grp:s days:i at_risk:i events:i survival:f", _km_sql("times", "days", "event", "grp"), [TIMES])
def kaplan_meier_orders(spark, d):
    return survival.kaplan_meier(_times(spark, d), "days", "event", ["grp"], domain=MAX_DAYS)


@query("era:s time_to_regret_days:i at_risk:i events:i survival:f",
       _km_sql(f"(SELECT {ERA} AS era, time_to_regret_days, reversal FROM enriched)", "time_to_regret_days", "reversal", "era"), RICH)
def kaplan_meier_eras(spark, d):
    rows = layer(spark, d).withColumn("era", bins.era(F.col("post_year")))
    return survival.kaplan_meier(rows, "time_to_regret_days", "reversal", ["era"], domain=3651, min_n=10)


@query("grp:s n:i median_time:f event_rate:f", "SELECT grp, count(*) AS n, median(days) AS median_time, avg(event) AS event_rate FROM times GROUP BY grp HAVING count(*) >= 10", [TIMES])
def survival_summary(spark, d):
    return survival.curve_summary(_times(spark, d), "days", "event", "grp", domain=MAX_DAYS)


def _log_rank_sql(source: str, time: str, event: str, group: str, names: list[str]) -> str:
    parts = []
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            parts.append(f"""SELECT '{a}' AS a, '{b}' AS b, sum(d1 - d * n1 / n) ** 2 / sum(CASE WHEN n > 1 THEN n1 * n2 * d * (n - d) / (n * n * (n - 1)) END) AS chi2 FROM (
              SELECT *, n1 + n2 AS n FROM (SELECT t, d1, d1 + d2 AS d, sum(c1) OVER (ORDER BY t DESC) AS n1, sum(c2) OVER (ORDER BY t DESC) AS n2 FROM (
                SELECT {time} AS t, CAST(count(*) FILTER ({group} = '{a}' AND {event} = 1) AS DOUBLE) AS d1, CAST(count(*) FILTER ({group} = '{b}' AND {event} = 1) AS DOUBLE) AS d2,
                       CAST(count(*) FILTER ({group} = '{a}') AS DOUBLE) AS c1, CAST(count(*) FILTER ({group} = '{b}') AS DOUBLE) AS c2
                FROM {source} WHERE {group} IN ('{a}', '{b}') AND {time} IS NOT NULL GROUP BY 1)))""")
    return f"SELECT *, {sql.chi2_p('chi2', '1')} AS p_value FROM ({' UNION ALL '.join(parts)})"


@query("a:s b:s chi2:f p_value:f", _log_rank_sql("times", "days", "event", "grp", ["F", "O", "P"]), [TIMES])
def log_rank_orders(spark, d):
    return survival.log_rank_pairs(_times(spark, d), "days", "event", "grp", ["F", "O", "P"], domain=MAX_DAYS)


@query("a:s b:s chi2:f p_value:f", _log_rank_sql("enriched", "time_to_regret_days", "reversal", "domain", ["career", "immigration", "relationships"]), RICH)
def log_rank_domains(spark, d):
    return survival.log_rank_pairs(layer(spark, d).where("time_to_regret_days > 0"), "time_to_regret_days", "reversal", "domain", domain=3651)


# coefficients at which likelihood and gradient are compared
STATED = {"l_quantity": 0.01, "l_discount": 0.5}


@query("term:s score:f log_likelihood:f n:i events:i", f"""
  WITH RECURSIVE {TIMES}, r AS (SELECT *, exp({STATED['l_quantity']}::DOUBLE * l_quantity + {STATED['l_discount']}::DOUBLE * l_discount) AS w FROM times),
    per AS (SELECT days, sum(w) AS s, sum(w * l_quantity) AS sq, sum(w * l_discount) AS sd, sum(event) AS m, sum(w * event) AS d, sum(w * event * l_quantity) AS dq,
      sum(w * event * l_discount) AS dd, sum(event * ln(w)) AS eta, sum(event * l_quantity) AS xq, sum(event * l_discount) AS xd FROM r GROUP BY days),
    risk AS (SELECT * REPLACE (sum(s) OVER w AS s, sum(sq) OVER w AS sq, sum(sd) OVER w AS sd) FROM per WINDOW w AS (ORDER BY days DESC)),
    steps AS (SELECT *, k / CAST(m AS DOUBLE) AS f FROM (SELECT *, unnest(range(CAST(m AS BIGINT))) AS k FROM risk WHERE m > 0)),
    added AS (SELECT sum(ln(s - f * d)) AS l, sum((sq - f * dq) / (s - f * d)) AS gq, sum((sd - f * dd) / (s - f * d)) AS gd FROM steps),
    plain AS (SELECT sum(eta) AS eta, sum(xq) AS xq, sum(xd) AS xd FROM per), size AS (SELECT count(*) AS n, sum(event) AS events FROM times)
  SELECT 'l_quantity' AS term, xq - gq AS score, eta - l AS log_likelihood, n, events FROM added, plain, size
  UNION ALL SELECT 'l_discount', xd - gd, eta - l, n, events FROM added, plain, size""")
def cox_score_orders(spark, d):
    """Efron likelihood and gradient at stated coefficients, risk sums in several buckets."""
    return survival.cox_score(_times(spark, d), "days", "event", list(STATED), list(STATED.values()), times=500)


@query("term:s coef:f hazard_ratio:f se:f p_value:f n:i events:i converged:b")
def cox_orders(spark, d):
    fit = survival.cox_fit(_times(spark, d), "days", "event", ["l_quantity", "l_discount"])
    return survival.cox_table(spark, fit)


@query("term:s coef:f hazard_ratio:f se:f p_value:f n:i events:i converged:b")
def cox_posts(spark, d):
    rows = by_rows(model_layer(spark, d)[0]).where("time_to_regret_days > 0")
    rows, dummies = stats.dummies(rows, "domain", "domain", ["career", "immigration", "relationships"])
    rows, moods = stats.dummies(rows, "emotion", "emo", ["anger", "disgust", "fear", "joy", "neutral", "sadness", "surprise"])
    covariates = ["vader_compound", "vader_neg", "urgency_score", "log_post_length", "topic", *dummies, *moods]
    fit = survival.cox_fit(rows.select("time_to_regret_days", "reversal", *covariates), "time_to_regret_days", "reversal", covariates, penalizer=0.01)
    return survival.cox_table(spark, fit)


@query("concordance:f pairs:f", """
  SELECT sum(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) / count(*) AS concordance, count(*) AS pairs FROM
    (SELECT time_to_regret_days AS t, reversal AS e, hedging_score + urgency_score AS risk FROM enriched WHERE time_to_regret_days > 0) a JOIN
    (SELECT time_to_regret_days AS t, reversal AS e, hedging_score + urgency_score AS risk FROM enriched WHERE time_to_regret_days > 0) b
    ON a.e = 1 AND (a.t < b.t OR (a.t = b.t AND b.e = 0))""", RICH)
def concordance_posts(spark, d):
    rows = layer(spark, d).where("time_to_regret_days > 0").withColumn("risk", F.col("hedging_score") + F.col("urgency_score"))
    return survival.concordance(rows, "time_to_regret_days", "reversal", "risk")


# --- evaluation ---------------------------------------------------------------------
SCORES = "scores AS (SELECT CAST(l_returnflag = 'R' AS INT) AS label, (l_extendedprice % 1000) / 1000.0::DOUBLE AS score FROM lineitem)"


def _scores(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("label"),
                                              (F.col("l_extendedprice") % 1000 / 1000.0).alias("score"))


@query("auc:f n_pos:i n_neg:i", f"SELECT (sum(rk) FILTER (label = 1) - p * (p + 1) / 2) / (p * n) AS auc, p AS n_pos, n AS n_neg FROM (SELECT *, CAST(sum(label) OVER () AS DOUBLE) AS p, CAST(sum(1 - label) OVER () AS DOUBLE) AS n FROM ({sql.midranks('scores', 'score')})) GROUP BY p, n", [SCORES])
def auc_exact(spark, d):
    return metrics.auc(_scores(spark, d), "label", "score")


PR = """pts AS (SELECT score, pos, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS said, sum(pos) OVER () AS total FROM (SELECT score, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM scores GROUP BY score))"""


@query("average_precision:f", "SELECT sum(pos / total * tp / said) AS average_precision FROM pts", [SCORES, PR])
def average_precision(spark, d):
    return metrics.average_precision(_scores(spark, d), "label", "score")


@query("threshold:f tp:i fp:i precision:f recall:f fpr:f", """
  SELECT score AS threshold, tp, said - tp AS fp, tp / said AS precision, tp / total AS recall, (said - tp) / (m - total) AS fpr FROM (
    SELECT score, sum(pos) OVER w AS tp, sum(n) OVER w AS said, sum(pos) OVER () AS total, sum(n) OVER () AS m FROM (
      SELECT l_discount AS score, CAST(sum(CAST(l_returnflag = 'R' AS INT)) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY 1) WINDOW w AS (ORDER BY score DESC))""")
def roc_and_pr_points(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), F.col("l_discount").alias("score"))
    return metrics.curve(rows, "label", "score")


@query("bin:i mean_score:f positive_share:f n:i", "SELECT " + " + ".join(f"CAST(score > {e!r}::DOUBLE AS INT)" for e in metrics.CALIBRATION_EDGES) + " AS bin, avg(score) AS mean_score, avg(label) AS positive_share, count(*) AS n FROM scores GROUP BY 1", [SCORES])
def calibration_curve(spark, d):
    return metrics.calibration(_scores(spark, d), "label", "score")


REPORT = """
  WITH c AS (SELECT label, CAST(score >= 0.5 AS INT) AS said FROM scores),
  per AS (SELECT k AS class, count(*) FILTER (label = k AND said = k) AS tp, count(*) FILTER (said = k) AS s, count(*) FILTER (label = k) AS support FROM c, (VALUES (0), (1)) v(k) GROUP BY k),
  m AS (SELECT CAST(class AS VARCHAR) AS class, tp / s AS precision, tp / support AS recall, 2 * tp / CAST(s + support AS DOUBLE) AS f1, support, tp FROM per)
  SELECT class, precision, recall, f1, support FROM m
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m
  UNION ALL SELECT 'accuracy', sum(tp) / sum(support), sum(tp) / sum(support), sum(tp) / sum(support), sum(support) FROM m"""


@query("class:s precision:f recall:f f1:f support:i", REPORT, [SCORES])
def classification_report(spark, d):
    rows = _scores(spark, d).withColumn("said", (F.col("score") >= 0.5).cast("int"))
    return metrics.classification_report(rows, "label", "said")


SWEEP = "sweep AS (SELECT t AS threshold, 2 * count(*) FILTER (score >= t AND label = 1) / CAST(count(*) FILTER (score >= t) + count(*) FILTER (label = 1) AS DOUBLE) AS f1 FROM scores, (SELECT unnest([" + ", ".join(f"{t!r}::DOUBLE" for t in metrics.F1_THRESHOLDS) + "]) AS t) GROUP BY t)"


@query("threshold:f f1:f", "SELECT * FROM sweep", [SCORES, SWEEP])
def f1_sweep(spark, d):
    return metrics.f1_sweep(_scores(spark, d), "label", "score")


@query("threshold:f f1:f", "SELECT * FROM sweep ORDER BY f1 DESC, threshold LIMIT 1", [SCORES, SWEEP])
def best_f1_threshold(spark, d):
    return metrics.best_threshold(metrics.f1_sweep(_scores(spark, d), "label", "score"))


def _auc_sql(source: str) -> str:
    return f"""
  WITH {sql.replicates(source, 'label, score', 'key', REPLICATES)},
       c AS (SELECT rep, score, CAST(sum(w * label) AS DOUBLE) AS p, CAST(sum(w * (1 - label)) AS DOUBLE) AS n FROM drawn GROUP BY ALL),
       r AS (SELECT rep, p, n, sum(n) OVER (PARTITION BY rep ORDER BY score ROWS UNBOUNDED PRECEDING) AS upto FROM c),
       m AS (SELECT rep, sum(p * (upto - n / 2)) / (sum(p) * sum(n)) AS stat FROM r GROUP BY rep HAVING sum(p) > 0 AND sum(n) > 0)
  SELECT coalesce(quantile_cont(stat, 0.025), 0.5) AS ci_lower, coalesce(quantile_cont(stat, 0.975), 0.5) AS ci_upper, count(*) AS reps FROM m"""


@query("ci_lower:f ci_upper:f reps:i", _auc_sql("(SELECT reversal AS label, hedging_score + urgency_score AS score, doc_id AS key FROM enriched)"), RICH)
def auc_interval_posts(spark, d):
    rows = layer(spark, d).select("reversal", "doc_id", (F.col("hedging_score") + F.col("urgency_score")).alias("risk"))
    return resample.auc_interval(rows, "reversal", "risk", "doc_id", REPLICATES)


# without SQL: a window over 2,000 times all rows; auc_interval_posts asks the same of fewer rows
@query("ci_lower:f ci_upper:f reps:i")
def auc_interval(spark, d):
    return resample.auc_interval(_scores(spark, d), "label", "score", "key", reps=REPLICATES)

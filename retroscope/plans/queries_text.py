"""Queries on terms, topics and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import terms, topics, vectors
from retroscope.operators.relational import mean_pivot, top_per_group
from retroscope.plans import oracle as sql
from retroscope.plans.catalogue import documents, layer, model_layer, query
from retroscope.plans.queries_posts import BASE, RICH
from retroscope.sources.readers import table


def _words_cte(source: str, text: str, extra: str) -> list[str]:
    return [f"words AS (SELECT {extra}, unnest({sql.without_stopwords(sql.tokens(text))}) AS term FROM {source})"]


def _log_odds_sql(side: str, a, b, floor: int = 10) -> str:
    return f"""SELECT term, delta AS log_odds, delta / sqrt(1.0 / (a + 1) + 1.0 / (b + 1)) AS z_score, a AS freq_a, b AS freq_b FROM (
      SELECT *, ln((a + 1) / CAST(na + v AS DOUBLE)) - ln((b + 1) / CAST(nb + v AS DOUBLE)) AS delta FROM (
        SELECT *, sum(a) OVER () AS na, sum(b) OVER () AS nb, count(*) OVER () AS v FROM (
          SELECT term, count(*) FILTER ({side} = {a}) AS a, count(*) FILTER ({side} = {b}) AS b FROM words WHERE {side} IN ({a}, {b}) GROUP BY term))) WHERE a + b >= {floor}"""


LOG_ODDS = "term:s log_odds:f z_score:f freq_a:i freq_b:i"


@query(LOG_ODDS, _log_odds_sql("quality", 1, 0), _words_cte("(SELECT quality, text FROM documents JOIN labels USING (doc_id))", "text", "quality"))
def log_odds_quality(spark, d):
    rows = documents(spark, d).select("doc_id", "text").join(table(spark, d, "labels"), "doc_id")
    return terms.log_odds(rows, tx.contrast_words("text"), F.col("quality"))


@query(LOG_ODDS, _log_odds_sql("reversal", 1, 0), [*BASE, *_words_cte("structured", "spoken", "reversal")])
def log_odds_reversal(spark, d):
    return terms.log_odds(layer(spark, d), tx.contrast_words("spoken"), F.col("reversal"))


SIDE = "CASE WHEN time_to_regret_days < 180 THEN 1 WHEN time_to_regret_days > 365 THEN 0 END"


@query(LOG_ODDS, _log_odds_sql("side", 1, 0) + f" AND (SELECT least(count(*) FILTER ({SIDE} = 1), count(*) FILTER ({SIDE} = 0)) > 50 FROM enriched)",
       [*RICH, *_words_cte(f"(SELECT spoken, {SIDE} AS side FROM enriched)", "spoken", "side")])
def log_odds_early_late(spark, d):
    return terms.log_odds_early_late(layer(spark, d), tx.contrast_words("spoken"), "time_to_regret_days")


LANGS = ["de", "en", "es", "fr"]


@query("group:s term:s log_odds:f z_score:f freq_a:i freq_b:i rank:i", """
  SELECT "group", term, delta AS log_odds, z AS z_score, a AS freq_a, b AS freq_b, rank FROM (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(z, 9) DESC, term) AS rank FROM (
    SELECT *, delta / sqrt(1.0 / (a + 1) + 1.0 / (b + 1)) AS z FROM (SELECT *, ln((a + 1) / CAST(na + v AS DOUBLE)) - ln((b + 1) / CAST(nb + v AS DOUBLE)) AS delta FROM (
      SELECT g."group", t.term, count(*) FILTER (w.lang = g."group") AS a, count(*) FILTER (w.lang <> g."group") AS b, any_value(t.v) AS v, any_value(g.na) AS na, any_value(t.total - g.na) AS nb
      FROM words w JOIN (SELECT term, count(*) OVER () AS v, sum(c) OVER () AS total FROM (SELECT term, count(*) AS c FROM words GROUP BY term)) t ON w.term = t.term,
           (SELECT lang AS "group", count(*) AS na FROM words GROUP BY lang) g GROUP BY 1, 2)) WHERE a + b >= 10)) WHERE rank <= 15""",
       _words_cte("documents", "text", "lang"))
def log_odds_by_language(spark, d):
    scored = terms.log_odds_one_vs_rest(documents(spark, d), tx.contrast_words("text"), "lang", LANGS)
    return top_per_group(scored, ["group"], [F.desc(F.round("z_score", 9)), F.col("term")], 15)


def _rates_sql(source: str, text: str, by: str, words: list[str]) -> str:
    parts = [f"SELECT {by}, '{w}' AS word, count(*) FILTER (t = '{w}') AS n, count(*) FILTER (t = '{w}') / CAST(count(*) AS DOUBLE) * 1000 AS per_1000 FROM tk GROUP BY {by}" for w in words]
    return " UNION ALL ".join(parts)


@query("domain:s word:s n:i per_1000:f", _rates_sql("structured", "spoken", "domain", lex.MODAL_VERBS),
       [*BASE, f"tk AS (SELECT domain, unnest({sql.tokens('spoken')}) AS t FROM structured)"])
def modal_rates_by_domain(spark, d):
    return terms.word_rates(layer(spark, d), "domain", tx.tokens("spoken"))


@query("reversal:i word:s n:i per_1000:f", _rates_sql("structured", "spoken", "reversal", lex.MODAL_VERBS),
       [*BASE, f"tk AS (SELECT reversal, unnest({sql.tokens('spoken')}) AS t FROM structured)"])
def modal_rates_by_outcome(spark, d):
    return terms.word_rates(layer(spark, d), "reversal", tx.tokens("spoken"))


@query("lang:s term:s n:i", "SELECT lang, term, count(*) AS n FROM words GROUP BY ALL", _words_cte("documents", "text", "lang"))
def term_counts_by_language(spark, d):
    return terms.term_counts(documents(spark, d), tx.contrast_words("text"), ["lang"])


# the English stop-words of Spark ML, as the operator has them by default
STOP = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had
having do does did doing a an the and but if or because as until while of at by for with about against between into through
during before after above below to from up down in out on off over under again further then once here there when where why how
all any both each few more most other some such no nor not only own same so than too very s t can will just don should now
i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't
can't couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's would""".split()
_STOPPED = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP)


def _grams(source: str, key: str, text: str) -> str:
    return f"""runs AS (SELECT {key}, list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOPPED})) AS r FROM {source}),
  grams AS (SELECT {key}, unnest(list_concat(r, list_transform(range(1, len(r)), lambda i: r[i] || ' ' || r[i + 1]))) AS term FROM runs),
  tf AS (SELECT {key}, term, count(*) AS tf FROM grams GROUP BY ALL),
  vocab AS (SELECT term, count(*) AS df, sum(tf) AS c FROM tf GROUP BY term HAVING count(*) >= 5 ORDER BY c DESC, term LIMIT 10000),
  raw AS (SELECT {key}, term, tf, tf * (ln((1.0 + (SELECT count(*) FROM {source})) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
  weights AS (SELECT {key}, term, tf, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM raw)"""


GRAMS = _grams("documents", "doc_id", "text")


def _weights(spark, d):
    return terms.tfidf(documents(spark, d), "doc_id", tx.terms_and_bigrams("text"), min_df=5, max_features=10_000)


@query("term:s docs:i weight:f", "SELECT term, count(*) AS docs, sum(weight) AS weight FROM weights GROUP BY term", [GRAMS])
def tfidf_weights(spark, d):
    return terms.term_totals(documents(spark, d), tx.terms_and_bigrams("text"), 5, 10_000)


@query("doc_id:i length:f", "SELECT doc_id, sum(weight * weight) AS length FROM weights GROUP BY doc_id", [GRAMS])
def tfidf_row_lengths(spark, d):
    return _weights(spark, d).groupBy("doc_id").agg(F.sum(F.col("weight") * F.col("weight")).alias("length"))


@query("cleaned_md5:s doc_id:i",
       r"SELECT doc_id, md5(" + sql.strip(r"regexp_replace(regexp_replace(text, 'http[^\s\x0b]+', '', 'g'), '" + sql.SPACES + "+', ' ', 'g')") + ") AS cleaned_md5 FROM documents")
def cleaned_texts(spark, d):
    rows = documents(spark, d).select("doc_id", tx.strip_urls("text").alias("t"))
    return rows.select("doc_id", F.md5(tx.collapse_spaces("t")).alias("cleaned_md5"))


@query("topic:i top_terms:s label:s n:i rate:f")
def nmf_topics(spark, d):
    """Topics of the kept posts with their size and reversal rate."""
    rows, names = model_layer(spark, d)
    sizes = rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.avg("reversal").alias("rate"))
    return names.join(sizes, "topic", "left")


@query("topic:i career:f immigration:f relationships:f")
def topic_reversal_by_domain(spark, d):
    """Reversal rate per topic and domain, 0 where a topic has no post of the domain."""
    rows, _ = model_layer(spark, d)
    return mean_pivot(rows, "topic", "domain", ["career", "immigration", "relationships"], "reversal")


# topics that are given; the terms among them that the posts hold often enough count
THEMES = [["quitting", "offer", "job", "manager", "interview", "resigned"], ["moving", "visa", "left", "family", "moved"],
          ["broke", "going", "cheated", "wish", "listened"], ["waiting", "pressure", "deadline", "rushed", "late"]]
_LOADS = ", ".join(f"coalesce(sum(weight) FILTER (term IN ({', '.join(map(sql.q, g))})), 0) / greatest(1, (SELECT count(*) FROM vocab WHERE term IN ({', '.join(map(sql.q, g))}))) AS w{i}, "
                   f"(SELECT count(*) FROM vocab WHERE term IN ({', '.join(map(sql.q, g))})) AS m{i}" for i, g in enumerate(THEMES))


@query("topic:i n:i load:f residual:f", f"""
  SELECT topic, count(*) AS n, sum(load) AS load, sum(residual) AS residual FROM (
    SELECT list_position(l, list_max(l)) - 1 AS topic, list_max(l) AS load, square - ({' + '.join(f'w{i} * w{i} * m{i}' for i in range(len(THEMES)))}) AS residual FROM (
      SELECT *, [{', '.join(f'w{i}' for i in range(len(THEMES)))}] AS l FROM (
        SELECT s.id, coalesce(sum(weight * weight), 0) AS square, {_LOADS} FROM structured s LEFT JOIN weights USING (id) GROUP BY s.id))) GROUP BY topic""",
       [*BASE, _grams("structured", "id", "spoken")])
def stated_topics(spark, d):
    """Loads, largest topic and loss of the posts under given topics: what a pass of the factorisation does."""
    packed, names = terms.tfidf_vectors(layer(spark, d), "id", tx.terms_and_bigrams("spoken"), 5, 10_000)
    found = topics.stated_model(names, THEMES).transform(packed, "id")
    return found.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum(F.array_max("loads")).alias("load"), F.sum("residual").alias("residual"))


DIM = 384
VECTORS = f"""said AS (SELECT id, unnest({sql.tokens('spoken')}) AS w FROM structured), slots AS (SELECT id, md5(w) AS m FROM said),
  held AS (SELECT m[1:4] AS kind, count(DISTINCT id) AS df FROM slots GROUP BY 1),
  cells AS (SELECT id, CAST('0x' || m[5:8] AS BIGINT) % {DIM} AS pos, sum(CASE WHEN m[9] < '8' THEN 1 ELSE -1 END * (ln(((SELECT count(*) FROM structured) + 1.0) / (df + 1)) + 1)) AS v
    FROM slots JOIN held ON kind = m[1:4] GROUP BY 1, 2),
  unit AS (SELECT id, pos, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS value FROM cells)"""


@query("id:s pos:i value:f", "SELECT * FROM unit WHERE abs(value) > 1e-9", [*BASE, VECTORS])
def sentence_vectors(spark, d):
    """Every part of the posts' vectors that is not zero, by batch inference with the fitted encoder."""
    rows, words = layer(spark, d), tx.tokens("spoken")
    encoder = vectors.fit_hashing(rows, words, DIM)
    made = vectors.encode(rows.select("id", vectors.joined(words).alias("words")), "words", encoder.load, element=T.DoubleType())
    return made.select("id", F.posexplode("embedding").alias("pos", "value")).where(F.abs("value") > 1e-9)


@query("id:s " + " ".join(f"emb_{i}:f" for i in range(10)))
def reduced_sentence_vectors(spark, d):
    return model_layer(spark, d)[0]


@query("component:i variance:f cumulative:f")
def pca_variance(spark, d):
    _, shares = topics.pca_reduce(table(spark, d, "embeddings"), "vec_id", "embedding", 50)
    return shares


@query("vec_id:i emb_0:f emb_9:f")
def pca_vectors(spark, d):
    scores, _ = topics.pca_reduce(table(spark, d, "embeddings"), "vec_id", "embedding", 50)
    return scores

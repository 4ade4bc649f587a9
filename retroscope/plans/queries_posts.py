"""Queries on the post layers: filters, labels, durations, events, scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import relational as rel
from retroscope.operators import resample, sentiment
from retroscope.plans import oracle as sql
from retroscope.plans import posts, scoring
from retroscope.plans.catalogue import documents, enriched, layer, query, structured
from retroscope.sources import comments, schemas, writers
from retroscope.sources.readers import table

BASE = [sql.POSTS, sql.FLAGGED, sql.STRUCTURED]
RICH = [*BASE, sql.ENRICHED]


@query("domain:s rate:f n:i",
       "SELECT domain, avg(reversal) AS rate, count(*) AS n FROM structured GROUP BY domain", BASE)
def reversal_rate_by_domain(spark, d):
    return rel.rates(structured(spark, d), ["domain"], "reversal")


@query("domain:s keep:b exclude:b n:i",
       "SELECT domain, keep, exclude, count(*) AS n FROM flagged GROUP BY ALL", [sql.POSTS, sql.FLAGGED])
def keep_and_exclude_flags(spark, d):
    made = posts.posts_of_documents(documents(spark, d))
    return made.withColumn("full_text", tx.full_text()).select(
        "domain", tx.any_pattern("full_text", lex.KEEP_PATTERNS).alias("keep"),
        tx.any_pattern("full_text", lex.EXCLUDE_PATTERNS).alias("exclude"),
    ).groupBy("domain", "keep", "exclude").agg(F.count(F.lit(1)).alias("n"))


@query("id:s domain:s post_year:i regret_sentence:s negated_regret:b reversal:i urgency_score:i time_to_regret_days:f",
       "SELECT * FROM structured", BASE)
def structured_posts(spark, d):
    return structured(spark, d)


V1 = f"""v1 AS (SELECT id, {sql.SENTENCE} AS regret_sentence,
  coalesce({sql.strip("list_filter(regexp_split_to_array(full_text, '[.]'), lambda p: contains(p, 'regret'))[1]")}, '') AS decision_sentence,
  {sql.count_phrases('full_text', lex.URGENCY_WORDS_V1)} AS urgency_score,
  {sql.duration('full_text', 'post_year', lex.DURATION_PATTERNS[:2], None)} AS time_to_regret_days
  FROM flagged WHERE keep AND NOT exclude)"""


@query("id:s decision_sentence:s reversal:i urgency_score:i time_to_regret_days:f",
       f"SELECT *, CAST({sql.any_phrase('regret_sentence', lex.REVERSAL_ACTIONS_V1)} AS INT) AS reversal FROM v1",
       [sql.POSTS, sql.FLAGGED, V1])
def structured_posts_first_version(spark, d):
    return posts.structure_posts_v1(posts.keep_posts(posts.posts_of_documents(documents(spark, d))))


@query("id:s time_to_regret_days:f event_type:s", "SELECT * FROM enriched", RICH)
def refined_durations_and_events(spark, d):
    return enriched(spark, d)


@query("event_type:s label:s n:i", """SELECT event_type, array_to_string(list_transform(string_split(event_type, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS label,
       count(*) AS n FROM enriched GROUP BY event_type""", RICH)
def event_labels(spark, d):
    return layer(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("label", tx.title_label("event_type"))


@query("domain:s event_type:s rate:f n:i",
       "SELECT domain, event_type, avg(reversal) AS rate, count(*) AS n FROM enriched GROUP BY ALL HAVING count(*) >= 5", RICH)
def event_type_rates(spark, d):
    return rel.rates(layer(spark, d), ["domain", "event_type"], "reversal", min_n=5)


@query("urgency_score:i reversal:i n:i",
       "SELECT urgency_score, reversal, count(*) AS n FROM structured GROUP BY ALL", BASE)
def urgency_counts(spark, d):
    return rel.point_counts(structured(spark, d), "urgency_score", "reversal")


PSY = ["agency_score", "hedging_score", "social_embed_score", "causal_reasoning_score", "future_orient_score"]


@query("id:s " + " ".join(f"{p}:f" for p in PSY), "SELECT * FROM enriched", RICH)
def psycholinguistic_scores(spark, d):
    return enriched(spark, d)


@query("domain:s feature:s mean:f std:f median:f", " UNION ALL ".join(
    f"SELECT domain, '{p}' AS feature, avg({p}) AS mean, stddev_samp({p}) AS std, median({p}) AS median FROM enriched GROUP BY domain"
    for p in PSY), RICH)
def psycholinguistic_by_domain(spark, d):
    rows = layer(spark, d).select("domain", F.inline(F.array(*[
        F.struct(F.lit(p).alias("feature"), F.col(p).alias("x")) for p in PSY])))
    return rel.moments(rows, ["domain", "feature"], "x")


SENTIMENT = [*BASE, sql.sentiment("structured", "id", "spoken")]


@query("id:s vader_compound:f vader_neg:f vader_pos:f vader_neu:f",
       "SELECT id, compound AS vader_compound, neg AS vader_neg, pos AS vader_pos, neu AS vader_neu FROM sentiment", SENTIMENT)
def sentiment_of_posts(spark, d):
    return enriched(spark, d)


@query("compound_r:f neg_r:f n:i",
       "SELECT corr(compound, reversal) AS compound_r, corr(neg, reversal) AS neg_r, count(*) AS n FROM sentiment JOIN structured USING (id)", SENTIMENT)
def sentiment_correlation(spark, d):
    return layer(spark, d).agg(
        F.corr("vader_compound", "reversal").alias("compound_r"),
        F.corr("vader_neg", "reversal").alias("neg_r"), F.count(F.lit(1)).alias("n"))


@query("doc_id:i compound:f neg:f pos:f neu:f", "SELECT * FROM sentiment",
       [sql.sentiment("documents", "doc_id", "text").strip()])
def sentiment_of_documents(spark, d):
    entries = F.array(*[F.struct(F.lit(w).alias("token"), F.lit(float(v)).alias("valence")) for w, v in lex.DEMO_VALENCE.items()])
    lexicon = spark.range(1).select(F.inline(entries))
    return sentiment.lexicon_join(documents(spark, d), "doc_id", "text", lexicon)


EMOTION = [*BASE, sql.emotion("structured", "id", "spoken")]


@query("id:s emotion:s emotion_score:f", "SELECT * FROM emotions", EMOTION)
def emotion_of_posts(spark, d):
    return enriched(spark, d)


@query("id:s emotion:s emotion_score:f", "SELECT * FROM emotions", EMOTION)
def emotion_by_model(spark, d):
    """The same through the hook for models, in batches; the model here is the lexicon."""
    rows = layer(spark, d).select("id", "spoken")
    return sentiment.model_labels(rows, "spoken", sentiment.lexicon_predictor())


@query("domain:s emotion:s n:i share:f",
       "SELECT *, n / sum(n) OVER (PARTITION BY domain) AS share FROM (SELECT domain, emotion, count(*) AS n FROM emotions JOIN structured USING (id) GROUP BY ALL)", EMOTION)
def emotion_shares_by_domain(spark, d):
    return rel.shares(layer(spark, d), "domain", "emotion")


@query("domain:s " + " ".join(f"share_{e}:f" for e in lex.EMOTIONS),
       "SELECT domain, " + ", ".join(f"count(*) FILTER (emotion = '{e}') / CAST(count(*) AS DOUBLE) AS share_{e}" for e in lex.EMOTIONS)
       + " FROM emotions JOIN structured USING (id) GROUP BY domain", EMOTION)
def emotion_row_shares(spark, d):
    return rel.row_shares(layer(spark, d), "domain", "emotion", lex.EMOTIONS)


FIRST = sql.first_match([(f"regexp_matches(full_text, {sql.q(p)})", sql.q(p)) for p in lex.STRONG_PATTERNS], "NULL")
START = sql.first_match(
    [(f"regexp_matches(full_text, {sql.q(p)})", f"strpos(full_text, regexp_extract(full_text, {sql.q(p)}, 0)) - 1") for p in lex.STRONG_PATTERNS], "NULL")
VERB = sql.first_match([(f"contains(substr(full_text, 1, s), {sql.q(v)})", sql.q(v)) for v in lex.PAST_ACTION_VERBS], "NULL")


@query("id:s pattern:s start:f snippet:s action:s",
       f"SELECT id, pattern, s AS start, replace(substr(full_text, greatest(s - 90, 0) + 1, s + 90 - greatest(s - 90, 0)), chr(10), ' ') AS snippet, "
       f"CASE WHEN s IS NOT NULL THEN {VERB} END AS action FROM (SELECT id, full_text, {FIRST} AS pattern, {START} AS s FROM flagged WHERE keep AND NOT exclude)",
       [sql.POSTS, sql.FLAGGED])
def strong_statement_snippets(spark, d):
    kept = posts.keep_posts(posts.posts_of_documents(documents(spark, d)))
    found = kept.select("id", "full_text", tx.first_pattern("full_text").alias("pattern"), tx.first_pattern_start("full_text").alias("start"))
    return found.select("id", "pattern", "start", tx.snippet("full_text", "start").alias("snippet"), tx.action_before("full_text", "start").alias("action"))


@query("id:s title:s",
       "SELECT id, title FROM flagged WHERE keep AND NOT exclude ORDER BY md5('42|' || id), id LIMIT 15", [sql.POSTS, sql.FLAGGED])
def shuffled_reading_sample(spark, d):
    return resample.shuffled(posts.keep_posts(posts.posts_of_documents(documents(spark, d))), "id", 15)


@query("domain:s reversal_rate:f n:i median_time_days:f",
       "SELECT domain, avg(reversal) AS reversal_rate, count(*) AS n, median(time_to_regret_days) AS median_time_days FROM enriched GROUP BY domain", RICH)
def domain_baselines(spark, d):
    return scoring.baselines(layer(spark, d))


def _scored_sql() -> tuple[str, list[str]]:
    t = "lower(txt)"
    counts = {name: sql.count_phrases(t, words) for name, words in lex.DOMAIN_KEYWORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    domain = sql.first_match([(f"{c} = {best}", f"'{n}'") for n, c in counts.items()], "'career'")
    raw = (f"0.37::DOUBLE + least({sql.count_phrases(t, lex.SCORING_REVERSAL_WORDS)} * 0.08::DOUBLE, 0.25::DOUBLE) - compound * 0.05::DOUBLE")
    texts = f"texts AS (SELECT id, {sql.strip('selftext')} AS txt FROM posts)"
    scored = (f"scored AS (SELECT id, emotion, round(emotion_score, 3) AS emotion_confidence, {domain} AS domain, "
              f"round(least(greatest({raw}, 0.05), 0.95), 3) AS reversal_probability, "
              f"least({sql.count_phrases(t, lex.URGENCY_WORDS_V1)} / 3.0::DOUBLE, 1.0::DOUBLE) AS urgency, "
              f"CAST({sql.any_pattern(t, lex.TEMPORAL_PATTERNS)} AS INT) AS has_time FROM texts JOIN sentiment USING (id) JOIN emotions USING (id))")
    base = "(VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c})" for a, b, c in lex.DOMAIN_BASELINES) + ") v(domain, rate, days)"
    notes = sql.first_match([(f"emotion = '{e}'", sql.q(" " + note)) for e, note in lex.EMOTION_NOTES.items()], "''")
    pct = "CAST(CAST(round_even({0} * 100, 0) AS INT) AS VARCHAR) || '%'"
    sentence = ("CASE WHEN urgency < 0.3 THEN 'Low' WHEN urgency < 0.6 THEN 'Medium' ELSE 'High' END || '-urgency ' || emotion || ' post classified in the ' || domain || ' domain. ' || "
                "'The estimated reversal probability (' || " + pct.format("reversal_probability") + " || ') is ' || CASE WHEN reversal_probability > rate THEN 'above' ELSE 'below' END || "
                "' the ' || domain || ' baseline (' || " + pct.format("rate") + " || '). ' || 'In our dataset, ' || domain || ' regret typically surfaces around ' || days || ' days after the decision.' || " + notes)
    return (f"SELECT id, emotion, emotion_confidence, domain, reversal_probability, round(urgency, 3) AS urgency_score, has_time, {sentence} AS interpretation FROM scored JOIN {base} USING (domain)",
            [sql.POSTS, texts, sql.sentiment("texts", "id", "txt"), sql.emotion("texts", "id", "txt"), scored])


_SCORED = _scored_sql()


@query("id:s emotion:s emotion_confidence:f domain:s reversal_probability:f urgency_score:f has_time:i interpretation:s", *_SCORED)
def scored_texts(spark, d):
    return scoring.score(posts.posts_of_documents(documents(spark, d)).select("id", "selftext"), "selftext")


# --- annotations --------------------------------------------------------------------
REPLY = ("CASE WHEN doc_id % 11 = 0 THEN 'sorry, no' ELSE '```json' || chr(10) || '{\"decision_type\": \"move\", \"reversal_confident\": ' "
         "|| CASE WHEN (doc_id * 7) % 5 < 2 THEN 'true' ELSE 'false' END || ', \"agency_level\": \"' || ['high','medium','low'][1 + doc_id % 3] || '\"}' || chr(10) || '```' END")
ANNOTATED = f"""annotated AS (SELECT id, domain, reversal, reply NOT LIKE 'sorry%' AS valid, CAST(contains(reply, 'true') AS INT) AS said FROM (SELECT *, {REPLY} AS reply FROM structured))"""


def _annotations(spark, d):
    made = structured(spark, d)
    n = F.col("doc_id")
    verdict = F.when(n * 7 % 5 < 2, "true").otherwise("false")
    level = F.get(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), (n % 3).cast("int"))
    reply = F.when(n % 11 == 0, "sorry, no").otherwise(F.concat(
        F.lit('```json\n{"decision_type": "move", "reversal_confident": '), verdict, F.lit(', "agency_level": "'), level, F.lit('"}\n```')))
    parsed = made.withColumn("reply", reply).select("id", "domain", "reversal", tx.parse_annotation("reply", schemas.ANNOTATION).alias("a"))
    return parsed.select("id", "domain", "reversal", F.col("a.agency_level").alias("agency_level"),
                         F.col("a.reversal_confident").isNotNull().alias("valid"),
                         F.coalesce(F.col("a.reversal_confident"), F.lit(False)).cast("int").alias("said"))


@query("domain:s n:i errors:i agreement:f kappa:f said_rate:f keyword_rate:f", """
  SELECT domain, n, errors, agreement, CASE WHEN a1 > 0 AND a1 < n AND b1 > 0 AND b1 < n THEN (agreement - pe) / (1 - pe) ELSE 0 END AS kappa, b1 / n AS said_rate, a1 / n AS keyword_rate FROM (
    SELECT *, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM (
      SELECT domain, CAST(count(*) FILTER (valid) AS DOUBLE) AS n, count(*) FILTER (NOT valid) AS errors, avg(CAST(reversal = said AS INT)) FILTER (valid) AS agreement,
             CAST(sum(reversal) FILTER (valid) AS DOUBLE) AS a1, CAST(sum(said) FILTER (valid) AS DOUBLE) AS b1 FROM annotated GROUP BY domain))""", [*BASE, ANNOTATED])
def annotation_agreement(spark, d):
    from retroscope.operators import stats
    rows = _annotations(spark, d)
    errors = rows.groupBy("domain").agg(F.count_if(~F.col("valid")).alias("errors"))
    return stats.agreement(rows.where("valid"), "reversal", "said", ["domain"]).join(errors, "domain").withColumnsRenamed(
        {"rate_b": "said_rate", "rate_a": "keyword_rate"})


# --- comments -----------------------------------------------------------------------
def _threads_sql(source: str = "conversations") -> list[str]:
    found = f"list_filter({sql.listed(lex.UPDATE_PHRASES)}, lambda p: contains(said, p))"
    return [
        f"""turns AS (SELECT conv_id AS id, turn, role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place FROM {source})""",
        """live AS (SELECT id || '/' || place AS k, id, body FROM turns WHERE place <= 10 AND body NOT IN ('', '[deleted]', '[removed]'))""",
        sql.sentiment("live", "k", "body", "felt"),
        f"""threads AS (SELECT *, {found} AS found FROM (SELECT id, count(*) AS n_top_comments, count(*) FILTER (role = 'user') AS n_op_replies,
             lower(coalesce(string_agg(body, ' ' ORDER BY place) FILTER (role = 'user'), '')) AS said,
             coalesce(arg_min(substr(body, 1, 200), place) FILTER (role = 'user'), '') AS op_reply_preview FROM turns GROUP BY id))""",
        """comment_features AS (SELECT t.id, n_top_comments, n_op_replies, comment_vader_mean, round(least(len(found) / 3.0::DOUBLE, 1.0::DOUBLE), 4) AS reversal_comment_score,
             array_to_string(found, ',') AS update_keywords_found, op_reply_preview FROM threads t LEFT JOIN
             (SELECT id, round(avg(compound), 4) AS comment_vader_mean FROM felt JOIN live USING (k) GROUP BY id) USING (id))""",
    ]


# an update phrase for every fourth conversation's user turns, so that the signal is not empty
TOLD = """told AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text || ['', ' I quit.', ' We broke up and I moved out, then filed.', ''][1 + conv_id % 4] ELSE text END AS text FROM conversations)"""


def _told(spark, d):
    tail = F.get(F.array(F.lit(""), F.lit(" I quit."), F.lit(" We broke up and I moved out, then filed."), F.lit("")), (F.col("conv_id") % 4).cast("int"))
    return table(spark, d, "conversations").withColumn("text", F.when(F.col("role") == "user", F.concat("text", tail)).otherwise(F.col("text")))


COMMENT_SPEC = "id:i n_top_comments:i n_op_replies:i comment_vader_mean:f reversal_comment_score:f update_keywords_found:s op_reply_preview:s"


@query(COMMENT_SPEC, "SELECT * FROM comment_features", [TOLD, *_threads_sql("told")])
def comment_thread_features(spark, d):
    return comments.conversation_features(_told(spark, d))


# as threads: a user's turn that follows another's is a reply to it, all others stand at the top
_NESTED = [
    """turns AS (SELECT *, coalesce(role = 'user' AND before <> 'user', false) AS nested FROM (SELECT conv_id AS id, role, coalesce(text, '') AS body,
      row_number() OVER w AS place, lag(role) OVER w AS before FROM told WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)))""",
    """live AS (SELECT id || '/' || place AS k, id, body FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY place) AS top FROM turns WHERE NOT nested)
      WHERE top <= 10 AND body NOT IN ('', '[deleted]', '[removed]'))""",
    *_threads_sql("told")[2:3],
    f"""threads AS (SELECT *, list_filter({sql.listed(lex.UPDATE_PHRASES)}, lambda p: contains(said, p)) AS found FROM (
      SELECT id, count(*) FILTER (NOT nested) AS n_top_comments, count(*) FILTER (role = 'user') AS n_op_replies,
        lower(coalesce(string_agg(body, ' ' ORDER BY place) FILTER (role = 'user'), '')) AS said,
        coalesce(arg_min(substr(body, 1, 200), place) FILTER (role = 'user'), '') AS op_reply_preview FROM turns GROUP BY id))""",
]


@query(COMMENT_SPEC + " upvote_ratio:f", """
  SELECT t.id, id % 10 / 10.0 AS upvote_ratio, n_top_comments, n_op_replies, comment_vader_mean, op_reply_preview, array_to_string(found, ',') AS update_keywords_found,
    round(least(least(len(found) / 3.0::DOUBLE, 1.0::DOUBLE) + CASE WHEN id % 3 = 0 THEN 0.3::DOUBLE ELSE 0 END, 1.0::DOUBLE), 4) AS reversal_comment_score
  FROM threads t LEFT JOIN (SELECT id, round(avg(compound), 4) AS comment_vader_mean FROM felt JOIN live USING (k) GROUP BY id) USING (id)""", [TOLD, *_NESTED])
def comment_threads_from_json(spark, d):
    """The same conversations as thread JSON with nested replies, titles and vote ratios, parsed back."""
    turn = F.struct("turn", "role", "text")
    listed = _told(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_t"))

    def listing(children):
        return F.to_json(F.struct(F.struct(children.alias("children")).alias("data")))

    def comment(t, replies):
        return F.struct(F.lit("t1").alias("kind"), F.struct(t["text"].alias("body"), t["role"].alias("author"), replies.alias("replies")).alias("data"))

    def nested(t, i):
        return (t["role"] == "user") & F.coalesce(F.get("_t", i - 1)["role"] != "user", F.lit(False)) & (i > 0)

    marked = listed.withColumn("_n", F.transform("_t", lambda t, i: F.struct(t["role"].alias("role"), t["text"].alias("text"), nested(t, i).alias("nested"), i.alias("i"))))
    answer = lambda t: F.get("_n", t["i"] + 1)
    replies = lambda t: F.when(answer(t)["nested"], listing(F.array(comment(answer(t), F.lit(""))))).otherwise("")
    said = F.transform(F.filter("_n", lambda t: ~t["nested"]), lambda t: comment(t, replies(t)))
    n = F.col("conv_id")
    poster = F.struct(F.lit("user").alias("author"), F.when(n % 3 == 0, "An UPDATE at last").otherwise("A question").alias("title"), (n % 10 / 10).alias("upvote_ratio"))
    payload = F.concat(F.lit("["), listing(F.array(F.struct(poster.alias("data")))), F.lit(","), listing(said), F.lit("]"))
    raw = marked.select(n.alias("id"), payload.alias("payload"))
    return comments.thread_features(comments.parse_threads(raw))


@query("domain:s n:i agreement:f kappa:f only_a:i only_b:i",
       """SELECT domain, n, agreement, CASE WHEN a1 > 0 AND a1 < n AND b1 > 0 AND b1 < n THEN (agreement - pe) / (1 - pe) ELSE 0 END AS kappa, only_a, only_b FROM (
            SELECT *, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM (
              SELECT domain, CAST(count(*) AS DOUBLE) AS n, avg(CAST(reversal = cr AS INT)) AS agreement, CAST(sum(reversal) AS DOUBLE) AS a1, CAST(sum(cr) AS DOUBLE) AS b1,
                     count(*) FILTER (reversal = 1 AND cr = 0) AS only_a, count(*) FILTER (reversal = 0 AND cr = 1) AS only_b
              FROM (SELECT s.domain, s.reversal, CAST(c.reversal_comment_score >= 0.3 AS INT) AS cr FROM structured s JOIN comment_features c ON s.doc_id = c.id)
              GROUP BY domain HAVING count(*) > 10))""",
       [*BASE, TOLD, *_threads_sql("told")])
def comment_label_agreement(spark, d):
    from retroscope.operators import stats
    features = comments.conversation_features(_told(spark, d)).withColumnRenamed("id", "doc_id")
    merged = rel.enrich(structured(spark, d), features.select("doc_id", *schemas.COMMENT_COLUMNS), "doc_id")
    labelled = comments.with_comment_label(merged.where(F.col("reversal_comment_score").isNotNull()))
    return stats.agreement(labelled, "reversal", "comment_reversal", ["domain"]).where("n > 10")


@query("id:s document:s")
def published_documents(spark, d):
    return writers.result_document(writers.publishable(enriched(spark, d)), "id")

"""Comment threads to features, with array functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import sentiment
from retroscope.operators.relational import top_per_group
from retroscope.sources import schemas


def parse_threads(raw: DataFrame, key: str = "id", payload: str = "payload") -> DataFrame:
    """(id, post_author, title, upvote_ratio, comments, op_replies) from two-listing JSON."""
    parts = F.from_json(payload, "array<string>")
    opened = raw.select(
        key,
        F.from_json(F.get(parts, F.lit(0)), schemas.THREAD_POST).alias("_p"),
        F.from_json(F.get(parts, F.lit(1)), schemas.THREAD_COMMENTS).alias("_c"),
    )
    post = F.get("_p.data.children", F.lit(0))["data"]
    flat = opened.select(
        key, post["author"].alias("post_author"), F.coalesce(post["title"], F.lit("")).alias("title"),
        post["upvote_ratio"].alias("upvote_ratio"),
        F.filter("_c.data.children", lambda c: c["kind"] == "t1").alias("_top"),
    )
    author = F.coalesce("post_author", F.lit(""))

    def nested(c: Column) -> Column:
        replies = F.from_json(c["data"]["replies"], schemas.THREAD_REPLIES)["data"]["children"]
        mine = F.filter(replies, lambda r: (r["kind"] == "t1") & (r["data"]["author"] == author))
        return F.coalesce(F.transform(mine, lambda r: F.coalesce(r["data"]["body"], F.lit(""))),
                          F.array().cast("array<string>"))

    def own(c: Column) -> Column:
        body = F.coalesce(c["data"]["body"], F.lit(""))
        return F.concat(
            F.when(F.coalesce(c["data"]["author"], F.lit("")) == author, F.array(body)).otherwise(
                F.array().cast("array<string>")),
            nested(c),
        )

    return flat.select(
        key, "post_author", "title", "upvote_ratio",
        F.transform("_top", lambda c: F.coalesce(c["data"]["body"], F.lit(""))).alias("comments"),
        F.flatten(F.transform("_top", own)).alias("op_replies"),
    )


def live_comments(comments: Column, first: int = 10) -> Column:
    """Of the first ten comments, those with a text that still stands."""
    return F.filter(F.slice(comments, 1, first), lambda b: (b != "") & ~b.isin(lex.DEAD_COMMENTS))


def update_score(hits: Column, title: Column) -> Column:
    """Three update phrases saturate; a title that says "update" adds .3."""
    base = tx.capped_hits(hits)
    return F.round(F.when(F.lower(title).contains("update"), F.least(base + 0.3, F.lit(1.0))).otherwise(base), 4)


def thread_features(threads: DataFrame, key: str = "id", lexicon=lex.DEMO_VALENCE) -> DataFrame:
    """Reply counts, update signal and mean sentiment of the first live comments."""
    base = threads.select(
        key, "upvote_ratio", F.size("comments").alias("n_top_comments"),
        F.size("op_replies").alias("n_op_replies"), "title",
        live_comments(F.col("comments")).alias("_live"),
        tx.phrases_found("lower(array_join(op_replies, ' '))", lex.UPDATE_PHRASES).alias("_found"),
        F.coalesce(F.substring(F.get("op_replies", F.lit(0)), 1, 200), F.lit("")).alias("op_reply_preview"),
    )
    scored = sentiment.inline_sentiment(
        base.select(key, F.explode("_live").alias("_body")), "_body", lexicon, "_s"
    ).groupBy(key).agg(F.round(F.avg("_s_compound"), 4).alias("comment_vader_mean"))
    return base.join(scored, key, "left").select(
        key, "upvote_ratio", "n_top_comments", "n_op_replies", "comment_vader_mean",
        update_score(F.size("_found"), F.col("title")).alias("reversal_comment_score"),
        F.array_join("_found", ",").alias("update_keywords_found"), "op_reply_preview",
    )


# a conversation is read in stretches of this many turns, however long it is
STRETCH = 4096
# longer than any update phrase
EDGE = 40


def conversation_features(turns: DataFrame, lexicon=lex.DEMO_VALENCE, stretch: int = STRETCH) -> DataFrame:
    """The features of ``thread_features`` from (conv_id, turn, role, text) rows.

    The user is the poster, turns are the comments in order. Turns join into texts per
    stretch only, so one endless conversation spreads over many tasks; what a phrase could
    span between stretches is looked up in their joined edges.
    """
    text = F.coalesce("text", F.lit(""))
    rows = turns.select(F.col("conv_id").alias("id"), "turn", "role", text.alias("text"),
                        F.floor(F.col("turn") / stretch).alias("_at"))
    own = F.col("role") == "user"
    line = F.struct("turn", "role", "text")
    parts = rows.groupBy("id", "_at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(own).alias("n_op"),
        F.lower(F.array_join(F.transform(
            F.array_sort(F.collect_list(F.when(own, line))), lambda t: t["text"]), " ")).alias("_said"),
        F.min_by(F.when(own, F.substring("text", 1, 200)), F.when(own, line)).alias("_first"),
    )
    phrases = tx.array_sql(lex.UPDATE_PHRASES)
    marks = (f"aggregate(sequence(0, {len(lex.UPDATE_PHRASES) - 1}), 0L, "
             f"(_m, _i) -> if(contains(_said, get({phrases}, _i)), _m | shiftleft(1L, _i), _m))")
    edge = f"if(length(_said) <= {2 * EDGE}, _said, concat(left(_said, {EDGE}), '\\0', right(_said, {EDGE})))"
    parts = parts.withColumn("_marks", F.expr(marks)).withColumn("_edge", F.when(F.col("n_op") > 0, F.expr(edge)))
    joined = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.when(F.col("n_op") > 0, F.struct("_at", "_edge")))), lambda e: e["_edge"]), " ")
    whole = parts.groupBy("id").agg(
        F.sum("n").alias("n_top_comments"), F.sum("n_op").alias("n_op_replies"), F.bit_or("_marks").alias("_marks"),
        joined.alias("_edges"), F.coalesce(F.min_by("_first", F.when(F.col("n_op") > 0, F.col("_at"))), F.lit("")).alias("op_reply_preview"),
    )
    found = F.expr(f"filter({phrases}, (_p, _i) -> (_marks & shiftleft(1L, _i)) != 0 OR contains(_edges, _p))")
    live = top_per_group(rows, ["id"], [F.col("turn"), F.col("role"), F.col("text")], 10).where(
        (F.col("text") != "") & ~F.col("text").isin(lex.DEAD_COMMENTS))
    felt = sentiment.inline_sentiment(live.select("id", "text"), "text", lexicon, "_s").groupBy("id").agg(
        F.round(F.avg("_s_compound"), 4).alias("comment_vader_mean"))
    return whole.withColumn("_found", found).join(felt, "id", "left").select(
        "id", F.lit(None).cast("double").alias("upvote_ratio"), "n_top_comments", "n_op_replies", "comment_vader_mean",
        update_score(F.size("_found"), F.lit("")).alias("reversal_comment_score"),
        F.array_join("_found", ",").alias("update_keywords_found"), "op_reply_preview",
    )


def with_comment_label(df: DataFrame, score: str = "reversal_comment_score", at: float = 0.3) -> DataFrame:
    return df.withColumn("comment_reversal", (F.col(score) >= at).cast("int"))

"""Rule-based sentiment and emotion from lexicons.

A token's valence is changed by boosters and negators among the three tokens before it and
by "but"; the sum maps to -1..1. With a short lexicon everything is one expression per row.
With a full lexicon table the tokens that matter are joined to it.
"""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx

# a literal map is searched entry by entry, so longer lexicons are looked up in batches
MAX_INLINE = 200


def _map_sql(entries: Mapping[str, float], token: str) -> str:
    """Value of a token, null if not listed."""
    table = ", ".join(f"{tx.quoted(k)}, {float(v)}D" for k, v in entries.items())
    return f"try_element_at(map({table}), {token})"


def adjusted_sql(valence: str, before: list[str]) -> str:
    """Valence after its context; ``before`` holds the previous tokens, nearest first."""
    boost = " + ".join(
        f"coalesce({_map_sql(lex.BOOSTERS, t)}, 0D) * {damp}D" for t, damp in zip(before, lex.DISTANCE_DAMPING)
    )
    negated = " OR ".join(f"coalesce(array_contains({tx.array_sql(lex.NEGATORS)}, {t}), false)" for t in before)
    return (f"({valence} + signum({valence}) * ({boost})) "
            f"* CASE WHEN {negated} THEN {lex.NEGATION_FACTOR}D ELSE 1D END")


def _around_but_sql(value: str, i: str, but: str) -> str:
    """What stands before the first "but" counts half, what follows it half as much again."""
    return (f"{value} * CASE WHEN {but} = 0 OR {i} + 1 = {but} THEN 1D "
            f"WHEN {i} + 1 < {but} THEN 0.5D ELSE 1.5D END")


def _emphasis(text: Column) -> Column:
    """Exclamation marks push away from zero, up to four of them."""
    return F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(4)) * F.lit(0.292)


def compound_of(total: Column, emphasis: Column) -> Column:
    pushed = total + F.signum(total) * emphasis
    return pushed / F.sqrt(pushed * pushed + F.lit(lex.NORMALISER))


def _scores(pos: Column, neg: Column, neutral: Column, emphasis: Column) -> dict[str, Column]:
    """Compound and the three shares from positive sum, negative sum (<= 0) and neutral count.

    ``pos``/``neg`` are struct-like pairs (sum, count).
    """
    total = pos["sum"] + neg["sum"]
    up = pos["sum"] + pos["n"]
    down = F.abs(neg["sum"]) + neg["n"]
    whole = up + down + neutral

    def share(x: Column) -> Column:
        return F.when(whole > 0, x / whole).otherwise(0.0)

    return {"compound": compound_of(total, emphasis), "neg": share(down), "pos": share(up),
            "neu": share(neutral)}


def _looked_up(lexicon: Mapping[str, float]):
    """Valence of each token of an array, null where not listed; rows are handled in Arrow batches."""
    values = {k: float(v) for k, v in lexicon.items()}

    @F.pandas_udf("array<double>")
    def look_up(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda row: [values.get(t) for t in row])

    return look_up


def inline_sentiment(df: DataFrame, text: str, lexicon: Mapping[str, float] = lex.DEMO_VALENCE,
                     prefix: str = "vader") -> DataFrame:
    """Adds <prefix>_compound/neg/pos/neu without leaving the row, on static and streaming tables and
    with a lexicon of any size."""
    staged = df.withColumn("_text", F.expr(f"coalesce({text}, '')")).withColumn(
        "_tokens", tx.sentiment_tokens("_text")
    )
    # only tokens the lexicon lists are looked at in context
    if len(lexicon) > MAX_INLINE:
        staged = staged.withColumn("_found", _looked_up(lexicon)("_tokens"))
        each = "struct(_i AS i, get(_found, _i) AS v)"
    else:
        each = f"struct(_i AS i, {_map_sql(lexicon, '_w')} AS v)"
    listed = f"filter(transform(_tokens, (_w, _i) -> {each}), _h -> _h.v IS NOT NULL)"
    value = adjusted_sql("_h.v", [f"get(_tokens, _h.i - {k})" for k in (1, 2, 3)])
    value = _around_but_sql(value, "_h.i", "array_position(_tokens, 'but')")
    staged = staged.withColumn("_values", F.expr(f"transform({listed}, _h -> {value})"))

    def side(keep) -> Column:
        part = F.filter("_values", keep)
        return F.struct(F.aggregate(part, F.lit(0.0), lambda a, v: a + v).alias("sum"), F.size(part).alias("n"))

    staged = staged.withColumn("_pos", side(lambda v: v > 0)).withColumn("_neg", side(lambda v: v < 0))
    neutral = F.size("_tokens") - F.col("_pos")["n"] - F.col("_neg")["n"]
    scored = _scores(F.col("_pos"), F.col("_neg"), neutral, _emphasis(F.col("_text")))
    return staged.select(*df.columns, *[c.alias(f"{prefix}_{k}") for k, c in scored.items()])


def lexicon_join(df: DataFrame, key: str, text: str, lexicon: DataFrame) -> DataFrame:
    """(key, compound, neg, pos, neu) with ``lexicon`` a (token, valence) table of any size.

    Context travels with each token, so only tokens found in the lexicon are shuffled, and
    those are summed per row inside each task first.
    """
    base = df.select(key, F.expr(f"coalesce({text}, '')").alias("_text")).withColumn(
        "_tokens", tx.sentiment_tokens("_text")
    )
    tokens = F.col("_tokens")
    with_context = F.transform(tokens, lambda t, i: F.struct(
        t.alias("token"), i.alias("i"), *[F.get(tokens, i - k).alias(f"p{k}") for k in (1, 2, 3)]
    ))
    exploded = base.select(key, F.array_position(tokens, "but").alias("_but"), F.explode_outer(with_context).alias("_e"))
    hits = exploded.select(key, "_but", "_e.*").join(lexicon, "token")
    value = _around_but_sql(adjusted_sql("valence", ["p1", "p2", "p3"]), "i", "_but")
    sums = hits.withColumn("_v", F.expr(value)).groupBy(key).agg(
        F.struct(F.sum(F.when(F.col("_v") > 0, F.col("_v")).otherwise(0.0)).alias("sum"),
                 F.count_if(F.col("_v") > 0).alias("n")).alias("_pos"),
        F.struct(F.sum(F.when(F.col("_v") < 0, F.col("_v")).otherwise(0.0)).alias("sum"),
                 F.count_if(F.col("_v") < 0).alias("n")).alias("_neg"),
    )
    sizes = base.select(key, F.size("_tokens").alias("_size"), _emphasis(F.col("_text")).alias("_emph"))
    zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("bigint").alias("n"))
    full = sizes.join(sums, key, "left").withColumn("_pos", F.coalesce("_pos", zero)).withColumn(
        "_neg", F.coalesce("_neg", zero))
    neutral = F.col("_size") - F.col("_pos")["n"] - F.col("_neg")["n"]
    scored = _scores(F.col("_pos"), F.col("_neg"), neutral, F.col("_emph"))
    return full.select(key, *[c.alias(k) for k, c in scored.items()])


def lexicon_emotion(df: DataFrame, text: str, lexicon: Mapping[str, str] = lex.DEMO_EMOTION) -> DataFrame:
    """Adds ``emotion`` (most lexicon words; ties to the first in label order; none: neutral)
    and ``emotion_score`` (its share of the words found)."""
    def found(emotion: str) -> str:
        words = [w for w, e in lexicon.items() if e == emotion]
        return f"size(filter(_tokens, _w -> array_contains({tx.array_sql(words)}, _w)))" if words else "0"

    staged = df.withColumn("_tokens", tx.sentiment_tokens(f"coalesce({text}, '')")).withColumn(
        "_counts", F.expr(f"array({', '.join(found(e) for e in lex.EMOTIONS)})"))
    label = f"get({tx.array_sql(lex.EMOTIONS)}, int(array_position(_counts, array_max(_counts)) - 1))"
    share = "round(array_max(_counts) / aggregate(_counts, 0, (_a, _c) -> _a + _c), 4)"
    return staged.select(
        *df.columns,
        F.expr(f"CASE WHEN array_max(_counts) > 0 THEN {label} ELSE 'neutral' END").alias("emotion"),
        F.expr(f"CASE WHEN array_max(_counts) > 0 THEN {share} ELSE 1D END").alias("emotion_score"),
    )


def model_labels(df: DataFrame, text: str, make_predict, batch_size: int = 64, out: str = "emotion") -> DataFrame:
    """Labels from a supplied model: ``make_predict`` loads it once per worker and returns a
    function from a string array to {"label": ..., "score": ...}."""
    from pyspark.ml.functions import predict_batch_udf
    from pyspark.sql import types as T

    predict = predict_batch_udf(
        make_predict,
        return_type=T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]),
        batch_size=batch_size,
    )
    staged = df.withColumn("_p", predict(F.expr(f"coalesce({text}, '')")))
    return staged.select(*df.columns, F.col("_p.label").alias(out), F.round("_p.score", 4).alias(f"{out}_score"))


def lexicon_predictor(lexicon: Mapping[str, str] = lex.DEMO_EMOTION):
    """``lexicon_emotion`` as a model that can be handed to ``model_labels``."""
    words, emotions = dict(lexicon), list(lex.EMOTIONS)

    def load():
        import re

        import numpy as np

        run = re.compile(r"[\w']+")

        def predict(texts):
            labels, scores = [], []
            for text in texts:
                found = [words[w] for w in run.findall(text.lower()) if w in words]
                counts = [found.count(e) for e in emotions]
                most = max(counts)
                labels.append(emotions[counts.index(most)] if most else "neutral")
                scores.append(most / len(found) if most else 1.0)
            return {"label": np.array(labels, dtype=object), "score": np.array(scores)}

        return predict

    return load

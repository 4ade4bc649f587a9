"""Scoring of new texts, batch or stream: one projection, rules or a fitted model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import ranks, sentiment
from retroscope.sources.readers import require


def baselines(df: DataFrame, by: str = "domain", outcome: str = "reversal",
              days: str = "time_to_regret_days") -> DataFrame:
    """Reversal rate and median days per domain, recomputed from the data."""
    rate = df.groupBy(by).agg(F.avg(outcome).alias("reversal_rate"), F.count(F.lit(1)).alias("n"))
    middle = ranks.quantiles(df, days, {"median_time_days": 0.5}, [by], domain=3651)
    return rate.join(middle.drop("n"), by, "left")


def rule_probability(text: str, compound: Column) -> Column:
    """Base rate, plus action phrases, minus sentiment; kept within .05 and .95."""
    hits = tx.count_phrases(text, lex.SCORING_REVERSAL_WORDS)
    raw = F.lit(0.37) + F.least(hits * F.lit(0.08), F.lit(0.25)) - compound * F.lit(0.05)
    return F.round(F.least(F.greatest(raw, F.lit(0.05)), F.lit(0.95)), 3)


def interpretation(emotion: Column, domain: Column, probability: Column, urgency: Column,
                   table=lex.DOMAIN_BASELINES) -> Column:
    """The sentences that explain a score against the domain's baseline."""
    def by_domain(position: int, default) -> Column:
        entries = [x for row in table for x in (F.lit(row[0]), F.lit(row[position]))]
        return F.coalesce(F.try_element_at(F.create_map(*entries), domain), F.lit(default))

    def percent(p: Column) -> Column:
        return F.concat(F.bround(p * 100, 0).cast("int").cast("string"), F.lit("%"))

    rate, days = by_domain(1, 0.37), by_domain(2, 180)
    band = F.when(urgency < 0.3, "Low").when(urgency < 0.6, "Medium").otherwise("High")
    side = F.when(probability > rate, "above").otherwise("below")
    notes = None
    for label, note in lex.EMOTION_NOTES.items():
        hit = emotion == F.lit(label)
        notes = F.when(hit, F.lit(note)) if notes is None else notes.when(hit, F.lit(note))
    return F.concat_ws(
        " ",
        F.concat(band, F.lit("-urgency "), emotion, F.lit(" post classified in the "), domain, F.lit(" domain.")),
        F.concat(F.lit("The estimated reversal probability ("), percent(probability), F.lit(") is "), side,
                 F.lit(" the "), domain, F.lit(" baseline ("), percent(rate), F.lit(").")),
        F.concat(F.lit("In our dataset, "), domain, F.lit(" regret typically surfaces around "),
                 days.cast("string"), F.lit(" days after the decision.")),
        notes,
    )


def load_model(path: str | None, spark: SparkSession | None = None, or_rules: bool = False) -> PipelineModel | None:
    """The fitted pipeline at ``path``; none (the rules) without a path. A path that is not there
    raises, unless the caller asks for the rules then. The file system of the path is asked."""
    if not path:
        return None
    try:
        require(spark or SparkSession.getActiveSession(), [path])
    except FileNotFoundError:
        if or_rules:
            return None
        raise
    return PipelineModel.load(path)


def score(df: DataFrame, text: str = "text", hint: str | None = None,
          lexicon: Mapping[str, float] = lex.DEMO_VALENCE,
          reversal_model: PipelineModel | None = None, domain_model: PipelineModel | None = None,
          domain_names: list[str] | None = None) -> DataFrame:
    """Adds emotion, emotion_confidence, domain, reversal_probability, urgency_score, has_time
    and interpretation. Works on static and streaming tables alike."""
    staged = df.withColumn("_text", tx.strip(f"coalesce({text}, '')")).withColumn("_low", F.lower("_text"))
    staged = sentiment.inline_sentiment(staged, "_text", lexicon, "_v")
    staged = sentiment.lexicon_emotion(staged, "_text").withColumnRenamed("emotion_score", "_confidence")
    staged = staged.withColumns({
        "_urgency": tx.capped_hits(tx.count_phrases("_low", lex.URGENCY_WORDS_V1)),
        "has_time": tx.any_pattern("_low", lex.TEMPORAL_PATTERNS).cast("int"),
    })
    if domain_model is None:
        guessed = tx.keyword_domain("_low")
    else:
        names = F.array(*[F.lit(d) for d in (domain_names or lex.DOMAINS)])
        staged = domain_model.transform(staged.withColumn("spoken", F.col("_text"))).select(
            *staged.columns, F.get(names, F.col("prediction").cast("int")).alias("_guess"))
        guessed = F.col("_guess")
    if hint is not None:
        guessed = F.when(F.col(hint).isin(lex.DOMAINS), F.col(hint)).otherwise(guessed)
    staged = staged.withColumn("domain", guessed)
    if reversal_model is None:
        staged = staged.withColumn("reversal_probability", rule_probability("_low", F.col("_v_compound")))
    else:
        from pyspark.ml.functions import vector_to_array

        ready = staged.withColumn("spoken", F.col("_text")).withColumn("vader_compound", F.col("_v_compound")).withColumn(
            "vader_neg", F.col("_v_neg")).withColumn(
            # the model was fitted on raw counts over the long list
            "urgency_score", tx.count_phrases("_low", lex.URGENCY_WORDS).cast("double"))
        staged = reversal_model.transform(ready).select(
            *staged.columns, F.round(F.get(vector_to_array("probability"), F.lit(1)), 3).alias("reversal_probability"))
    return staged.select(
        *df.columns, "emotion", F.round("_confidence", 3).alias("emotion_confidence"), "domain",
        "reversal_probability", F.round("_urgency", 3).alias("urgency_score"), "has_time",
        interpretation(F.col("emotion"), F.col("domain"), F.col("reversal_probability"), F.col("_urgency"))
        .alias("interpretation"),
    )

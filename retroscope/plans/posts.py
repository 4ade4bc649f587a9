"""The post layers: raw -> kept -> structured -> enriched."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.functions import durations
from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import sentiment

# --- fixed values: the phrase bank that turns documents into posts ---------------------
TITLES = [
    "Should I have stayed?",
    "My biggest mistake",
    "Update: one year later",
    "Feeling stuck",
    "Need advice",
    "Was it worth it",
    "Looking back",
]
BODIES = [
    "I regret quitting. I regret leaving my old team so quickly last spring, 6 months later I am still sad.",
    "I wish I had waited, it was a rushed decision under pressure and after 2 years I feel it every day.",
    "Will I regret this offer? I regret it already maybe, the deadline is close.",
    "I don't regret moving, I regret it never, and I left because my family needed me.",
    "I messed up my application. It's been 3 weeks since I messed up my visa paperwork and was denied.",
    "I regret that I resigned and moved back in 2015, I had to because of my parents.",
    "Nothing special happened here, just a quiet week with my friends.",
    "I fucked up and I fucked up the interview, was fired and laid off a year later.",
    "My biggest mistake was that I decided too fast. I regret deciding so fast, a couple of years passed.",
    "You will regret it they said, and I regret it now after 5 months of waiting for an answer.",
    "I regret it. Short one.",
    "I wish I had listened, we broke up because he cheated, I am going to try again, several months passed.",
    "I regret staying with a toxic and abusive manager for so long, over 4 years in total.",
    "I regret this since March 2018 and I think I will probably switch, I was forced to sign.",
    "i regret turning it down, I turned down the offer last minute and panicked, 12 years ago.",
    "I messed up everything when I dropped out and switched schools, 10 days later I knew.",
]


def posts_of_documents(documents: DataFrame) -> DataFrame:
    """Documents as posts: a title and an opening from the phrase bank, then the whole text."""
    n = F.col("doc_id")
    titles, bodies, domains = (F.expr(tx.array_sql(x)) for x in (TITLES, BODIES, lex.DOMAINS))
    made = F.timestamp_add("DAY", (n * 37 % 5000).cast("int"), F.lit("2012-01-01").cast("timestamp_ntz"))
    return documents.select(
        F.concat(F.lit("d"), n).alias("id"), n.alias("doc_id"),
        F.get(domains, (n % 3).cast("int")).alias("domain"),
        F.col("source").alias("subreddit"), F.col("source").alias("source_subreddit"),
        F.get(titles, (n % 7).cast("int")).alias("title"),
        F.concat(F.get(bodies, (n * (1 + n % 3) % 16).cast("int")), F.lit(" "), F.col("text")).alias("selftext"),
        made.alias("created"), F.year(made).alias("post_year"),
        (F.col("n_chars") % 97).cast("int").alias("num_comments"), (n * 31 % 211).cast("int").alias("score"),
    )


def keep_posts(posts: DataFrame) -> DataFrame:
    """Posts in the first person about something done, hypotheticals left out."""
    flagged = posts.withColumn("full_text", tx.full_text()).withColumns({
        "keep": tx.any_pattern("full_text", lex.KEEP_PATTERNS),
        "exclude": tx.any_pattern("full_text", lex.EXCLUDE_PATTERNS),
    })
    return flagged.where("keep AND NOT exclude")


def structure_posts(kept: DataFrame) -> DataFrame:
    """Sentence, negation, label, urgency and duration of each kept post."""
    staged = kept.withColumns({
        "regret_sentence": tx.regret_sentence(),
        "negated_regret": tx.any_phrase("full_text", lex.NEGATED_PHRASES),
        "urgency_score": tx.count_phrases("full_text", lex.URGENCY_WORDS),
    })
    told = (F.length("regret_sentence") > 0) & ~F.col("negated_regret")
    labelled = staged.withColumn("reversal", (told & tx.any_phrase("full_text", lex.REVERSAL_ACTIONS)).cast("int"))
    return durations.with_duration(labelled)


def structure_posts_v1(kept: DataFrame) -> DataFrame:
    """The first version: action phrases in the sentence only, three duration patterns, no cap."""
    staged = kept.withColumns({
        "regret_sentence": tx.regret_sentence(),
        "decision_sentence": tx.decision_sentence(),
        "urgency_score": tx.count_phrases("full_text", lex.URGENCY_WORDS_V1),
    })
    labelled = staged.withColumn("reversal", tx.any_phrase("regret_sentence", lex.REVERSAL_ACTIONS_V1).cast("int"))
    return durations.with_duration(labelled, patterns=lex.DURATION_PATTERNS[:2], cap=None)


def enrich_posts(structured: DataFrame, lexicon: Mapping[str, float] = lex.DEMO_VALENCE) -> DataFrame:
    """Sentiment, refined durations, event type, emotion and psycholinguistic rates."""
    scored = structured.withColumn("spoken", tx.fallback_text())
    scored = durations.with_refined_duration(sentiment.inline_sentiment(scored, "spoken", lexicon))
    scored = sentiment.lexicon_emotion(scored, "spoken")
    return with_engagement(scored.withColumn("_words", tx.word_count("full_text")).withColumns({
        "event_type": tx.classify_event("concat_ws(' ', full_text, regret_sentence)"),
        **tx.psycholinguistic(words="_words"),
    }).drop("_words"))


def with_engagement(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "comment_count_log": F.log1p(F.coalesce(F.col("num_comments"), F.lit(0))),
        "score_log": F.log1p(F.coalesce(F.col("score"), F.lit(0))),
        "log_post_length": F.log1p(F.length(F.coalesce("full_text", F.lit("")))),
    })


def structured_from_documents(documents: DataFrame) -> DataFrame:
    return structure_posts(keep_posts(posts_of_documents(documents)))


def enriched_from_documents(documents: DataFrame) -> DataFrame:
    return enrich_posts(structured_from_documents(documents))

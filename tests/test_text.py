"""Text functions on hand-made rows, with every trap that is easy to get wrong."""

import pytest
from pyspark.sql import functions as F

from retroscope.functions import bins, durations
from retroscope.functions import lexicons as lex
from retroscope.functions import text as tx
from retroscope.operators import sentiment
from retroscope.plans import posts, scoring


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first()["x"]


def test_phrases_match_inside_words_and_nest(spark):
    assert one(spark, "the cleft was quite wide", tx.count_phrases("t", ["left", "quit"])) == 2
    assert one(spark, "visa denied", tx.count_phrases("t", ["denied", "visa denied"])) == 2
    assert one(spark, "nothing", tx.any_phrase("t", ["left"])) is False
    assert one(spark, "i don’t regret it", tx.any_phrase("t", lex.NEGATED_PHRASES)) is False
    assert one(spark, "i don't regret it", tx.any_phrase("t", lex.NEGATED_PHRASES)) is True


def test_patterns_respect_word_bounds_in_any_script(spark):
    assert one(spark, "i regret it", tx.any_pattern("t", lex.KEEP_PATTERNS)) is True
    assert one(spark, "ai regret it", tx.any_pattern("t", lex.KEEP_PATTERNS)) is False
    assert one(spark, "éi regret it", tx.any_pattern("t", lex.KEEP_PATTERNS)) is False
    assert one(spark, "you'll regret this", tx.any_pattern("t", lex.EXCLUDE_PATTERNS)) is True
    assert one(spark, "they will regret", tx.any_pattern("t", lex.EXCLUDE_PATTERNS)) is True
    assert one(spark, "3 weeks ago", tx.any_pattern("t", lex.TEMPORAL_PATTERNS)) is True


@pytest.mark.parametrize("text,expected", [
    ("", ""),
    ("i regret it. short", ""),
    ("x" * 23 + " regret", "x" * 23 + " regret"),           # 30 characters
    ("x" * 22 + " regret", ""),                              # 29 characters
    ("\t\n " + "x" * 30 + " regret \t. more", "x" * 30 + " regret"),
    ("regret " + "y" * 600, ("regret " + "y" * 600)[:500]),
    ("i regret. i wish i had never done such a thing! i regret the rest of it a lot", "i wish i had never done such a thing"),
])
def test_key_sentence(spark, text, expected):
    assert one(spark, text, tx.regret_sentence("t")) == expected


@pytest.mark.parametrize("text,expected", [
    ("6 months later", 180), ("after 2 years", 730), ("it's been 3 weeks", 21), ("it has been 4 days", 4),
    ("0 days later and in 2015", 0),                        # the first match decides, even if 0
    ("20 years later, after 2 years", None),                # over the cap, no falling through
    ("99999999999999999999 years later", None),
    ("begin 2021", 3 * 365), ("in 2030", None), ("in 2024 and in 2015", None), ("nothing", None),
])
def test_first_duration(spark, text, expected):
    df = spark.createDataFrame([(text, 2024)], "full_text string, post_year int")
    assert durations.with_duration(df).first()["time_to_regret_days"] == expected


@pytest.mark.parametrize("text,expected", [
    ("a year later", 365), ("a couple of years", 730), ("a few weeks", 21), ("several months", 150),
    ("half a year", 182), ("half a month", 15), ("3 weeks ago", 21), ("over 4 years", 1460), ("almost 2 months", 60),
    ("last year", 365), ("12 years ago, over 2 weeks", 14),  # out of range falls through
    ("since march 2001", 23 * 365),                           # months with a year are not capped
    ("since march 2030", None), ("last week", 7), ("alas year", None), ("9 chars..", None),
])
def test_refined_duration(spark, text, expected):
    df = spark.createDataFrame([(text.ljust(10) if text != "9 chars.." else text, 2024, None)],
                               "full_text string, post_year int, time_to_regret_days bigint")
    assert durations.with_refined_duration(df).first()["time_to_regret_days"] == expected


def test_refined_duration_keeps_what_is_known(spark):
    df = spark.createDataFrame([("last year it was", 2024, 7)], "full_text string, post_year int, time_to_regret_days bigint")
    assert durations.with_refined_duration(df).first()["time_to_regret_days"] == 7


def test_events_first_label_wins(spark):
    rows = [("he cheated so we broke up", "relationships", "infidelity"), ("i was FIRED and quit", "career", "involuntary_exit"),
            ("quit", "immigration", "unknown"), ("quit", "other", "unknown")]
    df = spark.createDataFrame(rows, "t string, domain string, want string")
    assert all(r["x"] == r["want"] for r in df.select("want", tx.classify_event("t").alias("x")).collect())


def test_tokens_words_and_bigrams(spark):
    assert one(spark, "Café the don’t x_y ab1 two TWO a", tx.tokens("t")) == ["the", "don", "two", "two"]
    assert one(spark, "", tx.word_count("t")) == 1
    assert one(spark, " one two\n three ", tx.word_count("t")) == 3
    assert one(spark, "aa bb cc", tx.terms_and_bigrams("t")) == ["aa", "bb", "cc", "aa bb", "bb cc"]
    assert one(spark, "aa", tx.terms_and_bigrams("t")) == ["aa"]
    assert one(spark, "a thing and a thing", tx.contrast_words("t")) == ["thing", "thing"]


def test_domain_ties_and_eras(spark):
    assert one(spark, "visa job", tx.keyword_domain("t")) == "career"
    assert one(spark, "nothing", tx.keyword_domain("t")) == "career"
    assert one(spark, "visa country wife", tx.keyword_domain("t")) == "immigration"
    years = spark.createDataFrame([(y,) for y in (2019, 2020, 2021, 2022)], "y int")
    assert [r[0] for r in years.select(bins.era(F.col("y"))).collect()] == ["pre_covid", "covid", "covid", "post_covid"]


def test_annotation_parsing(spark):
    schema = "reversal_confident boolean, agency_level string"
    good = one(spark, '```json\n{"reversal_confident": true, "agency_level": "low"}\n```', tx.parse_annotation("t", schema))
    assert good["reversal_confident"] is True and good["agency_level"] == "low"
    bad = one(spark, "sorry", tx.parse_annotation("t", schema))
    assert bad is None or bad["reversal_confident"] is None


def test_inline_and_joined_sentiment_agree(spark):
    rows = [(1, "not good at all!"), (2, "very happy but sad"), (3, ""), (4, None), (5, "plain words only"), (6, "I really love it, no hate!!")]
    df = spark.createDataFrame(rows, "id int, t string")
    a = {r["id"]: r for r in sentiment.inline_sentiment(df, "t").collect()}
    lexicon = spark.createDataFrame(list(lex.DEMO_VALENCE.items()), "token string, valence double")
    b = {r["id"]: r for r in sentiment.lexicon_join(df, "id", "t", lexicon).collect()}
    for i in a:
        for side in ("compound", "neg", "pos", "neu"):
            assert a[i][f"vader_{side}"] == pytest.approx(b[i][side])
    assert a[1]["vader_compound"] < 0 and a[3]["vader_compound"] == 0


def test_label_needs_action_sentence_and_no_negation(spark):
    rows = [("a", "", "I regret that I quit my job without any plan"), ("b", "", "I don't regret that I quit my job without any plan, I regret nothing"),
            ("c", "", "I regret it. quit"), ("d", "", "Will I regret that I quit my job without a plan? I regret it")]
    made = spark.createDataFrame(rows, "id string, title string, selftext string").withColumn("post_year", F.lit(2024))
    out = {r["id"]: r["reversal"] for r in posts.structure_posts(posts.keep_posts(made)).collect()}
    assert out == {"a": 1, "b": 0, "c": 0}


def test_scoring_rules_and_hint(spark):
    df = spark.createDataFrame([("I quit my job under pressure", "auto"), ("hello", "immigration")], "text string, hint string")
    a, b = scoring.score(df, hint="hint").collect()
    assert a["domain"] == "career" and b["domain"] == "immigration"
    assert b["reversal_probability"] == 0.37 and b["emotion"] == "neutral" and b["urgency_score"] == 0
    assert "below the immigration baseline" not in b["interpretation"] and "(37%) is above" in b["interpretation"]


def test_annotation_prompt_shows_a_bounded_text(spark):
    df = spark.createDataFrame([("it's", "y" * 2000)], "title string, full_text string")
    made = df.select(tx.annotation_prompt("Title: %s\nText: %s").alias("p")).first()["p"]
    assert made == "Title: it's\nText: " + "y" * 1500


def test_urls_and_spaces(spark):
    assert one(spark, " see  http://a.b/c?d\n now ", tx.strip_urls("t")) == " see  \n now "
    assert one(spark, " see  \n now ", tx.collapse_spaces("t")) == "see now"

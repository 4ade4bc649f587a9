"""Term counts, contrasts between groups, TF-IDF."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex


def exploded(df: DataFrame, keep: Sequence[str], words: Column) -> DataFrame:
    """One row per word as ``term``. The outer form keeps Spark from computing the words a
    second time in a filter for empty lists below the scan."""
    return df.select(*keep, F.explode_outer(words).alias("term")).where("term IS NOT NULL")


def term_counts(df: DataFrame, words: Column, by: Sequence[str] = ()) -> DataFrame:
    """How often each term occurs per group; tasks pre-add before the shuffle."""
    return exploded(df, by, words).groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("n")
    )


def _score(a: Column, b: Column, n_a: Column, n_b: Column, vocab: Column, alpha: float):
    fa, fb = a + F.lit(alpha), b + F.lit(alpha)
    pad = vocab * F.lit(alpha)
    delta = F.ln(fa / (n_a + pad)) - F.ln(fb / (n_b + pad))
    return delta, delta / F.sqrt(1 / fa + 1 / fb)


def log_odds(df: DataFrame, words: Column, side: Column, alpha: float = 1.0, min_count: int = 10) -> DataFrame:
    """Log-odds with a flat prior and their z for terms of side 1 against side 0.

    The vocabulary is counted before rare terms are dropped.
    """
    sided = df.withColumn("_side", side.cast("int")).where("_side IS NOT NULL")
    counts = exploded(sided, ["_side"], words).groupBy("term").agg(
        F.count_if(F.col("_side") == 1).alias("freq_a"), F.count_if(F.col("_side") == 0).alias("freq_b")
    )
    sums = counts.agg(F.struct(
        F.sum("freq_a").cast("double").alias("a"), F.sum("freq_b").cast("double").alias("b"),
        F.count(F.lit(1)).cast("double").alias("v"),
    )).scalar()
    delta, z = _score(F.col("freq_a"), F.col("freq_b"), sums.getField("a"), sums.getField("b"),
                      sums.getField("v"), alpha)
    return counts.where(F.col("freq_a") + F.col("freq_b") >= min_count).select(
        "term", delta.alias("log_odds"), z.alias("z_score"), "freq_a", "freq_b"
    )


def log_odds_one_vs_rest(df: DataFrame, words: Column, group: str, groups: Sequence[str],
                         alpha: float = 1.0, min_count: int = 10) -> DataFrame:
    """The same for each listed group against all other rows, from one count table."""
    counts = exploded(df.withColumn("_g", F.col(group)), ["_g"], words).groupBy("term").agg(
        F.count(F.lit(1)).alias("all"),
        *[F.count_if(F.col("_g") == F.lit(g)).alias(f"g{i}") for i, g in enumerate(groups)],
    )
    sums = counts.agg(F.struct(
        F.sum("all").cast("double").alias("all"), F.count(F.lit(1)).cast("double").alias("v"),
        *[F.sum(f"g{i}").cast("double").alias(f"g{i}") for i in range(len(groups))],
    )).scalar()
    cells = F.array(*[
        F.struct(F.lit(g).alias("group"), F.col(f"g{i}").alias("freq_a"),
                 (F.col("all") - F.col(f"g{i}")).alias("freq_b"), sums.getField(f"g{i}").alias("n_a"))
        for i, g in enumerate(groups)
    ])
    rows = counts.where(F.col("all") >= min_count).select("term", F.inline(cells))
    delta, z = _score(F.col("freq_a"), F.col("freq_b"), F.col("n_a"),
                      sums.getField("all") - F.col("n_a"), sums.getField("v"), alpha)
    return rows.select("group", "term", delta.alias("log_odds"), z.alias("z_score"), "freq_a", "freq_b")


def early_late(days: Column, early: int = 180, late: int = 365) -> Column:
    """1 for early, 0 for late, null between the two."""
    return F.when(days < early, 1).when(days > late, 0)


def log_odds_early_late(df: DataFrame, words: Column, days: str, min_side: int = 50) -> DataFrame:
    """Early against late rows; no rows unless both sides exceed ``min_side``."""
    side = early_late(F.col(days))
    big = df.agg((F.least(F.count_if(side == 1), F.count_if(side == 0)) > min_side).alias("ok")).scalar()
    return log_odds(df, words, side).where(big)


def word_rates(df: DataFrame, by: str, tokens: Column, words: Sequence[str] = lex.MODAL_VERBS) -> DataFrame:
    """Count and rate per 1000 tokens of each listed word per group."""
    def uses(word: str) -> Column:
        return F.size(F.filter("_t", lambda t: t == F.lit(word)))

    prepared = df.select(by, tokens.alias("_t"))
    sums = prepared.groupBy(by).agg(
        F.sum(F.size("_t")).alias("_total"),
        *[F.sum(uses(w)).alias(w) for w in words],
    )
    cells = F.array(*[F.struct(F.lit(w).alias("word"), F.col(w).alias("n")) for w in words])
    return sums.select(by, "_total", F.inline(cells)).select(
        by, "word", "n",
        F.when(F.col("_total") > 0, F.col("n") / F.col("_total") * 1000).otherwise(0.0).alias("per_1000"),
    )


# --- TF-IDF -------------------------------------------------------------------------
def vocabulary(df: DataFrame, terms: Column, min_df: int, max_features: int) -> DataFrame:
    """(term, df, corpus_n): terms in at least ``min_df`` rows, the most frequent ones. A row's terms are
    sorted, so the first use of each tells itself by the one before it; tasks add up before the shuffle."""
    held = df.select(F.array_sort(terms).alias("_terms"))
    first = lambda t, i: F.when(i == 0, 1).when(F.get("_terms", i - 1) == t, 0).otherwise(1)
    uses = held.select(F.explode_outer(F.transform("_terms", lambda t, i: F.struct(t.alias("term"), first(t, i).alias("d")))).alias("_u"))
    counts = uses.groupBy("_u.term").agg(F.sum("_u.d").alias("df"), F.count(F.lit(1)).alias("corpus_n")).where("term IS NOT NULL")
    return counts.where(F.col("df") >= min_df).orderBy(F.desc("corpus_n"), "term").limit(max_features)


def tfidf_vectors(df: DataFrame, key: str, terms: Column, min_df: int = 5, max_features: int = 10_000) -> tuple[DataFrame, list[str]]:
    """(key, idx, tf, val) per row and the vocabulary in alphabetic order: the positions of a row's listed
    terms, their counts, and tf * (ln((1+n)/(1+df)) + 1) scaled to unit length. No shuffle but that of the
    vocabulary, no Python: counts come from a hash map of the vocabulary, at most ``max_features`` terms,
    that the plan carries to the tasks. A row without a listed term has empty arrays."""
    n = df.count()
    found = sorted((r["term"], r["df"]) for r in vocabulary(df, terms, min_df, max_features).collect())
    names = [t for t, _ in found]
    # the model wants a term and a weight at least: a term with a null sign occurs in no row
    padded = names or ["\0"]
    idf = [math.log((n + 1) / (d + 1)) + 1 for _, d in found] or [0.0]
    rows = df.select(key, F.coalesce(terms, F.array().cast("array<string>")).alias("_terms"))
    counted = CountVectorizerModel.from_vocabulary(padded, "_terms", "_tf").transform(rows)
    weighed = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_raw").transform(counted)
    scaled = Normalizer(p=2.0, inputCol="_raw", outputCol="_val").transform(weighed)
    # sparse vectors keep their positions through both steps
    tf, val = F.unwrap_udt("_tf"), F.unwrap_udt("_val")
    return scaled.select(key, tf["indices"].alias("idx"), tf["values"].alias("tf"), val["values"].alias("val")), names


def named(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with an ``idx`` of a vocabulary, with ``term`` in its place."""
    index = cells.sparkSession.createDataFrame(list(enumerate(names)), "idx int, term string")
    return cells.join(F.broadcast(index), "idx").drop("idx")


def tfidf(df: DataFrame, key: str, terms: Column, min_df: int = 5, max_features: int = 10_000) -> DataFrame:
    """(key, term, tf, weight): ``tfidf_vectors`` as rows. A row without a listed term gives none here."""
    vectors, names = tfidf_vectors(df, key, terms, min_df, max_features)
    cells = vectors.select(key, F.inline(F.arrays_zip("idx", "tf", "val")))
    return named(cells, names).select(key, "term", F.col("tf").cast("bigint").alias("tf"), F.col("val").alias("weight"))


def term_totals(df: DataFrame, terms: Column, min_df: int = 5, max_features: int = 10_000) -> DataFrame:
    """(term, docs, weight): rows that hold a term and its summed weight, added up before it gets its name."""
    vectors, names = tfidf_vectors(df.select("*", F.lit(0).alias("_row")), "_row", terms, min_df, max_features)
    cells = vectors.select(F.inline(F.arrays_zip("idx", "val")))
    return named(cells.groupBy("idx").agg(F.count(F.lit(1)).alias("docs"), F.sum("val").alias("weight")), names)

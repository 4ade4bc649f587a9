"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retroscope.llm import (
    chat, dedup, fill_middle, jaccard_join, language_id, mixing, pieces, prefix_trie, rotated_codes, secret_scan, suffix_dedup, tokens, topk_search,
)

TOKENIZERS = os.environ.get("RETROSCOPE_TOKENIZERS", "/opt/tokenizers")

# what the training mix should hold of each domain of the labels table; good documents are the scarce side, so they stay
MIX_WEIGHTS = {"good": 0.95, "poor": 0.05, "toxic": 0.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


@query(dedup.OP1_SQL)
def op1_exact_dedup(spark, folder):
    return dedup.exact_groups(table(spark, folder, "documents"))


@query()
def op2_mix_sources(spark, folder):
    return mixing.document_rates(table(spark, folder, "documents"), table(spark, folder, "labels"), MIX_WEIGHTS)


@query()
def op3_token_counts(spark, folder):
    return tokens.count_tokens(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.json")


@query(chat.OP4_SQL)
def op4_chat_format(spark, folder):
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
                                  "conv_id bigint, turn bigint, role string, text string")
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_conversations(turns)
    read = out.withColumn("turns", chat.parse_formatted("formatted")).withColumn("learned", chat.learned_text())
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"), "valid")


@query(topk_search.OP5_SQL)
def op5_topk_search(spark, folder):
    return topk_search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query()
def op6_sentencepiece(spark, folder):
    return pieces.segmentations(table(spark, folder, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


@query()
def op7_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    apart = docs.withColumn("held_out", language_id.held_out())
    model = language_id.fit_filters(apart.where(~F.col("held_out") & F.col("doc_id").isNotNull()))
    found = language_id.identify(docs, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@query(jaccard_join.OP8_SQL)
def op8_jaccard_join(spark, folder):
    return jaccard_join.jaccard_groups(table(spark, folder, "documents"))


@query(secret_scan.OP9_SQL)
def op9_secret_scan(spark, folder):
    return secret_scan.secret_spans(table(spark, folder, "documents"))


@query()
def op10_suffix_dedup(spark, folder):
    return suffix_dedup.remove_repeats(table(spark, folder, "documents")).withColumn("kept_bytes", F.col("n_bytes") - F.col("n_removed"))


@query(prefix_trie.OP11_SQL)
def op11_prefix_trie(spark, folder):
    return prefix_trie.prefix_trie(table(spark, folder, "conversations"))


@query(fill_middle.OP12_SQL)
def op12_fill_middle(spark, folder):
    out = fill_middle.fill_in_middle(table(spark, folder, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(fill_middle.restored(), 256).alias("restored_sha256"))


@query()
def op13_nearest_vectors(spark, folder):
    return rotated_codes.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)

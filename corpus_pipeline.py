"""From raw documents to encoded training text: stages over the documents table, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from retroscope.llm import dedup, jaccard_join, language_id, mixing, pieces
from retroscope.llm.queries import MIX_WEIGHTS, TOKENIZERS, table
from retroscope.session import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in none of the labelled languages, or without a letter, go. The filters learn from two thirds of
    the documents; how much of a text its language must hold is measured on the other third."""
    model = language_id.fit_filters(docs.where(~language_id.held_out()))
    return language_id.keep_identified(docs, model, language_id.rejection_share(docs.where(language_id.held_out()), model))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays, the one with the smallest id."""
    return dedup.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.75 stays."""
    return jaccard_join.keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear at rates that bring the domains of the labels table to their target weights."""
    return mixing.mixed(docs, table(spark, sf_dir, "labels"), MIX_WEIGHTS)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as piece ids, with scores and ids of the two best ways through the lattice, as the operator
    gives them; its log frequencies are those of the documents that got here."""
    made = ("text", "pieces", "scores", "best_pieces", "round_trip")
    carried = tuple(c for c in docs.columns if c not in made)
    return pieces.encode_n_best(docs, f"{TOKENIZERS}/piece_bpe_32k.model", carried=carried)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("mixing to target weights", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

# the two classifiers and the encoding cannot be said in SQL; tests hold each stage against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

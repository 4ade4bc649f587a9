"""Exact dedup: group by a 128-bit content hash, keep the smallest id, compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.llm.names import free
from retroscope.session import cut_lineage

# Fixed value: white space of the contract, each run of which counts as one space.
WHITE_SPACE = r"[\x20\x09-\x0D]+"

BROADCAST = 1_000_000  # narrow rows that are sent to all tasks

def normalised(text: str | Column) -> Column:
    """The text as it is compared; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), WHITE_SPACE, " ")


def content_hash(norm: Column) -> Column:
    """128 bits of the normalised text."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, text: str = "text", id: str = "doc_id",
                 hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the hash and, inside a hash, by the bytes themselves, so two texts with one
    hash never fall together. Copies collapse before the shuffle: a group that holds a third of all
    rows sends one row per task. Only hash and id of each row travel to find their group afterwards,
    in a join that Spark may split where one hash is hot.

    Null text counts as empty. Rows without an id group like others but are never kept unless all
    rows of the group lack one. Rows that repeat an id with the same text all count in group_size and
    share the same flags. An empty table gives no rows; other columns of ``docs`` are ignored.
    """
    keyed = docs.select(F.col(id).alias("doc_id"), normalised(text).alias("norm")).withColumn("hash", hashed(F.col("norm")))
    groups = cut_lineage(
        keyed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("hash", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256")))
    shared = cut_lineage(groups.groupBy("hash").count().where("count > 1").select("hash"))
    rows = keyed.select("doc_id", "hash")
    if shared.isEmpty():
        marked = rows.join(groups, "hash")
    else:
        # several texts under one hash: those rows find their group by hash and bytes
        apart = rows.join(shared, "hash", "left_anti").join(groups.join(shared, "hash", "left_anti"), "hash")
        mixed = keyed.join(shared, "hash", "left_semi")
        kinds = mixed.groupBy("hash", "norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        mixed = mixed.join(kinds, ["hash", "norm"]).withColumn("text_sha256", F.sha2("norm", 256)).drop("norm")
        marked = apart.unionByName(mixed)
    return marked.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         "text_sha256")


def drop_copies(docs: DataFrame, text: str = "text", id: str = "doc_id", hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The documents without exact copies, all columns kept. Rows that repeat an id with the same
    text are copies as well and one of them stays; an id with several texts is judged text by text.

    Groups are counted by hash and id alone. Bytes are compared only under hashes of several rows, where
    copies collapse before the shuffle, and the rows that go are taken out by hash and id: a text with a
    hash of its own never moves. Lists of up to BROADCAST hashes go to the tasks; longer ones meet the rows
    in a sorted join.
    """
    h, norm = free(docs.columns, "hash", "norm")
    keyed = docs.withColumn(h, hashed(normalised(text)))
    ids = keyed.select(F.col(id).alias("doc_id"), F.col(h).alias("hash")).groupBy("hash", "doc_id").agg(F.count("*").alias("c"))
    ids = cut_lineage(ids)
    groups = cut_lineage(ids.groupBy("hash").agg(
        F.sum("c").alias("n"), F.min("doc_id").alias("keep"), F.coalesce(F.min_by("c", "doc_id"), F.sum("c")).alias("same")).where("n > 1"))
    # several rows under one hash: what their bytes say
    shared = keyed.join(_sized(groups.select(F.col("hash").alias(h))), h, "left_semi").withColumn(norm, normalised(text))
    kinds = cut_lineage(shared.groupBy(F.col(h).alias("hash"), F.col(norm).alias("norm")).agg(F.min(id).alias("keep")).select("hash", "keep", F.sha2("norm", 256).alias("sha")))
    apart = cut_lineage(kinds.groupBy("hash").count().where("count > 1").select("hash"))
    alike = groups if apart.isEmpty() else cut_lineage(groups.join(apart, "hash", "left_anti"))
    gone = cut_lineage(ids.join(_sized(alike.select("hash", "keep")), "hash").where(~F.col("doc_id").eqNullSafe(F.col("keep"))).select("hash", "doc_id"))
    losers = _sized(gone.select(F.col("hash").alias("g_hash"), F.col("doc_id").alias("g_id"))).alias("g")
    rest = keyed.alias("k").join(losers, (F.col(f"k.{h}") == F.col("g.g_hash")) & F.col(f"k.{id}").eqNullSafe(F.col("g.g_id")), "left_anti")
    repeated = alike.where("same > 1").select(F.col("hash").alias(h))
    if not repeated.isEmpty():
        again = _sized(repeated)
        rest = rest.join(again, h, "left_anti").unionByName(rest.join(again, h, "left_semi").dropDuplicates([h]))
    if apart.isEmpty():
        return rest.select(*docs.columns)
    # different texts under one hash are told apart by their bytes
    these = _sized(apart.select(F.col("hash").alias(h)))
    mixed = keyed.join(these, h, "left_semi").withColumn(norm, normalised(text)).alias("k")
    kept = kinds.join(apart, "hash").select(F.col("sha").alias("g_sha"), F.col("keep").alias("g_id")).alias("g")
    mixed = mixed.join(kept, (F.sha2(F.col(f"k.{norm}"), 256) == F.col("g.g_sha")) & F.col(f"k.{id}").eqNullSafe(F.col("g.g_id")), "left_semi")
    return rest.join(these, h, "left_anti").select(*docs.columns).unionByName(mixed.dropDuplicates([norm]).select(*docs.columns))


def _sized(keys: DataFrame) -> DataFrame:
    """Keys of a written table, for the tasks where they are few enough, for a sorted join otherwise."""
    return F.broadcast(keys) if keys.count() <= BROADCAST else keys.hint("merge")


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)
"""

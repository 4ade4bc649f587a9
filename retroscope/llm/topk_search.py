"""Exact top-k search over an impact-ordered index, one segment of equal impact at a time.

Vectors are whole numbers. A shard of them keeps, per component, its rows in LEVELS classes of equal
width: the postings. For a query each class of a component is a segment whose rows gain at least a
known amount; segments are taken by descending impact and add that amount to their rows. At any time
a row scores at least what it has gained and at most that plus what open segments and class widths
can still give. Rows whose upper bound lies below the k-th lower bound are out for good: the search
stops as soon as few are left, or when segments run out, and scores those left exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCALE = 1024
SHARD = 16_384
QUERIES = 1_024
LEVELS = 64
FEW = 64  # possible members at which exact scores are cheaper than more segments
CHECKS = 16


def quantised(vector: str | Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null where a component is null or not finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    fit = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fit, F.transform(c, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Shard:
    """The postings of some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.low, self.high = vectors.min(axis=0), vectors.max(axis=0)
        self.width = (self.high - self.low) // LEVELS + 1
        level = (vectors - self.low) // self.width
        self.rows = np.argsort(level, axis=0, kind="stable").T.copy()
        self.cuts = np.stack([np.searchsorted(np.sort(level[:, j]), np.arange(LEVELS + 1)) for j in range(vectors.shape[1])]) \
            if vectors.shape[1] else np.zeros((0, LEVELS + 1), np.int64)

    def segments(self, query: np.ndarray):
        """Per segment, by descending impact: component, class, least and most it gives; and the most each component has."""
        classes = np.arange(LEVELS)
        least, span = classes * self.width[:, None], self.width[:, None] - 1
        most = np.minimum(least + span, (self.high - self.low)[:, None])
        rise = (query > 0)[:, None]
        whole = (self.high - self.low)[:, None]
        gain_least = np.where(rise, least, np.maximum(whole - most, 0)) * np.abs(query)[:, None]
        gain_most = np.where(rise, most, np.maximum(whole - least, 0)) * np.abs(query)[:, None]
        j, c = np.nonzero((np.diff(self.cuts, axis=1) > 0) & (query != 0)[:, None])
        order = np.argsort(-gain_most[j, c], kind="stable")
        j, c = j[order], c[order]
        return j, c, gain_least[j, c], gain_most[j, c]

    def best(self, query: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the k best (all ties at the end by id) and their scores."""
        others = np.flatnonzero(self.ids != own)
        if len(others) > max(k, FEW) and len(query):
            j, c, least, most = self.segments(query)
            gained = np.zeros(len(self.ids), np.int64)
            # what a row can still gain in a component: its next open segment, or the width of the class it was in
            slack = np.abs(query) * (self.width - 1)
            after = np.zeros(len(j), np.int64)
            for x in range(len(query)):
                mine = np.flatnonzero(j == x)
                after[mine] = np.concatenate([most[mine][1:], [0]]) if len(mine) else 0
            bound = np.array([max(slack[x], most[j == x].max(initial=0)) for x in range(len(query))])
            step, possible = max(1, -(-len(j) // CHECKS)), others
            for at in range(0, len(j), step):
                for x, y, gain, then in zip(j[at:at + step], c[at:at + step], least[at:at + step], after[at:at + step]):
                    gained[self.rows[x, self.cuts[x, y]:self.cuts[x, y + 1]]] += gain
                    bound[x] = max(slack[x], then)
                mine = gained[others]
                kth = np.partition(mine, len(mine) - k)[len(mine) - k]
                possible = others[mine + bound.sum() >= kth]
                if len(possible) <= FEW:
                    break
            others = possible
        scores = self.vectors[others] @ query
        top = np.lexsort((self.ids[others], -scores))[:k]
        return others[top], scores[top]


def _answer(k: int):
    def answer(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if queries.num_rows and rows.num_rows:
            width = max(int(np.diff(t.column("v").combine_chunks().offsets.to_numpy()).max(initial=0)) for t in (queries, rows))
            shard = Shard(rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), width))
            for own, q in zip(queries.column("vec_id").to_numpy(), _matrix(queries.column("v"), width)):
                found, scores = shard.best(q, own, k)
                for held, new in zip(out, (np.full(len(found), own), shard.ids[found], scores)):
                    held.append(new)
        cols = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
        return pa.table({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    return answer


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", id: str = "vec_id",
          scale: int = SCALE, shard_rows: int = SHARD, block_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row that ``is_query`` marks the k largest inner
    products with all rows of another id, ties to the smaller id; all, if there are fewer.

    Rows are dealt over shards of about ``shard_rows``, queries over blocks of about ``block_rows``;
    each pair of a shard and a block is one task of bounded size, and a shard sends k rows a query.
    A vector that is null, or holds a null or a component that is not finite, takes no part, nor does
    a row without an id. Shorter vectors count as filled up with zeros. A repeated row is a candidate
    of its own; a repeated query is asked once. No rows or no queries give no rows. Scores are exact
    while the sums stay below 2**63.
    """
    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("vec_id"), quantised(vector, scale).alias("v"), is_query.alias("asks"))
    rows = rows.where("v IS NOT NULL")
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).first()
    shards, blocks = max(1, -(-counts.n // shard_rows)), max(1, -(-counts.q // block_rows))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # dealt by row number: equal vectors and equal ids do not meet in one shard
    held = (rows.select("vec_id", "v").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
            .withColumn("block", span(blocks)))
    asked = (rows.where("asks").select("vec_id", "v").distinct().withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", span(shards)))
    found = (asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
             .applyInArrow(_answer(k), "query_id bigint, vec_id bigint, score bigint"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM p QUALIFY rank <= 10
"""

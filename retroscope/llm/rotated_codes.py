"""Approximate nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to one of a few centres, filled up with zeros, rotated at random, and kept as
the signs of its D components, packed. With x the unit vector of those signs, o the vector's own direction
and q the query's, <o, q> is estimated by <x, q> / <x, o>; the correction scalar <x, o> and the length of the
vector are kept beside the bits. The estimate is off by about sqrt((1 - <x,o>^2) / (<x,o>^2 (D - 1))) in one
standard deviation, so a distance has a lower bound that holds but for a chance EPSILON sets. The query is
rounded to whole numbers of BITS bits; with these its product with the signs is a weighted sum of popcounts,
and what rounding costs is bounded by the length of the rounding error. Vectors are looked at exactly by
rising lower bound, until that bound exceeds the k-th distance found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.session import cut_lineage, discard

SEED = 20
EPSILON = 2.5  # standard deviations a bound allows for
SPREAD = 2  # bits per component: a vector filled up with zeros has more signs, which halves the variance of its estimates
BITS = 8
SAMPLE = 4_096  # rows the centres are fitted on, and first distances measured against
CENTRES = 16
SHARD_VALUES = 1 << 20  # components of the vectors of one shard
QUERIES = 2_048
CHUNK = 64  # vectors first looked at exactly; then twice as many each time


def usable(vector: str | Column) -> Column:
    """The vector as doubles; null where it is null, zero or empty, or holds a null or a component that is not finite."""
    c = F.col(vector) if isinstance(vector, str) else vector
    fit = F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(c, lambda x: x != 0)
    return F.when(fit, F.transform(c, lambda x: x.cast("double")))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as rows of ``width`` numbers, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotated(x: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Rows turned by a random rotation: three rounds of random signs and a Hadamard transform. Rows are
    filled up with zeros to SPREAD times their width, and on to a power of two (64 at least), so that no
    matrix of the square of the width is needed."""
    width = max(64, 1 << max(0, SPREAD * x.shape[1] - 1).bit_length())
    out = np.zeros((len(x), width))
    out[:, :x.shape[1]] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def fit_centres(sample: np.ndarray, k: int = CENTRES, seed: int = SEED, rounds: int = 10) -> np.ndarray:
    """Means of the sample's nearest-centre groups, from rows of the sample as first centres."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:k]].copy()
    for _ in range(rounds):
        near = nearest_centre(sample, centres)
        for j in np.unique(near):
            centres[j] = sample[near == j].mean(axis=0)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres ** 2).sum(axis=1) - 2 * x @ centres.T).argmin(axis=1)


def encode(x: np.ndarray, centres: np.ndarray, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Centre, packed signs (eight bytes to a word), length and correction scalar of each row."""
    near = nearest_centre(x, centres)
    turned = rotated(x - centres[near], seed)
    length = np.sqrt((turned ** 2).sum(axis=1))
    bits = np.packbits(turned > 0, axis=1, bitorder="little")
    scalar = np.abs(turned).sum(axis=1) / (np.sqrt(turned.shape[1]) * np.where(length > 0, length, 1))
    return near, bits, length, np.where(length > 0, scalar, 1.0)


class Codes:
    """The codes of a shard's vectors, and the vectors for the exact look."""

    def __init__(self, ids, vectors, near, bits, length, scalar, turned_centres, epsilon):
        order = np.argsort(near, kind="stable")
        self.ids, self.vectors, self.length, self.scalar = ids[order], vectors[order], length[order], scalar[order]
        self.words = np.ascontiguousarray(bits[order]).view(np.uint64)
        self.cuts = np.searchsorted(near[order], np.arange(len(turned_centres) + 1))
        self.turned_centres = turned_centres
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        width = turned_centres.shape[1]
        spread = np.sqrt(np.maximum(0, 1 - self.scalar ** 2) / max(1, width - 1)) / self.scalar
        self.off = epsilon * spread

    def least(self, turned: np.ndarray) -> np.ndarray:
        """A lower bound of the squared distance of each vector to a rotated query."""
        width = len(turned)
        out = np.empty(len(self.ids))
        for j, centre in enumerate(self.turned_centres):
            part = slice(self.cuts[j], self.cuts[j + 1])
            if part.start == part.stop:
                continue
            q = turned - centre
            far = np.sqrt(q @ q)
            q = q / far if far > 0 else q
            low, step = q.min(), max((q.max() - q.min()) / (2 ** BITS - 1), 1e-300)
            whole = np.rint((q - low) / step).astype(np.int64)
            rounding = q - (low + whole * step)
            planes = np.packbits((whole[None, :] >> np.arange(BITS)[:, None]) & 1, axis=1, bitorder="little").view(np.uint64)
            words, ones = self.words[part], self.ones[part]
            both = np.zeros(len(words), np.int64)
            for b in range(BITS):
                both += np.bitwise_count(words & planes[b]).sum(axis=1, dtype=np.int64) << b
            # sum of sign * (low + step * whole) over the components, from the components whose sign is +
            product = (low * (2 * ones - width) + step * (2 * both - whole.sum())) / np.sqrt(width)
            cosine = product / self.scalar[part] + self.off[part] + np.sqrt(rounding @ rounding) / self.scalar[part]
            length = self.length[part]
            out[part] = length ** 2 + far ** 2 - 2 * length * far * np.minimum(cosine, 1)
        return np.maximum(out, 0)

    def search(self, own, query: np.ndarray, turned: np.ndarray, reach: float, k: int):
        """Ids and distances of the k nearest of another id that are no further than ``reach``, and how many were looked at."""
        least = self.least(turned) * (1 - 1e-12) - 1e-12
        open_ = np.flatnonzero((least <= reach * reach) & (self.ids != own))
        open_ = open_[np.argsort(least[open_], kind="stable")]
        ids, found, at, step = np.empty(0, np.int64), np.empty(0), 0, CHUNK
        while at < len(open_) and least[open_[at]] <= reach * reach:
            rows = open_[at:at + step]
            away = np.sqrt(((self.vectors[rows] - query) ** 2).sum(axis=1))
            ids, found = np.append(ids, self.ids[rows]), np.append(found, away)
            best = np.lexsort((ids, found))[:k]
            ids, found = ids[best], found[best]
            if len(found) == k:
                reach = min(reach, found[-1])
            at, step = at + step, step * 2
        keep = found <= reach
        return ids[keep], found[keep], min(at, len(open_))


def _indexed(rows: DataFrame, centres: np.ndarray, width: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, bits, length, scalar = encode(matrix(b.column(1), width), centres, seed)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(near.astype(np.int32)), pa.array([r.tobytes() for r in bits], pa.binary()),
                 pa.array(length), pa.array(scalar)], ["vec_id", "v", "asks", "centre", "code", "length", "scalar"])

    return rows.select("vec_id", "v", "asks").mapInArrow(
        run, "vec_id bigint, v array<double>, asks boolean, centre int, code binary, length double, scalar double")


def _asked(queries: DataFrame, sample_ids: np.ndarray, sample: np.ndarray, width: int, k: int) -> DataFrame:
    """Each query with ``reach``: its k-th distance to rows of the sample, or infinity. k rows are that
    near, so the k nearest of all rows are no further."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach = []
            for own, q in zip(b.column(0).to_numpy(), matrix(b.column(1), width)):
                away = np.sort(((sample[sample_ids != own] - q) ** 2).sum(axis=1))
                reach.append(float(np.sqrt(away[k - 1]) * (1 + 1e-12)) if len(away) >= k else float("inf"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(reach, pa.float64())], ["vec_id", "v", "reach"])

    return queries.mapInArrow(run, "vec_id bigint, v array<double>, reach double")


def _answer(k: int, centres: np.ndarray, width: int, seed: int, epsilon: float):
    def answer(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if queries.num_rows and rows.num_rows:
            bits = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            shard = Codes(rows.column("vec_id").to_numpy(), matrix(rows.column("v"), width), rows.column("centre").to_numpy(), bits,
                          rows.column("length").to_numpy(), rows.column("scalar").to_numpy(), rotated(centres, seed), epsilon)
            asked = matrix(queries.column("v"), width)
            for own, q, turned, reach in zip(queries.column("vec_id").to_numpy(), asked, rotated(asked, seed), queries.column("reach").to_numpy()):
                ids, away, looked = shard.search(own, q, turned, reach, k)
                for held, new in zip(out, (np.full(len(ids), own), ids, away, np.full(len(ids), looked))):
                    held.append(new)
        cols = [np.concatenate(x) if x else np.empty(0) for x in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)),
                         "score": pa.array(cols[2].astype(float)), "looked_at": pa.array(cols[3].astype(np.int64))})

    return answer


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", id: str = "vec_id", seed: int = SEED,
            epsilon: float = EPSILON, sample_rows: int = SAMPLE, centres: int = CENTRES, shard_values: int = SHARD_VALUES,
            block_rows: int = QUERIES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), looked_at: for each row that ``is_query``
    marks its k nearest rows of another id, nearest first, ties to the smaller id; all, if there are fewer.
    ``looked_at`` counts the vectors the row's shard measured exactly for the query.

    Centres are fitted on the ``sample_rows`` rows with the smallest hashes; every row is encoded once and
    written. Rows are dealt over shards of ``shard_values`` components, queries over blocks of
    ``block_rows``; each pair of a shard and a block is one task of bounded size, and a shard sends at most k
    rows a query. A vector that is null, empty or zero, or holds a null or a component that is not
    finite, takes no part, nor does a row without an id. Shorter vectors count as filled up with zeros. A
    repeated row is a candidate of its own; a repeated query (same id, same vector) is asked once, one id
    with two vectors asks with both and gets the k nearest of either. No rows or no queries give no rows.
    Scores are exact; a nearer row is missed only where its error exceeds ``epsilon`` deviations.
    """
    rows = vectors.where(F.col(id).isNotNull()).select(F.col(id).cast("bigint").alias("vec_id"), usable(vector).alias("v"),
                                                       F.coalesce(is_query, F.lit(False)).alias("asks")).where("v IS NOT NULL")
    head = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("width")).first()
    width = head.width or 1
    chosen = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(sample_rows).select("vec_id", "v").toArrow()  # bounded by the parameter
    sample_ids, sample = chosen.column("vec_id").to_numpy(), matrix(chosen.column("v"), width)
    middle = fit_centres(sample, centres, seed) if head.n else np.zeros((1, width))
    index = cut_lineage(_indexed(rows, middle, width, seed))
    shards, blocks = max(1, -(-head.n * width // shard_values)), max(1, -(-head.q // block_rows))
    span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = _asked(index.where("asks").select("vec_id", "v").distinct(), sample_ids, sample, width, k)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).withColumn("shard", span(shards))
    # dealt by row number: equal vectors do not meet in one shard
    held = (index.drop("asks").withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(shards)).cast("int"))
            .withColumn("block", span(blocks)))
    found = (asked.groupBy("shard", "block").cogroup(held.groupBy("shard", "block"))
             .applyInArrow(_answer(k, middle, width, seed, epsilon), "query_id bigint, vec_id bigint, score double, looked_at bigint"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score", "looked_at")

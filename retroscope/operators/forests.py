"""Forests of two classes on few numeric columns, grown level by level for all trees at once.

A pass is one job: tasks route their rows through the trees so far, one tree after the other, and send a
histogram per open node; each group of nodes finds its best splits where its histograms meet. The driver holds
the trees. Bootstrap weights come from the key, so with the same cut points (a sketch gives those of columns with
many values) the trees do not depend on how rows are dealt out. One tree's histograms stay in a core's cache while
a task's rows go through it.

The rules are those of Spark ML's forest: Poisson weights, up to 32 bins a column, a random subset of columns
per node, the split of largest Gini gain, and leaves of one parent that predict the same class become one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.operators import resample

BINS = 32
TASK = 100_000  # rows of a task, once there are more than cores
NODES = 64  # nodes whose histograms meet in one group
DEEPEST = 14  # levels below the root; nodes are numbered as in a heap, 2 ** 15 of them at most

BINNED = "y tinyint, w double, x binary, drawn binary"
SUMS = "tree int, part int, h binary"
SPLITS = "tree int, node int, feature int, cut int, l0 double, l1 double, r0 double, r1 double"


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _codes(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Number of cut points below each value."""
    return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1).astype(np.uint8)


def cut_points(df: DataFrame, features: str = "features") -> list[np.ndarray]:
    """Up to 31 cut points per column: between all values where they are few, else at quantiles of all rows."""
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for j, col in enumerate(_matrix(batch.column(0)).T):
                    held = seen.get(j, np.empty(0))
                    if len(held) <= BINS:
                        seen[j] = np.unique(np.concatenate([held, col[~np.isnan(col)]]))[:BINS + 1]
        if seen:
            yield pa.RecordBatch.from_pydict({"j": pa.array(list(seen), pa.int32()), "v": pa.array([v.tolist() for v in seen.values()], pa.list_(pa.float64()))})

    rows = df.select(vector_to_array(features).alias("x"))
    values = rows.mapInArrow(few, "j int, v array<double>").select("j", F.explode_outer("v").alias("v")).groupBy("j").agg(
        F.sort_array(F.collect_set("v")).alias("v"))
    found = {r["j"]: np.array(r["v"]) for r in values.collect()}
    many = [j for j, v in found.items() if len(v) > BINS]
    if many:
        steps = [i / BINS for i in range(1, BINS)]
        x = {j: F.get("x", F.lit(j)) for j in many}
        at = rows.agg(*[F.percentile_approx(F.when(~F.isnan(x[j]), x[j]), steps, 20 * BINS).alias(f"q{j}") for j in many]).first()
    return [np.unique(at[f"q{j}"]) if j in many else (found[j][:-1] + found[j][1:]) / 2 for j in sorted(found)]


def _bytes(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _from_bytes(batches: list[pa.RecordBatch], i: int, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(v for b in batches for v in b.column(i).to_pylist()), np.uint8).reshape(-1, width)


def _binned(df: DataFrame, key: str, cuts: list[np.ndarray], trees: int, seed: int, weight: str | None) -> DataFrame:
    """Per row its bins, a byte a column, and its bootstrap weights, a byte a tree."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                drawn = resample.poisson_weights(batch.column(0).to_numpy(), np.arange(1, trees + 1), seed)
                codes = _codes(_matrix(batch.column(3)), cuts)
                yield pa.RecordBatch.from_arrays([*batch.columns[1:3], _bytes(codes), _bytes(drawn)], ["y", "w", "x", "drawn"])

    return df.select(resample.key_number(df, key).alias("k"), F.col("label").cast("tinyint").alias("y"),
                     (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"),
                     vector_to_array("features").alias("x")).mapInArrow(code, BINNED)


def best_splits(h: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of histograms (node, column, bin, class): column and bin of the largest Gini gain, -1 if none gains,
    and the class weights on both sides (left: all, if none)."""
    left = h.cumsum(2)
    whole = left[:, :1, -1:]
    left = left[:, :, :-1]
    right = whole - left

    def spread(c: np.ndarray) -> np.ndarray:
        n = c.sum(-1)
        return n - (c * c).sum(-1) / np.maximum(n, 1e-300)

    gain = np.where((left.sum(-1) > 0) & (right.sum(-1) > 0), spread(whole) - spread(left) - spread(right), 0.0)
    flat = gain.reshape(len(h), -1)
    at = np.arange(len(h)), flat.argmax(1)
    column, cut = np.divmod(at[1], h.shape[2] - 1)
    gains = flat[at] > 1e-12 * np.maximum(whole.sum((1, 2, 3)), 1e-300)
    side = [np.where(gains[:, None], s[at[0], column, cut], e) for s, e in ((left, whole[:, 0, 0]), (right, 0.0))]
    return np.where(gains, column, -1), cut, *side


class Forest:
    """``fit`` returns a model; columns read: ``label`` 0 or 1, ``features`` and the key."""

    def __init__(self, trees: int, depth: int, key: str, seed: int = 42, weight: str | None = None):
        if depth > DEEPEST:
            raise ValueError(f"at most {DEEPEST} levels")
        self.trees, self.depth, self.key, self.seed, self.weight = trees, depth, key, seed, weight

    def fit(self, df: DataFrame) -> ForestModel:
        spark, cuts = df.sparkSession, cut_points(df)
        rows = _binned(df, self.key, cuts, self.trees, self.seed, self.weight)
        tasks = max(spark.sparkContext.defaultParallelism, -(-df.count() // TASK))
        rows = rows.coalesce(tasks).persist()
        size, p = 2 << self.depth, len(cuts)
        feature, cut = np.full((self.trees, size), -1, np.int16), np.zeros((self.trees, size), np.uint8)
        counts = np.zeros((self.trees, size, 2))
        open_nodes = [np.array([1])] * self.trees
        try:
            for level in range(self.depth):
                some = [self._columns(t, level, len(o), p) for t, o in enumerate(open_nodes)]
                for r in self._pass(rows, feature, cut, open_nodes, some, level, p).collect():
                    t, node = r["tree"], open_nodes[r["tree"]][r["node"]]
                    sides = (r["l0"], r["l1"]), (r["r0"], r["r1"])
                    counts[t, node] = np.add(*sides)
                    if r["feature"] >= 0:
                        feature[t, node], cut[t, node] = some[t][r["node"], r["feature"]], r["cut"]
                        counts[t, 2 * node], counts[t, 2 * node + 1] = sides
                open_nodes = [self._next(o[feature[t, o] >= 0], counts[t]) for t, o in enumerate(open_nodes)]
                if not any(map(len, open_nodes)):
                    break
        finally:
            rows.unpersist()
        return ForestModel(cuts, self.depth, _pruned(feature, counts), cut, counts)

    def _columns(self, tree: int, level: int, nodes: int, p: int) -> np.ndarray:
        """The columns each open node may split on."""
        draw = np.random.default_rng((self.seed, tree, level)).random((nodes, p))
        return draw.argsort(1)[:, :int(np.ceil(np.sqrt(p)))].astype(np.int64)

    @staticmethod
    def _next(split: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Children that are not pure."""
        below = np.concatenate([2 * split, 2 * split + 1])
        return np.sort(below[counts[below].min(1) > 0]) if len(below) else below

    def _pass(self, rows, feature, cut, open_nodes, some, level, p) -> DataFrame:
        trees, whole = self.trees, self.weight is None
        first, wide = 1 << level, some[0].shape[1]

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if not held:
                return
            y, w = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
            y, flat = y.astype(np.int64), _from_bytes(held, 2, p).ravel()
            drawn = np.ascontiguousarray(_from_bytes(held, 3, trees).T)
            for t in np.flatnonzero([len(o) for o in open_nodes]):
                own = np.flatnonzero(drawn[t])
                node, f_of, cut_of = np.ones(len(own), np.int64), feature[t].astype(np.int64), cut[t]
                for _ in range(level):
                    f = f_of.take(node)
                    if (f < 0).any():
                        own, node, f = own[f >= 0], node[f >= 0], f[f >= 0]
                    f += own * p
                    node = 2 * node + (flat.take(f) > cut_of.take(node))
                place = np.full(first, -1, np.int64)
                place[open_nodes[t] - first] = np.arange(len(open_nodes[t]))
                node = place.take(node - first)
                own, node = own[node >= 0], node[node >= 0]
                weight, start, spot = drawn[t].take(own) * w.take(own), own * p, node * (2 * BINS) + y.take(own)
                h = np.empty((len(open_nodes[t]), wide, 2 * BINS), np.float32 if whole else np.float64)
                for j in range(wide):
                    code = flat.take(some[t][:, j].take(node) + start)
                    h[:, j] = np.bincount(spot + 2 * code.astype(np.int64), weight, len(h) * 2 * BINS).reshape(len(h), -1)
                parts = range(0, len(h), NODES)
                yield pa.RecordBatch.from_arrays([
                    pa.array([t] * len(parts), pa.int32()), pa.array([i // NODES for i in parts], pa.int32()),
                    pa.array([h[i:i + NODES].tobytes() for i in parts], pa.binary())], ["tree", "part", "h"])

        def splits(table: pa.Table) -> pa.Table:
            t, part, total = table.column("tree")[0].as_py(), table.column("part")[0].as_py(), 0.0
            for h in table.column("h"):
                total = total + np.frombuffer(h.as_buffer(), np.float32 if whole else np.float64).astype(np.float64)
            column, at, left, right = best_splits(total.reshape(-1, wide, BINS, 2))
            n = len(column)
            return pa.table({"tree": pa.array([t] * n, pa.int32()), "node": pa.array(part * NODES + np.arange(n), pa.int32()),
                             "feature": pa.array(column, pa.int32()), "cut": pa.array(at, pa.int32()),
                             "l0": left[:, 0], "l1": left[:, 1], "r0": right[:, 0], "r1": right[:, 1]})

        return rows.mapInArrow(sums, SUMS).groupBy("tree", "part").applyInArrow(splits, SPLITS)


def _pruned(feature: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Two leaves of one parent that predict the same class become one, from the bottom up."""
    says = counts[:, :, 1] > counts[:, :, 0]
    for node in range(feature.shape[1] // 2 - 1, 0, -1):
        a, b = 2 * node, 2 * node + 1
        feature[(feature[:, a] < 0) & (feature[:, b] < 0) & (says[:, a] == says[:, b]), node] = -1
    return feature


class ForestModel:
    def __init__(self, cuts, depth: int, feature: np.ndarray, cut: np.ndarray, counts: np.ndarray):
        self.cuts, self.depth, self.feature, self.cut = cuts, depth, feature, cut
        self.share = counts[:, :, 1] / np.maximum(counts.sum(2), 1e-300)
        self.grown = np.flatnonzero(counts[:, 1].sum(1) > 0)  # a tree that drew no row has no vote

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 over the leaves a row comes to."""
        codes, total = _codes(x, self.cuts), np.zeros(len(x))
        flat, start = codes.ravel(), np.arange(len(x)) * codes.shape[1]
        for t in self.grown:
            f_of, cut_of, node = self.feature[t].astype(np.int64), self.cut[t], np.ones(len(x), np.int64)
            for _ in range(self.depth):
                f = f_of.take(node)
                if (f < 0).all():
                    break
                below = 2 * node + (flat.take(np.maximum(f, 0) + start) > cut_of.take(node))
                node = np.where(f < 0, node, below)
            total += self.share[t].take(node)
        return total / max(1, len(self.grown))

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability``."""
        names = [c for c in df.columns if c != "features"]

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(self.score(_matrix(batch.column(batch.num_columns - 1))))], [*names, "_score"])

        rows = df.select(*names, vector_to_array("features").alias("_x"))
        out = rows.mapInArrow(scored, rows.drop("_x").withColumn("_score", F.lit(0.0)).schema)
        return out.withColumn("probability", array_to_vector(F.array(1 - F.col("_score"), "_score"))).drop("_score")

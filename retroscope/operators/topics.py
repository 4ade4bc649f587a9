"""Topics by non-negative factorisation and dense reduction by PCA."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.operators.relational import vector_sum


def _added(at: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``parts`` added up by their place among ``n``."""
    out = np.zeros((n, parts.shape[1]))
    if n:
        for j in range(parts.shape[1]):
            out[:, j] = np.bincount(at, parts[:, j], n)
    return out


class _Batch:
    """Sparse rows of one Arrow batch laid end to end."""

    def __init__(self, idx: pd.Series, val: pd.Series):
        sizes = idx.map(len).to_numpy()
        self.n = len(sizes)
        self.row = np.repeat(np.arange(self.n), sizes)
        self.idx = np.concatenate([np.asarray(i) for i in idx]) if self.n else np.zeros(0, int)
        self.val = np.concatenate([np.asarray(v) for v in val]) if self.n else np.zeros(0)

    def loads(self, h: np.ndarray, gram: np.ndarray, sweeps: int = 200):
        """Best non-negative loads of every row given the topics, by coordinate descent. A row that no longer
        moves is left out of later sweeps."""
        target = _added(self.row, h[:, self.idx].T * self.val[:, None], self.n)
        w = np.repeat(target.sum(axis=1, keepdims=True) / max(gram.sum(), 1e-12), len(h), axis=1)
        live = np.arange(self.n)
        for _ in range(sweeps):
            part, goal, moved = w[live], target[live], np.zeros(len(live))
            for j in np.flatnonzero(np.diag(gram) > 0):
                new = np.maximum(0.0, part[:, j] + (goal[:, j] - part @ gram[:, j]) / gram[j, j])
                moved = np.maximum(moved, np.abs(new - part[:, j]))
                part[:, j] = new
            w[live] = part
            live = live[moved >= 1e-9]
            if not len(live):
                break
        return w, target


class NmfModel:
    """Topics x terms matrix (at most k x max_features) and its vocabulary."""

    def __init__(self, terms: list[str], h: np.ndarray, losses: list[float]):
        self.terms, self.h, self.losses = terms, h, losses

    def top_terms(self, spark, n: int = 10) -> DataFrame:
        """(topic, top_terms, label): the heaviest terms, and a short label of the first three."""
        rows = []
        for k, row in enumerate(self.h):
            best = [self.terms[i] for i in np.argsort(-row, kind="stable")[:n]]
            rows.append((k, ", ".join(best), f"T{k}: {', '.join(best[:3])}"))
        return spark.createDataFrame(rows, "topic int, top_terms string, label string")

    def transform(self, rows: DataFrame, key: str) -> DataFrame:
        """(key, loads, topic, residual) of (key, idx, val) rows: the best non-negative loads, the topic with
        the largest (the first on ties, and for an empty row), and what of the squared length is left."""
        h, gram = self.h, self.h @ self.h.T
        kind = rows.schema[key].dataType.simpleString()

        def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                held = _Batch(b["idx"], b["val"])
                w, target = held.loads(h, gram)
                square = np.bincount(held.row, held.val ** 2, held.n) if held.n else np.zeros(0)
                left = square - 2 * (w * target).sum(axis=1) + ((w @ gram) * w).sum(axis=1)
                yield pd.DataFrame({key: b[key], "loads": list(w), "topic": w.argmax(axis=1), "residual": left})

        return rows.select(key, "idx", "val").mapInPandas(assign, f"{key} {kind}, loads array<double>, topic int, residual double")


def stated_model(terms: list[str], groups: list[list[str]]) -> NmfModel:
    """Topics that are given: each the mean direction of its listed terms, those the vocabulary has."""
    place = {t: i for i, t in enumerate(terms)}
    h = np.zeros((len(groups), len(terms)))
    for k, group in enumerate(groups):
        h[k, [place[t] for t in group if t in place]] = 1.0
    return NmfModel(terms, h, [])


def _summed(rows: DataFrame, partial, width: int) -> dict[int, np.ndarray]:
    """One job: ``partial`` gives (pos, v) with v of ``width`` numbers per task, v is added up per pos."""
    parts = rows.select("idx", "val").mapInPandas(partial, "pos int, v array<double>")
    found = parts.groupBy("pos").agg(vector_sum("v")).toArrow()
    return dict(zip(found.column("pos").to_pylist(), found.column("v").combine_chunks().flatten().to_numpy().reshape(-1, width)))


def _spread(found: dict[int, np.ndarray], v: int, width: int) -> np.ndarray:
    out = np.zeros((v, width))
    for at, row in found.items():
        if at >= 0:
            out[at] = row
    return out


def truncated_svd(rows: DataFrame, v: int, k: int, extra: int = 10, rounds: int = 4, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The k largest singular values and right vectors (v x k) of (idx, val) rows, by a randomised range
    finder: each round multiplies a v x (k + extra) basis by X'X in one pass; rows stay where they are."""
    width = min(k + extra, v)

    def times(basis: np.ndarray) -> np.ndarray:
        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((v, width))
            for b in batches:
                held = _Batch(b["idx"], b["val"])
                left = _added(held.row, basis[held.idx] * held.val[:, None], held.n)
                total += _added(held.idx, left[held.row] * held.val[:, None], v)
            used = np.flatnonzero(total.any(axis=1))
            yield pd.DataFrame({"pos": used.astype(np.int32), "v": list(total[used])})

        return _spread(_summed(rows, partial, width), v, width)

    basis = np.linalg.qr(np.random.default_rng(seed).normal(size=(v, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(times(basis))[0]
    image = times(basis)
    values, turn = np.linalg.eigh(basis.T @ image)
    order = np.argsort(-values)[:k]
    return np.sqrt(np.maximum(values[order], 0)), basis @ turn[:, order]


def svd_start(rows: DataFrame, v: int, k: int, seed: int = 42) -> np.ndarray:
    """Topics x terms to begin with: of each singular pair the sign whose halves weigh more, zeros filled
    with the mean of all cells. The left vectors are never made: a pass adds up the squares of their
    positive and negative parts."""
    k_ = min(k, v)
    s, right = truncated_svd(rows, v, k_, seed=seed)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up, down, total, n = np.zeros(k_), np.zeros(k_), 0.0, 0
        for b in batches:
            held = _Batch(b["idx"], b["val"])
            left = _added(held.row, right[held.idx] * held.val[:, None], held.n)
            up += (np.maximum(left, 0) ** 2).sum(axis=0)
            down += (np.minimum(left, 0) ** 2).sum(axis=0)
            total, n = total + held.val.sum(), n + held.n
        yield pd.DataFrame({"pos": np.zeros(1, np.int32), "v": [np.concatenate([up, down, [total, n]])]})

    sums = _summed(rows, partial, 2 * k_ + 2).get(0, np.zeros(2 * k_ + 2))
    mean = sums[-2] / max(1.0, sums[-1] * v)
    h = np.full((k, v), mean)
    for j in range(k_):
        if s[j] <= 0:
            continue
        if j == 0:
            row = np.sqrt(s[0]) * np.abs(right[:, 0])
        else:
            halves = []
            for sign, square in ((1, sums[j]), (-1, sums[k_ + j])):
                part = np.maximum(sign * right[:, j], 0)
                length = np.sqrt(part @ part)
                halves.append((np.sqrt(square) / s[j] * length, part / length if length else part))
            weight, part = max(halves, key=lambda x: x[0])
            row = np.sqrt(s[j] * weight) * part
        h[j] = np.where(row > 0, row, mean)
    return h


def fit_nmf(rows: DataFrame, terms: list[str], k: int = 10, iterations: int = 200, seed: int = 42, tolerance: float = 1e-4,
            start: np.ndarray | None = None) -> NmfModel:
    """Alternate exact row loads with multiplicative topic updates, until a pass lowers the loss by less
    than ``tolerance`` of the first loss or ``iterations`` passes are done; ``losses`` has them all.

    ``start`` (topics x terms) defaults to ``svd_start``, so the outcome hangs on no random draw but that
    of the range finder. A pass is one job that sends each task the topics and gets back k numbers per
    term, so nothing grows with the rows and no state is kept between passes: a lost task is simply run
    again.
    """
    rows = rows.persist()
    try:
        v = len(terms)
        if not v:
            return NmfModel(terms, np.zeros((k, 0)), [])
        h = svd_start(rows, v, k, seed) if start is None else start
        losses: list[float] = []
        for _ in range(iterations):
            def partial(batches: Iterator[pd.DataFrame], h=h) -> Iterator[pd.DataFrame]:
                gram = h @ h.T
                wx, ww, loss = np.zeros((v, k)), np.zeros((k, k)), 0.0
                for b in batches:
                    held = _Batch(b["idx"], b["val"])
                    w, target = held.loads(h, gram)
                    wx += _added(held.idx, w[held.row] * held.val[:, None], v)
                    ww += w.T @ w
                    loss += held.val @ held.val - 2 * (w * target).sum() + ((w @ gram) * w).sum()
                used = np.flatnonzero(wx.any(axis=1))
                # below the terms: the k rows of the loads' products, and the loss
                yield pd.DataFrame({"pos": np.concatenate([used, -1 - np.arange(k + 1)]).astype(np.int32),
                                    "v": [*wx[used], *ww, np.full(k, loss / k)]})

            found = _summed(rows, partial, k)
            wx, ww = _spread(found, v, k).T, np.stack([found[-1 - j] for j in range(k)])
            losses.append(float(found[-1 - k].sum()))
            if len(losses) > 1 and losses[-2] - losses[-1] < tolerance * losses[0]:
                break
            for _ in range(10):
                h = h * wx / np.maximum(ww @ h, 1e-12)
        return NmfModel(terms, h, losses)
    finally:
        rows.unpersist()


def pca_reduce(df: DataFrame, key: str, vector: str, k: int = 50, keep: int = 10) -> tuple[DataFrame, DataFrame]:
    """Component scores (first ``keep`` as emb_i, null beyond the last) and (component, variance, cumulative).
    A vector of fewer than ``k`` numbers has as many components as numbers."""
    x = df.select(key, array_to_vector(F.transform(F.col(vector), lambda e: e.cast("double"))).alias("_x"))
    width = len(df.select(vector).first()[0])
    model = PCA(k=min(k, width), inputCol="_x", outputCol="_p").fit(x)
    reduced = model.transform(x).select(key, vector_to_array("_p").alias("components"))
    wide = reduced.select(key, "components", *[F.get("components", F.lit(i)).alias(f"emb_{i}") for i in range(keep)])
    share = df.sparkSession.createDataFrame(
        [(i, float(s)) for i, s in enumerate(model.explainedVariance)], "component int, variance double")
    run = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, 0)
    return wide, share.withColumn("cumulative", F.sum("variance").over(run))

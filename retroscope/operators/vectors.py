"""Sentence vectors: batch inference with any encoder, and an encoder fitted in Spark.

The encoder is signed feature hashing: a word's MD5 gives its place and its sign, words weigh by how few rows
hold them, a row's vector is the unit vector of the sum. Nothing but row counts per hash is learned, so the model
has a fixed size whatever the vocabulary.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 4  # of the hash: words are counted in 16 ** DIGITS classes
KNOWN = 200_000  # words a task remembers


def encode(df: DataFrame, text: str | Column, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 128,
           out: str = "embedding", element: T.DataType = T.FloatType()) -> DataFrame:
    """Adds vectors of a text. ``load`` is called once per worker and gives a function from an array of
    texts to a matrix; it is asked for ``batch_size`` rows at a time. A null text counts as empty."""
    run = predict_batch_udf(load, return_type=T.ArrayType(element), batch_size=batch_size)
    return df.withColumn(out, run(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


class HashingEncoder:
    """Words parted by blanks to a unit vector of ``dim`` numbers; zero where there is no word."""

    def __init__(self, idf: np.ndarray, dim: int):
        self.idf, self.dim = idf, dim

    def load(self) -> Callable[[np.ndarray], np.ndarray]:
        idf, dim = self.idf, self.dim
        known: dict[str, tuple[int, float]] = {}

        def slot(word: str) -> tuple[int, float]:
            if word not in known:
                if len(known) >= KNOWN:
                    known.pop(next(iter(known)))
                digits = hashlib.md5(word.encode()).hexdigest()
                weight = float(idf[int(digits[:DIGITS], 16)])
                known[word] = (int(digits[DIGITS:DIGITS + 4], 16) % dim, weight if digits[DIGITS + 4] < "8" else -weight)
            return known[word]

        def vectors(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, text in enumerate(texts):
                slots = [slot(w) for w in text.split(" ") if w]
                if slots:
                    at, weight = zip(*slots)
                    np.add.at(out[i], list(at), weight)
            length = np.sqrt((out ** 2).sum(axis=1, keepdims=True))
            return out / np.where(length > 0, length, 1)

        return vectors


def fit_hashing(df: DataFrame, words: Column, dim: int = 384) -> HashingEncoder:
    """Counts the rows that hold a word of each hash class; at most 16 ** DIGITS counts come back."""
    n = df.count()
    kinds = F.array_distinct(F.transform(words, lambda w: F.substring(F.md5(w), 1, DIGITS)))
    counts = df.select(F.explode_outer(kinds).alias("_kind")).groupBy("_kind").agg(F.count(F.lit(1)).alias("df")).where("_kind IS NOT NULL")
    idf = np.full(16 ** DIGITS, math.log(n + 1) + 1)
    for kind, held in counts.collect():
        idf[int(kind, 16)] = math.log((n + 1) / (held + 1)) + 1
    return HashingEncoder(idf, dim)


def joined(words: Column) -> Column:
    """Words as the encoder reads them."""
    return F.array_join(words, " ")

"""Term weights, topics and sentence vectors against plain numpy."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retroscope.operators import sentiment, terms, topics, vectors


def words_table(spark, rows):
    return spark.createDataFrame(rows, "id int, w array<string>").repartition(3)


def corpus(seed, n, kinds):
    rnd = random.Random(seed)
    return [(i, [f"{'abcd'[i % 4]}{min(int(rnd.expovariate(0.3)), kinds)}" if rnd.random() < 0.8 else "all" for _ in range(rnd.randint(0, 30))]) for i in range(n)]


def plain_tfidf(rows, min_df, most):
    df, tf = Counter(), Counter()
    for _, ws in rows:
        df.update(set(ws or ()))
        tf.update(ws or ())
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-tf[t], t))[:most]
    names = sorted(kept)
    x = np.zeros((len(rows), len(names)))
    for i, (_, ws) in enumerate(rows):
        for w in ws or ():
            if w in names:
                x[i, names.index(w)] += 1
    x *= [math.log((1 + len(rows)) / (1 + df[t])) + 1 for t in names]
    length = np.sqrt((x ** 2).sum(axis=1, keepdims=True))
    return names, x / np.where(length > 0, length, 1)


@pytest.mark.parametrize("rows", [[*corpus(1, 80, 9), (80, None), (81, [])], corpus(2, 30, 3)])
def test_weights_and_vocabulary(spark, rows):
    df = words_table(spark, rows)
    names, x = plain_tfidf(rows, 3, 12)
    found, vocabulary = terms.tfidf_vectors(df, "id", F.col("w"), 3, 12)
    assert vocabulary == names and "Python" not in found._jdf.queryExecution().toString()
    got = np.zeros_like(x)
    for r in found.collect():
        got[r["id"], r["idx"]] = r["val"]
    assert got == pytest.approx(x)
    long = {(r["id"], r["term"]): r["weight"] for r in terms.tfidf(df, "id", F.col("w"), 3, 12).collect()}
    assert len(long) == (x > 0).sum() and all(v == pytest.approx(x[i, names.index(t)]) for (i, t), v in long.items())


def test_weights_without_a_vocabulary(spark):
    df = words_table(spark, [(1, ["a"]), (2, None)])
    assert terms.tfidf(df, "id", F.col("w"), 5).count() == 0
    packed, names = terms.tfidf_vectors(df, "id", F.col("w"), 5)
    assert names == [] and packed.count() == 2
    model = topics.fit_nmf(packed, names, 3)
    assert {r["topic"] for r in model.transform(packed, "id").collect()} == {0}


def test_singular_values_and_start(spark):
    rows = corpus(3, 200, 20)
    packed, names = terms.tfidf_vectors(words_table(spark, rows), "id", F.col("w"), 2, 100)
    packed = packed.persist()
    _, x = plain_tfidf(rows, 2, 100)
    s, right = topics.truncated_svd(packed, len(names), 4)
    u, exact, vt = np.linalg.svd(x, full_matrices=False)
    assert s == pytest.approx(exact[:4], rel=1e-3)
    assert np.abs((right * vt[:4].T).sum(axis=0)) == pytest.approx(np.ones(4), abs=1e-2)
    h = topics.svd_start(packed, len(names), 4)
    assert h.shape == (4, len(names)) and (h > 0).all()
    assert h[0] == pytest.approx(np.maximum(np.sqrt(s[0]) * np.abs(vt[0]), 0), abs=2e-2)
    # a start from the singular pairs is nearer to the end than a random one
    good = topics.fit_nmf(packed, names, 4, iterations=60)
    poor = topics.fit_nmf(packed, names, 4, iterations=2, start=np.random.default_rng(1).uniform(0.1, 1, h.shape))
    assert good.losses[0] < poor.losses[0] and all(b <= a + 1e-9 for a, b in zip(good.losses, good.losses[1:]))
    again = topics.fit_nmf(packed.repartition(7), names, 4, iterations=60)
    assert again.losses[-1] == pytest.approx(good.losses[-1], rel=1e-6)
    # the residuals of the rows are the loss of the pass that would come next
    left = good.transform(packed, "id").agg(F.sum("residual")).first()[0]
    assert left == pytest.approx(good.losses[-1], rel=1e-3)
    packed.unpersist()


def test_hashed_vectors(spark):
    rows = [*corpus(5, 60, 8), (60, None), (61, []), (62, ["é", "é", "x"])]
    df = words_table(spark, rows)
    encoder = vectors.fit_hashing(df, F.col("w"), 32)
    held = Counter(k for _, ws in rows for k in {hashlib.md5(w.encode()).hexdigest()[:4] for w in ws or ()})
    got = vectors.encode(df, vectors.joined(F.col("w")), encoder.load, batch_size=7, element=T.DoubleType()).collect()
    for r in got:
        want = np.zeros(32)
        for w in r["w"] or ():
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[4:8], 16) % 32] += (1 if h[8] < "8" else -1) * (math.log((len(rows) + 1) / (held[h[:4]] + 1)) + 1)
        length = math.sqrt((want ** 2).sum())
        assert r["embedding"] == pytest.approx(want / length if length > 0 else want)


def test_any_model_labels_in_batches(spark):
    df = spark.createDataFrame([(1, "so happy and glad, but afraid"), (2, None), (3, "nothing here")], "id int, t string")
    one = {r["id"]: (r["emotion"], r["emotion_score"]) for r in sentiment.model_labels(df, "t", sentiment.lexicon_predictor()).collect()}
    two = {r["id"]: (r["emotion"], r["emotion_score"]) for r in sentiment.lexicon_emotion(df, "t").collect()}
    assert one == two

"""Prefix trie, fill-in-middle and rotated codes against brute force, on odd rows and on empty tables."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.llm import fill_middle, prefix_trie, queries, rotated_codes

SMALL = os.environ.get("RETROSCOPE_DATA", "/root/testdata/sf0.001")
HEX = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- prefix trie --------------------------------------------------------------------
def brute_trie(rows):
    """Rows (conv, turn, role, text) without ties of turn inside a conversation."""
    own = defaultdict(list)
    for c, *t in rows:
        if c is not None:
            own[c].append(t)
    own = {c: [(r or "", x or "") for _, r, x in sorted(ts, key=lambda t: (t[0] is not None, t[0]))] for c, ts in own.items()}
    nodes = defaultdict(lambda: [set(), []])
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:]
        for d in range(len(whole) + 1):
            nodes[tuple(whole[:d])][0].add(c)
        nodes[tuple(whole)][1].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in nodes:
        if key:
            children[key[:-1]] += 1
    for key, (members, _) in nodes.items():
        gain = (len(members) - 1) * len(key[-1][1]) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += key not in children
            saved[key[:d]] += gain
    return sorted(((min(m), len(k), min(nodes[k[:-1]][0]) if k else None, len(m), children[k], leaves[k], saved[k],
                    HEX(",".join(map(str, sorted(e))))) for k, (m, e) in nodes.items()), key=str)


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "own", 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, n1 string, depth int")
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(df.repartition(3), **kw).collect()), key=str)


def conversations(seed, n, longest=9):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(-250, 700), n):
        turns = rnd.sample(range(0, 2000), rnd.randint(1, longest))
        rows += [(c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["a", "bb", "", None, "é"])) for t in turns]
    return rows


ODD_TURNS = [(0, None, "user", "first"), (0, 0, "user", "first"), (0, 5, None, None), (0, 6, "", ""), (1, 3, "user", "x"), (2, 1, "user", "x"),
             (3, 1, "user", "x"), (3, 2, "assistant", "word " * 9000), (4, 2, "assistant", "word " * 9000), (None, 0, "user", "lost"),
             (300, 0, "user", "alone"), (301, 0, "user", "no more"), (777, 0, "user", "no base"), (-5, 0, "user", "below"), (100, 0, "user", "first"), (200, 0, "user", "first")]


@pytest.mark.parametrize("rows", [ODD_TURNS, conversations(1, 60), conversations(2, 200, 4)], ids=["odd", "some", "many"])
def test_trie_equals_brute_force(spark, rows):
    assert trie(spark, rows) == brute_trie(rows)
    assert trie(spark, rows, queue=3, shards=7) == brute_trie(rows)


def test_trie_of_long_conversations_in_bands(spark):
    rnd = random.Random(5)
    turns = [("user" if i % 2 else "assistant", rnd.choice("ab")) for i in range(700)]
    rows = [(c, i * 3, *t) for c, cut in ((100, 700), (101, 700), (102, 513), (103, 256), (104, 257)) for i, t in enumerate(turns[:cut])]
    rows += [(105, i, *t) for i, t in enumerate([*turns[:300], ("user", "else"), *turns[301:600]])]
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_with_one_first_turn_and_copies(spark):
    rows = [(c, t, "user", "same" if t == 0 else f"{c if c % 3 else 0} {t}") for c in range(600) for t in range(4)]
    assert trie(spark, rows, shards=5) == brute_trie(rows)


def test_trie_counts_repeated_rows_and_takes_no_rows(spark):
    got = trie(spark, [(7, 0, "user", "q"), (7, 0, "user", "q")] * 4)
    h = zlib.crc32(b"7") % 6
    assert [r[1] for r in got] == list(range(8 - h + 1)) and {r[3] for r in got} == {1}
    assert trie(spark, []) == []


def test_queue_spills_and_keeps_order():
    rnd = random.Random(3)
    queue, sent = prefix_trie.SpillingQueue(10), []
    for _ in range(500):
        item = ((rnd.randint(-5, 5), rnd.randint(0, 9)), (rnd.randint(0, 3), 1))
        sent.append(item)
        queue.push(*item)
    got = []
    while (key := queue.least()) is not None:
        got += [(key, v) for v in queue.take(key)]
    assert queue.spilled >= 480 and sorted(got) == sorted(sent)
    assert [k for k, _ in got] == sorted(k for k, _ in sent)


# --- fill in middle -----------------------------------------------------------------
def brute_middle(doc, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(HEX(f"1:{'' if doc is None else doc}")[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return (doc, n, "plain", None, None, text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < 20 else "psm"
    return (doc, n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def middle_rows():
    rnd = random.Random(8)
    texts = [None, "", "a", " ", "\n", "<P>", "x<S>y", "<<M>", "word thing " * 9000, "é" * 70_000, "🙂a🙂", "@[`{AZaz\x00", "KKſ", "<S", "S>", "<P", ">" * 50]
    texts += ["".join(rnd.choice("ab <SPM>é🙂\n") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    return [(i, t) for i, t in enumerate(texts)] + [(5, "again"), (5, "again"), (None, "none at all")]


def test_fill_in_middle_equals_brute_force_and_comes_back(spark):
    rows = middle_rows()
    df = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id bigint, text string, output string, digest string").repartition(3)
    got = fill_middle.fill_in_middle(df).withColumn("back", fill_middle.restored())
    found = [tuple(r) for r in got.collect()]
    assert sorted((r[:6] for r in found), key=str) == sorted((brute_middle(*r) for r in rows), key=str)
    assert sorted((r[0], r[6]) for r in found if r[0] is not None) == sorted((d, t or "") for d, t in rows if d is not None)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(df.where("false")).count() == 0


def test_skip_list_reaches_every_rank_in_few_steps(monkeypatch):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["ab", "c", " ", "é", "\n"]) for _ in range(3000))
    monkeypatch.setattr(fill_middle, "PART", 97)
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    widths = fill_middle.unit_widths(text)
    assert [len(u) for u in units] == widths.tolist()
    skip = fill_middle.SkipList(widths)
    assert len(skip.lanes) == 1 + math.ceil(math.log(len(units) / fill_middle.FAN, fill_middle.FAN))
    ends = np.concatenate([[0], widths.cumsum()])
    assert [skip.place(i) for i in range(len(units) + 1)] == ends.tolist()


# --- nearest neighbours -------------------------------------------------------------
def brute_nearest(rows, k=10):
    width = max((len(v) for _, v in rows if v), default=0)
    fit = [(i, np.array([*v, *[0.0] * (width - len(v))], float)) for i, v in rows
           if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in {(i, tuple(q)): (i, q) for i, q in fit}.values():  # a repeated query is asked once
        if i % 100 == 0:
            away = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in fit if j != i)
            out.setdefault(i, []).extend(away)
    return {i: sorted(a)[:k] for i, a in out.items()}


def near(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "own", 3) for r in rows], "vec_id bigint, embedding array<float>, code string, score int").repartition(3)
    got = defaultdict(list)
    for r in rotated_codes.nearest(df, F.col("vec_id") % 100 == 0, **kw).orderBy("query_id", "rank").collect():
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    return got


def vectors(seed, n, width, spread=1.0):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(5, width)) * 2
    return [(i, [float(np.float32(x)) for x in middles[i % 5] + spread * rng.normal(size=width)]) for i in range(n)]


@pytest.mark.parametrize("n, width, kw", [(700, 16, {}), (500, 64, {"shard_values": 64 * 100, "block_rows": 2}), (300, 100, {"sample_rows": 20, "centres": 3}), (8, 5, {}), (250, 1, {})])
def test_nearest_finds_at_least_nine_of_ten(spark, n, width, kw):
    rows = vectors(n, n, width)
    want, got = brute_nearest(rows), near(spark, rows, **kw)
    assert set(want) == set(got) and all(len(got[q]) == len(want[q]) for q in want)
    hit = sum(len({v for _, v in want[q]} & {v for _, v in got[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    exact = {(q, v): s for q in want for s, v in brute_nearest(rows, n)[q]}
    assert all(abs(s - exact[q, v]) < 1e-9 for q in got for s, v in got[q])


def test_nearest_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]),
            (8, []), (9, [0.5]), (None, [1.0, 0.0]), (100, [3.0, 4.0]), (200, [1.0, 0.0]), (200, [1.0, 0.0]), (300, [0.0]), (400, None), (10, [3.0, 4.0, 12.0])]
    want, got = brute_nearest(rows), near(spark, rows)
    assert dict(got) == want and set(want) == {0, 100, 200}
    assert near(spark, [r for r in rows if r[0] not in (0, 100, 200)]) == {}
    assert near(spark, []) == {}


def test_nearest_with_a_third_of_all_vectors_equal(spark):
    rows = [(i, [1.0] * 8) if i % 3 == 0 else v for i, v in enumerate(vectors(1, 900, 8))]
    rows = [(r[0], r[1]) for r in rows]
    want, got = brute_nearest(rows), near(spark, rows, shard_values=8 * 200)
    assert all([v for _, v in got[q]] == [v for _, v in want[q]] for q in want if q % 3 == 0)


def test_recall_and_share_looked_at_on_the_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = queries.QUERIES["op13_nearest_vectors"](spark, SMALL).collect()
    want = brute_nearest(rows)
    hit = sum(r.vec_id in {v for _, v in want[r.query_id]} for r in got)
    assert hit >= 0.99 * sum(map(len, want.values()))


def test_estimates_stay_within_their_bound():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(20, 64))
    centres = rotated_codes.fit_centres(x, 4)
    near_, bits, length, scalar = rotated_codes.encode(x, centres)
    shard = rotated_codes.Codes(np.arange(2000), x, near_, bits, length, scalar, rotated_codes.rotated(centres), 3.5)
    tight = rotated_codes.Codes(np.arange(2000), x, near_, bits, length, scalar, rotated_codes.rotated(centres), 0.0)
    held = []
    for one, turned in zip(q, rotated_codes.rotated(q)):
        away = ((shard.vectors - one) ** 2).sum(axis=1)
        held.append((shard.least(turned) <= away + 1e-9).mean())
        assert abs(np.mean(tight.least(turned) - away)) < 0.05 * away.mean()
    assert np.mean(held) > 0.999

"""Repeated passages: every byte that a repeated string of ``length`` bytes covers is removed.

A full merge of shard transforms refines the interleave of all suffixes once per byte of common
prefix: 400 passes over the corpus. Here the same refinement runs where it can matter.

1. Each start of a length-byte string has an anchor, the leftmost smallest k-mer among its first
   WINDOW; equal strings have their anchors at equal places. Starts with one anchor form a run, about
   one in WINDOW / 2 bytes. A run carries a hash of its core, the bytes all of its strings share.
2. Runs whose core occurs once are done. Runs with equal core and equal surroundings repeat in full.
3. Where one core has several surroundings, their right and left contexts are interleaved: intervals
   of equal prefix are refined by one symbol of eight bytes at a time, singletons leave, and what
   remains are common prefixes. A string repeats if another run shares as much on both sides.
4. Repeated strings become spans of their texts, and the bytes they cover are cut out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.llm.bytehash import blocks, buffer_of, mix, running, stretch
from retroscope.session import cut_lineage, discard

LENGTH = 400
WINDOW = 128
KMER = 16
BLOCK = 1 << 20
ROWS = 20_000
_PLACE = 21  # bits for the place inside a block

_RUNS = "key bigint, ctx bigint, t1 bigint, t2 bigint, anchor bigint, far int, near int"


def _anchors(data: np.ndarray, kmer: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start the place of its anchor, and the running sums of the bytes."""
    sums = running(data)
    at = np.arange(len(data) - kmer + 1)
    mask = np.uint64((1 << _PLACE) - 1)
    order = (stretch(sums, at, at + kmer) & ~mask) | at.astype(np.uint64)
    rows = -(-len(order) // window)
    grid = np.full((rows + 1) * window, np.iinfo(np.uint64).max, np.uint64)
    grid[:len(order)] = order
    grid = grid.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = len(order) - window + 1
    return (np.minimum(behind[:starts], ahead[window - 1:window - 1 + starts]) & mask).astype(np.int64), sums


def _runs(data: np.ndarray, bounds: np.ndarray, length: int, window: int, kmer: int):
    """Per run of starts with one anchor: text, anchor, distance of the first and of the last start, hashes."""
    if len(data) < length:
        return None
    anchor, sums = _anchors(data, kmer, window)
    places = np.arange(len(data) - length + 1)
    text = np.searchsorted(bounds, places, "right") - 1
    inside = places + length <= bounds[text + 1]
    p, text = places[inside], text[inside]
    if not len(p):
        return None
    a = anchor[p]
    new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 1) | (np.diff(text) != 0)])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(p)]]) - 1
    a, lo, hi, text = a[first], p[first], p[last], text[first]
    core = length - window + 1
    key = stretch(sums, a, a + core)
    far, near = a - lo, a - hi
    ctx = mix(stretch(sums, lo, hi + length) + (far * 1024 + near).astype(np.uint64))
    return text, a, far, near, key.view(np.int64), ctx.view(np.int64)


def _scan_runs(docs: DataFrame, length: int, window: int, kmer: int) -> DataFrame:
    """All runs of rows (t1, t2, text)."""
    def scan(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            # of equal texts in a task one is read
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            fresh = [i for i, name in enumerate(names) if name not in seen and not seen.add(name)]
            batch = batch.take(pa.array(fresh, pa.int64()))
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            data, offsets = buffer_of(batch.column(2))
            for i, j in blocks(offsets, BLOCK):
                # a text longer than a block is read in stretches that overlap by a string
                base, end = int(offsets[i]), int(offsets[j])
                for lo in range(base, max(end, base + 1), BLOCK if j == i + 1 else max(end - base, 1)):
                    hi = min(end, lo + BLOCK + length - 1) if j == i + 1 else end
                    bounds = np.array([0, hi - lo]) if j == i + 1 else offsets[i:j + 1] - base
                    found = _runs(data[lo:hi], bounds, length, window, kmer)
                    if found is None:
                        continue
                    text, a, far, near, key, ctx = found
                    start = (np.full(len(text), base) if j == i + 1 else offsets[i + text]) - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key), pa.array(ctx), pa.array(t1[i + text]), pa.array(t2[i + text]), pa.array(a - start),
                         pa.array(far.astype(np.int32)), pa.array(near.astype(np.int32))],
                        ["key", "ctx", "t1", "t2", "anchor", "far", "near"])

    return docs.mapInArrow(scan, _RUNS)


def interleave(group: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by group and then by symbols, and how many bytes each shares with the row before
    it in that order (-1: another group). ``symbols`` are big-endian words of eight bytes.

    Rows start interleaved by group alone. Each round partitions the intervals of rows that agree so
    far by their next symbol; rows alone in their interval are not looked at again.
    """
    order = np.argsort(group, kind="stable")
    shared = np.full(len(order), symbols.shape[1] * 8, np.int64)
    head = np.concatenate([[True], group[order][1:] != group[order][:-1]]) if len(order) else np.empty(0, bool)
    shared[head] = -1
    for w in range(symbols.shape[1]):
        name = np.cumsum(head)
        alone = head & np.concatenate([head[1:], [True]])
        live = np.flatnonzero(~alone)
        if not len(live):
            break
        word = symbols[order[live], w]
        turn = np.lexsort((word, name[live]))
        order[live] = order[live][turn]
        word, same = word[turn], name[live][turn]
        split = np.flatnonzero((same[1:] == same[:-1]) & (word[1:] != word[:-1])) + 1
        apart = word[split] ^ word[split - 1]
        equal = np.zeros(len(split), np.int64)
        for byte in range(1, 8):
            equal += apart < (np.uint64(1) << np.uint64(64 - 8 * byte))
        shared[live[split]] = w * 8 + equal
        head[live[split]] = True
    return order, shared


def _symbols(contexts: list[bytes], width: int) -> np.ndarray:
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(c.ljust(width, b"\0") for c in contexts), ">u8").reshape(-1, width // 8).astype(np.uint64)


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """A number for each row, equal where rows of one group agree in ``depth`` bytes."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < depth)
    return out


def _resolve(length: int, window: int):
    def resolve(table: pa.Table) -> pa.Table:
        """Which strings of each run occur in another run with the same core."""
        key, ctx, far, near = (table.column(c).to_numpy() for c in ("key", "ctx", "far", "near"))
        left = interleave(key, _symbols(table.column("before").to_pylist(), window - 1))
        right = interleave(key, _symbols(table.column("after").to_pylist(), window - 1))
        hit = np.zeros((len(key), window + 1), bool)
        for back in range(window):
            here = np.flatnonzero((near <= back) & (far >= back))
            if len(here) < 2:
                continue
            both = _classes(*left, back)[here] * (len(key) + 1) + _classes(*right, window - 1 - back)[here]
            _, which, n = np.unique(both, return_inverse=True, return_counts=True)
            hit[here, back] = n[which] > 1
        step = np.diff(hit.astype(np.int8), axis=1, prepend=0)
        row, begin = np.nonzero(step == 1)
        end = np.nonzero(step == -1)[1] - 1
        return pa.table({"key": key[row], "ctx": ctx[row], "least": begin.astype(np.int32), "most": end.astype(np.int32)})

    return resolve


def _contexts(runs: DataFrame, texts: DataFrame, length: int, window: int) -> DataFrame:
    """key, ctx, far, near and the bytes before the anchor (backwards) and after the core."""
    core = length - window + 1

    def cut(batches):
        for batch in batches:
            out = []
            for text, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode()
                for r in rows:
                    a, far, near = r["anchor"], r["far"], r["near"]
                    out.append((r["key"], r["ctx"], far, near, raw[a - far:a][::-1], raw[a + core:a - near + length]))
            if out:
                cols = list(zip(*out))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["key", "ctx", "far", "near", "before", "after"])

    by_text = runs.groupBy("t1", "t2").agg(F.collect_list(F.struct("key", "ctx", "anchor", "far", "near")).alias("runs"))
    return texts.join(by_text.hint("merge"), ["t1", "t2"]).select("text", "runs").mapInArrow(
        cut, "key bigint, ctx bigint, far int, near int, before binary, after binary")


def _cut_out(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Per text: bytes removed, maximal removed stretches, digest of what stays."""
    def cut(batches):
        for batch in batches:
            removed, count, digest = [], [], []
            for text, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw, at, gone, n, kept = text.encode(), 0, 0, 0, hashlib.sha256()
                reach = -1
                for s in sorted((x["start"], x["end"]) for x in found):
                    if s[0] > reach:
                        kept.update(raw[at:s[0]])
                        n += 1
                        at = s[0]
                        reach = s[0]
                    if s[1] > reach:
                        gone += s[1] - reach
                        reach = at = s[1]
                kept.update(raw[at:])
                removed.append(gone)
                count.append(n)
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()),
                                              pa.array(count, pa.int64()), pa.array(digest, pa.string())],
                                             ["t1", "t2", "gone", "cuts", "rest"])

    by_text = spans.groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return texts.join(by_text.hint("merge"), ["t1", "t2"]).select("t1", "t2", "text", "spans").mapInArrow(
        cut, "t1 bigint, t2 bigint, gone bigint, cuts bigint, rest string")


def remove_repeats(docs: DataFrame, text: str = "text", id: str = "doc_id", length: int = LENGTH,
                   window: int = WINDOW, kmer: int = KMER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row.

    Texts are UTF-8 bytes, null counts as empty, no match crosses a text. A byte goes if a string of
    ``length`` bytes that covers it starts at any other place too; all strings are judged on the
    input. Equal texts are worked on once; a text of ``length`` bytes or more that occurs in several
    rows goes as a whole, so copies and repeated rows never meet in a group. An empty table gives no rows.
    Cores and surroundings are compared by 64-bit hashes each, contested surroundings byte by byte.
    """
    if not 0 < kmer < window <= length // 2:
        raise ValueError("the anchor window must fit into half a string")
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(F.col(id).alias("doc_id"), t.alias("text"), F.xxhash64(t).alias("t1"), F.xxhash64(t, F.lit(1)).alias("t2"))
    meta = cut_lineage(keyed.select("doc_id", "t1", "t2", F.octet_length("text").cast("bigint").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    rows = meta.where(F.col("n_bytes") >= length).groupBy("t1", "t2", "doc_id").agg(F.count("*").alias("rows"))
    heads = cut_lineage(rows.groupBy("t1", "t2").agg(F.min(F.struct("doc_id", "rows")).alias("head"), F.sum("rows").alias("copies"))
                        .select("t1", "t2", F.col("head.doc_id").alias("head"), F.col("head.rows").alias("head_rows"), "copies"))

    # all of this needs the runs of a core together: one exchange serves it
    core, around = Window.partitionBy("key"), Window.partitionBy("key", "ctx")
    runs = _scan_runs(keyed.where(F.octet_length("text") >= length).select("t1", "t2", "text"), length, window, kmer)
    runs = runs.withColumn("all", F.count("*").over(core)).where(F.col("all") > 1).dropDuplicates(["key", "ctx", "t1", "t2", "anchor"])
    runs = (runs.withColumn("n", F.count("*").over(around))
            .withColumn("turn", F.row_number().over(around.orderBy("t1", "t2", "anchor")))
            .withColumn("all", F.count("*").over(core)).withColumn("kinds", F.count_if(F.col("turn") == 1).over(core)))
    runs = cut_lineage(runs.where(F.col("all") > 1).drop("all"))
    shared = cut_lineage(runs.select("t1", "t2").distinct().join(heads, ["t1", "t2"]))

    want = shared.select(F.col("t1").alias("w1"), F.col("t2").alias("w2"), "head")
    texts = keyed.join(want.hint("merge"), F.col("doc_id").eqNullSafe(F.col("head")) & (F.col("t1") == F.col("w1")) & (F.col("t2") == F.col("w2"))).select("t1", "t2", "text")
    if not shared.where("head_rows > 1").isEmpty():
        texts = texts.dropDuplicates(["t1", "t2"])
    texts = cut_lineage(texts)

    one_each = runs.where("kinds > 1 AND turn = 1").select("key", "ctx", "t1", "t2", "anchor", "far", "near")
    contested = cut_lineage(_contexts(one_each, texts, length, window))
    buckets = max(1, contested.count() // ROWS + 1)
    marks = (contested.withColumn("bucket", F.pmod(F.hash("key"), F.lit(buckets))).groupBy("bucket")
             .applyInArrow(_resolve(length, window), "key bigint, ctx bigint, least int, most int"))
    # runs with equal surroundings repeat in full, others as far as their contexts say
    partial = runs.where("n = 1 AND kinds > 1").join(marks, ["key", "ctx"])
    full = runs.where("n > 1").withColumns({"least": F.lit(0), "most": F.lit(window - 1)})
    columns = ["t1", "t2", "anchor", "far", "near", "least", "most"]
    spans = partial.select(*columns).union(full.select(*columns)).select(
        "t1", "t2", (F.col("anchor") - F.least("most", "far")).alias("start"),
        (F.col("anchor") - F.greatest("least", "near") + length).alias("end"))
    cuts = cut_lineage(_cut_out(spans, texts))
    discard(runs, shared, texts, contested)

    gone = F.coalesce("copies", F.lit(1)) > 1
    joined = meta.join(cuts, ["t1", "t2"], "left").join(heads.select("t1", "t2", "copies"), ["t1", "t2"], "left")
    return joined.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("cuts", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(gone, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("rest", "whole")).alias("kept_sha256"))

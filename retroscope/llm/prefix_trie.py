"""Trie of conversation prefixes, its subtree totals by time-forward processing.

Conversations are rebuilt with the first turns of a base conversation, and every prefix gets a 128-bit
identity, so texts never move. A node belongs to its smallest member: the nodes of one member are a piece of
its path, from some depth down to its end, and above it come nodes of others. Shards are ranges of members.
A shard holds its members' nodes and the nodes above them, sorted by reverse level order (Spark's sort, which
spills), and goes through them once: each node takes what its children sent from a priority queue, and sends
its total to its parent, which comes later. The queue writes sorted runs to disk beyond a bounded size. What
the roots of the shards' pieces receive is then added up across shards, per node.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retroscope.session import cut_lineage

STRETCH = 256  # turns put together in one row
HUNDRED = 100  # conversations that share a base
HEADS = 6  # a rebuilt conversation begins with less than so many turns of its base
SHARD = 1 << 20  # rows a shard may have before more shards are made than the session asks for
SMALL = 4_096
QUEUE = 200_000  # messages a queue holds before it writes them down
CHUNK = 1 << 10  # conversation numbers joined to one string before the digest
ROOT = (0, 0)


class SpillingQueue:
    """Messages by ascending key. At most ``limit`` of them are in memory; more are written, sorted, to
    nameless files of this task, which are gone with it and which nobody else reads."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.held, self.runs, self.spilled = limit, [], [], 0
        self.heads: list = []

    def push(self, key: tuple, value: tuple) -> None:
        heapq.heappush(self.held, (key, value))
        if len(self.held) > self.limit:
            self._spill()

    def _spill(self) -> None:
        file = tempfile.TemporaryFile()
        write = pickle.Pickler(file)
        self.held.sort()
        for item in self.held:
            write.dump(item)
            write.clear_memo()
        file.seek(0)
        self.spilled += len(self.held)
        self.held = []
        self.runs.append((pickle.Unpickler(file), file))
        self._advance(len(self.runs) - 1)

    def _advance(self, run: int) -> None:
        read, file = self.runs[run]
        try:
            heapq.heappush(self.heads, (*read.load(), run))
        except EOFError:
            file.close()

    def least(self):
        """The smallest key, or None."""
        first = min((h[0][0] for h in (self.held, self.heads) if h), default=None)
        return first

    def take(self, key: tuple) -> Iterator[tuple]:
        """The values of all messages with this key, which must be the smallest."""
        while self.held and self.held[0][0] == key:
            yield heapq.heappop(self.held)[1]
        while self.heads and self.heads[0][0] == key:
            _, value, run = heapq.heappop(self.heads)
            self._advance(run)
            yield value


def _identity(*parts) -> list[Column]:
    """Two 64-bit hashes of different seeds."""
    return [F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)]


def _rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, length, turns (depth, d1, d2, chars) by part of a conversation, each with depth 0 in its first part."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    d1, d2 = _identity(role, text)
    rows = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.floor(F.col("turn") / STRETCH).alias("part"),
        F.struct("turn", d1.alias("d1"), d2.alias("d2"), F.length(text).cast("bigint").alias("chars")).alias("t"))
    whole = Window.partitionBy("conv_id")
    parts = (rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts")).withColumn("n", F.size("ts").cast("bigint"))
             .withColumn("before", F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
             .withColumn("total", F.sum("n").over(whole)).withColumn("base", F.col("conv_id") - F.col("conv_id") % HUNDRED)
             .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS))
    bases = (parts.where(f"conv_id % {HUNDRED} = 0 AND before < {HEADS}")
             .select(F.col("conv_id").alias("base"), F.struct("before", F.slice("ts", 1, HEADS).alias("ts")).alias("p"))
             .groupBy("base").agg(F.flatten(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["ts"])).alias("lead")))
    both = parts.join(bases, "base", "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast(bases.schema["lead"].dataType)), F.lit(1), F.col("h").cast("int")))
    k = F.size("lead").cast("bigint")
    at = lambda t, depth: F.struct(depth.alias("depth"), t["d1"].alias("d1"), t["d2"].alias("d2"), t["chars"].alias("chars"))
    top = F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("depth", "d1", "d2", "chars")]))
    lead = F.transform("lead", lambda t, i: at(t, i + F.lit(1).cast("bigint")))
    own = F.filter(F.transform("ts", lambda t, i: at(t, k + F.col("before") + i + 1 - F.col("h"))), lambda t: t["depth"] > k)
    return both.select("conv_id", (k + F.greatest(F.col("total") - F.col("h"), F.lit(0))).alias("length"),
                       F.when(F.col("before") == 0, F.concat(top, lead, own)).otherwise(own).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """conv_id, length, depth, n1, n2, p1, p2, chars, first: the node of every prefix of every rebuilt
    conversation, its parent, the code points of its last turn and a hash of the first turn.

    Prefixes are put together in bands of STRETCH depths: inside a band an identity follows from the one
    above it; each band starts from the identity the band before it ended with.
    """
    rows = _rebuilt(turns).select("conv_id", "length", F.explode("turns").alias("t"))
    band = F.when(F.col("t.depth") == 0, F.lit(0).cast("bigint")).otherwise(F.floor((F.col("t.depth") - 1) / STRETCH))
    banded = rows.withColumn("band", band).groupBy("conv_id", "length", "band").agg(F.array_sort(F.collect_list("t")).alias("ts"))

    def chained(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        l1, l2 = _identity(last["l1"], last["l2"], t["d1"], t["d2"])
        return F.concat(done, F.array(F.struct(l1.alias("l1"), l2.alias("l2"))))

    start = F.array(F.struct(F.lit(7).cast("bigint").alias("l1"), F.lit(11).cast("bigint").alias("l2")))
    real = F.filter("ts", lambda t: t["depth"] > 0)
    local = F.aggregate(real, start, chained)
    banded = banded.withColumn("local", F.slice(local, F.lit(2), F.size(local))).withColumn("last", F.floor((F.col("length") - 1) / STRETCH))
    # only conversations of several bands meet here, with one row per band
    first = F.get(F.col("bs")[0]["local"], F.lit(0))["l1"]

    def follow(done: Column, b: Column) -> Column:
        s, e = F.element_at(done, -1), F.element_at(b["local"], -1)
        s1, s2 = _identity(s["s1"], s["s2"], e["l1"], e["l2"])
        return F.concat(done, F.array(F.struct(s1.alias("s1"), s2.alias("s2"))))

    root = F.array(F.struct(F.lit(ROOT[0]).cast("bigint").alias("s1"), F.lit(ROOT[1]).cast("bigint").alias("s2")))
    ends = banded.where("last > 0").select("conv_id", F.struct("band", F.when(F.col("band") == 0, F.concat(F.slice("local", 1, 1), F.slice("local", -1, 1))).otherwise(
        F.slice("local", -1, 1)).alias("local")).alias("b"))
    starts = (ends.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("bs")).withColumn("f", first)
              .select("conv_id", "f", F.posexplode(F.aggregate(F.slice("bs", F.lit(1), F.size("bs") - 1), root, follow)).alias("band", "s"))
              .select("conv_id", F.col("band").cast("bigint").alias("band"), "f", "s.*"))
    from_ = banded.join(starts, ["conv_id", "band"], "left").select(
        "conv_id", "length", "ts", "local", F.coalesce("s1", F.lit(ROOT[0])).alias("s1"), F.coalesce("s2", F.lit(ROOT[1])).alias("s2"),
        F.coalesce("f", F.get("local", F.lit(0))["l1"], F.lit(0)).alias("first"))

    def node(l: Column) -> Column:
        n1, n2 = _identity(F.col("s1"), F.col("s2"), l["l1"], l["l2"])
        return F.struct(n1.alias("n1"), n2.alias("n2"))

    nodes = F.transform("local", node)
    above = F.concat(F.array(F.struct(F.col("s1").alias("n1"), F.col("s2").alias("n2"))), nodes)
    rows = F.zip_with(F.zip_with(real, nodes, lambda t, n: F.struct(t["depth"].alias("depth"), t["chars"].alias("chars"), n["n1"].alias("n1"), n["n2"].alias("n2"))),
                      F.slice(above, F.lit(1), F.size(nodes)),
                      lambda t, p: F.struct(t["depth"].alias("depth"), t["chars"].alias("chars"), t["n1"].alias("n1"), t["n2"].alias("n2"), p["n1"].alias("p1"), p["n2"].alias("p2")))
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    top = F.array(F.struct(zero.alias("depth"), zero.alias("chars"), F.lit(ROOT[0]).cast("bigint").alias("n1"), F.lit(ROOT[1]).cast("bigint").alias("n2"),
                           none.alias("p1"), none.alias("p2")))
    rows = F.when(F.col("ts")[0]["depth"] == 0, F.concat(top, rows)).otherwise(rows)
    return from_.select("conv_id", "length", "first", F.inline(rows))


def _totals(limit: int):
    """One pass over a shard's rows in reverse level order: what each node holds of the shard."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue, out = SpillingQueue(limit), []
        key = parent = None
        sums = [0, 0, 0]  # leaves, saved tokens, children
        own = 0

        def close():
            if key is None:
                return
            out.append((key[1], key[2], *sums))
            if parent[0] is not None:
                queue.push((key[0] + 1, *parent), (sums[0], sums[1], own))

        def batch():
            cols = list(zip(*out)) or [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n1", "n2", "leaves", "saved", "children"])

        for b in batches:
            for depth, n1, n2, p1, p2, mine, leaf, saved in zip(*(c.to_pylist() for c in b.columns)):
                at = (-depth, n1, n2)
                if at != key:
                    close()
                    key, parent, sums, own = at, (p1, p2), [0, 0, 0], 0
                    if queue.least() == key:
                        for leaves, more, child in queue.take(key):
                            sums = [sums[0] + leaves, sums[1] + more, sums[2] + child]
                sums[0], sums[1], own = sums[0] + leaf, sums[1] + saved, own + mine
            yield batch()
        close()
        if queue.least() is not None:
            raise AssertionError("a parent is missing in the shard")
        yield batch()

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the strings of each node, comma-joined, fed one after the other."""
    key = digest = None
    for b in batches:
        done = []
        for n1, n2, ids in zip(*(c.to_pylist() for c in b.columns)):
            if (n1, n2) != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = (n1, n2), hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield _digest_rows(done)
    if key is not None:
        yield _digest_rows([(*key, digest.hexdigest())])


def _digest_rows(done):
    cols = list(zip(*done)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())],
                                      ["n1", "n2", "ends_sha256"])


def prefix_trie(turns: DataFrame, queue: int = QUEUE, shards: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 per node.

    A conversation's turns go by number, a null number first, ties by a hash of role and text; a repeated
    row is a turn of its own; null role and null text count as empty. Rows without a conv_id take no part.
    An empty table gives no rows; other columns are ignored. Turns are counted per stretch of 256 numbers,
    so a very long conversation meets as one row per stretch; its nodes, a chain, pass through one shard,
    row by row. Turns of one number (or none) in one conversation are sorted in one row. Equal
    conversations are counted where they are read; only the smallest of them goes to a shard.
    """
    spark = turns.sparkSession
    steps = cut_lineage(paths(turns))
    node = ["n1", "n2"]
    nodes = cut_lineage(steps.groupBy(*node).agg(
        F.min("conv_id").alias("conv_id"), F.min_by("first", "conv_id").alias("first"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"),
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("chars").alias("chars"), (F.max("length") == F.max("depth")).cast("int").alias("leaf")))
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("top"))
    above = steps.join(tops, "conv_id").where("depth < top").select(
        "first", "conv_id", "depth", *node, "p1", "p2", F.lit(0).alias("mine"), F.lit(0).alias("leaf"), F.lit(0).cast("bigint").alias("saved"))
    rows = nodes.select("first", "conv_id", "depth", *node, "p1", "p2", F.lit(1).alias("mine"), "leaf",
                        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")).unionByName(above)
    if shards is None:
        # a path holds at least one node, so there are never more rows than steps
        n, asked = steps.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
        shards = max(1, -(-n // SHARD), min(asked, -(-n // SMALL)))
    sorted_ = cut_lineage(rows).repartitionByRange(shards, "first", "conv_id").sortWithinPartitions(F.desc("depth"), *node)
    shared = sorted_.select("depth", *node, "p1", "p2", "mine", "leaf", "saved").mapInArrow(
        _totals(queue), "n1 bigint, n2 bigint, leaves bigint, saved bigint, children bigint")
    totals = shared.groupBy(*node).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"), F.sum("children").alias("n_children"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ends = (steps.where("depth = length").groupBy(*node, F.floor(F.col("conv_id") / CHUNK).alias("chunk")).agg(ids.alias("ids"))
            .repartition(*node).sortWithinPartitions(*node, "chunk").select(*node, "ids").mapInArrow(_digests, "n1 bigint, n2 bigint, ends_sha256 string"))
    parents = nodes.select(F.col("n1").alias("p1"), F.col("n2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(totals, node).join(ends, node, "left").join(parents, ["p1", "p2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


# the usual table-free CRC-32, one bit a step, over the decimal digits
_CRC = """xor(list_reduce(range(0, 8 * len(CAST({c} AS VARCHAR))), lambda a, i: CASE WHEN
  (xor(a, CASE WHEN i % 8 = 0 THEN ascii(CAST({c} AS VARCHAR)[i // 8 + 1]) ELSE 0 END) & 1) = 1
  THEN xor(xor(a, CASE WHEN i % 8 = 0 THEN ascii(CAST({c} AS VARCHAR)[i // 8 + 1]) ELSE 0 END) >> 1, 3988292384)
  ELSE xor(a, CASE WHEN i % 8 = 0 THEN ascii(CAST({c} AS VARCHAR)[i // 8 + 1]) ELSE 0 END) >> 1 END, 4294967295::BIGINT), 4294967295::BIGINT)"""
OP11_SQL = f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT *, {_CRC.format(c='conv_id')} % 6 AS h FROM own),
c AS (SELECT h.conv_id, list_concat(coalesce(b.ts, [])[:h.h], h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN own b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, len(ts) AS n, unnest(range(0, len(ts) + 1)) AS depth, ts FROM c),
k AS (SELECT conv_id, n, depth, ts[:depth] AS key, CASE WHEN depth > 0 THEN ts[:depth - 1] END AS up, CASE WHEN depth > 0 THEN length(ts[depth].t) ELSE 0 END AS chars FROM p),
n AS (
  SELECT key, any_value(up) AS up, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(chars) AS chars,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends FROM k GROUP BY key),
kids AS (SELECT up AS key, count(*) AS n_children FROM n WHERE up IS NOT NULL GROUP BY up),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (key)),
sub AS (SELECT key[:d] AS key, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * chars) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM m) GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN sub USING (key) LEFT JOIN n u ON u.key = m.up
"""

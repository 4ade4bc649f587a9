"""N-gram Jaccard join: count vectors bound the overlap of two sets, surviving pairs are verified.

1. One scan turns each text into its set of five-word shingles and keeps of it the size, a 128-bit
   key, the counts of its shingles by hash group, and for the whole corpus a sketch of how often
   shingles occur. Equal sets become one class.
2. A second scan sends the part of each set that any partner must touch: its n - ceil(3n/4) + 1 least
   frequent shingles. Classes that share one of these form a cell; all links lie inside cells, and cells
   of the same members are one.
3. Cells are searched by size and by count vectors. A cell of up to LEAF classes is one leaf of points.
   In a larger one, dealt over tasks, points are packed into leaves with bounding boxes and a few
   members per round ask which leaves and points can reach them, first the one that shares most with
   others. Members that links already join are not asked about each other, so a large group of near
   copies costs rows, not pairs.
4. A pair stays while the summed minima of its counts, and then bitmaps of its shingles, allow the overlap
   that it needs; those that stay are verified on their texts, first one per class and then what the
   links so far leave open. Texts and bitmaps are dealt by class once, and pairs go to them.
5. Links give components of classes; an id with several texts joins their classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.llm.batches import batches_of
from retroscope.llm.bytehash import blocks, buffer_of, mix, running, stretch
from retroscope.llm.components import components
from retroscope.operators.relational import vector_sum
from retroscope.session import cut_lineage, discard

WORDS = 5
GROUPS = 256
FULL = 255  # top of a count; a set that reaches it has all counts there and is never excluded
SKETCH = 1 << 18  # most slots of the sketch: 2 MB a task
SLOTS = 1 << 12  # slots of a block of it
BITS = 8  # of a bitmap per shingle, rounded up to a power of two
BROADCAST = 1_000_000  # narrow rows that are sent to all tasks
LEAF = 128
LEADERS = 4096  # most members of a cell that ask in one round
PART = 4096  # members of a large cell per task
BLOCK = 1 << 18
BATCH = 1000  # rows, with texts, counts or bitmaps, that a Python worker gets at once
ROWS = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TURNS = np.array([0x51ED270B7A3C5F19, 0x2545F4914F6CDD1D, 0x6C62272E07BB0143, 0x27D4EB2F165667C5, 0x1B873593CC9E2D51], np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text, as 64-bit hashes."""
    data, offsets = buffer_of(texts)
    for i, j in blocks(offsets, BLOCK):
        part, ends = data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]
        blank = _SPACE[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[ends] = True
        first = np.flatnonzero(~blank & (np.concatenate([[True], blank[:-1]])[:len(part)] | edge[:-1]))
        last = np.flatnonzero(~blank & (np.concatenate([blank[1:], [True]])[:len(part)] | edge[1:])) + 1
        words = stretch(running(_LOWER[part]), first, last)
        bounds = np.searchsorted(first, ends)
        if len(words) >= WORDS:
            sums = sum(words[k:len(words) - WORDS + 1 + k] * _TURNS[k] for k in range(WORDS))
            shingles = mix(sums)
        else:
            shingles = np.empty(0, np.uint64)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                yield np.unique(shingles[a:b - WORDS + 1])
            elif b > a:
                whole = (words[a:b] * _TURNS[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
                yield mix(np.array([whole], np.uint64))
            else:
                yield np.empty(0, np.uint64)


def _key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    k1 = mix(s).sum(dtype=np.uint64)
    k2 = mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(k1.view(np.int64)), int(k2.view(np.int64))


def _counts(s: np.ndarray) -> bytes:
    """Shingles per hash group."""
    n = np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=GROUPS)
    return (np.full(GROUPS, FULL) if n.max() >= FULL else n).astype(np.uint8).tobytes()


def _slots(docs: DataFrame) -> int:
    """Slots of the sketch: a power of two in proportion to the corpus, from a block up to SKETCH."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(SKETCH, max(SLOTS, 1 << (int(size) // 64).bit_length()))


def _profile(docs: DataFrame, slots: int) -> DataFrame:
    """Per row (doc_id, n, k1, k2, counts), and rows (block, seen) of the sketch, a block of slots each."""
    def scan(batches):
        sketch = np.zeros(slots, np.int64)
        for batch in batches:
            n, k1, k2, counts = [], [], [], []
            for s in shingle_sets(batch.column(1)):
                key = _key(s)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                counts.append(_counts(s))
                np.add.at(sketch, (s & np.uint64(slots - 1)).astype(np.int64), 1)
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()),
                 pa.array(counts, pa.binary()), none, pa.nulls(len(n), pa.list_(pa.float64()))], names)
        blocks_ = sketch.reshape(-1, SLOTS).astype(float)
        at = np.flatnonzero(blocks_.any(axis=1))
        none = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(at), pa.binary()), pa.array(at, pa.int64()),
                                          pa.array(list(blocks_[at]), pa.list_(pa.float64()))], names)

    names = ["doc_id", "n", "k1", "k2", "counts", "block", "seen"]
    return docs.mapInArrow(scan, "doc_id bigint, n bigint, k1 bigint, k2 bigint, counts binary, block bigint, seen array<double>")


def _prefixes(docs: DataFrame, sketch: np.ndarray) -> DataFrame:
    """token, rep: what a partner of the set must share with it."""
    slots = len(sketch)

    def scan(batches):
        done: set[tuple[int, int]] = set()
        for batch in batches:
            tokens, keys = [], []
            for s in shingle_sets(batch.column(1)):
                key = _key(s)
                if not len(s) or key in done:
                    continue
                done.add(key)
                rare = np.argsort(sketch[(s & np.uint64(slots - 1)).astype(np.int64)], kind="stable")
                part = s[rare[:len(s) - (3 * len(s) + 3) // 4 + 1]]
                tokens.append(part.view(np.int64))
                keys.append(np.full(len(part), key[0]))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(keys), pa.int64())], ["token", "rep"])

    return docs.mapInArrow(scan, "token bigint, rep bigint")


def _pairs_in_leaves(table: pa.Table) -> pa.Table:
    """Pairs (a, b) of fitting size inside each cell of the bucket."""
    token, rep, n = (table.column(c).to_numpy() for c in ("token", "rep", "n"))
    names, rep = np.unique(rep, return_inverse=True)
    order = np.lexsort((rep, token))
    token, rep, n = token[order], rep[order], n[order]
    # a pair is one number
    found = [np.empty(0, np.int64)]
    for d in range(1, LEAF):
        same = np.flatnonzero(token[d:] == token[:-d])
        if not len(same):
            break
        x, y = n[same], n[same + d]
        same = same[4 * np.minimum(x, y) >= 3 * np.maximum(x, y)]
        found.append(np.unique(rep[same] * len(names) + rep[same + d]))
    pairs = np.unique(np.concatenate(found))
    return pa.table({"a": names[pairs // max(1, len(names))], "b": names[pairs % max(1, len(names))]})


def _points(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _reach(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The most that sets of these counts can share."""
    most = np.minimum(x, y).sum(axis=-1, dtype=np.int64)
    return np.where((x[..., 0] == FULL) & (x == FULL).all(axis=-1) | (y[..., 0] == FULL) & (y == FULL).all(axis=-1), 1 << 60, most)


def _needed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The overlap that a link of two sizes needs: the least o with 100 o >= 75 (x + y - o)."""
    return -(-3 * (x + y) // 7)


def _search(asking: pa.Table, members: pa.Table) -> pa.Table:
    """Pairs of an asking member and a point that its bounds cannot exclude, through packed leaves."""
    if not asking.num_rows or not members.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    rep, n, label = (members.column(c).to_numpy() for c in ("rep", "n", "label"))
    points = _points(members.column("counts"))
    order = np.lexsort((points.argmax(axis=1), n))
    rep, n, label, points = rep[order], n[order], label[order], points[order]
    starts = np.arange(0, len(n), 64)
    top, low, high = np.maximum.reduceat(points, starts), np.minimum.reduceat(n, starts), np.maximum.reduceat(n, starts)
    asks = asking.column("rep").to_numpy()
    names = np.unique(np.concatenate([rep, asks]))
    place, turn = np.searchsorted(names, rep), np.searchsorted(names, asks)
    # a pair is one number
    out = [np.empty(0, np.int64)]
    for q, size, mine, at in zip(turn, asking.column("n").to_numpy(), asking.column("label").to_numpy(),
                                 _points(asking.column("counts"))):
        near = np.flatnonzero((_reach(top, at) >= _needed(size, low)) & (4 * high >= 3 * size) & (4 * size >= 3 * low))
        if not len(near):
            continue
        i = (starts[near][:, None] + np.arange(64)).ravel()
        i = i[i < len(n)]
        i = i[(label[i] != mine) & (4 * np.minimum(n[i], size) >= 3 * np.maximum(n[i], size))]
        i = i[_reach(points[i], at) >= _needed(size, n[i])]
        out.append(np.minimum(place[i], q) * len(names) + np.maximum(place[i], q))
    pairs = np.unique(np.concatenate(out))
    return pa.table({"a": names[pairs // len(names)], "b": names[pairs % len(names)]})


def _within_bounds(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """The pairs whose summed minima over all groups reach the overlap they need."""
    def bound(batches):
        for batch in batches:
            keep = _reach(_points(batch.column(2)), _points(batch.column(3))) >= _needed(batch.column(4).to_numpy(), batch.column(5).to_numpy())
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    side = lambda c: vectors.select(F.col("rep").alias(c), F.col("n").alias(f"n_{c}"), F.col("counts").alias(f"counts_{c}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "counts_a", "counts_b", "n_a", "n_b")
    return both.mapInArrow(bound, "a bigint, b bigint")


def _bitmap(s: np.ndarray) -> bytes:
    """One bit per shingle, at a place its hash gives."""
    width = max(64, 1 << (BITS * max(1, len(s)) - 1).bit_length())
    bits = np.zeros(width, bool)
    bits[((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _most_shared(x: bytes, n: int, y: bytes, m: int) -> int:
    """The most that sets of n and m shingles with these bitmaps can share: a bit that only one of them
    has stands for a shingle the other lacks. The longer bitmap is folded to the length of the shorter."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) > len(b):
        a = a[:len(a) // 2] | a[len(a) // 2:]
    while len(b) > len(a):
        b = b[:len(b) // 2] | b[len(b) // 2:]
    return min(n - int(np.bitwise_count(a & ~b).sum()), m - int(np.bitwise_count(b & ~a).sum()))


class Texts:
    """One text per class that may have a partner, dealt by class once and for all so that a join moves pairs
    to it, and its bitmap. Texts are read again from the table where an executor is lost."""

    def __init__(self, docs: DataFrame, wanted: DataFrame):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

        def scan(batches):
            for batch in batches:
                keys, bits, n = [], [], []
                for s in shingle_sets(batch.column(2)):
                    keys.append(_key(s)[0])
                    bits.append(_bitmap(s))
                    n.append(len(s))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary())],
                                                 ["doc_id", "mark", "rep", "n", "bits"])

        few = wanted.count() <= BROADCAST
        sized = lambda keys: F.broadcast(keys) if few else keys.hint("merge")
        marked = docs.withColumn("mark", F.xxhash64("text"))
        held = marked.join(sized(wanted.select(F.col("head").alias("doc_id")).distinct()), "doc_id", "left_semi")
        made = held.select("doc_id", "mark", "text").mapInArrow(scan, "doc_id bigint, mark bigint, rep bigint, n bigint, bits binary")
        # an id with several texts brings them all; those of other classes go again
        made = made.join(sized(wanted.select("rep", F.col("head").alias("doc_id"))), ["rep", "doc_id"], "left_semi")
        self.marks = cut_lineage(made.dropDuplicates(["rep"]))
        rows = marked.join(sized(self.marks.select("doc_id", "mark", "rep")), ["doc_id", "mark"]).select("rep", "text")
        self.rows = rows.repartition(parts, "rep").dropDuplicates(["rep"]).persist(StorageLevel.DISK_ONLY)

    def drop(self) -> None:
        self.rows.unpersist()
        discard(self.marks)

    def _beside(self, pairs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
        side = lambda c: rows.select(F.col("rep").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in columns]).hint("merge")
        return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{x}_{c}" for x in columns for c in "ab"])

    def possible(self, pairs: DataFrame) -> DataFrame:
        """The pairs that their bitmaps cannot exclude."""
        def judge(batches):
            for batch in batches:
                n, m, x, y = (c.to_pylist() for c in batch.columns[2:6])
                ok = [_most_shared(p, i, q, j) >= -(-3 * (i + j) // 7) for i, j, p, q in zip(n, m, x, y)]
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return self._beside(pairs, self.marks, "n", "bits").mapInArrow(judge, "a bigint, b bigint")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by the sets of their whole texts."""
        def verify(batches):
            for batch in batches:
                ok = []
                for x, y in zip(shingle_sets(batch.column(2)), shingle_sets(batch.column(3))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(100 * both >= 75 * (len(x) + len(y) - both) and both > 0)
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return self._beside(pairs, self.rows, "text").mapInArrow(verify, "a bigint, b bigint")


def _spanning_links(pairs: DataFrame, texts: Texts) -> DataFrame:
    """Links among ``pairs``, enough of them that their components are those of all links: first each
    class with its smallest partner, then the pairs whose ends are still apart. Where classes have hardly
    more than one partner, all pairs are verified at once."""
    first = cut_lineage(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    if pairs.count() <= 2 * first.count():
        found = cut_lineage(texts.verified(pairs))
        discard(first)
        return found
    roots = cut_lineage(components(texts.verified(first)))
    side = lambda c: roots.select(F.col("v").alias(c), F.col("root").alias(f"root_{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = cut_lineage(rest.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"))
    stars = roots.select(F.col("v").alias("a"), F.col("root").alias("b"))
    found = cut_lineage(stars.unionByName(texts.verified(rest)))
    discard(first, roots, rest)
    return found


def _large_cells(rows: DataFrame, vectors: DataFrame, texts: Texts, links: DataFrame) -> DataFrame:
    """Components of ``links`` and of the links inside cells of more than LEAF classes. ``rows``: a class
    with its cells (token, m) as an array; only cells that hold several components go on."""
    asked, most, last = None, 1, False
    while True:
        roots = cut_lineage(components(links)).select(F.col("v").alias("rep"), "root")
        if last:
            return roots
        labelled = rows.join(roots, "rep", "left").select("rep", F.coalesce("root", "rep").alias("label"), F.size("cells").alias("cells"), F.inline("cells"))
        groups = labelled.groupBy("token", "label").agg(F.count("*").alias("size"))
        largest = groups.groupBy("token").agg(F.max(F.struct("size", "label")).alias("top"), F.count("*").alias("labels"))
        open_cells = largest.where("labels > 1").select("token", F.col("top.label").alias("top"))
        left = cut_lineage(labelled.join(open_cells, "token"))
        free_ = left
        if asked is not None:
            free_ = left.where("label <> top").join(asked, ["token", "rep"], "left_anti")
        # one member of each component before the second of any, those in most cells first
        inside = F.row_number().over(Window.partitionBy("token", "label").orderBy(F.desc("cells"), "rep"))
        turn = F.row_number().over(Window.partitionBy("token").orderBy("inside", F.desc("cells"), "rep"))
        chosen = free_.withColumn("inside", inside).where(F.col("inside") <= most)
        leaders = cut_lineage(chosen.withColumn("turn", turn).where(F.col("turn") <= most)
                              .select("token", "rep", "label", "m"))
        asking = leaders.count()
        if not asking:
            return roots
        # when all that may still ask do so in this round, no other can find more
        last = asked is not None and asking == free_.count()
        parts = F.ceil(F.col("m") / PART).cast("int")
        # only here do rows carry their points
        spread = leaders.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m").join(vectors.toDF(*vectors.columns), "rep")
        dealt = left.select("token", F.pmod(F.hash("rep"), parts).alias("part"), "rep", "label").join(vectors, "rep")
        found = (spread.groupBy("token", "part").cogroup(dealt.groupBy("token", "part"))
                 .applyInArrow(_search, "a bigint, b bigint").distinct())
        stars = roots.select(F.col("rep").alias("a"), F.col("root").alias("b"))
        links = cut_lineage(stars.unionByName(texts.verified(found)))
        asked_now = leaders.select("token", "rep")
        asked = asked_now if asked is None else asked.unionByName(asked_now)
        if not last:
            rows = cut_lineage(left.groupBy("rep").agg(F.collect_list(F.struct("token", "m")).alias("cells")))
        discard(left)
        most = min(most * 64, LEADERS)


def jaccard_groups(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id that links lead to, itself included) per row.

    Two documents link when their sets of five-word shingles (A-Z folded, words between white space;
    fewer words: all of them as one shingle) have 100 * intersection >= 75 * union. A text without
    words, or null, has an empty set and links with nothing. Rows that repeat an id are one document
    that links where any of its texts does; a row without an id joins the documents of equal set, and
    has no component if there is none. An empty table gives no rows. Shingles are compared as 64-bit hashes.
    """
    docs = docs.select(F.col(id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    with batches_of(docs.sparkSession, BATCH):
        slots = _slots(docs)
        profile = cut_lineage(_profile(docs, slots))
        sets = profile.where("block IS NULL").drop("block", "seen")
        full = sets.where("n > 0")
        sketch = np.zeros(slots, np.int32)
        for row in profile.where("block IS NOT NULL").groupBy("block").agg(vector_sum("seen")).toArrow().to_pylist():
            sketch[row["block"] * SLOTS:(row["block"] + 1) * SLOTS] = np.minimum(row["seen"], 2 ** 31 - 1)

        # a class of equal sets: its first key names it, one of its documents stands for it
        classes = cut_lineage(full.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("head"), F.first("counts").alias("counts")).withColumnRenamed("k1", "rep"))
        vectors = classes.where("head IS NOT NULL").select("rep", "n", "counts")
        # one exchange serves the copies of a set in several tasks, the size of a cell and what it holds
        cell, held = Window.partitionBy("token"), F.xxhash64("rep")
        shared = _prefixes(docs.where("doc_id IS NOT NULL"), sketch).repartition("token").dropDuplicates(["token", "rep"])
        shared = shared.select("token", "rep", F.count("*").over(cell).alias("m"), F.bit_xor(held).over(cell).alias("x"), F.sum(F.shiftright(held, 24)).over(cell).alias("s")).where("m > 1")
        # cells of the same members are one cell, named after them
        members = cut_lineage(shared.select(F.xxhash64("m", "x", "s").alias("token"), "rep", "m").distinct())
        small = members.where(F.col("m") <= LEAF).join(vectors.select("rep", "n"), "rep").select("token", "rep", "n")
        buckets = max(1, -(-members.count() // ROWS)) * 8
        found = (small.withColumn("bucket", F.pmod(F.hash("token"), F.lit(buckets))).groupBy("bucket")
                 .applyInArrow(_pairs_in_leaves, "a bigint, b bigint").distinct())
        near = cut_lineage(_within_bounds(found, vectors))
        large = cut_lineage(members.where(F.col("m") > LEAF).groupBy("rep").agg(F.collect_list(F.struct("token", "m")).alias("cells")))
        wanted = near.select(F.explode(F.array("a", "b")).alias("rep")).union(large.select("rep")).distinct()
        wanted = cut_lineage(wanted.join(classes.where("head IS NOT NULL").select("rep", "head"), "rep"))
        texts = Texts(docs, wanted)
        try:
            pairs = cut_lineage(texts.possible(near))
            links = _spanning_links(pairs, texts)
            several = _classes_of_one_id(full)
            if several is not None:
                links = cut_lineage(links.unionByName(several))
            roots = _large_cells(large, vectors, texts, links)
        finally:
            texts.drop()
        discard(members, near, large, wanted, pairs)
    placed = classes.join(roots, "rep", "left").select("rep", "k2", "n", "head", F.coalesce("root", "rep").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("head").alias("component_id")), "root").select(F.col("rep").alias("k1"), "k2", "n", "component_id")
    grouped = full.join(named, ["k1", "k2", "n"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return grouped.unionByName(alone)


def _classes_of_one_id(full: DataFrame) -> DataFrame | None:
    """Links between the classes of an id that has different texts; None if there are none."""
    ids = full.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("a"), F.max("k1").alias("z")).where("a <> z")
    ids = cut_lineage(ids.select("doc_id", "a"))
    if ids.isEmpty():
        return None
    return full.join(ids, "doc_id").where("a <> k1").select("a", F.col("k1").alias("b")).distinct()


def keep_one_per_group(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """The document that names each component; rows without an id stay if nothing equals them."""
    groups = cut_lineage(jaccard_groups(docs, text, id))
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("stay")).distinct()
    goes = cut_lineage(groups.select("doc_id").distinct().join(stays, F.col("doc_id").eqNullSafe(F.col("stay")), "left_anti"))
    few = goes.count() <= BROADCAST
    return docs.alias("d").join((F.broadcast(goes) if few else goes.hint("merge")).alias("g"), F.col(f"d.{id}").eqNullSafe(F.col("g.doc_id")), "left_anti")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
t AS (SELECT doc_id, unnest(sh) AS t FROM s),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM n UNION SELECT r.v, e.y FROM r JOIN e ON r.u = e.x)
SELECT n.doc_id, n.n AS n_shingles, min(r.u) AS component_id FROM n JOIN r ON r.v = n.doc_id GROUP BY 1, 2
"""

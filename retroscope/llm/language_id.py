"""Language ID by bit-sliced Bloom filters: one lookup gives all languages that hold an n-gram."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retroscope.llm.bytehash import blocks
from retroscope.session import cut_lineage

GRAM = 4  # bytes, so that a gram is one 32-bit number
LOG2_BITS = 18
HASHES = 2
SHARE = 0.1  # a language holds a gram if it uses it at least this often, against the language that uses it most
WINDOW = 1 << 19
BLOCK = 1 << 20  # bytes of text that are folded and looked up together: a batch may hold far more
FLUSH = 2_000_000
MOST_LANGUAGES = 1024
RARE = 0.001  # of unseen texts may lie further from their language than the threshold of rejection is measured by

# multipliers of the hash family, odd numbers from the digits of the golden ratio and of e
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xB7E151628AED2A6B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
# letters and bytes of longer characters stay, capitals are folded, anything else is a blank
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_BLANK = np.uint32(0x20202020)


def held_out(id: str = "doc_id") -> Column:
    """A third of the documents, by their id; rows without an id are neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes of all texts, each between two blanks, and where each begins and ends."""
    edge, none = pa.scalar("  ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(edge, pc.utf8_lower(texts.cast(pa.large_string())), edge, none)
    ends = np.frombuffer(padded.buffers()[1], np.int64)[padded.offset:padded.offset + len(padded) + 1]
    raw = np.frombuffer(padded.buffers()[2], np.uint8)[ends[0]:ends[-1]] if len(padded) else np.empty(0, np.uint8)
    return _FOLD[raw], ends - ends[0]


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK bytes of texts; a longer text is alone in its range."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    return blocks(np.append(0, np.cumsum(size, dtype=np.int64)), BLOCK)


def _windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Stretches of at most WINDOW grams: position of the first, the grams, and which lie within a text."""
    last = len(data) - GRAM + 1
    for lo in range(0, max(last, 0), WINDOW):
        hi = min(lo + WINDOW, last)
        b = data[lo:hi + GRAM - 1].astype(np.uint32)
        n = hi - lo
        grams = (b[:n] << 24) | (b[1:n + 1] << 16) | (b[2:n + 2] << 8) | b[3:n + 3]
        inside = grams != _BLANK
        cuts = offsets[1:-1][np.searchsorted(offsets[1:-1], lo, "right"):np.searchsorted(offsets[1:-1], hi + GRAM, "left")]
        for back in range(1, GRAM):
            at = cuts - back - lo
            inside[at[(at >= 0) & (at < n)]] = False
        yield lo, grams, inside


def _positions(grams: np.ndarray, log2_bits: int, which: int) -> np.ndarray:
    return ((grams.astype(np.uint64) * _MULTIPLIERS[which]) >> np.uint64(64 - log2_bits)).astype(np.int64)


def gram_counts(labelled: DataFrame) -> DataFrame:
    """lang, gram, n over all rows (lang, text): counted in each task, then summed."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        size = 0

        def merged(parts):
            grams, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return grams, np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)

        def flush():
            for lang, parts in sums.items():
                grams, n = merged(parts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            sums.clear()

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                texts = batch.column(1).filter(pc.equal(langs, lang))
                parts = [np.unique(g[ok], return_counts=True) for i, j in _blocks(texts) for _, g, ok in _windows(*_bytes_of(texts.slice(i, j - i)))]
                if parts:
                    sums.setdefault(lang, []).append(merged(parts))
            size = sum(len(p[0]) for parts in sums.values() for p in parts)
            if size > FLUSH:
                yield from flush()
        yield from flush()

    found = labelled.select("lang", "text").mapInArrow(counted, "lang string, gram bigint, n bigint")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class LanguageFilters:
    """``slices[w][position]`` has a bit for each language of word w; its size depends on parameters alone."""

    languages: list[str]
    slices: list[np.ndarray]
    false_positive: np.ndarray
    fallback: int
    log2_bits: int
    hashes: int


def fit_filters(docs: DataFrame, text: str = "text", lang: str = "lang", log2_bits: int = LOG2_BITS,
                hashes: int = HASHES, share: float = SHARE) -> LanguageFilters:
    """Filters from all rows with a language and a text. What comes to the driver is bounded: the
    languages (at most MOST_LANGUAGES) and 2 ** log2_bits positions."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    counts = cut_lineage(gram_counts(labelled))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    known = {r.lang: r.total for r in totals.orderBy("lang").limit(MOST_LANGUAGES + 1).collect()}
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = sorted(known)
    if not names:
        return LanguageFilters([], [], np.empty(0), 0, log2_bits, hashes)
    index = docs.sparkSession.createDataFrame([(x, i // 63, 1 << (i % 63), float(known[x])) for i, x in enumerate(names)],
                                              "lang string, word int, bit bigint, total double")
    rates = counts.join(F.broadcast(index), "lang").withColumn("rate", F.col("n") / F.col("total"))
    best = rates.groupBy("gram").agg(F.max("rate").alias("most"), F.collect_list(F.struct("word", "bit", "rate")).alias("by"))
    masks = (best.select("gram", "most", F.explode("by").alias("b")).where(F.col("b.rate") >= share * F.col("most"))
             .groupBy("gram", F.col("b.word").alias("word")).agg(F.bit_or("b.bit").alias("mask")))

    def placed(batches):
        for b in batches:
            grams = b.column(0).to_numpy().astype(np.uint32)
            for k in range(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(_positions(grams, log2_bits, k)), b.column(1), b.column(2)], ["at", "word", "mask"])

    slots = masks.mapInArrow(placed, "at bigint, word int, mask bigint").groupBy("word", "at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words, at, mask = (slots.column(c).to_numpy() for c in ("word", "at", "mask"))
    width = np.uint8 if len(names) <= 8 else np.uint64
    slices = []
    for w in range((len(names) + 62) // 63):
        table = np.zeros(1 << log2_bits, width)
        table[at[words == w]] = mask[words == w].astype(width)
        slices.append(table)
    fill = np.array([np.count_nonzero(slices[i // 63] & width(1 << (i % 63))) / (1 << log2_bits) for i in range(len(names))])
    return LanguageFilters(names, slices, np.minimum(fill ** hashes, 0.999999), int(np.argmax([known[x] for x in names])), log2_bits, hashes)


def language_hits(model: LanguageFilters, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Grams of each text, and of those how many each language holds, freed of false positives."""
    total, hits = np.zeros(len(texts)), np.zeros((len(model.languages), len(texts)))
    for i, j in _blocks(texts):
        total[i:j], hits[:, i:j] = _hits(model, texts.slice(i, j - i))
    false = model.false_positive[:, None]
    return total, np.maximum(0.0, (hits - total * false) / (1 - false))


def _hits(model: LanguageFilters, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = _bytes_of(texts)
    total, hits = np.zeros(len(texts)), np.zeros((len(model.languages), len(texts)))
    for lo, grams, inside in _windows(data, offsets):
        first, last = np.searchsorted(offsets, lo, "right") - 1, np.searchsorted(offsets, lo + len(grams), "left")
        cuts = np.clip(offsets[first:last + 1] - lo, 0, len(grams))
        spread = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[cuts])
        total[first:last] += spread(inside)
        at = [_positions(grams, model.log2_bits, k) for k in range(model.hashes)]
        for w, table in enumerate(model.slices):
            found = table[at[0]]
            for x in at[1:]:
                found &= table[x]
            found[~inside] = 0
            for i in range(w * 63, min(w * 63 + 63, len(model.languages))):
                hits[i, first:last] += spread((found >> table.dtype.type(i % 63)) & table.dtype.type(1))
    return total, hits


def _judge(docs: DataFrame, model: LanguageFilters, text: str, carried: list[str]) -> DataFrame:
    """The carried columns and, after them, the language and its share."""
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            letters = np.array(batch.column(1).to_pylist(), bool)
            if n and model.languages:
                total, hits = language_hits(model, pc.fill_null(batch.column(0), ""))
                best = hits.argmax(axis=0)
                top = hits[best, np.arange(n)]
                best = np.where(top > 0, best, model.fallback)
                share = np.where(letters & (total > 0), np.clip(top / np.maximum(total, 1), 0, 1), 0.0)
                names = [model.languages[b] if ok else "und" for b, ok in zip(best, letters)]
            else:
                names, share = ["und"] * n, np.zeros(n)
            out = [*batch.columns[2:], pa.array(names, pa.string()), pa.array(share)]
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema(
                [*list(batch.schema)[2:], pa.field("_language", pa.string()), pa.field("_share", pa.float64())]))

    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    rows = docs.select(F.col(text).alias("_text"), letters.alias("_letters"), *[F.col(c) for c in carried])
    schema = docs.select(*carried).schema.add("_language", "string").add("_share", "double")
    return rows.mapInArrow(judged, schema)


def identify(docs: DataFrame, model: LanguageFilters, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred, score per row, from the text alone and without a shuffle.

    lang_pred is the language that holds most grams of the text once the expected false positives are
    taken off (ties: first by name), score its share of all grams. A null text or one without a letter
    is ``und`` with score 0. A text whose grams no language holds goes to the language with the most
    training text, score 0; with nothing learned all is ``und``. Repeated rows are judged each.
    """
    return _judge(docs, model, text, [id]).toDF("doc_id", "lang_pred", "score")


def keep_identified(docs: DataFrame, model: LanguageFilters, least: float, text: str = "text") -> DataFrame:
    """The rows whose text is in a learned language with a score of ``least`` or more, all columns kept."""
    # by place: a caller's columns may have any names
    places = [f"c{i}" for i in range(len(docs.columns))]
    judged = _judge(docs.toDF(*places), model, places[docs.columns.index(text)], places)
    kept = judged.where((F.col("_language") != "und") & (F.col("_share") >= least)).select(*places)
    return kept.toDF(*docs.columns)


def rejection_share(held: DataFrame, model: LanguageFilters, text: str = "text", lang: str = "lang", rare: float = RARE) -> float:
    """The share of grams below which a text is in none of the learned languages, from labelled texts the model
    has not seen (``held``): midway between the share that all but one in ``1 / rare`` have in their own
    language and the median of the best share that another language has in them. Rows without a text, a
    learned language or a letter say nothing, nor do those that another language explains better than their
    own (wrong labels); where none is left, 0: only texts without a letter are rejected then."""
    labelled = held.where(F.col(lang).isin(model.languages) & F.col(text).rlike(r"\p{L}"))

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, hits = language_hits(model, batch.column(0))
            own, at = pc.index_in(batch.column(1), pa.array(model.languages)).to_numpy(), np.arange(batch.num_rows)
            said = hits[own, at]
            hits[own, at] = 0.0
            other = hits.max(axis=0)
            ok = (said > 0) & (said >= other)
            yield pa.RecordBatch.from_arrays([pa.array(said[ok] / total[ok]), pa.array(other[ok] / total[ok])], ["own", "other"])

    if not model.languages:
        return 0.0
    found = labelled.select(F.col(text).cast("string"), F.col(lang).cast("string")).mapInArrow(shares, "own double, other double")
    own, other = found.agg(F.percentile_approx("own", rare), F.percentile_approx("other", 0.5)).first()
    return 0.0 if own is None else (own + other) / 2

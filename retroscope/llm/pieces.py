"""SentencePiece encoding by the model's merges, decoding, and the n best paths through the piece lattice.

The encoding joins neighbours in the order of the model's scores, which are merge ranks in a BPE
model and do not add up. The lattice takes scores that do: log frequencies of the pieces, counted
over all documents. Forward: Viterbi scores give the best way to reach each place. Backward: A-star
from the end, with those scores as exact heuristic, pops the n best whole paths in order.

No piece holds a space behind another character, so a text falls into independent stretches (spaces
and the word after them); its merges and its n best segmentations follow from those of its stretches.
The distinct stretches of a batch are merged and searched forward together, in arrays; the forward pass
keeps the two best scores, and only stretches whose second way can enter the n best are searched backward.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retroscope.llm.bytehash import blocks, buffer_of

KEPT = 200_000  # stretches remembered by a worker
LONGEST = 32  # characters of a stretch that goes through the arrays; longer ones go one by one
TOGETHER = 1 << 13  # stretches in the arrays at once
DISTINCT = 1 << 25  # bytes of text whose distinct stretches are found together
BLOCK = 1 << 21  # bytes of text whose ids are laid out together
ENCODED = 1 << 21  # bytes of text that are encoded and sent on together: ids of a whole batch would be large
_POINT = 21  # bits of a code point
_SYMBOL = 20  # bits of a symbol
NO_MERGE = 1 << 40
UNKNOWN = 10.0  # below the lowest score of the vocabulary, for a character that only bytes can spell
_LATTICES: dict[str, tuple[bytes, Lattice]] = {}


class Places:
    """Where each of many numbers (not negative) stands in a list: open addressing, whole arrays at a time."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(4, (4 * len(numbers)).bit_length())
        self.held = np.full(1 << self.bits, -1, np.int64)
        self.at = np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(numbers)), self._slot(numbers)
        while len(left):
            free = np.flatnonzero(self.at[slot] < 0)
            won = free[np.unique(slot[free], return_index=True)[1]]
            self.at[slot[won]], self.held[slot[won]] = left[won], numbers[left[won]]
            left, slot = np.delete(left, won), (np.delete(slot, won) + 1) & ((1 << self.bits) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        slot = self._slot(numbers)
        held, out = self.held[slot], self.at[slot]
        left = np.flatnonzero((held != numbers) & (held >= 0))
        out[left] = -1
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            held = self.held[slot[left]]
            hit = held == numbers[left]
            out[left[hit]] = self.at[slot[left[hit]]]
            left = left[~hit & (held >= 0)]
        return out


def laid_out(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run of ``size``, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Runs:
    """Lists of numbers by name: where each starts in ``flat``, and its size."""

    def __init__(self, n: int):
        self.start, self.size, self.parts, self.end = np.zeros(n, np.int64), np.zeros(n, np.int64), [], 0

    def put(self, names: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.start[names], self.size[names] = self.end + np.cumsum(size) - size, size
        self.parts.append(flat)
        self.end += len(flat)

    @property
    def flat(self) -> np.ndarray:
        self.parts = [np.concatenate([np.empty(0, np.int32), *self.parts])]
        return self.parts[0]


class Lattice:
    """Vocabulary, merge ranks and scores of a .model file; ``logs`` (a number per id) replaces the
    scores of the lattice, not the ranks."""

    def __init__(self, path: str, logs: np.ndarray | None = None):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.ranks = {sp.id_to_piece(i).replace("▁", " "): (i, sp.get_score(i)) for i in plain}
        self.pieces = self.ranks if logs is None else {p: (i, float(logs[i])) for p, (i, _) in self.ranks.items()}
        self.size, self.logs = size, logs
        self.bytes = [b""] * size
        for piece, (i, _) in self.pieces.items():
            self.bytes[i] = piece.encode()
        self.byte_ids = [0] * 256
        for i in range(size):
            if sp.is_byte(i):
                value = int(sp.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
        # every beginning of a piece, with id and score where it is one
        self.begun = {p[:k]: self.pieces.get(p[:k], ()) for p in self.pieces for k in range(1, len(p) + 1)}
        self.lowest = min((s for _, s in self.pieces.values() if s > -1e8), default=0.0) - UNKNOWN
        if any(" " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece holds a space behind another character")
        line = "" if any("\n" in p for p in self.pieces) else r"\n"
        self.stretches = re.compile(rf" *[^ {line}]+| +" + (r"|\n" if line else ""))
        self.known: dict[str, list[tuple[float, tuple[int, ...]]]] = {}
        self._tables()

    def _tables(self) -> None:
        """Merges, beginnings and bytes as arrays. Stretches with a character that is no piece do not go through them."""
        if self.size >> _SYMBOL:
            raise ValueError("the vocabulary is too large")
        single = {ord(p): i for p, (i, _) in self.ranks.items() if len(p) == 1}
        self.points, self.point_id = Places(np.array(list(single), np.int64)), np.array([*single.values(), -1], np.int64)
        pairs = [(self.ranks[p[:k]][0] << _SYMBOL | self.ranks[p[k:]][0], i, -score) for p, (i, score) in self.ranks.items()
                 for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks]
        self.pairs, self.pair_id = Places(np.array([x[0] for x in pairs], np.int64)), np.array([x[1] for x in pairs] + [-1], np.int64)
        # ranks in steps of 64, which leave room for a place; the last is that of no merge
        self.pair_rank = np.append(np.unique(np.array([x[2] for x in pairs]), return_inverse=True)[1].astype(np.int64) << 6, NO_MERGE)
        states = {p: i + 1 for i, p in enumerate(self.begun)} | {"": 0}
        self.trie = Places(np.array([states[p[:-1]] << _POINT | ord(p[-1]) for p in self.begun], np.int64))
        self.state_id = np.array([x[0] if x else -1 for x in self.begun.values()], np.int64)
        self.state_score = np.array([x[1] if x else 0.0 for x in self.begun.values()])
        self.byte_size = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_start, self.byte_flat = np.cumsum(self.byte_size) - self.byte_size, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.breaks = np.zeros(256, bool)
        self.breaks[10] = not any("\n" in p for p in self.pieces)

    def merged(self, s: str) -> tuple[int, ...]:
        """Ids of a stretch by the model's merges: of all neighbours that form a piece those of the best
        rank are joined first, the leftmost among equals. Characters without a piece are spelled in bytes."""
        get, n = self.ranks.get, len(s)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the symbol that starts here; 0: joined to another
        agenda = []

        def offer(a: int, b: int) -> None:
            found = get(s[a:end[b]])
            if found:
                heapq.heappush(agenda, (-found[1], a, b, end[b]))

        for a in range(n - 1):
            offer(a, a + 1)
        while agenda:
            _, a, b, stop = heapq.heappop(agenda)
            # outdated if a side has gone or grown since
            if end[a] != b or end[b] != stop:
                continue
            end[a], end[b] = stop, 0
            if stop < n:
                before[stop] = a
                offer(a, stop)
            if before[a] >= 0:
                offer(before[a], a)
        out: list[int] = []
        a = 0
        while a < n:
            found = get(s[a:end[a]])
            out.extend((found[0],) if found else [self.byte_ids[x] for x in s[a].encode()])
            a = end[a]
        return tuple(out)

    def parts(self, text: str) -> list[str]:
        return self.stretches.findall(" " + text) if text else []

    def edges(self, s: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end, (start, score, ids) of the pieces that lead there."""
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(len(s) + 1)]
        get, n = self.begun.get, len(s)
        for a in range(n):
            if not get(s[a]):
                ids = tuple(self.byte_ids[x] for x in s[a].encode())
                into[a + 1].append((a, self.lowest if self.logs is None else float(sum(self.logs[i] for i in ids)), ids))
            for b in range(a + 1, n + 1):
                found = get(s[a:b])
                if found:
                    into[b].append((a, found[1], (found[0],)))
                elif found is None:
                    break
        return into

    def n_best(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best (score, ids) of a stretch, best first; all, if there are fewer."""
        into = self.edges(s)
        reach = [0.0] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            reach[end] = max(reach[a] + w for a, w, _ in into[end])
        # among equal scores the one nearest to its end goes first, so ties cost no more than one path each
        agenda, turn, out = [(-reach[-1], len(s), 0, 0.0, None)], 0, []
        while agenda and len(out) < n:
            _, at, _, done, path = heapq.heappop(agenda)
            if not at:
                ids = []
                while path:
                    ids.extend(path[0])
                    path = path[1]
                out.append((done, tuple(ids)))
                continue
            for a, w, ids in into[at]:
                turn += 1
                heapq.heappush(agenda, (-(done + w + reach[a]), a, turn, done + w, (ids, path)))
        return out

    def ways(self, text: str, n: int) -> list[list[tuple[float, tuple[int, ...]]]]:
        """The n best of each stretch of a text."""
        return [self.known_ways(p, n) for p in self.parts(text)]

    def known_ways(self, s: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best of a stretch; a lattice is asked for one n."""
        if s not in self.known:
            if len(self.known) > KEPT:
                self.known.clear()
            self.known[s] = self.n_best(s, n)
        return self.known[s]

    def cut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the stretches of the texts begin, and the end of the last: the same as ``parts``."""
        space, alone = data == 32, self.breaks[data]
        first = alone.copy()
        first[1:] |= alone[:-1] | (space[1:] & ~space[:-1])
        first[ends[:-1][ends[:-1] < len(data)]] = True
        return np.append(np.flatnonzero(first), len(data))

    def distinct(self, data: np.ndarray, starts: np.ndarray, search: bool) -> Distinct:
        found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        found = found.dictionary_encode()
        return Distinct(self, found.dictionary.cast(pa.large_string()), found.indices.to_numpy(), search)

    def merge_all(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``merged`` of many stretches: a column of piece ids each, -1 behind its end. Sizes, and the ids one after the other."""
        n, m = symbols.shape
        sym = np.full((n + 1, m), -1, np.int64)
        sym[:n] = symbols
        rank, into = np.full((n + 1, m), NO_MERGE), np.full((n + 1, m), -1, np.int64)
        after, before = np.repeat(np.arange(1, n + 2)[:, None], m, 1), np.repeat(np.arange(-1, n)[:, None], m, 1)
        after[n], before[0] = n, n

        def judge(at, cols):
            left, right = sym[at, cols], sym[after[at, cols], cols]
            found = self.pairs.find(left << _SYMBOL | right)  # negative, and so not found, where one is missing
            rank[at, cols] = self.pair_rank[found] + at
            into[at, cols] = self.pair_id[found]

        every = np.arange(m)
        for at in range(n - 1):
            judge(np.full(m, at), every)
        while True:
            # the best rank of each, the leftmost of equals
            best = rank.min(axis=0)
            cols = np.flatnonzero(best < NO_MERGE)
            if not len(cols):
                break
            at = best[cols] & 63
            sym[at, cols] = into[at, cols]
            gone = after[at, cols]
            beyond = after[gone, cols]
            sym[gone, cols], rank[gone, cols] = -1, NO_MERGE
            after[at, cols], before[beyond, cols] = beyond, at
            judge(at, cols)
            judge(before[at, cols], cols)
        stays = sym.T >= 0
        return stays.sum(axis=1), sym.T[stays].astype(np.int32)

    def search_all(self, points: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The forward pass of many stretches: a column of code points each, -1 behind its ``n``. Best score, what
        the second best way loses (inf: there is none), and size and ids of the best way; of equals it is the one
        that ``n_best`` meets first, of the longest last pieces."""
        most, m = points.shape
        one, two = np.full((most + 1, m), -np.inf), np.full((most + 1, m), -np.inf)
        start, by = np.zeros((most + 1, m), np.int64), np.zeros((most + 1, m), np.int64)
        one[0] = 0.0
        for a in range(most):
            cols = np.flatnonzero(n > a)
            state = np.zeros(len(cols), np.int64)
            for b in range(a + 1, most + 1):
                found = self.trie.find(state << _POINT | points[b - 1, cols])  # -1, and so not found, behind the end
                live = np.flatnonzero(found >= 0)
                if not len(live):
                    break
                cols, found = cols[live], found[live]
                state = found.astype(np.int64) + 1
                whole = np.flatnonzero(self.state_id[found] >= 0)
                c, f = cols[whole], found[whole]
                w = self.state_score[f]
                x, y, best = one[a, c] + w, two[a, c] + w, one[b, c]
                two[b, c] = np.maximum(two[b, c], np.maximum(np.minimum(x, best), y))
                better = np.flatnonzero(x > best)
                c, f = c[better], f[better]
                one[b, c], start[b, c], by[b, c] = x[better], a, self.state_id[f]
        every = np.arange(m)
        at, rows, ids = n.copy(), [], []
        live = every
        while len(live):
            rows.append(live)
            ids.append(by[at[live], live])
            at[live] = start[at[live], live]
            live = live[at[live] > 0]
        size = np.bincount(np.concatenate(rows), minlength=m)
        ends = np.cumsum(size)
        flat = np.empty(ends[-1], np.int32)
        for step, (r, i) in enumerate(zip(rows, ids)):
            flat[ends[r] - 1 - step] = i
        return one[n, every], one[n, every] - two[n, every], size, flat

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return self.byte_flat[laid_out(self.byte_start[ids], self.byte_size[ids])]

    def decode(self, ids) -> str:
        return b"".join([self.bytes[i] for i in ids])[1:].decode()


class Distinct:
    """The distinct stretches of some texts, which of them stands where (``codes``), their merged ids, and if
    ``search`` is set score, loss and ids of the best way."""

    def __init__(self, lattice: Lattice, stretches: pa.Array, codes: np.ndarray, search: bool):
        self.stretches, self.codes, n = stretches, codes, len(stretches)
        self.merged, self.best = Runs(n), Runs(n)
        self.score, self.loss = np.zeros(n), np.full(n, np.inf)
        size = pc.utf8_length(stretches).to_numpy(zero_copy_only=False).astype(np.int64)
        data, _ = buffer_of(stretches)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(size) - size
        single = lattice.point_id[lattice.points.find(points)]
        plain = size <= LONGEST
        plain &= np.add.reduceat(single < 0, first) == 0 if n else plain
        turn = np.flatnonzero(plain)
        turn = turn[np.argsort(size[turn], kind="stable")]
        for i in range(0, len(turn), TOGETHER):
            names = turn[i:i + TOGETHER]
            rows = np.arange(size[names[-1]])[:, None]
            within = rows < size[names]
            at = np.where(within, first[names] + rows, 0)
            self.merged.put(names, *lattice.merge_all(np.where(within, single[at], -1)))
            if search:
                self.score[names], self.loss[names], *best = lattice.search_all(np.where(within, points[at], -1), size[names])
                self.best.put(names, *best)
        for i in np.flatnonzero(~plain):
            s = stretches[i].as_py()
            ids = lattice.merged(s)
            self.merged.put(np.array([i]), np.array([len(ids)]), np.array(ids, np.int32))
            if search:
                (self.score[i], ids), *others = lattice.n_best(s, 2)
                self.loss[i] = self.score[i] - others[0][0] if others else np.inf
                self.best.put(np.array([i]), np.array([len(ids)]), np.array(ids, np.int32))


def combine(ways: list[list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """The n best of the whole: total score, and which stretches do not take their best way."""
    near = heapq.nsmallest(n - 1, ((w[0][0] - w[1][0], i) for i, w in enumerate(ways) if len(w) > 1))
    return _combined(sum(w[0][0] for w in ways), {i: ways[i] for _, i in near}, n)


def _combined(total: float, near: dict[int, list[tuple[float, tuple[int, ...]]]], n: int) -> list[tuple[float, dict[int, int]]]:
    """``combine`` from the score of the whole and the ways of the stretches that matter: the n best differ from
    the best only where the first loss is among the n - 1 smallest."""
    best: list[tuple[float, dict[int, int]]] = [(0.0, {})]
    for i, ways in near.items():
        more = [(loss + ways[0][0] - ways[k][0], {**taken, i: k} if k else taken) for loss, taken in best for k in range(len(ways))]
        best = heapq.nsmallest(n, more, key=lambda x: x[0])
    return [(total - loss, taken) for loss, taken in best]


def _lattice(path: str, n: int, logs: np.ndarray | None = None) -> Lattice:
    key, state = f"{n}:{path}", b"" if logs is None else hashlib.sha256(logs.tobytes()).digest()
    if key not in _LATTICES or _LATTICES[key][0] != state:
        _LATTICES[key] = state, Lattice(path, logs)
    return _LATTICES[key][1]


def _pieces_of(lattice: Lattice, texts: pa.Array, search: bool) -> Iterator[tuple[Distinct, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: their distinct stretches, for each text where its stretches begin among the codes, the
    bytes of the texts (behind the space that a text starts with) and where each text begins among them."""
    large = pc.fill_null(texts.cast(pa.large_string()), "")
    none = pa.scalar("", pa.large_string())
    lead = pc.if_else(pc.equal(large, none), none, pa.scalar(" ", pa.large_string()))
    data, ends = buffer_of(pc.binary_join_element_wise(lead, large, none))
    for i, j in blocks(ends, DISTINCT):
        part, bounds = data[ends[i]:ends[j]], ends[i:j + 1] - ends[i]
        starts = lattice.cut(part, bounds)
        yield lattice.distinct(part, starts, search), np.searchsorted(starts, bounds), part, bounds


def _slices(batch: pa.RecordBatch, most: int | None) -> Iterator[pa.RecordBatch]:
    if most is None or not batch.num_rows:
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch.column(0)), 0).to_numpy(zero_copy_only=False)
    for i, j in blocks(np.append(0, np.cumsum(size, dtype=np.int64)), most):
        yield batch.slice(i, j - i)


def _apply(docs: DataFrame, model: str, text: str, n: int, carried: list[str], names: dict[str, pa.DataType], types: str, column,
           logs: np.ndarray | None = None, most: int | None = None) -> DataFrame:
    """``column`` makes the new columns of a batch, or, if ``most`` is given, of about so many bytes of texts."""
    def scan(batches):
        lattice = _lattice(model, n, logs)
        for batch in chain.from_iterable(_slices(b, most) for b in batches):
            new = [pa.array(c, k) for c, k in zip(column(lattice, batch.column(0)), names.values())]
            fields = [*list(batch.schema)[1:], *(pa.field(x, k) for x, k in names.items())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *new], schema=pa.schema(fields))

    schema = docs.select(*carried).schema
    for field in StructType.fromDDL(types):
        schema = schema.add(field)
    return docs.select(F.col(text).alias("_text"), *[F.col(c) for c in carried]).mapInArrow(scan, schema)


def encode(docs: DataFrame, model: str, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``pieces``: ids by the merges of a BPE ``model``, as its library gives them
    (but for a space mark in the text, which is spelled in bytes so that it comes back). Null counts as
    empty, and an empty text has no pieces; repeated rows are encoded each; an empty table gives no rows."""
    def column(lattice: Lattice, texts: pa.Array) -> list:
        flat, ends = [np.empty(0, np.int32)], [np.zeros(1, np.int64)]
        for found, bounds, _, _ in _pieces_of(lattice, texts, False):
            size = found.merged.size[found.codes]
            flat.append(found.merged.flat[laid_out(found.merged.start[found.codes], size)])
            ends.append(ends[-1][-1] + np.append(0, np.cumsum(size))[bounds[1:]])
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(flat)))]

    return _apply(docs, model, text, 1, list(carried), {"pieces": pa.list_(pa.int32())}, "pieces array<int>", column, most=ENCODED)


def decode(encoded: DataFrame, model: str, pieces: str = "pieces", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns and ``text``, exactly the text that was encoded (null pieces: empty)."""
    column = lambda lattice, ids: ([lattice.decode(x or ()) for x in ids.to_pylist()],)
    return _apply(encoded, model, pieces, 1, list(carried), {"text": pa.string()}, "text string", column)


def log_frequencies(docs: DataFrame, model: str, text: str = "text") -> np.ndarray:
    """Log of the share of each id among the pieces of all rows, each id counted once more than it occurs.
    A task sends a number per id, as does the sum to the driver: no more than the vocabulary holds."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model, 1)
        total = np.zeros(lattice.size, np.int64)
        for batch in batches:
            for found, *_ in _pieces_of(lattice, batch.column(0), False):
                often = np.bincount(found.codes, minlength=len(found.stretches))
                size = found.merged.size
                ids = found.merged.flat[laid_out(found.merged.start, size)]
                total += np.bincount(ids, np.repeat(often, size), lattice.size).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    found = docs.select(F.col(text).alias("_text")).mapInArrow(counted, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.ones(_lattice(model, 1).size)
    for r in found.collect():
        counts[r.id] += r.n
    # in whole 2^-20, so that sums are exact and the search meets true ties only
    return np.round(np.log(counts / counts.sum()) * (1 << 20)) / (1 << 20)


def _nearest(found: Distinct, codes: np.ndarray, bounds: np.ndarray, n: int) -> list[list[int]]:
    """For each text the places (among its stretches) of the ``n`` smallest losses, the first of equals first."""
    out: list[list[int]] = [[] for _ in bounds[1:]]
    some = np.flatnonzero(np.diff(bounds))
    loss = found.loss[codes]
    for _ in range(n if len(some) else 0):
        least = np.minimum.reduceat(loss, bounds[some])
        hits = np.flatnonzero(loss == np.repeat(least, np.diff(bounds)[some]))
        owner = np.searchsorted(bounds, hits, "right") - 1
        first = np.unique(owner, return_index=True)[1]
        first = first[np.isfinite(loss[hits[first]])]
        for t, at in zip(owner[first].tolist(), hits[first].tolist()):
            out[t].append(at - int(bounds[t]))
        loss[hits[first]] = np.inf
    return out


def _searched(lattice: Lattice, texts: pa.Array, n: int) -> Iterator[tuple]:
    """For runs of texts: where the stretches of each begin, the bytes of the texts and where each text begins among
    them, the merged stretches as (start, size, ids), the n best of each text as ``combine`` gives them, and, made one
    at a time, the stretches of each of the n best as (start, size, ids)."""
    for found, all_bounds, all_data, all_ends in _pieces_of(lattice, texts, True):
        for i, j in blocks(all_ends, BLOCK):
            codes, bounds = found.codes[all_bounds[i]:all_bounds[j]], all_bounds[i:j + 1] - all_bounds[i]
            data, ends = all_data[all_ends[i]:all_ends[j]], all_ends[i:j + 1] - all_ends[i]
            merged, best = found.merged, found.best
            # the best way of every stretch, and other ways where a text takes them
            total = np.append(0.0, np.cumsum(found.score[codes]))[bounds]
            chosen = []
            for t, places in enumerate(_nearest(found, codes, bounds, n - 1)):
                near = {p: lattice.known_ways(found.stretches[codes[bounds[t] + p]].as_py(), n) for p in places}
                chosen.append((near, _combined(float(total[t + 1] - total[t]), near, n)))

            def way(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                start, size, flat, end = best.start[codes], best.size[codes], [best.flat], len(best.flat)
                for t, (near, ways) in enumerate(chosen):
                    for p, taken in ways[k][1].items() if k < len(ways) else ():
                        ids = near[p][taken][1]
                        start[bounds[t] + p], size[bounds[t] + p] = end, len(ids)
                        flat.append(np.array(ids, np.int32))
                        end += len(ids)
                return start, size, np.concatenate(flat)

            yield bounds, data, ends, (merged.start[codes], merged.size[codes], merged.flat), [ways for _, ways in chosen], map(way, range(n))


def _read(lattice: Lattice, runs: tuple[np.ndarray, np.ndarray, np.ndarray], bounds, data, ends) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of ids laid out by stretch: the ids of the texts, where each text begins among them, and whether they spell it."""
    start, size, flat = runs
    ids = flat[laid_out(start, size)]
    cuts = np.append(0, np.cumsum(size))[bounds]
    spelled, places = lattice.spelled(ids), np.append(0, np.cumsum(lattice.byte_size[ids]))[cuts]
    if np.array_equal(places, ends) and np.array_equal(spelled, data):
        return ids, cuts, np.ones(len(cuts) - 1, bool)
    return ids, cuts, np.array([np.array_equal(spelled[a:b], data[c:d])
                                for a, b, c, d in zip(places[:-1], places[1:], ends[:-1], ends[1:])], bool)


def encode_n_best(docs: DataFrame, model: str, n: int = 2, text: str = "text", carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, ``pieces`` of ``encode``, and of the lattice: ``scores`` (sums of log frequencies of the n
    best segmentations, descending), ``best_pieces`` (the ids of each of them, best first) and ``round_trip`` (whether
    decoding ``pieces``, and each of the n best, gives the text back). An empty text has one segmentation, of no pieces."""
    def column(lattice: Lattice, texts: pa.Array) -> list:
        sizes, flats, scores, counts, best_sizes, best_flats, back = [], [np.empty(0, np.int32)], [], [], [], [np.empty(0, np.int32)], []
        for bounds, data, ends, merged, chosen, ways in _searched(lattice, texts, n):
            ids, cuts, good = _read(lattice, merged, bounds, data, ends)
            sizes.append(np.diff(cuts))
            flats.append(ids)
            read = [_read(lattice, way, bounds, data, ends) for way in ways]
            count = np.array([len(x) for x in chosen])
            has = np.arange(n) < count[:, None]  # text by text, best first
            base = np.cumsum([0, *(len(r[0]) for r in read[:-1])])
            start = np.stack([r[1][:-1] + b for r, b in zip(read, base)], 1)[has]
            size = np.stack([np.diff(r[1]) for r in read], 1)[has]
            best_sizes.append(size)
            best_flats.append(np.concatenate([r[0] for r in read])[laid_out(start, size)])
            counts.append(count)
            scores.extend(s for x in chosen for s, _ in x)
            back.append(good & (np.stack([r[2] for r in read], 1) | ~has).all(1))

        def lists(size: list[np.ndarray], values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.concatenate([np.empty(0, np.int64), *size]))), pa.int32()), values)

        return [lists(sizes, pa.array(np.concatenate(flats))), lists(counts, pa.array(scores, pa.float64())),
                lists(counts, lists(best_sizes, pa.array(np.concatenate(best_flats)))), np.concatenate([np.empty(0, bool), *back])]

    names = {"pieces": pa.list_(pa.int32()), "scores": pa.list_(pa.float64()), "best_pieces": pa.list_(pa.list_(pa.int32())), "round_trip": pa.bool_()}
    return _apply(docs, model, text, n, list(carried), names,
                  "pieces array<int>, scores array<double>, best_pieces array<array<int>>, round_trip boolean", column,
                  log_frequencies(docs, model, text), most=ENCODED)


def segmentations(docs: DataFrame, model: str, n: int = 2, text: str = "text", id: str = "doc_id") -> DataFrame:
    """doc_id, n_pieces, scores (sums of log frequencies of the n best segmentations, descending),
    pieces_sha256 (of the ids as 32-bit little-endian numbers), round_trip (whether decoding the ids, and
    those of each of the n best, gives the text back) and best_sha256 (of the ids of the n best, best first),
    per row. ``pieces_sha256`` is of the ids of ``encode``; they need not be the best by score."""
    def named(ids: np.ndarray, cuts: np.ndarray) -> list[str]:
        raw = memoryview(ids.astype("<i4")).cast("B")
        return [hashlib.sha256(raw[4 * a:4 * b]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    def column(lattice: Lattice, texts: pa.Array) -> list:
        out: list[list] = [[] for _ in range(5)]
        for bounds, data, ends, merged, chosen, ways in _searched(lattice, texts, n):
            ids, cuts, back = _read(lattice, merged, bounds, data, ends)
            count, digests = np.diff(cuts), named(ids, cuts)
            bests: list[list[str]] = [[] for _ in chosen]
            for k, way in enumerate(ways):
                ids, cuts, spells = _read(lattice, way, bounds, data, ends)
                for t, digest in enumerate(named(ids, cuts)):
                    if k < len(chosen[t]):
                        bests[t].append(digest)
                        back[t] &= spells[t]
            for column_, new in zip(out, (count.tolist(), [[s for s, _ in x] for x in chosen], digests, back.tolist(), bests)):
                column_.extend(new)
        return out

    names = {"n_pieces": pa.int64(), "scores": pa.list_(pa.float64()), "pieces_sha256": pa.string(), "round_trip": pa.bool_(),
             "best_sha256": pa.list_(pa.string())}
    return _apply(docs, model, text, n, [id], names,
                  "n_pieces bigint, scores array<double>, pieces_sha256 string, round_trip boolean, best_sha256 array<string>", column,
                  log_frequencies(docs, model, text))

"""Fill-in-middle: a text is cut at two unit ranks and written in another order, and can be put together again.

Units are runs of letters A-Z and single other code points. The units of a text form an indexable skip
list: the bottom lane has a node per unit, each express lane above it a node per FAN nodes of the lane
below. A node carries two widths, the units and the code points up to its right neighbour. A cut rank is
reached from the highest lane: go right while the units passed stay within the rank, then one lane down;
the code points passed on the way are the place of the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM = 90  # of 100: texts at and above it stay plain
SUFFIX_FIRST = 20  # of 100: of the others, those below it begin with the suffix
FAN = 16
PART = 1 << 20  # code points of a text looked at in one go


class SkipList:
    """Widths of the units of a text, and express lanes over them."""

    def __init__(self, widths: np.ndarray):
        # a lane is (units, code points) from each of its nodes to the next; the bottom lane comes first
        self.n = len(widths)
        self.lanes = [(np.ones(self.n, np.int64), widths.astype(np.int64))]
        while len(self.lanes[-1][0]) > FAN:
            below = self.lanes[-1]
            at = np.arange(0, len(below[0]), FAN)
            self.lanes.append((np.add.reduceat(below[0], at), np.add.reduceat(below[1], at)))

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank, all of them at rank n."""
        units = points = node = 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            across, along = self.lanes[lane]
            while node < len(across) and units + across[node] <= rank:
                units += int(across[node])
                points += int(along[node])
                node += 1
            node *= FAN if lane else 1
        return points


def unit_widths(text: str) -> np.ndarray:
    """Code points of each unit, in order."""
    starts, letter_before = [], False
    for at in range(0, len(text), PART):
        points = np.frombuffer(text[at:at + PART].encode("utf-32-le"), np.uint32)
        low = points | 32
        letter = (low >= 97) & (low <= 122) & (points < 128)
        starts.append(at + np.flatnonzero(~(letter & np.concatenate([[letter_before], letter[:-1]]))))
        letter_before = bool(letter[-1])
    return np.diff(np.append(np.concatenate(starts), len(text))) if starts else np.zeros(0, np.int64)


def cut(text: str, h: list[int], plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (null if plain) and the text written out."""
    units = SkipList(unit_widths(text))
    if not text or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= plain_from:
        return units.n, "plain", None, None, text
    first, second = sorted((h[0] % (units.n + 1), h[1] % (units.n + 1)))
    a, b = units.place(first), units.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        return units.n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return units.n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_in_middle(docs: DataFrame, text: str = "text", id: str = "doc_id", seed: int = SEED,
                   plain_from: int = PLAIN_FROM, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars, output: one row per row.

    The cuts, the form and the order come from the SHA-256 of ``seed:id``, so a row has the same outcome
    in every run and in every partition; rows of equal id are cut at the same hashes. A projection: no
    shuffle, each text is handled whole in its batch, and the units of a text are looked for in stretches.
    A null text counts as empty, a null id as an id without digits. Empty texts and texts that hold a
    mark stay plain, with null widths. An empty table gives no rows; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest.alias("digest"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [cut(t.as_py(), [int(d.as_py()[i:i + 8], 16) for i in range(0, 32, 8)], plain_from, suffix_first)
                    for t, d in zip(batch.column(1), batch.column(2))]
            n, form, before, between, output = zip(*done) if done else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()),
                 pa.array(between, pa.int64()), pa.array(output, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = rows.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long")
    return rows.mapInArrow(write, schema.add("middle_chars", "long").add("output", "string"))


def restored(output: str | Column = "output", form: str | Column = "form") -> Column:
    """The text that an output of this form was made of. A text holds no mark, and no mark overlaps
    itself or another, so the first occurrence of each is the one that was put there."""
    o = F.col(output) if isinstance(output, str) else output
    f = F.col(form) if isinstance(form, str) else form
    between = lambda a, b: F.split_part(F.split_part(o, F.lit(a), F.lit(2)), F.lit(b), F.lit(1))
    middle = F.split_part(o, F.lit(MIDDLE), F.lit(2))
    return (F.when(f == "psm", F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE)))
            .when(f == "spm", F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))).otherwise(o))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
         WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT *, array_to_string(units[:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

"""Nearest-neighbour 1:1 matching without replacement, within a caliper.

The rule: treated rows take turns in index order; each takes the nearest control still
free, the lowest index among equally near ones, if it lies within the caliper.

Rows further apart than the caliper never meet, so the score line falls into independent
components. Components of a checked size run the rule as it stands, one task each. Larger
ones use the equivalent deferred acceptance, in which the order of the proposals is free:
every treated row proposes to its nearest control that has not turned it down, every
control keeps the lowest index that asked. The controls of such a line are dealt to segments
of a checked size. In a round each segment settles all rows that are there, by the rule, and
a row that finds a nearer control possible in another segment goes there for the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retroscope.operators import ranks
from retroscope.session import cut_lineage, discard

LOCAL_ROWS = 200_000
UNSEEN = np.iinfo(np.int64).min  # in place of the index of a control that is not known yet


class _Free:
    """Controls in order of score and index; free neighbours are found by path-compressed links."""

    def __init__(self, control: np.ndarray, c_score: np.ndarray):
        order = np.lexsort((control, c_score))
        self.scores = c_score[order]
        self.control, self.score = control[order].tolist(), self.scores.tolist()
        self.block = np.searchsorted(self.scores, self.scores, side="left").tolist()
        n = self.n = len(order)
        self.right = list(range(n + 1))       # next free position at or after i (n = none)
        self.left = list(range(-1, n))        # left[i + 1]: next free position at or before i (-1 = none)

    def places(self, t_score: np.ndarray) -> list[int]:
        """For each score the number of controls below it."""
        return np.searchsorted(self.scores, t_score, side="left").tolist()

    def _find_right(self, i: int) -> int:
        right, root = self.right, i
        while right[root] != root:
            root = right[root]
        while right[i] != root:
            right[i], i = root, right[i]
        return root

    def above(self, at: int) -> int:
        """The first free position from ``at`` on; -1 if there is none."""
        spot = self._find_right(at)
        return spot if spot < self.n else -1

    def below(self, at: int) -> int:
        """Of the free positions before ``at`` the lowest index of the highest score; -1 if there is none."""
        left, i = self.left, at - 1
        root = i
        while left[root + 1] != root:
            root = left[root + 1]
        while left[i + 1] != root:
            left[i + 1], i = root, left[i + 1]
        return self._find_right(self.block[root]) if root >= 0 else -1

    def take(self, spot: int) -> None:
        self.right[spot], self.left[spot + 1] = spot + 1, spot - 1


def _take_turns(treated: np.ndarray, t_score: np.ndarray, control: np.ndarray, c_score: np.ndarray,
                caliper: float) -> list[tuple[int, int]]:
    """The rule itself on one component."""
    free = _Free(control, c_score)
    at, scores = free.places(t_score), t_score.tolist()
    pairs = []
    for k in np.argsort(treated, kind="stable").tolist():
        spots = [spot for spot in (free.above(at[k]), free.below(at[k])) if spot >= 0]
        if spots:
            dist, c, spot = min((abs(scores[k] - free.score[x]), free.control[x], x) for x in spots)
            if dist <= caliper:
                pairs.append((int(treated[k]), c))
                free.take(spot)
    return pairs


def match_nearest(units: DataFrame, index: str, treated: str, score: str, caliper: float,
                  local_rows: int = LOCAL_ROWS) -> DataFrame:
    """Pairs (treated_index, control_index). ``index`` orders the rows of each side."""
    rows = units.select(
        F.col(index).cast("bigint").alias("i"), F.col(treated).cast("int").alias("side"),
        F.col(score).cast("double").alias("s"),
        F.floor(F.col(score) / F.lit(caliper)).alias("cell"),
    )
    # occupied cells; two cells with an empty one between them are over a caliper apart
    cells = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    line = Window.orderBy("cell")
    starts = F.coalesce((F.col("cell") - F.lag("cell").over(line) > 1).cast("int"), F.lit(1))
    runs = cells.withColumn("_new", starts).withColumn("component", F.sum("_new").over(line))
    sizes = runs.groupBy("component").agg(F.sum("n").alias("size"))
    placed = rows.join(runs.select("cell", "component").join(sizes, "component"), "cell")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t, c = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        found = _take_turns(t["i"].to_numpy(), t["s"].to_numpy(), c["i"].to_numpy(),
                            c["s"].to_numpy(), caliper)
        return pd.DataFrame(found, columns=["treated_index", "control_index"], dtype="int64")

    small = placed.where(F.col("size") <= local_rows).groupBy("component").applyInPandas(
        solve, "treated_index long, control_index long"
    )
    largest = sizes.agg(F.max("size")).first()[0]
    if largest is None or largest <= local_rows:
        return small
    large = placed.where(F.col("size") > local_rows).select("i", "side", "s")
    return small.unionByName(_in_segments(large, caliper, max(1, local_rows)))


@dataclass
class _Segments:
    """Lowest and highest score of each segment, ascending; equal scores lie in one segment or in
    segments of their own, cut by index. ``next_left``: the segment that follows to the left (-1: none)."""
    low: np.ndarray
    high: np.ndarray

    def __post_init__(self) -> None:
        # segments of one score are walked by index up, whichever way one comes
        m = len(self.low)
        alike = np.concatenate([[False], (self.low[1:] == self.low[:-1]) & (self.high[1:] == self.high[:-1]), [False]])
        self.first = np.arange(m)
        for k in range(1, m):
            if alike[k]:
                self.first[k] = self.first[k - 1]
        before = np.where(self.first > 0, self.first[np.maximum(self.first - 1, 0)], -1)
        self.next_left = np.where(alike[1:], np.arange(m) + 1, before)

    def gap_right(self, k: int, score: float) -> float:
        """The least distance to a control from segment ``k`` on; infinite past the last."""
        return max(float(self.low[k]) - score, 0.0) if k < len(self.low) else float("inf")

    def gap_left(self, k: int, score: float) -> float:
        return max(score - float(self.high[k]), 0.0) if k >= 0 else float("inf")


_STATE = "t bigint, s double, seg int, held bigint, r_at int, r_d double, r_c bigint, l_at int, l_d double, l_c bigint"
_FIELDS = [("t", pa.int64()), ("s", pa.float64()), ("seg", pa.int32()), ("held", pa.int64()), ("r_at", pa.int32()),
           ("r_d", pa.float64()), ("r_c", pa.int64()), ("l_at", pa.int32()), ("l_d", pa.float64()), ("l_c", pa.int64())]


def _state(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, _FIELDS)], schema=pa.schema(_FIELDS))


def _enter(t: np.ndarray, s: np.ndarray, segments: _Segments, caliper: float) -> list[tuple]:
    """Treated rows where their nearest control may be; rows with none in reach are left out."""
    right = np.searchsorted(segments.high, s, side="left").tolist()
    lower = (np.searchsorted(segments.low, s, side="left") - 1).tolist()
    rows = []
    for i, score, r_at, k in zip(t.tolist(), s.tolist(), right, lower):
        l_at = int(segments.first[k]) if k >= 0 else -1
        r_d, l_d = segments.gap_right(r_at, score), segments.gap_left(l_at, score)
        if min(r_d, l_d) <= caliper:
            rows.append((i, score, r_at if r_d <= l_d else l_at, None, r_at, r_d, UNSEEN, l_at, l_d, UNSEEN))
    return rows


def _settle(k: int, control: np.ndarray, c_score: np.ndarray, rows: list[tuple], segments: _Segments, caliper: float) -> list[tuple]:
    """The rule among all treated rows that are in segment ``k``. A row takes the control that is nearest
    here, unless one elsewhere may be as near: then it moves there and asks nobody here. For the side it
    leaves it remembers the nearest control that was not refused, which can only get further."""
    free = _Free(control, c_score)
    at = free.places(np.array([r[1] for r in rows]))
    out = []
    for p in sorted(range(len(rows)), key=lambda j: rows[j][0]):
        t, s, _, _, r_at, r_d, r_c, l_at, l_d, l_c = rows[p]
        spot_r = spot_l = -1
        if r_at == k:
            spot_r = free.above(at[p])
            if spot_r >= 0:
                r_d, r_c = abs(s - free.score[spot_r]), free.control[spot_r]
            else:
                r_at, r_c = k + 1, UNSEEN
                r_d = segments.gap_right(r_at, s)
        if l_at == k:
            spot_l = free.below(at[p])
            if spot_l >= 0:
                l_d, l_c = abs(s - free.score[spot_l]), free.control[spot_l]
            else:
                l_at, l_c = int(segments.next_left[k]), UNSEEN
                l_d = segments.gap_left(l_at, s)
        if min(r_d, l_d) > caliper:
            continue
        to_right = (r_d, r_c) < (l_d, l_c)
        spot, held = (spot_r if to_right else spot_l), None
        if spot >= 0:
            held = free.control[spot]
            free.take(spot)
        out.append((t, s, k if spot >= 0 else r_at if to_right else l_at, held, r_at, r_d, r_c, l_at, l_d, l_c))
    return out


def _deal(rows: DataFrame, local_rows: int) -> tuple[DataFrame, _Segments]:
    """Controls (c, s, seg) in segments of about ``local_rows`` rows, cut by score and, where one score has
    more controls than that, by index. The driver gets two numbers per segment."""
    cuts = ranks.bucket_bounds(rows, "s", single=local_rows)
    controls = rows.where("side = 0").select(F.col("i").alias("c"), "s")
    crowded = controls.where(F.col("s").isin(cuts)).groupBy("s").count().where(F.col("count") > local_rows).select("s")
    often = sorted(r.s for r in crowded.collect())
    bounds = sorted({*cuts, *(float(np.nextafter(v, np.inf)) for v in often)})
    part = F.lit(0)
    for v in often:
        inner = ranks.bucket_bounds(controls.where(F.col("s") == v), "c", single=local_rows)
        place = sum(((F.col("c") >= F.lit(b)).cast("int") for b in inner), F.lit(0))
        part = F.when(F.col("s") == v, place).otherwise(part)
    placed = ranks.in_buckets(controls, "s", bounds).withColumn("part", part)
    found = placed.groupBy("_bucket", "part").agg(F.min("s").alias("low"), F.max("s").alias("high")).orderBy("_bucket", "part").collect()
    names = F.array(*[F.struct(F.lit(r["_bucket"]).alias("b"), F.lit(r["part"]).alias("p")) for r in found])
    seg = (F.array_position(names, F.struct(F.col("_bucket").alias("b"), F.col("part").alias("p"))) - 1).cast("int")
    return (placed.select("c", "s", seg.alias("seg")),
            _Segments(np.array([r["low"] for r in found], float), np.array([r["high"] for r in found], float)))


def _in_segments(rows: DataFrame, caliper: float, local_rows: int) -> DataFrame:
    """Deferred acceptance between the segments of the line, until no treated row has to move."""
    spark = rows.sparkSession
    if rows.where("side = 0").isEmpty():
        return spark.createDataFrame([], "treated_index long, control_index long")
    controls, segments = _deal(rows, local_rows)
    controls = cut_lineage(controls)

    def enter(batches):
        for batch in batches:
            yield _state(_enter(batch.column(0).to_numpy(), batch.column(1).to_numpy(), segments, caliper))

    def settle(key, here: pa.Table, there: pa.Table) -> pa.Table:
        found = _settle(key[0].as_py(), here["c"].to_numpy(), here["s"].to_numpy(),
                        list(zip(*[there[name].to_pylist() for name, _ in _FIELDS])), segments, caliper)
        return pa.Table.from_batches([_state(found)])

    state = cut_lineage(rows.where("side = 1").select("i", "s").mapInArrow(enter, _STATE))
    while True:
        waiting = state.where("held IS NULL")
        sizes = {r.seg: r.n for r in waiting.groupBy("seg").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            break
        # where more wait than a task takes, the lowest indexes go in and the others stay for the next round
        goes = F.col("seg").isin(list(sizes))
        for k, n in sizes.items():
            if n > 2 * local_rows:
                last = waiting.where(F.col("seg") == k).agg(F.percentile_approx("t", local_rows / n, 1000)).first()[0]
                goes = goes & ~((F.col("seg") == k) & F.col("held").isNull() & (F.col("t") > last))
        moved = controls.where(F.col("seg").isin(list(sizes))).groupBy("seg").cogroup(state.where(goes).groupBy("seg")).applyInArrow(settle, _STATE)
        last_state, state = state, cut_lineage(moved.unionByName(state.where(~goes)))
        discard(last_state)
    return state.select(F.col("t").alias("treated_index"), F.col("held").alias("control_index"))


def matched_frame(units: DataFrame, pairs: DataFrame, index: str, treated: str, cols: list[str]) -> DataFrame:
    """One row per pair with the listed columns of both sides (suffix _t and _c)."""
    def side(v: int, key: str, tag: str) -> DataFrame:
        return units.where(F.col(treated) == v).select(
            F.col(index).cast("bigint").alias(key), *[F.col(c).alias(f"{c}_{tag}") for c in cols]
        )
    return pairs.join(side(1, "treated_index", "t"), "treated_index").join(
        side(0, "control_index", "c"), "control_index"
    )


def effect_of_matching(matched: DataFrame, units: DataFrame, treated: str, outcome: str) -> DataFrame:
    """Outcome gap (control - treated) before and after matching, with the pair count."""
    raw = units.agg(
        F.avg(F.when(F.col(treated) == 0, F.col(outcome))).alias("control_rate"),
        F.avg(F.when(F.col(treated) == 1, F.col(outcome))).alias("treated_rate"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.lit("unmatched").alias("sample"), "control_rate", "treated_rate", "n")
    paired = matched.agg(
        F.avg(f"{outcome}_c").alias("control_rate"), F.avg(f"{outcome}_t").alias("treated_rate"),
        F.count(F.lit(1)).alias("n"),
    ).select(F.lit("matched").alias("sample"), "control_rate", "treated_rate", "n")
    return raw.unionByName(paired).withColumn("gap", F.col("control_rate") - F.col("treated_rate"))

"""Binning expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex


def era(year: Column, eras: Sequence[tuple[int, str]] = lex.ERAS) -> Column:
    """Right-closed year ranges; years outside every range are null."""
    chain = F.when(year <= 0, F.lit(None).cast("string"))
    for last, label in eras:
        chain = chain.when(year <= last, F.lit(label))
    return chain


def right_closed(value: Column, edges: Column) -> Column:
    """Index of the right-closed bin, the lowest edge included; ``edges`` is ascending."""
    above = F.size(F.filter(F.slice(edges, 2, F.size(edges) - 1), lambda e: e < value))
    return F.when(value.isNotNull(), above)


def equal_width(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Index of the equal-width bin, the last bin closed."""
    width = (high - low) / F.lit(float(bins))
    index = F.floor((value - low) / width).cast("int")
    return F.when(width == 0, F.lit(bins // 2)).otherwise(F.least(index, F.lit(bins - 1)))


def steps_passed(value: Column, thresholds: Sequence[float], strict: bool = False) -> Column:
    """How many of the ascending thresholds ``value`` reaches (or exceeds, if strict)."""
    total = F.lit(0)
    for t in thresholds:
        reached = value > F.lit(t) if strict else value >= F.lit(t)
        total = total + reached.cast("int")
    return total

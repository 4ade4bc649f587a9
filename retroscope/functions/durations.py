"""Durations in days read from free text.

Each pattern is run once over the text; what it matched is kept as a short snippet and
number and unit are read from the snippet. Texts are lower-cased.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex
from retroscope.functions.text import bind_sql, holds_sql, quoted


def unit_days_sql(unit: str) -> str:
    entries = ", ".join(f"'{u}', {d}L" for u, d in lex.UNIT_DAYS.items())
    return f"try_element_at(map({entries}), lower({unit}))"


def _days_of(snippet: str) -> str:
    return unit_days_sql(f"regexp_extract({snippet}, '(day|week|month|year)', 1)")


def _number(snippet: str) -> str:
    """The first digits as a number. Runs too long for one, or long enough to overflow a
    product, become null: they are out of range in any unit."""
    digits = f"try_cast(nullif(regexp_extract({snippet}, '(\\\\d+)', 1), '') AS bigint)"
    return bind_sql(digits, "_n", "CASE WHEN _n < 1000000000 THEN _n END")


def _snippets(text: str, patterns: list[tuple[str, list[str]]]) -> str:
    """What each pattern matched first, '' where it did not.

    Each comes with words of which any match must hold one; a byte search for those spares
    most texts the regex engine.
    """
    each = ", ".join(
        f"CASE WHEN {holds_sql('_x', words)} THEN regexp_extract(_x, {quoted('(?U)' + p)}, 0) ELSE '' END"
        for p, words in patterns
    )
    return bind_sql(text, "_x", f"array({each})")


def _years_since(snippet: str, year: str) -> str:
    """Whole years from the year at the snippet's end to ``year``, in days; null if not before it."""
    named = f"try_cast(right({snippet}, 4) AS bigint)"
    return bind_sql(named, "_y", f"CASE WHEN _y < {year} THEN ({year} - _y) * 365 END")


def with_duration(
    df: DataFrame,
    text: str = "full_text",
    year: str = "post_year",
    out: str = "time_to_regret_days",
    patterns=lex.DURATION_PATTERNS,
    cap: int | None = lex.MAX_DURATION_DAYS,
) -> DataFrame:
    """The first pattern that matches decides, also when its value is then out of range."""
    seen = _snippets(text, [*patterns, lex.YEAR_PATTERN])
    found = f"filter(transform({seen}, (_s, _i) -> struct(_s AS s, _i AS i)), _f -> _f.s != '')"
    value = bind_sql(
        f"get({found}, 0)", "_h",
        f"CASE WHEN _h.i < {len(patterns)} THEN {_number('_h.s')} * {_days_of('_h.s')} "
        f"ELSE {_years_since('_h.s', year)} END",
    )
    if cap is not None:
        value = bind_sql(value, "_d", f"CASE WHEN _d <= {cap} THEN _d END")
    return df.withColumn(out, F.expr(value))


def with_refined_duration(
    df: DataFrame,
    text: str = "full_text",
    year: str = "post_year",
    out: str = "time_to_regret_days",
) -> DataFrame:
    """Fill what is still null: the first pattern with a value in range decides, then a
    month with a year, which is not capped."""
    n = len(lex.REFINED_PATTERNS)
    units = ", ".join("CAST(NULL AS bigint)" if u is None else f"{u}L" for _, u, _ in lex.REFINED_PATTERNS)
    divisors = ", ".join(str(d) for _, _, d in lex.REFINED_PATTERNS)
    listed = [*[p for p, _, _ in lex.REFINED_PATTERNS], lex.MONTH_YEAR_PATTERN]
    counted = (
        f"transform(slice(_seen, 1, {n}), (_s, _i) -> "
        f"coalesce(get(array({units}), _i), {_number('_s')}) * {_days_of('_s')} DIV get(array({divisors}), _i))"
    )
    in_range = f"get(filter({counted}, _v -> _v BETWEEN 1 AND {lex.MAX_DURATION_DAYS}), 0)"
    since = _years_since("element_at(_seen, -1)", f"coalesce({year}, {lex.DEFAULT_YEAR})")
    picked = bind_sql(_snippets(f"lower({text})", listed), "_seen", f"coalesce({in_range}, {since})")
    return df.withColumn(out, F.expr(
        f"CASE WHEN {out} IS NULL AND length({text}) >= {lex.REFINED_MIN_CHARS} THEN {picked} ELSE {out} END"
    ))

"""Pieces of plain SQL that say the same as the operators, for checking them in another engine."""

from __future__ import annotations

from retroscope.functions import lexicons as lex
from retroscope.operators import resample
from retroscope.plans.posts import BODIES, TITLES

SPACES = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def any_phrase(text: str, phrases) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(p)})" for p in phrases) + ")"


def count_phrases(text: str, phrases) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(p)}) AS INT)" for p in phrases) + ")"


def any_pattern(text: str, patterns) -> str:
    return f"regexp_matches({text}, {q('|'.join(f'(?:{p})' for p in patterns))})"


def strip(text: str) -> str:
    return f"regexp_replace({text}, '^{SPACES}+|{SPACES}+$', '', 'g')"


def tokens(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
            "lambda x: regexp_full_match(x, '[a-z]{2,}'))")


def without_stopwords(words: str) -> str:
    return f"list_filter({words}, lambda x: NOT list_contains({listed(lex.STOPWORDS)}, x))"


def unit_days(unit: str) -> str:
    return "CASE lower(" + unit + ") " + " ".join(f"WHEN '{u}' THEN {d}" for u, d in lex.UNIT_DAYS.items()) + " END"


def number(text: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(nullif(regexp_extract({text}, {q(pattern)}, {group}), '') AS BIGINT)"


def first_match(options, default) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in options) + f" ELSE {default} END"


def years_since(text: str, pattern: str, group: int, year: str) -> str:
    n = number(text, pattern, group)
    return f"CASE WHEN {n} < {year} THEN ({year} - {n}) * 365 END"


def duration(text: str, year: str, patterns=lex.DURATION_PATTERNS, cap=lex.MAX_DURATION_DAYS) -> str:
    options = []
    for p, _ in patterns:
        n, u = (2, 3) if p.startswith("(it") else (1, 2)
        days = f"(CASE WHEN {number(text, p, n)} < 1000000000 THEN {number(text, p, n)} END) * ({unit_days(f'regexp_extract({text}, {q(p)}, {u})')})"
        options.append((f"regexp_matches({text}, {q(p)})", days))
    raw = first_match(options, years_since(text, lex.YEAR_PATTERN[0], 2, year))
    return raw if cap is None else f"(SELECT CASE WHEN d <= {cap} THEN d END FROM (SELECT {raw} AS d))"


def refined(text: str, year: str) -> str:
    options = []
    for (p, _), fixed, divisor in lex.REFINED_PATTERNS:
        amount, u = (str(fixed), 1) if fixed else (number(text, p, 1), 2)
        if not fixed:
            amount = f"(CASE WHEN {amount} < 1000000000 THEN {amount} END)"
        days = f"({amount} * ({unit_days(f'regexp_extract({text}, {q(p)}, {u})')}))"
        if divisor != 1:
            days = f"({days} // {divisor})"
        options.append(f"(CASE WHEN regexp_matches({text}, {q(p)}) AND {days} BETWEEN 1 AND 3650 THEN {days} END)")
    options.append("(" + years_since(text, lex.MONTH_YEAR_PATTERN[0], 1, year) + ")")
    return f"CASE WHEN length({text}) >= 10 THEN coalesce({', '.join(options)}) END"


def event_type(text: str, domain: str) -> str:
    return "CASE lower(" + domain + ") " + " ".join(
        f"WHEN '{d}' THEN " + first_match([(any_phrase(text, ps), q(label)) for label, ps in labels], "'unknown'")
        for d, labels in lex.EVENT_TAXONOMY.items()) + " ELSE 'unknown' END"


def word_count(text: str) -> str:
    return f"CASE WHEN {strip(text)} = '' THEN 1 ELSE len(regexp_split_to_array({strip(text)}, '{SPACES}+')) END"


POSTS = f"""posts AS (
  SELECT 'd' || doc_id AS id, doc_id, {listed(lex.DOMAINS)}[1 + doc_id % 3] AS domain, source AS subreddit,
         {listed(TITLES)}[1 + doc_id % 7] AS title,
         {listed(BODIES)}[1 + (doc_id * (1 + doc_id % 3)) % 16] || ' ' || text AS selftext,
         year(DATE '2012-01-01' + CAST(doc_id * 37 % 5000 AS INT)) AS post_year,
         n_chars % 97 AS num_comments, doc_id * 31 % 211 AS score
  FROM documents)"""

FLAGGED = f"""flagged AS (
  SELECT *, {any_pattern('full_text', lex.KEEP_PATTERNS)} AS keep, {any_pattern('full_text', lex.EXCLUDE_PATTERNS)} AS exclude
  FROM (SELECT *, lower(coalesce(title, '') || chr(10) || coalesce(selftext, '')) AS full_text FROM posts))"""

SENTENCE = (
    "coalesce(substr(list_filter(list_transform(list_filter(regexp_split_to_array(full_text, '[.\\n!?]'), "
    f"lambda p: {any_phrase('p', lex.SENTENCE_CUES)}), lambda p: {strip('p')}), lambda p: length(p) >= 30)[1], 1, 500), '')"
)

STRUCTURED = f"""structured AS (
  SELECT *, CAST({any_phrase('full_text', lex.REVERSAL_ACTIONS)} AND length(regret_sentence) > 0 AND NOT negated_regret AS INT) AS reversal,
         {count_phrases('full_text', lex.URGENCY_WORDS)} AS urgency_score,
         {duration('full_text', 'post_year')} AS time_to_regret_days,
         CASE WHEN regret_sentence <> '' THEN regret_sentence ELSE coalesce(title, '') END AS spoken
  FROM (SELECT *, {SENTENCE} AS regret_sentence, {any_phrase('full_text', lex.NEGATED_PHRASES)} AS negated_regret
        FROM flagged WHERE keep AND NOT exclude))"""


def _rate(text: str, phrases) -> str:
    return f"{count_phrases(text, phrases)} / CAST(words AS DOUBLE) * 1000"


ENRICHED = f"""enriched AS (
  SELECT *, ({count_phrases('full_text', lex.AGENCY_ACTIVE)} - {count_phrases('full_text', lex.AGENCY_PASSIVE)}) / CAST(words AS DOUBLE) * 1000 AS agency_score,
         {_rate('full_text', lex.HEDGING)} AS hedging_score, {_rate('full_text', lex.SOCIAL_EMBED)} AS social_embed_score,
         {_rate('full_text', lex.CAUSAL)} AS causal_reasoning_score, {_rate('full_text', lex.FUTURE)} AS future_orient_score
  FROM (SELECT * EXCLUDE (time_to_regret_days), coalesce(time_to_regret_days, {refined('full_text', 'post_year')}) AS time_to_regret_days,
               {event_type("(full_text || ' ' || regret_sentence)", 'domain')} AS event_type, {word_count('full_text')} AS words
        FROM structured))"""


def _values(table, kinds="sf") -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in table) + ")"


def _boost(t: str) -> str:
    return "CASE " + t + " " + " ".join(f"WHEN {q(w)} THEN {b}" for w, b in lex.BOOSTERS.items()) + " ELSE 0 END"


def sentiment(source: str, key: str, text: str, name: str = "sentiment") -> str:
    """CTEs that end in ``name`` (key, compound, neg, pos, neu)."""
    neg = "[" + ", ".join(q(w) for w in lex.NEGATORS) + "]"
    return f"""
  {name}_t AS (SELECT {key} AS k, coalesce({text}, '') AS txt, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_'']+') AS tk FROM {source}),
  {name}_x AS (SELECT k, tk, list_position(tk, 'but') AS but, unnest(range(1, len(tk) + 1)) AS i FROM {name}_t),
  {name}_c AS (SELECT k, i, but, tk[i] AS w, CASE WHEN i > 1 THEN tk[i-1] END AS p1, CASE WHEN i > 2 THEN tk[i-2] END AS p2, CASE WHEN i > 3 THEN tk[i-3] END AS p3 FROM {name}_x),
  {name}_v AS (SELECT k, i, but, val + sign(val) * ({_boost('p1')} * 1.0::DOUBLE + {_boost('p2')} * 0.95::DOUBLE + {_boost('p3')} * 0.9::DOUBLE) AS moved,
        coalesce(list_contains({neg}, p1), false) OR coalesce(list_contains({neg}, p2), false) OR coalesce(list_contains({neg}, p3), false) AS negated
      FROM {name}_c JOIN (SELECT col0 AS w, col1::DOUBLE AS val FROM {_values(lex.DEMO_VALENCE.items())}) USING (w)),
  {name}_a AS (SELECT k, (CASE WHEN negated THEN moved * -0.74::DOUBLE ELSE moved END) * (CASE WHEN but > 0 AND i < but THEN 0.5::DOUBLE WHEN but > 0 AND i > but THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END) AS v FROM {name}_v),
  {name}_s AS (SELECT k, sum(CASE WHEN v > 0 THEN v ELSE 0 END) AS ps, count(*) FILTER (v > 0) AS pn, sum(CASE WHEN v < 0 THEN v ELSE 0 END) AS ns, count(*) FILTER (v < 0) AS nn FROM {name}_a GROUP BY k),
  {name}_f AS (SELECT k, coalesce(ps, 0) AS ps, coalesce(pn, 0) AS pn, coalesce(ns, 0) AS ns, coalesce(nn, 0) AS nn, len(tk) AS n,
        least(length(txt) - length(replace(txt, '!', '')), 4) * 0.292::DOUBLE AS emph FROM {name}_t LEFT JOIN {name}_s USING (k)),
  {name}_g AS (SELECT *, (ps + ns) + sign(ps + ns) * emph AS total, ps + pn AS up, abs(ns) + nn AS down, n - pn - nn AS flat FROM {name}_f),
  {name} AS (SELECT k AS {key}, total / sqrt(total * total + 15) AS compound,
        CASE WHEN up + down + flat > 0 THEN down / (up + down + flat) ELSE 0 END AS neg,
        CASE WHEN up + down + flat > 0 THEN up / (up + down + flat) ELSE 0 END AS pos,
        CASE WHEN up + down + flat > 0 THEN flat / (up + down + flat) ELSE 0 END AS neu FROM {name}_g)"""


def emotion(source: str, key: str, text: str, name: str = "emotions") -> str:
    hits = []
    for e in lex.EMOTIONS:
        words = [w for w, x in lex.DEMO_EMOTION.items() if x == e]
        hits.append(f"len(list_filter(tk, lambda t: list_contains({listed(words)}, t)))" if words else "0")
    return f"""
  {name}_c AS (SELECT {key}, [{', '.join(hits)}] AS c FROM (SELECT {key}, regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}_'']+') AS tk FROM {source})),
  {name} AS (SELECT {key}, CASE WHEN list_max(c) > 0 THEN {listed(lex.EMOTIONS)}[list_position(c, list_max(c))] ELSE 'neutral' END AS emotion,
       CASE WHEN list_max(c) > 0 THEN round(list_max(c) / CAST(list_sum(c) AS DOUBLE), 4) ELSE 1.0 END AS emotion_score FROM {name}_c)"""


def chi2_p(x: str, dof: str) -> str:
    """Upper tail from the power series of the lower incomplete gamma function."""
    return (f"(CASE WHEN {x} IS NULL OR {dof} < 1 THEN NULL WHEN {x} <= 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 3000), "
            f"lambda i_: exp(({dof} / 2.0 + i_) * ln({x} / 2.0) - {x} / 2.0 - lgamma({dof} / 2.0 + i_ + 1)))) END)")


def normal_p(z: str) -> str:
    return chi2_p(f"(({z}) * ({z}))", "1")


def chi_square(cells: str, row: str, col: str, by: str | None = None) -> str:
    """SELECT over a CTE of (by, row, col, n) cells, every cell filled in."""
    b = f"{by}, " if by else ""
    on_by = f" AND g.{by} = c.{by}" if by else ""
    part = f"PARTITION BY {by}" if by else ""
    part_row = f"PARTITION BY {b}{row}"
    part_col = f"PARTITION BY {b}{col}"
    rows = f"(SELECT DISTINCT {b}{row} FROM {cells})"
    cols = f"(SELECT DISTINCT {b}{col} FROM {cells})"
    grid = f"{rows} r JOIN {cols} k ON " + (f"r.{by} = k.{by}" if by else "true")
    pick = (f"r.{by}, " if by else "") + f"r.{row}, k.{col}"
    return f"""SELECT {b}n, dof, CASE WHEN dof > 0 THEN chi2 END AS chi2,
       CASE WHEN dof > 0 THEN sqrt(chi2 / (n * (least(nr, nc) - 1))) END AS cramers_v,
       {chi2_p('(CASE WHEN dof > 0 THEN chi2 END)', 'dof')} AS p_value FROM (
  SELECT {b}max(total) AS n, count(DISTINCT {row}) AS nr, count(DISTINCT {col}) AS nc,
         (count(DISTINCT {row}) - 1) * (count(DISTINCT {col}) - 1) AS dof,
         CASE WHEN (count(DISTINCT {row}) - 1) * (count(DISTINCT {col}) - 1) = 1
              THEN sum((abs(o - e) - least(0.5, abs(o - e))) ** 2 / e) ELSE sum((o - e) ** 2 / e) END AS chi2
  FROM (SELECT {b}{row}, {col}, o, total, rt * ct / CAST(total AS DOUBLE) AS e FROM (
          SELECT {b}{row}, {col}, o, sum(o) OVER ({part}) AS total, sum(o) OVER ({part_row}) AS rt, sum(o) OVER ({part_col}) AS ct
          FROM (SELECT {pick}, coalesce(c.n, 0) AS o FROM {grid} LEFT JOIN {cells} c ON c.{row} = r.{row} AND c.{col} = k.{col}{f" AND c.{by} = r.{by}" if by else ""})))
  {f"GROUP BY {by}" if by else ""})"""


def midranks(source: str, value: str) -> str:
    """Every row of ``source`` with the average rank of its value."""
    return (f"SELECT *, rank() OVER (ORDER BY {value}) + (count(*) OVER (PARTITION BY {value}) - 1) / 2.0::DOUBLE AS rk, "
            f"count(*) OVER (PARTITION BY {value}) AS t FROM {source} WHERE {value} IS NOT NULL")


def mann_whitney(source: str, value: str, label: str, first, second) -> str:
    return f"""SELECT u, z, 1 - 2 * u / (n1 * n2) AS effect, n1 AS n_first, n2 AS n_second, {normal_p('z')} AS p_value FROM (
  SELECT *, greatest(abs(u - n1 * n2 / 2) - 0.5, 0) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))) AS z FROM (
    SELECT sum(rk) FILTER ({label} = {first}) - n1 * (n1 + 1) / 2 AS u, any_value(n1) AS n1, any_value(n2) AS n2, any_value(ties) AS ties FROM (
      SELECT *, CAST(count(*) FILTER ({label} = {first}) OVER () AS DOUBLE) AS n1, CAST(count(*) FILTER ({label} = {second}) OVER () AS DOUBLE) AS n2,
             sum(CAST(t AS DOUBLE) * t - 1) OVER () AS ties
      FROM ({midranks(f"(SELECT * FROM {source} WHERE {label} IN ({first}, {second}))", value)})) GROUP BY n1))"""


def t_p(t: str, dof: str) -> str:
    """Both tails beyond t > 0 for whole degrees of freedom: the finite series in sine and cosine."""
    def series(top: str, ratio: str) -> str:
        return (f"(SELECT 1 + coalesce(sum(x), 0) FROM (SELECT exp(sum(ln({ratio} * {dof} / ({dof} + {t} * {t}))) OVER (ORDER BY k)) AS x FROM "
                f"(SELECT unnest(range(1, CAST({top} AS BIGINT) + 1)) AS k)))")

    sine, cosine = f"({t} / sqrt({dof} + {t} * {t}))", f"sqrt({dof} / ({dof} + {t} * {t}))"
    even = f"{sine} * {series(f'{dof} // 2 - 1', '(2.0 * k - 1) / (2.0 * k)')}"
    odd = f"2 / pi() * (atan({t} / sqrt({dof})) + CASE WHEN {dof} > 1 THEN {sine} * {cosine} * {series(f'({dof} - 3) // 2', '2.0 * k / (2.0 * k + 1)')} ELSE 0 END)"
    return f"(1 - CASE WHEN {dof} % 2 = 0 THEN {even} ELSE {odd} END)"


def replicates(source: str, columns: str, key: str, reps: int, name: str = "drawn", seed: int = 42) -> str:
    """CTEs that end in ``name``: the columns of a source per replicate, with the row's weight as ``w``."""
    p = resample.PRIME
    steps = " + ".join(f"CAST(h2 >= ceil({s * p!r}::DOUBLE) AS INT)" for s in resample.POISSON_STEPS)
    return f"""{name}_0 AS (SELECT {columns}, rep, (({key} % {p}) * 48271 + rep * 69621 + {seed * 16807 + 12345}) % {p} AS h0 FROM {source}, (SELECT unnest(range(1, {reps + 1})) AS rep)),
  {name}_1 AS (SELECT * REPLACE ((h0 * h0 + h0) % {p} AS h0) FROM {name}_0), {name}_2 AS (SELECT *, (h0 * h0 + rep + 7) % {p} AS h2 FROM {name}_1),
  {name} AS (SELECT * EXCLUDE (h0, h2), {steps} AS w FROM {name}_2)"""

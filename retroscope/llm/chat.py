"""Chat formatting: a state machine over roles, a declarative template, loss flags per segment."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    """What stands around a turn, by role, and whether its text is learned.

    Every mark begins with ``<`` or ``[``. Inside texts these two and the escape sign are followed by
    an escape sign, so no mark can occur there and the escape can be undone.
    """

    marks: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>", False),
        "user": ("[INST]", "[/INST]", False),
        "assistant": ("<s>", "</s>", True),
    })
    other: tuple[str, str, str] = ("[TURN]", "[/TURN]", "[/END]")


@dataclass(frozen=True)
class TurnOrder:
    """A finite-state machine: the state is named after the last role; any other step leads to ``bad``."""

    steps: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",), "bad": (),
    })
    final: tuple[str, ...] = ("assistant",)


def escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])", r"$1\\")


def unescaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([<\[\\])\\", "$1")


def turn_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Each turn with ``segments``: array of (text, loss) for mark, escaped text and mark. A projection;
    null role and null text count as empty, and roles the template lacks are spelt out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    start, middle, stop = template.other
    before = F.concat(F.lit(start), escaped(role), F.lit(middle))
    after, learned = F.lit(stop), F.lit(False)
    for name, (a, b, loss) in template.marks.items():
        before = F.when(role == name, F.lit(a)).otherwise(before)
        after = F.when(role == name, F.lit(b)).otherwise(after)
        learned = F.when(role == name, F.lit(loss)).otherwise(learned)
    part = lambda t, flag: F.struct(t.alias("text"), flag.alias("loss"))
    return turns.withColumn("segments", F.array(part(before, F.lit(False)), part(escaped(text), learned), part(after, F.lit(False))))


def format_conversations(turns: DataFrame, template: Template = Template(), order: TurnOrder = TurnOrder(),
                         stretch: int = 256) -> DataFrame:
    """One row per conversation: conv_id, n_turns, valid, segments (array of text and loss flag), formatted.

    Turns go by number, ties by role and text; a null number comes first; a repeated row is a turn of
    its own; a null conv_id is one conversation. ``valid`` tells whether the roles are a path of the
    state machine that ends well; the others are formatted all the same. Stretches of ``stretch``
    turns are put together first, and each carries where it leads from every state, so a very long
    conversation meets as few rows. An empty table gives no rows; other columns are ignored.
    """
    states = list(order.steps)
    roles = [r for r in states if r not in ("start", "bad")]
    bad = states.index("bad")
    # row by row: the state after each (state, role); the last role stands for any other
    table = F.array(*[F.lit(states.index(r) if r in order.steps[s] else bad) for s in states for r in [*roles, None]])
    code = F.lit(len(roles))
    for i, r in enumerate(roles):
        code = F.when(F.col("role") == r, F.lit(i)).otherwise(code)
    rows = turn_segments(turns.select("conv_id", "turn", "role", "text"), template).select(
        "conv_id", F.floor(F.col("turn") / stretch).alias("part"),
        F.struct("turn", "role", "text", "segments", code.alias("code")).alias("t"))
    step = lambda s, t: F.element_at(table, s * (len(roles) + 1) + t["code"] + 1)
    parts = (
        rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("ts"))
        .select("conv_id", F.struct(
            "part", F.size("ts").alias("n"), F.flatten(F.transform("ts", lambda t: t["segments"])).alias("segments"),
            F.transform(F.array(*[F.lit(i) for i in range(len(states))]),
                        lambda s: F.aggregate("ts", s, step)).alias("leads")).alias("p")))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    end = F.aggregate("ps", F.lit(states.index("start")), lambda s, p: F.element_at(p["leads"], s + 1))
    segments = F.flatten(F.transform("ps", lambda p: p["segments"]))
    return whole.select(
        "conv_id", F.aggregate("ps", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("n_turns"),
        end.isin([states.index(f) for f in order.final]).alias("valid"), segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_formatted(formatted: str | Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted conversation was made of."""
    c = F.col(formatted) if isinstance(formatted, str) else formatted
    start, middle, stop = template.other
    quote = lambda m: m.replace("[", r"\[")
    pairs = [*((a, b) for a, b, _ in template.marks.values()), (start, stop)]
    found = F.regexp_extract_all(c, F.lit("(?s)" + "|".join(f"{quote(a)}.*?{quote(b)}" for a, b in pairs)), F.lit(0))

    def turn(t: Column) -> Column:
        inner = lambda a, b: t.substr(F.lit(len(a) + 1), F.length(t) - len(a) - len(b))
        rest = F.split(inner(start, stop), quote(middle), 2)
        role, text = unescaped(rest[0]), rest[1]
        for name, (a, b, _) in template.marks.items():
            role = F.when(t.startswith(a), F.lit(name)).otherwise(role)
            text = F.when(t.startswith(a), inner(a, b)).otherwise(text)
        return F.struct(role.alias("role"), unescaped(text).alias("text"))

    return F.transform(found, turn)


def learned_text(segments: str = "segments") -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


OP4_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (
  SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '<', ''), '[', ''), '\', ''))
    + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
      ELSE 19 + length(role) + length(role) - length(replace(replace(replace(role, '<', ''), '[', ''), '\', '')) END AS chars
  FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn, role, text), 's?(ua)+') AS valid
FROM m GROUP BY conv_id
"""

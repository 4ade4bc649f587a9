"""Text predicates and extractors as Spark SQL expressions.

``text`` arguments are column names or SQL expressions. No Python runs per row: phrase lists
are array literals searched with ``contains``, pattern lists one alternation, sentence picks
array functions; generated code stays small however long the lists are. Whole texts are read.

The functions named ``*_sql`` return expression text to build on, the others columns.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from retroscope.functions import lexicons as lex

# what Python's str.strip / str.split call whitespace
SPACE = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


# --- expression text ----------------------------------------------------------------
def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def array_sql(items: Sequence[str]) -> str:
    return f"array({', '.join(quoted(i) for i in items)})"


def bind_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def holds_sql(text: str, phrases: Sequence[str]) -> str:
    """``text`` is evaluated per phrase: pass a column or a bound name."""
    return f"exists({array_sql(phrases)}, _p -> contains({text}, _p))"


def any_phrase_sql(text: str, phrases: Sequence[str]) -> str:
    return bind_sql(text, "_t", holds_sql("_t", phrases))


def phrases_found_sql(text: str, phrases: Sequence[str]) -> str:
    return bind_sql(text, "_t", f"filter({array_sql(phrases)}, _p -> contains(_t, _p))")


def count_phrases_sql(text: str, phrases: Sequence[str]) -> str:
    return f"size({phrases_found_sql(text, phrases)})"


def literal_forms(pattern: str) -> list[str] | None:
    """The plain strings a pattern of words, bounds and flat choices can match, or None."""
    head, choice, tail = re.fullmatch(r"([^(]*)(?:\(([^()]*)\)(.*))?", pattern.replace(r"\b", "")).groups()
    forms = [head + c + (tail or "") for c in choice.split("|")] if choice else [head]
    return None if any(re.search(r"[\\\[\](){}.*+?|^$]", f) for f in forms) else forms


def any_pattern_sql(text: str, patterns: Sequence[str]) -> str:
    regex = quoted("(?U)" + "|".join(f"(?:{p})" for p in patterns))
    forms = [literal_forms(p) if "(" in p or "\\b" in p else None for p in patterns]
    if any(f is None for f in forms):
        return f"({text} RLIKE {regex})"
    flat = [x for f in forms for x in f]
    # a phrase that holds another listed one adds nothing to the search
    flat = [x for x in flat if not any(y != x and y in x for y in flat)]
    return f"({any_phrase_sql(text, flat)} AND {text} RLIKE {regex})"


def strip_sql(text: str) -> str:
    return f"regexp_replace({text}, {quoted(f'^{SPACE}+|{SPACE}+$')}, '')"


def first_match_sql(options: Sequence[tuple[str, str]], default: str | None = None) -> str:
    """Label of the first condition that holds."""
    end = "NULL" if default is None else quoted(default)
    return "CASE " + " ".join(f"WHEN {c} THEN {quoted(v)}" for c, v in options) + f" ELSE {end} END"


# --- building and cleaning ----------------------------------------------------------
def full_text(title: str = "title", body: str = "selftext") -> Column:
    return F.expr(f"lower(concat(coalesce({title}, ''), '\\n', coalesce({body}, '')))")


def fallback_text(sentence: str = "regret_sentence", title: str = "title") -> Column:
    """The key sentence, or the title where there is none."""
    return F.expr(f"coalesce(nullif({sentence}, ''), {title}, '')")


def strip(text: str) -> Column:
    return F.expr(strip_sql(text))


def collapse_spaces(text: str) -> Column:
    return F.expr(strip_sql(f"regexp_replace({text}, {quoted(SPACE + '+')}, ' ')"))


def strip_urls(text: str) -> Column:
    return F.expr(f"regexp_replace({text}, {quoted('http' + chr(92) + 'S+')}, '')")


# --- predicates and counts ----------------------------------------------------------
def any_pattern(text: str, patterns: Sequence[str]) -> Column:
    """True where one of the patterns matches.

    Where the patterns are plain strings between word bounds, a byte search for the strings
    comes first, so the regex engine only sees texts that hold one.
    """
    return F.expr(any_pattern_sql(text, patterns))


def any_phrase(text: str, phrases: Sequence[str]) -> Column:
    """True where one of the phrases occurs as a substring (not bounded by words)."""
    return F.expr(any_phrase_sql(text, phrases))


def count_phrases(text: str, phrases: Sequence[str]) -> Column:
    """How many of the listed phrases occur at all; nested phrases each count."""
    return F.expr(count_phrases_sql(text, phrases))


def phrases_found(text: str, phrases: Sequence[str]) -> Column:
    """The listed phrases that occur, in list order."""
    return F.expr(phrases_found_sql(text, phrases))


def capped_hits(n: Column) -> Column:
    """Hits on a 0..1 scale that saturates at three."""
    return F.least(n / F.lit(3.0), F.lit(1.0))


def word_count_sql(text: str) -> str:
    return f"greatest(size(filter(split({text}, {quoted(SPACE + '+')}), _w -> _w != '')), 1)"


def word_count(text: str) -> Column:
    """Whitespace-separated words, one at least."""
    return F.expr(word_count_sql(text))


# --- tokens -------------------------------------------------------------------------
def tokens_sql(text: str) -> str:
    runs = f"regexp_extract_all(lower({text}), '([\\\\p{{L}}\\\\p{{N}}_]+)', 1)"
    return f"filter({runs}, _w -> _w RLIKE '^[a-z]{{2,}}$')"


def tokens(text: str) -> Column:
    """Runs of word characters that are two or more of a-z, in order."""
    return F.expr(tokens_sql(text))


def contrast_words(text: str, stopwords: Sequence[str] = lex.STOPWORDS) -> Column:
    """Tokens without stop-words; repeats stay, unlike with ``array_except``."""
    return F.expr(f"filter({tokens_sql(text)}, _w -> NOT array_contains({array_sql(stopwords)}, _w))")


def term_runs_sql(text: str) -> str:
    """Runs of two or more word characters."""
    return f"regexp_extract_all(lower({text}), '([\\\\p{{L}}\\\\p{{N}}_]{{2,}})', 1)"


def terms_and_bigrams(text: str, stopwords: Sequence[str] | None = None) -> Column:
    """Words and adjacent pairs once stop-words are gone (default: Spark ML's English list)."""
    words = english_stopwords() if stopwords is None else stopwords
    kept = f"filter({term_runs_sql(text)}, _w -> _w NOT IN ({', '.join(map(quoted, words))}))" if words else term_runs_sql(text)
    return with_bigrams(kept)


def title_label(label: str) -> Column:
    """A label as it is shown: spaces for underscores, each word with a capital."""
    return F.initcap(F.replace(F.col(label), F.lit("_"), F.lit(" ")))


def english_stopwords() -> list[str]:
    from pyspark.ml.feature import StopWordsRemover

    return StopWordsRemover.loadDefaultStopWords("english")


def sentiment_tokens(text: str) -> Column:
    return F.expr(f"regexp_extract_all(lower({text}), '([\\\\p{{L}}\\\\p{{N}}_\\']+)', 1)")


def with_bigrams(words: str) -> Column:
    """The words, then each adjacent pair joined by one space."""
    pairs = "zip_with(slice(_r, 1, greatest(size(_r) - 1, 0)), slice(_r, 2, greatest(size(_r) - 1, 0)), (_a, _b) -> concat(_a, ' ', _b))"
    return F.expr(bind_sql(words, "_r", f"concat(_r, {pairs})"))


# --- picks --------------------------------------------------------------------------
def first_piece(
    text: str, splitter: str, cues: Sequence[str], min_chars: int = 0, max_chars: int | None = None
) -> Column:
    """First piece of ``text`` that holds a cue and is long enough once trimmed, else ''."""
    cued = f"filter(split({text}, {quoted(splitter)}), _s -> {holds_sql('_s', cues)})"
    long = f"filter(transform({cued}, _s -> {strip_sql('_s')}), _s -> length(_s) >= {min_chars})"
    picked = f"coalesce(get({long}, 0), '')"
    return F.expr(picked if max_chars is None else f"substring({picked}, 1, {max_chars})")


def regret_sentence(text: str = "full_text") -> Column:
    return first_piece(
        text, r"[.\n!?]", lex.SENTENCE_CUES, lex.SENTENCE_MIN_CHARS, lex.SENTENCE_MAX_CHARS
    )


def decision_sentence(text: str = "full_text") -> Column:
    return first_piece(text, "[.]", ["regret"])


def first_pattern(text: str, patterns: Sequence[str] = lex.STRONG_PATTERNS) -> Column:
    """The first pattern, in list order, that matches anywhere."""
    return F.expr(first_match_sql([(any_pattern_sql(text, [p]), p) for p in patterns]))


def first_pattern_start(text: str, patterns: Sequence[str] = lex.STRONG_PATTERNS) -> Column:
    """Zero-based start of that pattern's leftmost match."""
    spots = " ".join(
        f"WHEN {any_pattern_sql(text, [p])} THEN regexp_instr({text}, {quoted('(?U)' + p)}) - 1"
        for p in patterns
    )
    return F.expr(f"CASE {spots} END")


def snippet(text: str, start: str, window: int = lex.SNIPPET_WINDOW) -> Column:
    """``window`` characters on both sides of ``start``, line breaks as spaces."""
    begin = f"greatest({start} - {window}, 0)"
    return F.expr(f"translate(substring({text}, {begin} + 1, {start} + {window} - {begin}), '\\n', ' ')")


def action_before(text: str, start: str, verbs: Sequence[str] = lex.PAST_ACTION_VERBS) -> Column:
    """First listed verb found left of ``start``."""
    return F.expr(f"get({phrases_found_sql(f'substring({text}, 1, {start})', verbs)}, 0)")


# --- classes and scores -------------------------------------------------------------
def classify_event(text: str, domain: str = "domain", taxonomy=lex.EVENT_TAXONOMY) -> Column:
    """Ordered labels per domain; the first whose phrases occur wins."""
    per_domain = " ".join(
        f"WHEN {quoted(name)} THEN "
        + first_match_sql([(holds_sql("_e", ps), tag) for tag, ps in labels], lex.UNKNOWN_EVENT)
        for name, labels in taxonomy.items()
    )
    chosen = f"CASE lower({domain}) {per_domain} ELSE {quoted(lex.UNKNOWN_EVENT)} END"
    return F.expr(bind_sql(f"lower({text})", "_e", chosen))


def keyword_domain(text: str, keywords=lex.DOMAIN_KEYWORDS) -> Column:
    """Domain with most keywords; ties to the first listed, none to the first listed too."""
    counts = f"array({', '.join(count_phrases_sql(text, words) for words in keywords.values())})"
    first = f"get({array_sql(list(keywords))}, int(array_position(_c, array_max(_c)) - 1))"
    return F.expr(bind_sql(counts, "_c", first))


def psycholinguistic(text: str = "full_text", words: str | None = None) -> dict[str, Column]:
    """Five phrase rates per thousand words of a lower-cased text; ``words`` names a column that has
    ``word_count`` of it, which costs as much as the phrases, so that it is made once."""
    def n(phrases: Sequence[str]) -> str:
        return count_phrases_sql(text, phrases)

    counts = {
        "agency_score": f"({n(lex.AGENCY_ACTIVE)} - {n(lex.AGENCY_PASSIVE)})",
        "hedging_score": n(lex.HEDGING),
        "social_embed_score": n(lex.SOCIAL_EMBED),
        "causal_reasoning_score": n(lex.CAUSAL),
        "future_orient_score": n(lex.FUTURE),
    }
    return {name: F.expr(f"{c} / {words or word_count_sql(text)} * 1000D") for name, c in counts.items()}


def parse_annotation(reply: str, schema: str) -> Column:
    """JSON of an annotator's reply with any code fence taken off; null where it is broken."""
    bare = f"regexp_replace({strip_sql(reply)}, '^```(?:json)?|```[\\\\s\\\\S]*$', '')"
    return F.from_json(F.expr(bare), schema, {"mode": "PERMISSIVE"})


def annotation_prompt(template: str, title: str = "title", text: str = "full_text", limit: int = 1500) -> Column:
    """The request for one post; annotators are shown at most ``limit`` characters."""
    return F.expr(f"format_string({quoted(template)}, {title}, substring({text}, 1, {limit}))")


def null_if_not_finite(value: Column) -> Column:
    return F.when(
        F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)
    ).otherwise(value)

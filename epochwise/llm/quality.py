"""Quality rules: a table of thresholds, compiled into one projection.

All measures are native column expressions over the whole text; a document costs
one pass and nothing is shuffled. Arrays built on the way (words, windows) belong to
one text only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import SPACE_CLASS, id_and_text, named

# Characters counted as symbols.
SYMBOLS = "#*$%&|<>"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is a it that for with as on by this be was are from at or an "
    "le la les de du des et un une en que qui dans pour par sur au avec ce il est "
    "der die das und ein eine von zu mit den im ist auf nicht sich dem für als auch "
    "el los las y una es por con para se del lo su al no como más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails if a ratio is beyond ``bound``; ``at_least`` words are needed to judge."""

    name: str
    numerator: str
    denominator: str
    direction: str  # "above" or "below"
    bound: float
    at_least: int = 0


# The threshold table. Ratios are of two columns of ``measured``.
RULES = (
    Rule("symbols_per_word", "n_symbols", "n_words", "above", 0.1),
    Rule("mean_word_length_high", "word_chars", "n_words", "above", 12.0),
    Rule("mean_word_length_low", "word_chars", "n_words", "below", 2.0),
    Rule("stop_word_share", "n_stop_words", "n_words", "below", 0.01, 80),
    Rule("duplicate_line_share", "n_dup_lines", "n_lines", "above", 0.5),
    Rule("repeated_word_share", "n_repeat_words", "n_words", "above", 0.2),
    Rule("shouting_share", "n_shouts", "n_words", "above", 0.3),
)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _repeat_words(words: str) -> str:
    """Words covered by five-word windows that occur more than once.

    Most texts repeat no window: as many distinct hashes as windows settles those.
    Otherwise the windows themselves are sorted, equal neighbours give the places, and
    the covered words are summed up as distances between places, at most five each.
    """
    hashes = f"transform(sequence(1, size({words}) - 4), i -> xxhash64(slice({words}, i, 5)))"
    windows = f"transform(sequence(1, size({words}) - 4), i -> array_join(slice({words}, i, 5), ' '))"
    places = (
        "array_sort(filter(transform(s, (x, k) -> if("
        "(k > 0 and get(s, k - 1).w = x.w) or (k + 1 < size(s) and get(s, k + 1).w = x.w), x.i, null)), "
        "x -> x is not null))"
    )
    covered = (
        "aggregate(transform(p, (x, k) -> if(k + 1 < size(p), least(5, get(p, k + 1) - x), 5)), "
        "0, (a, x) -> a + x)"
    )
    repeats = _let(
        f"sort_array(transform({windows}, (x, k) -> named_struct('w', x, 'i', k)))", "s", _let(places, "p", covered)
    )
    return f"if(size({words}) < 5 or size(array_distinct({hashes})) = size({words}) - 4, 0, {repeats})"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that rules read: words, characters, symbols, lines, repeats."""
    space = _literal(SPACE_CLASS)
    bare = "translate({}, ' \\t\\n\\u000B\\u000C\\r', '')"
    stops = ", ".join(_literal(w) for w in STOP_WORDS)
    of_words = _let(
        f"filter(split(text, concat({space}, '+')), w -> w <> '')",
        "ws",
        "named_struct("
        "'n_words', size(ws), "
        f"'n_repeat_words', {_repeat_words('ws')}, "
        f"'n_stop_words', size(filter(ws, w -> length(w) < 6 and lower(w) in ({stops}))), "
        "'n_shouts', size(filter(ws, w -> endswith(w, '!!'))))",
    )
    of_lines = _let(
        f"filter(split(text, '\\n'), l -> {bare.format('l')} <> '')",
        "ls",
        "named_struct('n_lines', size(ls), 'n_dup_lines', size(ls) - size(array_distinct(ls)))",
    )
    counted = id_and_text(docs, id_col, text_col).selectExpr(
        "doc_id",
        f"{of_words} as w",
        f"{of_lines} as l",
        f"length({bare.format('text')}) as word_chars",
        f"length(text) - length(translate(text, {_literal(SYMBOLS)}, '')) as n_symbols",
    )
    return counted.selectExpr(
        "doc_id",
        "cast(w.n_words as long) as n_words",
        "cast(word_chars as long) as word_chars",
        "cast(n_symbols as long) as n_symbols",
        "cast(l.n_dup_lines as long) as n_dup_lines",
        "cast(w.n_repeat_words as long) as n_repeat_words",
        "cast(l.n_lines as long) as n_lines",
        "cast(w.n_stop_words as long) as n_stop_words",
        "cast(w.n_shouts as long) as n_shouts",
    )


def _fails(rule: Rule) -> str:
    sign = {"above": ">", "below": "<"}[rule.direction]
    return (
        f"coalesce(n_words >= {rule.at_least} and "
        f"try_divide({rule.numerator}, {rule.denominator}) {sign} {rule.bound}D, false)"
    )


def quality_verdicts(
    docs: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: the counts, ``base_failed``, ``failed_rules`` and ``kept``.

    A text with fewer than 10 words, or more than 20 % of its words in repeated
    five-word windows, fails the base. A null or empty text has zero counts and
    fails it. A null id stays null; repeated rows give repeated results. Ratios
    without words or lines fail no rule.
    """
    names = ", ".join(f"if({_fails(r)}, {_literal(r.name)}, null)" for r in rules)
    failed = f"array_compact(array({names}))" if rules else "cast(array() as array<string>)"
    kept = " or ".join(["base_failed", *(_fails(r) for r in rules)])
    return (
        measured(docs, id_col, text_col)
        .selectExpr("*", "(n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed")
        .selectExpr("*", f"{failed} as failed_rules", f"not ({kept}) as kept")
    )


def accepted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; one projection and filter, no join."""
    # The whole row takes the place of the id, so nothing has to be joined back.
    whole = docs.select(F.struct(*(named(c) for c in docs.columns)).alias("doc_id"), named(text_col).alias("text"))
    return quality_verdicts(whole, rules).where("kept").select("doc_id.*")

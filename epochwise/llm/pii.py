"""Personal data by bootstrapped contextual extraction, in native expressions only.

1. Fixed patterns find base entities (mail addresses, ip addresses, card and phone
   numbers). They are the seeds. Other runs with digits are candidates.
2. The word before and the word after an entity are its lexical patterns. A pattern
   can only ever be trusted if entities and candidates make up enough of all places
   where its word occurs, which the word counts of the corpus tell; others go at once.
3. On the graph of patterns and instances, scores go to and fro: a pattern's
   confidence is the known share of its places, an instance's score is the chance that
   not all of its trusted patterns are wrong. Instances with a high score join the known
   and support patterns like seeds, until nothing changes: known ones only ever grow.
4. Their spans are added to the base ones, as kind ``context``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import SPACE_CLASS, bitmaps_from, id_and_text, marked_by_bitmaps, named
from epochwise.llm.quality import _let, _literal
from epochwise.storage import stage

_SPACE = r"[\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]"

# The base kinds in their order, with patterns that find the leftmost longest
# matches. Where a run of characters fails, no later start within it is tried: all fail alike.
# Groups repeat possessively, so that long runs need no stack.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # 14 to 19 digits of a maximal chain; shorter and longer chains are no cards.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_DIGIT = "cast(substring(d, i, 1) as int)"
# What a match must fulfil besides; m is the match.
_CHECKS = {
    "email": "true",
    "ip": "forall(split(m, '[.]'), p -> cast(right(concat('0', trim(leading '0' from p)), 9) as int) <= 255 "
    "and length(trim(leading '0' from p)) < 4)",
    "card": _let(
        _DIGITS,
        "d",
        "aggregate(sequence(1, length(d)), 0, (a, i) -> a + if((length(d) - i) % 2 = 0, "
        f"{_DIGIT}, 2 * {_DIGIT} - if({_DIGIT} > 4, 9, 0))) % 10 = 0",
    ),
    "phone": f"length({_DIGITS}) between 10 and 15",
}
# Runs without white space of at least 6 characters and 3 digits, from their beginning.
_CANDIDATE = rf"(?<!{_WORD})(?={_WORD}{{6}})(?:[^0-9\x20\x09-\x0D]*+[0-9]){{3}}{_WORD}*+"
# Punctuation around a candidate that does not belong to it.
_WRAP = r"[\"'(\[{<>}\])#*$%&|,.;:!?]"

# Characters on either side that contexts are read from.
_WINDOW = 80
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.5
MIN_SCORE = 0.6
# Rounds end when no instance joins and all scores together rise by less.
_STILL = 1e-6

_EMPTY = "cast(array() as array<struct<s: int, e: int, m: string>>)"


def _spans(pattern: str) -> str:
    """Matches of a pattern as (s, e, m) in code points: lengths of gaps and matches, summed up."""
    match, gap = "get(ms, i - 1)", "get(gs, i - 1)"
    begin = f"a.p + length({gap})"
    item = f"named_struct('s', {begin}, 'e', {begin} + length({match}), 'm', {match})"
    folded = (
        f"aggregate(sequence(1, size(ms)), named_struct('p', 0, 'o', {_EMPTY}), (a, i) -> "
        f"named_struct('p', {begin} + length({match}), 'o', concat(a.o, array({item}))), a -> a.o)"
    )
    found = _let(f"split(text, {_literal(pattern)}, -1)", "gs", folded)
    return _let(f"regexp_extract_all(text, {_literal(pattern)}, 0)", "ms", f"if(size(ms) = 0, {_EMPTY}, {found})")


def _context(side: str, s: str, e: str) -> str:
    if side == "L":
        part = f"substring(text, greatest(1, {s} - {_WINDOW} + 1), least({s}, {_WINDOW}))"
        pattern = rf"({_WORD}+){_SPACE}+{_WRAP}{{0,3}}$"
    else:
        part = f"substring(text, {e} + 1, {_WINDOW})"
        pattern = rf"^{_WRAP}{{0,3}}{_SPACE}+({_WORD}+)"
    return f"lower(regexp_extract({part}, {_literal(pattern)}, 1))"


def _entity(kind: str, s: str, e: str, value: str) -> str:
    return (
        f"named_struct('kind', {kind}, 's', {s}, 'e', {e}, 'value', {value}, "
        f"'l', {_context('L', s, e)}, 'r', {_context('R', s, e)})"
    )


def _entities_sql() -> str:
    base = []
    for number, (kind, pattern) in enumerate(KINDS.items()):
        passing = f"filter({_spans(pattern)}, x -> {_let('x.m', 'm', _CHECKS[kind])})"
        base.append(f"transform({passing}, x -> {_entity(str(number), 'x.s', 'x.e', 'x.m')})")
    left = f"length(regexp_extract(x.m, {_literal('^' + _WRAP + '*')}, 0))"
    inner = f"regexp_replace(x.m, {_literal('^' + _WRAP + '+|' + _WRAP + '+$')}, '')"
    stripped = (
        f"transform({_spans(_CANDIDATE)}, x -> named_struct('s', x.s + {left}, 'e', x.s + {left} + length({inner}), "
        f"'m', {inner}))"
    )
    free = f"filter({stripped}, x -> length(x.m) > 5 and not exists(b, y -> y.s < x.e and x.s < y.e))"
    others = f"transform({free}, x -> {_entity(str(len(KINDS)), 'x.s', 'x.e', 'x.m')})"
    return _let("concat(" + ", ".join(base) + ")", "b", f"concat(b, {others})")


def entities(texts: DataFrame) -> DataFrame:
    """Add ``ents``: base entities (kinds 0 to 3) and candidates (4) with spans and contexts."""
    kind = "array<struct<kind: int, s: int, e: int, value: string, l: string, r: string>>"
    # Texts without a digit and an at sign have none of them.
    found = f"if(text rlike '[0-9@]', {_entities_sql()}, cast(array() as {kind}))"
    return texts.withColumn("ents", F.expr(found))


def discovered(found: DataFrame, texts: DataFrame) -> DataFrame:
    """Values of candidates that trusted patterns tell to be identifiers; ``found`` has the entities."""
    seed = len(KINDS)
    sides = F.explode(F.expr("array(concat('L:', ent.l), concat('R:', ent.r))")).alias("pattern")
    edges = (
        found.where("size(ents) > 0")
        .select(F.explode("ents").alias("ent"))
        .select(F.col("ent.value").alias("value"), (F.col("ent.kind") < seed).alias("seed"), sides)
        .where(F.length("pattern") > 2)
        .groupBy("pattern", "value", "seed")
        .agg(F.count(F.lit(1)).alias("places"))
    )
    edges = stage(edges, "pii-edges")
    supported = (
        edges.groupBy("pattern")
        .agg(F.count_distinct("value").alias("support"), F.sum("places").alias("places"))
        .where(F.col("support") >= MIN_SUPPORT)
        .withColumn("word", F.substring("pattern", 3, 1 << 30))
    )
    supported = stage(supported, "pii-patterns")
    # How often the word of a pattern occurs at all: bitmaps drop the other words before they are counted.
    words = texts.select(F.explode(F.split(F.lower("text"), SPACE_CLASS + "+")).alias("word"))
    marked = marked_by_bitmaps(words, F.xxhash64("word"), bitmaps_from(supported, F.xxhash64("word")), "wanted")
    totals = marked.where("wanted").groupBy("word").agg(F.count(F.lit(1)).alias("total"))
    possible = (
        supported.join(totals, "word")
        .where(F.col("places") >= MIN_CONFIDENCE * F.col("total"))
        .select("pattern", "total")
    )
    graph = stage(edges.join(possible, "pattern"), "pii-graph")
    seeds = graph.where("seed").select("value", F.lit(1.0).alias("score")).distinct()
    known, before = seeds, None
    while True:
        trusted = (
            graph.join(known, "value")
            .groupBy("pattern", "total")
            .agg(F.sum(F.col("score") * F.col("places")).alias("sure"), F.count_distinct("value").alias("support"))
            .where((F.col("support") >= MIN_SUPPORT) & (F.col("sure") >= MIN_CONFIDENCE * F.col("total")))
            .select("pattern", F.least(F.col("sure") / F.col("total"), F.lit(0.99)).alias("confidence"))
        )
        scored = (
            graph.where("not seed")
            .join(trusted, "pattern")
            .groupBy("value")
            .agg((1 - F.product(1 - F.col("confidence"))).alias("score"))
            .where(F.col("score") >= MIN_SCORE)
        )
        known = stage(seeds.unionAll(scored).groupBy("value").agg(F.max("score").alias("score")), "pii-known")
        now = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("score"), F.lit(0.0)).alias("score")).first()
        if before and now.n == before.n and now.score - before.score < _STILL:
            break
        before = now
    return known.join(graph.where("not seed").select("value").distinct(), "value", "left_semi").select("value")


def _extra_spans(found: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, text_hash, extra) of the documents that mention a discovered value."""
    mentions = (
        found.where("size(ents) > 0")
        .select("doc_id", "text_hash", F.explode("ents").alias("ent"))
        .where(F.col("ent.kind") == len(KINDS))
        .select("doc_id", "text_hash", F.col("ent.value").alias("value"), F.struct("ent.kind", "ent.s", "ent.e").alias("x"))
    )
    return mentions.join(values, "value").groupBy("doc_id", "text_hash").agg(F.collect_set("x").alias("extra"))


def _ready(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_and_text(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))


_BASE_SPANS = f"transform(filter(ents, x -> x.kind < {len(KINDS)}), x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e))"


def _written(spans: str) -> str:
    """kind:start:end by start, then kind, joined by commas."""
    names = ", ".join(_literal(k) for k in (*KINDS, "context"))
    ordered = f"array_sort(transform({spans}, x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e)))"
    return f"array_join(transform({ordered}, x -> concat_ws(':', get(array({names}), x.kind), x.s, x.e)), ',')"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every whole text.

    Counts and digest are of base entities; ``spans`` holds the discovered ones too.
    Offsets are code points, the end exclusive. Null and empty texts have none. Null
    ids and repeated rows stay as they are.
    """
    texts = _ready(docs, id_col, text_col)
    found = stage(entities(texts).select("doc_id", "text_hash", "ents"), "pii-entities")
    extra = _extra_spans(found, discovered(found, texts)).toDF("_doc", "_hash", "extra")
    joined = found.join(extra, F.expr("text_hash = _hash and doc_id <=> _doc"), "left")
    counts = [
        F.expr(f"cast(size(filter(ents, x -> x.kind = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(KINDS)
    ]
    none = "cast(array() as array<struct<kind: int, s: int, e: int>>)"
    return joined.select(
        "doc_id",
        *counts,
        F.expr(f"sha2({_written(_BASE_SPANS)}, 256)").alias("base_sha256"),
        F.expr(_written(f"concat({_BASE_SPANS}, coalesce(extra, {none}))")).alias("spans"),
    )


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with every span replaced by its kind in square brackets.

    Spans that overlap are replaced together, by the kind of the first. Null texts
    stay null. Only documents with discovered values are shuffled.
    """
    texts = _ready(docs, id_col, text_col)
    found = stage(entities(texts).select("doc_id", "text_hash", "ents"), "pii-entities")
    extra = stage(_extra_spans(found, discovered(found, texts)), "pii-extra").toDF("_doc", "_hash", "extra")
    rows = docs.select(
        F.struct(*(named(c) for c in docs.columns)).alias("whole"),
        named(id_col).alias("doc_id"),
        F.coalesce(named(text_col), F.lit("")).alias("text"),
    ).withColumn("text_hash", F.xxhash64("text"))
    key = F.xxhash64("text_hash")
    marked = marked_by_bitmaps(rows, key, bitmaps_from(extra, F.xxhash64("_hash")), "more")
    none = F.expr("cast(array() as array<struct<kind: int, s: int, e: int>>)")
    plain = marked.where("not more").withColumn("extra", none)
    joined = marked.where("more").join(extra, F.expr("text_hash = _hash and doc_id <=> _doc"), "left")
    both = plain.select("whole", "text", "extra").unionAll(joined.select("whole", "text", F.coalesce("extra", none)))
    names = ", ".join(_literal(f"[{k.upper()}]") for k in (*KINDS, "context"))
    ordered = (
        f"array_sort(transform(concat({_BASE_SPANS}, extra), x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e)))"
    )
    folded = (
        f"aggregate({ordered}, named_struct('p', 0, 'o', ''), (a, x) -> named_struct('p', greatest(a.p, x.e), "
        f"'o', if(x.s >= a.p, concat(a.o, substring(text, a.p + 1, x.s - a.p), get(array({names}), x.kind)), a.o)), "
        "a -> concat(a.o, substring(text, a.p + 1, length(text))))"
    )
    clean = entities(both).withColumn("clean", F.expr(f"if(size(ents) = 0 and size(extra) = 0, text, {folded})"))
    text = F.when(F.col("whole").getField(text_col).isNotNull(), F.col("clean")).alias(text_col)
    return clean.select(
        *(text if c == text_col else F.col("whole").getField(c).alias(c) for c in docs.columns)
    )

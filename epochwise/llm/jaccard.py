"""Similarity join on word shingles, filtered by several global token orders.

If two sets have a Jaccard similarity of t or more, then under *any* order of all
tokens their prefixes of n - ceil(t n) + 1 tokens share one. So candidates must share
a prefix token under several orders at once:

1. Texts become sets of 64-bit shingle hashes (exact but for hash collisions, about
   N^2 / 2^65 for N different sets). Equal sets are one class from here on.
2. A count sketch of all shingles, of a fixed size, puts frequent shingles last in
   every order; within a frequency class each order has its own permutation.
3. Prefix tokens of the first order are the join key, limited by size and position: a
   token counts in the band of its set's size, and in the next one if the first token
   that the set has in common with a set of that size may stand so far back.
4. A pair must differ in few enough bits of a parity bitmap (a shingle in one of the sets
   only turns one bit): first of a short one beside each token, so that pairs which share
   a token by chance are not made, then of one with a bit a shingle. It must also meet in
   the prefixes of the other orders. Of what is left the whole sets are compared.
5. Large groups of similar texts: each token first links its classes to a central one
   only, then to a central one outside that one's component. A central class is then
   done with its token. Tokens whose other classes are connected need no more work; of
   the others all pairs across components are tried, so no link between components is
   lost. The result is components, not links: pairs within a component that are
   connected already are not compared.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import bitmaps_from, id_and_text, marked_by_bitmaps, named
from epochwise.llm.components import components
from epochwise.storage import stage

_CELL_BITS = 20
_CELL_BLOCK = 1 << 15
# Bytes of text worked on at once.
_CHUNK_BYTES = 1 << 19
_ORDERS = 3

_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD_FACTORS = _RNG.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER_FACTORS = _RNG.integers(0, 2**63, _ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashes of n-word shingles, for many texts in one array of bytes."""

    def __init__(self, n: int) -> None:
        self.n = n
        self.powers = self.inverses = np.ones(0, dtype=np.uint64)

    def _grow(self, size: int) -> None:
        if len(self.powers) < size:
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE_INVERSE)])

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text number of each word: polynomials of its bytes, from one running sum."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1)
        self._grow(len(data))
        space = _SPACE[data]
        before = np.r_[True, space[:-1]]
        first, last = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        total = np.r_[np.uint64(0), np.cumsum(_BYTE[data] * self.powers[: len(data)])]
        hashes = (total[last] - total[first]) * self.inverses[first]
        return _mix(hashes + (last - first).astype(np.uint64) * _BASE), np.searchsorted(ends, first, side="right")

    def sets(self, texts: list[bytes]) -> list[np.ndarray]:
        """The sorted distinct shingles of each text; of fewer than n words, the whole sequence."""
        words, owner = self._words(texts)
        counts = np.bincount(owner, minlength=len(texts))
        starts = np.cumsum(counts) - counts
        n, out = self.n, []
        m = max(0, len(words) - n + 1)
        long = sum((words[k : k + m] * _WORD_FACTORS[k] for k in range(n)), np.zeros(m, dtype=np.uint64))
        long = _mix(long)
        for start, count in zip(starts.tolist(), counts.tolist(), strict=True):
            if count >= n:
                out.append(np.unique(long[start : start + count - n + 1]))
            elif count:
                whole = (words[start : start + count] * _WORD_FACTORS[:count]).sum(keepdims=True)
                out.append(_mix(whole + np.array([count], dtype=np.uint64) * _BASE))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def _in_chunks(texts: pd.Series) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as bytes) of about ``_CHUNK_BYTES`` each."""
    held, first, size = [], 0, 0
    for row, text in enumerate(texts):
        held.append(text.encode())
        size += len(held[-1])
        if size >= _CHUNK_BYTES:
            yield first, held
            held, first, size = [], row + 1, 0
    if held:
        yield first, held


def class_id(shingles: np.ndarray) -> int:
    """One 64-bit id of a set."""
    total = _mix(shingles ^ _BASE).sum(keepdims=True) + np.array([len(shingles)], dtype=np.uint64)
    return int(_mix(total).view(np.int64)[0])


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Frequency class of each of the 2^20 cells of shingle hashes; summed up by Spark, 1 MB."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, cells = Shingler(n), np.zeros(1 << _CELL_BITS, dtype=np.int64)
        for batch in batches:
            for _, held in _in_chunks(batch["text"]):
                every = np.concatenate(shingler.sets(held))
                cells += np.bincount((every >> np.uint64(64 - _CELL_BITS)).astype(np.int64), minlength=len(cells))
        blocks = cells.reshape(-1, _CELL_BLOCK)
        full = np.flatnonzero(blocks.any(axis=1))
        yield pd.DataFrame({"block": full, "cells": [blocks[b].astype("<i8").tobytes() for b in full]})

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = reduce(np.add, (np.frombuffer(c, dtype="<i8") for c in parts["cells"]))
        return pd.DataFrame({"block": [key[0]], "cells": [total.tobytes()]})

    schema = "block int, cells binary"
    cells = np.zeros(1 << _CELL_BITS, dtype=np.int64)
    for row in texts.select("text").mapInPandas(count, schema).groupBy("block").applyInPandas(add, schema).collect():
        cells[row.block * _CELL_BLOCK :][:_CELL_BLOCK] = np.frombuffer(row.cells, dtype="<i8")
    return _classes(cells)


def _classes(cells: np.ndarray) -> np.ndarray:
    """Binary digits of what each cell has above the usual, block by block: the driver holds no second array of that size."""
    mean, out = cells.mean(), np.zeros(len(cells), dtype=np.uint8)
    for at in range(0, len(cells), _CELL_BLOCK):
        above = np.maximum(0, (cells[at : at + _CELL_BLOCK] - mean - 4 * np.sqrt(mean)) / 4).astype(np.int64)
        out[at : at + _CELL_BLOCK] = [int(x).bit_length() for x in np.minimum(above, 2**62)]
    return out


def prefix_length(size: int, num: int, den: int) -> int:
    return size + (-num * size) // den + 1  # size - ceil(size * num / den) + 1


class Bands:
    """Bands of sizes: sizes of a pair differ by the factor den / num at most, so by one band at most."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.edges = num, den, [1]

    def of(self, size: int) -> tuple[int, int]:
        """The band of a size and the first size of the next band."""
        while self.edges[-1] <= size:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        band = bisect.bisect_right(self.edges, size) - 1
        return band, self.edges[band + 1]

    def placed(self, prefix: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys of a set's sorted prefix tokens, one for each band of sizes, and place * 4 + role of each.

        Roles: 1 in the band of the set's own size, where it may be the larger of a pair; 2 where
        it may be the smaller one, or as large. The smaller one goes to the band of the larger, as far
        as its place, if that is the pair's first common token, leaves room for enough common ones.
        """
        band, edge = self.of(size)
        # Places at which a partner may be as large as this set, and as large as the next band's sets.
        smaller, next_too = (
            min(len(prefix), max(0, size + (-self.num * (size + partner)) // (self.num + self.den) + 1)) for partner in (size, edge)
        )
        add = [np.uint64(k * int(_BASE) % 2**64) for k in (band, band + 1)]
        places = np.arange(len(prefix), dtype=np.int32) * 4
        own = places + 1
        own[:smaller] += 2
        return _mix(np.r_[prefix + add[0], prefix[:next_too] + add[1]]), np.r_[own, places[:next_too] + 2]


def parities(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of a set, a power of 2 long: each bit is the parity of its shingles.

    Two bitmaps of one length differ in no more bits than their sets in shingles; halves
    of a longer one, added without carry, make the shorter one.
    """
    size = max(64, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded(odd: np.ndarray, shingles: int, num: int, den: int) -> np.ndarray:
    """Parities as short as still tells most sets without anything in common apart."""
    wanted = max(64, 1 << (5 * shingles * (den - num) // (num + den)).bit_length())
    return np.bitwise_xor.reduce(odd.reshape(-1, min(wanted // 64, len(odd))), axis=0)


def _prefixed(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, class c, parities (odd, few: folded), keys and places of the first order, prefix tokens of the others."""
    frequency = texts.sparkSession.sparkContext.broadcast(_sketch(texts, n))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler, bands = Shingler(n), Bands(num, den)
        for batch in batches:
            for first, held in _in_chunks(batch["text"]):
                rows = []
                for doc_id, own in zip(batch["doc_id"].iloc[first:], shingler.sets(held), strict=False):
                    if not len(own):
                        rows.append((doc_id, 0, None, [], [], [], [], [], []))
                        continue
                    size = prefix_length(len(own), num, den)
                    high = frequency.value[(own >> np.uint64(64 - _CELL_BITS)).astype(np.int64)].astype(np.uint64)
                    prefixes = []
                    for factor in _ORDER_FACTORS:
                        keys = (high << np.uint64(56)) | (_mix(own * factor) >> np.uint64(8))
                        prefixes.append(np.sort(np.partition(keys, size - 1)[:size]))
                    keys, places = bands.placed(prefixes[0], len(own))
                    rest = [p.astype(np.uint32).view(np.int32) for p in prefixes[1:]]
                    odd = parities(own)
                    few = folded(odd, len(own), num, den)
                    rows.append((doc_id, len(own), class_id(own), odd, few, keys.view(np.int64), places, *rest))
                doc_ids, sizes, classes, *arrays = zip(*rows, strict=True)
                yield pd.DataFrame(
                    # Nullable whole numbers: a detour over floats would lose digits.
                    {"doc_id": pd.Series(doc_ids, dtype="object"), "n": sizes, "c": pd.array(classes, dtype="Int64")}
                    | {x: pd.Series(a, dtype="object") for x, a in zip(("odd", "few", "p1", "w1", "p2", "p3"), arrays, strict=True)}
                )

    schema = "doc_id string, n long, c long, odd array<long>, few array<long>, p1 array<long>, w1 array<int>, p2 array<int>, p3 array<int>"
    return texts.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(run, schema).withColumn(
        "doc_id", F.col("doc_id").cast("long")
    )


def _may_link(num: int, den: int) -> Column:
    """Size and position filter of a pair that shares a token at places i and j of its prefixes."""
    left, right = F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")
    return F.least(left, right) * (num + den) >= num * (F.col("n_a") + F.col("n_b"))


def _close(num: int, den: int, odd: str = "odd") -> Column:
    """Whether parities differ in no more bits than similar sets may in shingles; the longer bitmap is folded."""
    size = f"least(size({odd}_a), size({odd}_b))"
    a, b = (
        f"aggregate(sequence(0, size({x}) div {size} - 1), array_repeat(0L, {size}),"
        f" (held, k) -> zip_with(held, slice({x}, cast(k * {size} as int) + 1, {size}), (p, q) -> p ^ q))"
        for x in (f"{odd}_a", f"{odd}_b")
    )
    bits = f"aggregate(zip_with({a}, {b}, (p, q) -> bit_count(p ^ q)), 0L, (total, k) -> total + k)"
    return F.expr(f"{bits} * {num + den} <= (n_a + n_b) * {den - num}")


def _side(rows: DataFrame, side: str, *others: str) -> DataFrame:
    return rows.select("token", F.col("c").alias(side), F.col("n").alias(f"n_{side}"), F.col("i").alias(f"i_{side}"), *others)


def _ordered(a: str, b: str) -> tuple[Column, Column]:
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _labelled(rows: DataFrame, labels: DataFrame, c: str, label: str) -> DataFrame:
    """The rows with the label of class ``c``; without links a class is its own."""
    known = labels.select(F.col("node").alias(c), F.col("label").alias(label))
    return rows.join(known, c, "left").withColumn(label, F.coalesce(label, c))


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows, with labels, of tokens whose classes are not all connected yet."""
    known = stage(_labelled(rows.drop("label"), labels, "c", "label"), "labelled-rows")
    mixed = known.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return stage(known.join(mixed.select("token"), "token", "left_semi"), "open-rows")


def _centred(rows: DataFrame, eligible: DataFrame, num: int, den: int) -> DataFrame:
    """The rows beside their token's central class b, one of ``eligible``, whose own rows go; ``near``: if they may link.

    Central is who has the token nearest the front of its prefix: copies put what they
    alone have, their rare tokens, before it.
    """
    own = [x for x in ("i", "c", "n", "few", "label") if x in rows.columns]
    centres = eligible.groupBy("token").agg(F.min(F.struct(*own)).alias("x"))
    beside = rows.select("token", *own).join(centres, "token").where("c <> x.c")
    both = beside.select("*", *(F.col(x).alias(f"{x}_a") for x in own), *(F.col(f"x.{x}").alias(f"{x}_b") for x in own))
    apart = F.col("label_a") != F.col("label_b") if "label" in own else F.lit(True)
    near = F.when(apart & _may_link(num, den), _close(num, den, "few")).otherwise(False)
    return stage(both.select("token", *own, F.col("c_b").alias("b"), near.alias("near")), "centred-rows")


def _star_pairs(centred: DataFrame) -> DataFrame:
    """Each token's central class with the other classes of its token that may link with it."""
    return centred.where("near").select(*_ordered("c", "b")).distinct()


def _other_pairs(known: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs of a token's classes that no links connect yet; a token's classes are of similar sizes.

    Of a pair with two labels, one at least is not its token's most frequent label: only
    such classes are compared with all classes of the token, each pair once.
    """
    counts = known.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    most = counts.groupBy("token").agg(F.max_by("label", F.struct("k", "label")).alias("most"))
    marked = known.join(most, "token")
    also = [x for x in ("label", "few") if x in known.columns]
    left = _side(marked.where("label <> most"), "a", *(F.col(x).alias(f"{x}_a") for x in also))
    is_most = (F.col("label") == F.col("most")).alias("most_b")
    right = _side(marked, "b", *(F.col(x).alias(f"{x}_b") for x in also), is_most)
    may_link = F.expr("label_a <> label_b and (most_b or a < b)") & _may_link(num, den)
    if "few" in also:
        may_link = may_link & F.when(may_link, _close(num, den, "few")).otherwise(False)
    pairs = left.join(right, "token").where(may_link)
    return pairs.select(*_ordered("a", "b")).distinct()


def _only(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in the one column of ``wanted``; most others go before the shuffle."""
    marked = marked_by_bitmaps(df, F.xxhash64(key), bitmaps_from(wanted, F.xxhash64(wanted.columns[0])), "_wanted")
    keys = wanted.toDF("_key").distinct()
    return marked.where("_wanted").drop("_wanted").join(keys, F.col(key).eqNullSafe(F.col("_key")), "left_semi")


def _nodes(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()


def _links(pairs: DataFrame, prefixed: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar: parities first, then other orders, then the whole sets."""
    pairs = stage(pairs, "pairs")
    held = _only(prefixed.select("c", "n", "odd", "p2", "p3"), "c", _nodes(pairs)).dropDuplicates(["c"])
    for side in ("a", "b"):
        pairs = pairs.join(held.select(F.col("c").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("n", "odd", "p2", "p3"))), side)
    meet = _close(num, den) & F.arrays_overlap("p2_a", "p2_b") & F.arrays_overlap("p3_a", "p3_b")
    pairs = stage(pairs.where(meet).select("a", "b"), "candidates")

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        for batch in batches:
            for _, chunk in _in_chunks(batch["text"]):
                found = [(class_id(s), s.view(np.int64)) for s in shingler.sets(chunk) if len(s)]
                yield pd.DataFrame(found, columns=["c", "own"])

    nodes = stage(_nodes(pairs), "nodes")
    first = _only(prefixed.select("c", "doc_id"), "c", nodes).groupBy("c").agg(F.min("doc_id").alias("doc_id"))
    fetched = _only(texts, "doc_id", stage(first.select("doc_id"), "fetched"))
    own = fetched.select("text").mapInPandas(sets, "c long, own array<long>").join(nodes, "c", "left_semi")
    own = stage(own.dropDuplicates(["c"]), "sets")
    for side in ("a", "b"):
        pairs = pairs.join(own.select(F.col("c").alias(side), F.col("own").alias(f"own_{side}")), side)
    common = F.size(F.array_intersect("own_a", "own_b"))
    return stage(
        pairs.withColumn("common", common)
        .where(F.col("common") * (num + den) >= num * (F.size("own_a") + F.size("own_b")))
        .select("a", "b"),
        "similar",
    )


def _grouped(texts: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, c) of every row, and (c, label, first, rows) of each class that is not one row alone."""
    prefixed = stage(_prefixed(texts, n, num, den), "prefixed")
    placed_tokens = prefixed.where("n > 0").select("c", "n", "few", F.explode(F.arrays_zip("p1", "w1")).alias("x"))
    tokens = placed_tokens.select(F.expr("x.p1").alias("token"), "c", "n", "few", F.expr("x.w1 div 4").alias("i"), F.expr("x.w1 & 3").alias("role"))
    # Most tokens belong to one class, or to classes that are all the smaller (or all the larger) ones;
    # bitmaps of the others drop them before the shuffle.
    shared = tokens.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bit_or("role").alias("roles"))
    shared = stage(shared.where("low < high and roles = 3").select("token"), "shared-tokens")
    rows = stage(_only(tokens.drop("role"), "token", shared).distinct(), "shared-rows")
    rows = _centred(rows, rows, num, den)
    links = _links(_star_pairs(rows), prefixed, texts, n, num, den)
    labels = components(links)
    rows = _open(rows, labels)
    outside = _labelled(rows, labels, "b", "first").where("label <> first")
    rows = _centred(rows, outside, num, den)
    links = links.unionAll(_links(_star_pairs(rows), prefixed, texts, n, num, den))
    labels = components(links)
    pairs = _other_pairs(_open(rows, labels), num, den)
    links = links.unionAll(_links(pairs, prefixed, texts, n, num, den))
    labels = components(links)
    known = prefixed.select("doc_id", "n", "c")
    # Copies are summed up before they move.
    classes = known.where("n > 0").groupBy("c").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    grouped = classes.join(labels.withColumnRenamed("node", "c"), "c", "left").where("label is not null or rows > 1")
    return known, stage(grouped.withColumn("label", F.coalesce("label", "c")), "grouped-classes")


def near_duplicates(
    docs: DataFrame,
    n: int = 5,
    threshold: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) of every row.

    Texts are lower-cased in A-Z; their sets of distinct n-word shingles link when
    den * intersection >= num * union for ``threshold`` = (num, den). Null, empty and
    wordless texts have no shingles and are linked with nothing. Repeated rows are
    equal texts. Null ids come after all others. An empty table has no rows. Ids are
    whole numbers.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    known, grouped = _grouped(texts, n, *threshold)
    first = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    of_class = stage(grouped.select("c", "label").join(first, "label").select("c", "component_id"), "class-components")
    return known.join(of_class, "c", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def without_near_duplicates(
    docs: DataFrame,
    n: int = 5,
    threshold: tuple[int, int] = (80, 100),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs``, all columns, with one row of each component: that of the smallest id, null last.

    Rows are told apart by id and shingle set: of different texts with one id each has the
    fate of its own component, and of rows that agree in both one stays. Rows without
    words, null texts included, all stay. An empty table has no rows.
    """
    whole = F.struct(*(named(c) for c in docs.columns)).alias("whole")
    ids, text = named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text")
    rows = docs.select(whole, ids, text)
    known, grouped = _grouped(rows.select("doc_id", "text"), n, *threshold)
    first = F.struct(F.col("first").isNull().alias("none"), "first", "c")
    keepers = grouped.groupBy("label").agg(F.min(first).alias("keeper"))
    of_class = grouped.select("c", "label").join(keepers, "label").select("c", "keeper")
    own = F.expr("c = keeper.c and doc_id <=> keeper.first")
    # What goes, and of what is kept, what is there more than once.
    fates = (
        known.where("n > 0").join(stage(of_class, "class-keepers"), "c")
        .groupBy("doc_id", "c").agg(F.first(own).alias("keep"), F.count(F.lit(1)).alias("times"))
        .where("not keep or times > 1")
    )
    fates = stage(fates.select("doc_id", "c", "keep"), "fates")

    @F.pandas_udf("long")
    def class_of(texts: pd.Series) -> pd.Series:
        shingler, found = Shingler(n), []
        for _, held in _in_chunks(texts):
            found += [class_id(s) if len(s) else None for s in shingler.sets(held)]
        return pd.Series(found, dtype="Int64")

    by_id = marked_by_bitmaps(rows, F.xxhash64("doc_id"), bitmaps_from(fates, F.xxhash64("doc_id")), "_maybe")
    classed = by_id.where("_maybe").withColumn("c", class_of("text"))
    both = F.xxhash64("doc_id", "c")
    marked = marked_by_bitmaps(classed, both, bitmaps_from(fates, both), "_suspect")
    decided = marked.where("_suspect").alias("x").join(
        fates.alias("f"), F.expr("x.doc_id <=> f.doc_id and x.c = f.c"), "left"
    ).select("x.whole", "x.doc_id", "x.c", "f.keep")
    parts = [
        by_id.where("not _maybe"),
        marked.where("not _suspect"),
        decided.where("keep is null"),
        decided.where("keep").dropDuplicates(["doc_id", "c"]),
    ]
    return reduce(DataFrame.unionAll, (p.select("whole.*") for p in parts))

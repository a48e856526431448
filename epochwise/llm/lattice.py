"""Encoding with a SentencePiece vocabulary on lattices of pieces, and decoding.

1. Texts are cut into units that no piece reaches across: before white space marks and
   around newlines. Each task encodes the units of its rows where the rows are; nothing is
   shuffled, and a task remembers the ids of short units between texts.
2. The lattices of many units lie in one set of arrays: from every place all substrings
   are followed down the trie of the pieces at once, one character further in each step.
   Those that are pieces are the edges.
3. A fold over each lattice picks the pieces:

   * ``viterbi``: the path of the highest total score, for unigram vocabularies;
   * ``merges``: the edge of the best score whose both halves stand side by side, again
     and again, for BPE vocabularies. The best path of a BPE vocabulary's scores is not
     what BPE gives, so this fold is needed there. Short units go together, one edge of
     each in every round; a long one takes its edges from a heap.

   Characters without a piece become bytes.

Decoding looks the ids of many rows up in the piece table at once; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from epochwise.llm.common import id_and_text, named

MARK = "▁"  # stands for a space
# Ids of short units are kept between texts; beyond so many only the first half, which has the frequent ones.
_REMEMBERED = 120_000
# Longer units take their edges from a heap, and are not remembered.
_LONG = 48
# Characters of text, of distinct units and ids of rows held at once.
_CHUNK_CHARS = 1_000_000
_UNIT_CHARS = 100_000
_CHUNK_IDS = 250_000
# Rows whose ids are held at once.
_ROWS = 512
# Below any score: a character without a piece.
_UNKNOWN_SCORE = -1e12
# What the unknown id is decoded to, as by the library.
_UNKNOWN_TEXT = " ⁇ "


class Pieces:
    """The piece table of a model file, read on the driver."""

    def __init__(self, model_path: str) -> None:
        told = sentencepiece.SentencePieceProcessor(model_file=model_path)
        every = range(told.vocab_size())
        if any(told.is_unused(i) for i in every):
            raise ValueError(f"{model_path}: unused pieces are not supported")
        self.first_byte = next((i for i in every if told.is_byte(i)), None)
        if self.first_byte is None or told.id_to_piece(self.first_byte) != "<0x00>":
            raise ValueError(f"{model_path}: only vocabularies with byte fallback are supported")
        self.rows = [
            (told.id_to_piece(i), i, told.get_score(i))
            for i in every
            if not (told.is_byte(i) or told.is_control(i) or told.is_unknown(i))
        ]
        texts = [p for p, _, _ in self.rows]
        if any(MARK in p.lstrip(MARK) for p in texts):
            raise ValueError(f"{model_path}: pieces that reach over white space are not supported")
        # What each id is decoded to; control ids are decoded to nothing.
        self.surfaces = [b""] * told.vocab_size()
        for piece, i, _ in self.rows:
            self.surfaces[i] = piece.replace(MARK, " ").encode()
        for i in every:
            if told.is_byte(i):
                self.surfaces[i] = bytes([i - self.first_byte])
            elif told.is_unknown(i):
                self.surfaces[i] = _UNKNOWN_TEXT.encode()
        # Ids of pieces that begin with a space; encoding puts one before a text.
        self.spaced = frozenset(i for piece, i, _ in self.rows if piece.startswith(MARK))
        self.longest = max(map(len, texts))
        self.newline_alone = not any("\n" in p for p in texts)


@dataclass
class Lattices:
    """Lattices of many units; places are those of the units' characters, one behind the other."""

    points: np.ndarray  # code points
    starts: np.ndarray  # of the units, and the end of the last
    single: np.ndarray  # each character's id, -1 where it is no piece
    # Edges of two characters and more, by place.
    s: np.ndarray
    e: np.ndarray
    node: np.ndarray


class Encoder:
    """Ids of units, from arrays whose size is that of the vocabulary file; sent to the tasks."""

    def __init__(self, pieces: Pieces, fold: str) -> None:
        self.first_byte, self.longest = pieces.first_byte, pieces.longest
        self.fold = {"merges": self._merges, "viterbi": self._viterbi}[fold].__name__
        stop = "\n" if pieces.newline_alone else ""
        self.pattern = f"{MARK}*[^{MARK}{stop}]+|{MARK}+" + ("|\n" if stop else "")
        chars = sorted({c for piece, _, _ in pieces.rows for c in piece})
        # 0 is any other character, and the root that no step leads to.
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.width = len(chars) + 1
        steps: dict[int, int] = {}
        known = {}
        for piece, i, score in pieces.rows:
            node = 0
            for c in piece:
                node = steps.setdefault(node * self.width + int(self.number[ord(c)]), len(steps) + 1)
            known[node] = (i, score)
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.child = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int32)
        self.first = np.zeros(self.width, dtype=np.int32)
        below = int(np.searchsorted(self.keys, self.width))
        self.first[self.keys[:below]] = self.child[:below]
        self.id_of = np.full(len(steps) + 1, -1, dtype=np.int32)
        self.score_of = np.full(len(steps) + 1, _UNKNOWN_SCORE)
        for node, (i, score) in known.items():
            self.id_of[node], self.score_of[node] = i, score
        # Better scores have lower ranks, equal scores the same.
        self.rank_of = np.unique(-self.score_of, return_inverse=True)[1].astype(np.int64)

    def lattices(self, units: list[str]) -> Lattices:
        points = np.frombuffer("".join(units).encode("utf-32-le"), dtype="<u4")
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        starts = np.r_[0, np.cumsum(sizes)]
        ends = np.repeat(starts[1:], sizes)
        number = self.number[points]
        node = self.first[number]
        single = self.id_of[node]
        at = np.flatnonzero(node)
        node, found = node[at], []
        for length in range(2, self.longest + 1):
            inside = at + length <= ends[at]
            at, node = at[inside], node[inside]
            key = node.astype(np.int64) * self.width + number[at + length - 1]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            there = self.keys[place] == key
            at, node = at[there], self.child[place[there]]
            piece = self.id_of[node] >= 0
            found.append((at[piece], at[piece] + length, node[piece]))
        s, e, node = (np.concatenate([f[k] for f in found] or [at[:0]]) for k in range(3))
        order = np.argsort(s, kind="stable")
        return Lattices(points, starts, single, s[order], e[order], node[order])

    def _merges(self, of: Lattices) -> tuple[np.ndarray, np.ndarray]:
        n = len(of.points)
        following, border, ids = np.arange(1, n + 2), np.ones(n + 1, dtype=bool), of.single.copy()
        unit = np.searchsorted(of.starts, of.s, side="right") - 1
        long = np.diff(of.starts) > _LONG
        for u in np.flatnonzero(long):
            self._merge_long(of, int(of.starts[u]), int(of.starts[u + 1]), border, ids)
        short = np.flatnonzero(~long[unit])
        s, e, unit, node = of.s[short], of.e[short], unit[short], of.node[short]
        rank = self.rank_of[node] << 32
        while len(s):
            ready = np.flatnonzero(following[following[s]] == e)
            if not len(ready):
                break
            # The best edge of each unit, the first of equal ones.
            own = unit[ready]
            begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.minimum.reduceat(rank[ready] | ready, begins) & 0xFFFFFFFF
            border[following[s[best]]] = False
            following[s[best]] = e[best]
            ids[s[best]] = self.id_of[node[best]]
            going = np.zeros(len(of.starts), dtype=bool)
            going[own[begins]] = True
            kept = border[s] & border[e] & (following[s] != e) & going[unit]
            s, e, unit, node, rank = s[kept], e[kept], unit[kept], node[kept], rank[kept]
        return np.flatnonzero(border[:n]), ids

    def _merge_long(self, of: Lattices, begin: int, end: int, border: np.ndarray, ids: np.ndarray) -> None:
        """The same for one unit: every pair that comes to stand side by side enters a heap once."""
        a, b = np.searchsorted(of.s, [begin, end])
        starts, ends, nodes = ((x[a:b] - shift).tolist() for x, shift in ((of.s, begin), (of.e, begin), (of.node, 0)))
        edges = dict(zip(zip(starts, ends, strict=True), nodes, strict=True))
        ranks = self.rank_of
        after, before = list(range(1, end - begin + 1)), list(range(-1, end - begin))
        heap = [(int(ranks[node]), s, s + 1, e) for (s, e), node in edges.items() if e == s + 2]
        heapify(heap)
        size = end - begin
        while heap:
            _, s, middle, e = heappop(heap)
            if after[s] != middle or after[middle] != e:
                continue
            after[s], before[e], after[middle] = e, s, -1
            border[begin + middle] = False
            ids[begin + s] = self.id_of[edges[s, e]]
            pairs = []
            if s > 0:
                pairs.append((before[s], s, e))
            if e < size:
                pairs.append((s, e, after[e]))
            for left, middle, right in pairs:
                node = edges.get((left, right))
                if node is not None:
                    heappush(heap, (int(ranks[node]), left, middle, right))

    def _viterbi(self, of: Lattices) -> tuple[np.ndarray, np.ndarray]:
        ids, begins = of.single.copy(), []
        one = self.score_of[self.first[self.number[of.points]]]
        edge_of = np.searchsorted(of.s, of.starts)
        for u in range(len(of.starts) - 1):
            begin, end = int(of.starts[u]), int(of.starts[u + 1])
            # To each place: the best score, the later of equal begins, and the id of its last piece.
            best = [(0.0, 0, 0)] + [(-np.inf, -1, -1)] * (end - begin)
            edge, last = int(edge_of[u]), int(edge_of[u + 1])
            for s in range(end - begin):
                total = best[s][0]
                best[s + 1] = max(best[s + 1], (total + float(one[begin + s]), s, int(of.single[begin + s])))
                while edge < last and of.s[edge] == begin + s:
                    node, e = of.node[edge], int(of.e[edge]) - begin
                    best[e] = max(best[e], (total + float(self.score_of[node]), s, int(self.id_of[node])))
                    edge += 1
            place = end - begin
            while place:
                _, s, i = best[place]
                ids[begin + s] = i
                begins.append(begin + s)
                place = s
        return np.sort(np.array(begins, dtype=np.int64)), ids

    def encoded(self, units: list[str]) -> list[bytes]:
        """The ids of each non-empty unit, as 32-bit numbers."""
        of = self.lattices(units)
        begins, ids = getattr(self, self.fold)(of)
        own, points = ids[begins], of.points[begins]
        # What has no piece is one character, and becomes the ids of its bytes.
        times = np.where(own >= 0, 1, 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))
        out = np.repeat(own, times)
        missing = points[own < 0].astype("<u4").tobytes().decode("utf-32-le").encode()
        out[out < 0] = np.frombuffer(missing, dtype=np.uint8).astype(np.int32) + self.first_byte
        at = 4 * np.r_[0, np.cumsum(times)][np.searchsorted(begins, of.starts)]
        data, at = out.astype("<i4").tobytes(), at.tolist()
        return [data[a:b] for a, b in zip(at, at[1:], strict=False)]

    def texts(self) -> TextEncoder:
        return TextEncoder(self)


class TextEncoder:
    """Encodes texts, remembering the ids of short units."""

    def __init__(self, encoder: Encoder) -> None:
        self.encoder = encoder
        self.find = re.compile(encoder.pattern).findall
        self.known: dict[str, bytes] = {}

    def _flush(self, held: list[list[str]]) -> Iterator[np.ndarray]:
        new = list(set().union(*held) - self.known.keys())
        extra: dict[str, bytes] = {}
        first, size = 0, 0
        for at, unit in enumerate(new, 1):
            size += len(unit)
            if size >= _UNIT_CHARS or at == len(new):
                some = new[first:at]
                for u, ids in zip(some, self.encoder.encoded(some), strict=True):
                    (self.known if len(u) <= _LONG else extra)[u] = ids
                first, size = at, 0
        known = self.known | extra if extra else self.known
        for units in held:
            yield np.frombuffer(b"".join(map(known.__getitem__, units)), dtype="<i4")
        if len(self.known) > _REMEMBERED:
            self.known = dict(islice(self.known.items(), _REMEMBERED // 2))

    def ids(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        held, chars = [], 0
        for text in texts:
            held.append(self.find(MARK + text.replace(" ", MARK)) if text else [])
            chars += len(text)
            if chars >= _CHUNK_CHARS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)


def unit_ids(units: DataFrame, pieces: Pieces, fold: str) -> DataFrame:
    """(unit, ids) for a table of non-empty units."""
    sent = units.sparkSession.sparkContext.broadcast(Encoder(pieces, fold))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = sent.value.encoded(batch.tolist()) if len(batch) else []
            yield pd.Series([np.frombuffer(x, dtype="<i4") for x in found], dtype="object")

    return units.select("unit", ids("unit").alias("ids"))


def encode(
    docs: DataFrame,
    model_path: str,
    fold: str = "merges",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens and ids of every whole text.

    Null and empty texts have no ids. Null ids and repeated rows stay as they are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Encoder(Pieces(model_path), fold))

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = sent.value.texts()
        for texts in batches:
            yield pd.Series(list(encoder.ids(texts)), dtype="object")

    encoded = id_and_text(docs, id_col, text_col).select("doc_id", ids("text").alias("ids"))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


class Decoder:
    """Texts of arrays of ids; sent to the tasks."""

    def __init__(self, pieces: Pieces) -> None:
        self.surfaces, self.spaced = pieces.surfaces, pieces.spaced

    def texts(self, rows: Iterable[np.ndarray | None]) -> Iterator[str]:
        table = pa.array(self.surfaces, pa.large_binary())
        lengths = np.fromiter(map(len, self.surfaces), dtype=np.int64, count=len(self.surfaces))
        held, size = [], 0
        for row in rows:
            held.append(np.zeros(0, dtype=np.int64) if row is None else np.asarray(row))
            size += len(held[-1])
            if size >= _CHUNK_IDS:
                yield from self._some(held, table, lengths)
                held, size = [], 0
        yield from self._some(held, table, lengths)

    def _some(self, rows: list[np.ndarray], table: pa.Array, lengths: np.ndarray) -> Iterator[str]:
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
        bad = ids[(ids < 0) | (ids >= len(self.surfaces))]
        if len(bad):
            raise ValueError(f"no such piece: {bad[0]}")
        data = table.take(pa.array(ids)).buffers()[2]
        data = memoryview(data if data is not None else b"")
        places = np.r_[0, np.cumsum(lengths[ids])]
        at = places[np.r_[0, np.cumsum([len(r) for r in rows], dtype=np.int64)]]
        # The first space of a text was added by encoding: that of its first id that stands for anything.
        first = np.searchsorted(places, at[:-1], side="right") - 1
        for begin, end, own in zip(at[:-1].tolist(), at[1:].tolist(), first.tolist(), strict=True):
            begin += begin < end and int(ids[own]) in self.spaced
            yield bytes(data[begin:end]).decode("utf-8", "replace")


def decoded(spark: SparkSession, pieces: Pieces, ids: Column) -> Column:
    """The text of an array of ids; a null array is an empty one.

    Control ids give nothing, the unknown id gives `` ⁇ ``, and an id that the vocabulary
    has not, or a null one, is an error. Bytes that are no UTF-8 become U+FFFD.
    """
    sent = spark.sparkContext.broadcast(Decoder(pieces))

    @F.pandas_udf("string")
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(sent.value.texts(batch)), dtype="object")

    # A null within an array would make floats of the other ids.
    return texts(F.transform(ids, lambda i: F.coalesce(i, F.lit(-1))))


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of arrays of ids, row by row: ids may be null and repeat."""
    text = decoded(encoded.sparkSession, Pieces(model_path), named(ids_col))
    return encoded.select(named(id_col).alias("doc_id"), text.alias("text"))


def encode_and_decode(
    docs: DataFrame,
    model_path: str,
    fold: str = "merges",
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """What ``encode`` gives, and decoded_sha256 of the text decoded from the ids of every row."""
    pieces = Pieces(model_path)
    sent = docs.sparkSession.sparkContext.broadcast((Encoder(pieces, fold), Decoder(pieces)))

    # Both in one worker, so that the ids need not be sent to another one; parts of a batch, so that few are held.
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = sent.value
        encoder = encoder.texts()
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                part = batch.slice(first, _ROWS)
                ids = list(encoder.ids(part.column(1).to_pylist()))
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(np.concatenate(ids), pa.int32())
                )
                hashed = [hashlib.sha256(t.encode()).hexdigest() for t in decoder.texts(ids)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), lists, pa.array(hashed, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded_sha256"],
                )

    texts = id_and_text(docs, id_col, text_col)
    schema = StructType([texts.schema["doc_id"]]).add("n_tokens", "long").add("ids", ArrayType(IntegerType())).add("decoded_sha256", "string")
    return texts.mapInArrow(both, schema)

"""Best-fit packing planned over the histogram of lengths.

Only counts of lengths (at most the capacity's number of them) reach the driver.
Best fit runs over those counts, longest first: all documents of a length go to
bins of the smallest remaining room at once, bins alike being kept as ranges. The
plan says "ranks a to b of length L go to bins from s on, at this offset"; documents
then take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from heapq import heappop, heappush
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from epochwise.llm.common import id_and_text
from epochwise.operators.numbering import number_by_chunk
from epochwise.storage import stage

# Parts of words whose ids are remembered in a worker at most; then afresh.
_PARTS = 400_000
_REMEMBERED_CHARS = 40
# Punctuation that is looked up apart from the letters before it.
_TAIL = ".,;:!?|"
# Bytes of text worked on at once; one row at least.
_SLICE_BYTES = 3_000_000
# New parts of words that the library encodes in one call, and rows of a batch that a worker gets at once.
_NEW_PARTS = 8_192
_BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Rows of one numbering chunk: 2 ** _CHUNK_BITS neighbours of a written part.
_CHUNK_BITS = 16

# The words pattern of vocabularies that drop white space.
_WORDS_ONLY = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

PLAN_SCHEMA = "length int, rank_from long, rank_to long, bin_from long, per_bin int, used int"
PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Traits:
    """What workers need of a vocabulary file; read once, on the driver."""

    def __init__(self, told: str) -> None:
        self.told = told
        self._encoder: Encoder | None = None
        parts = json.loads(told)
        pre = (parts["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        kinds = [n["type"] for n in (parts["normalizer"] or {}).get("normalizers", [])]
        self.by_words = (
            pre[0].get("pattern") == {"Regex": _WORDS_ONLY}
            and pre[0].get("behavior") == "Removed"
            and pre[0].get("invert") is True
            and set(kinds) <= {"NFC", "Replace", "Lowercase"}
            and bool(parts["added_tokens"])
        )
        self.special = [a["content"] for a in parts["added_tokens"]]
        suffix = parts["model"].get("end_of_word_suffix") or ""
        vocabulary = parts["model"]["vocab"]
        # Whether an id ends a pre-token.
        self.ends = np.zeros(1 + max([*vocabulary.values(), *(a["id"] for a in parts["added_tokens"])]), dtype=bool)
        if suffix:
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def encoder(self) -> Encoder:
        """The encoder of this process; a worker keeps it, and what it remembers, from task to task."""
        if self._encoder is None:
            self._encoder = Encoder(self)
        return self._encoder


class Ragged:
    """Growing lists of ids by string: where each begins in one array, and its length."""

    def __init__(self) -> None:
        self.numbers = {"": 0}
        self.begin, self.length = np.zeros(1, dtype=np.int32), np.zeros(1, dtype=np.int32)
        self.flat = np.zeros(0, dtype="<u4")

    def add(self, strings: list[str], ids: list[bytes]) -> None:
        self.numbers.update(zip(strings, range(len(self.length), len(self.length) + len(strings)), strict=True))
        self.begin, self.length, self.flat = self.grown(ids)

    def grown(self, ids: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """begin, length and flat with these lists behind the own ones."""
        sizes = np.fromiter((len(x) // 4 for x in ids), dtype=np.int32, count=len(ids))
        begin = (len(self.flat) + np.cumsum(sizes) - sizes).astype(np.int32)
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        return np.r_[self.begin, begin], np.r_[self.length, sizes], np.concatenate([self.flat, flat])


class Encoder:
    """Ids of whole texts as the library gives them.

    Where the vocabulary drops white space, a text's ids are those of its
    space-separated words one after another, and the ids of letters followed by
    punctuation are those of both parts. Arrow splits the texts and numbers their
    distinct words, and the distinct parts of these; only parts not met before are
    encoded by the library, in one call, and remembered.
    """

    def __init__(self, traits: Traits) -> None:
        self.tokenizer = Tokenizer.from_str(traits.told)
        self.by_words, self.special, self.ends = traits.by_words, traits.special, traits.ends
        self.parts = Ragged()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _marked(self, words: list[str]) -> list[bytes]:
        """Ids of any words that hold no special string: in one call, a special token between them."""
        mark = self.special[0]
        joined = np.frombuffer(self._library([mark.join(words)])[0], dtype="<u4")
        cuts = np.flatnonzero(joined == self.tokenizer.token_to_id(mark))
        begins, ends = np.r_[0, cuts + 1], np.r_[cuts, len(joined)]
        return [joined[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]

    def _spaced(self, stems: list[str]) -> list[bytes]:
        """Ids of words that are one pre-token each: in one call, cut behind ids that end a word."""
        joined = np.frombuffer(self._library([" ".join(stems)])[0], dtype="<u4")
        ends = (np.flatnonzero(self.ends[joined]) + 1).tolist()
        if len(ends) != len(stems):
            return self._marked(stems)
        return [joined[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def _learn_stems(self, new: list[str]) -> list[bytes]:
        return self._spaced([s.lower() for s in new])

    def _learn_words(self, new: list[str]) -> list[bytes]:
        """Ids of words of any kind; those that may hold a special string each for itself."""
        odd = [any(s[:2] in word for s in self.special) for word in new]
        plain = [w for w, o in zip(new, odd, strict=True) if not o]
        marked = iter(self._marked(plain) if plain else [])
        alone = iter(self._library([w for w, o in zip(new, odd, strict=True) if o]))
        return [next(alone) if o else next(marked) for o in odd]

    def _numbered(self, strings: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> np.ndarray:
        """Numbers of parts of words; new ones are learnt first."""
        coded = strings.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far quicker than to_pylist()
        new = [s for s in distinct if s not in self.parts.numbers]
        if new:
            # In calls of bounded size: the library keeps far more of a token than its id while it works.
            calls = (learn(new[at : at + _NEW_PARTS]) for at in range(0, len(new), _NEW_PARTS))
            self.parts.add(new, [ids for found in calls for ids in found])
        numbers = np.fromiter(map(self.parts.numbers.__getitem__, distinct), dtype=np.int64, count=len(distinct))
        return numbers[coded.indices.to_numpy()]

    def _word_parts(self, words: pa.Array) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Two part numbers for each distinct word, and the arrays that they point into."""
        if len(self.parts.numbers) > _PARTS:
            self.parts = Ragged()
        # The vocabulary normalises first; ASCII words come first here, and are normal already.
        basic = pc.string_is_ascii(words)
        order = np.r_[tuple(np.flatnonzero(a.to_numpy(zero_copy_only=False)) for a in (basic, pc.invert(basic)))]
        foreign = [normalize("NFC", w) for w in words.filter(pc.invert(basic)).to_pylist()]
        normal = pa.concat_arrays([words.filter(basic), pa.array(foreign, pa.string())])
        stems = pc.utf8_rtrim(normal, _TAIL)
        # What lowering makes of letters must not depend on their neighbours.
        odd = pc.or_(pc.match_substring(stems, "Σ"), pc.match_substring(stems, "İ"))
        size = pc.binary_length(stems).to_numpy()
        behind = pc.binary_length(normal).to_numpy() - size
        split = pc.and_not(pc.utf8_is_alpha(stems), odd).to_numpy(zero_copy_only=False)
        split &= (behind <= 1) & (size <= 2 * _REMEMBERED_CHARS)
        found = np.zeros((len(words), 2), dtype=np.int32)
        found[order[split], 0] = self._numbered(pc.ascii_lower(stems.filter(pa.array(split))), self._learn_stems)
        tailed = split & (behind == 1)
        tails = pc.utf8_slice_codeunits(normal.filter(pa.array(tailed)), -1)
        found[order[tailed], 1] = self._numbered(tails, self._library)
        rest = np.sort(order[~split])
        others = words.take(pa.array(rest))
        short = pc.less_equal(pc.utf8_length(others), _REMEMBERED_CHARS).to_numpy(zero_copy_only=False)
        found[rest[short], 0] = self._numbered(others.filter(pa.array(short)), self._learn_words)
        long = others.filter(pa.array(~short)).to_pylist()
        found[rest[~short], 0] = len(self.parts.length) + np.arange(len(long))
        return found, self.parts.grown(self._learn_words(long))

    def slice_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text ends in it."""
        if not self.by_words:
            ids = self._library(texts.to_pylist())
            ends = np.cumsum([len(x) // 4 for x in ids], dtype=np.int64)
            return np.frombuffer(b"".join(ids), dtype="<u4"), ends
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        held = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False), dtype=np.int64)
        coded = split.flatten().dictionary_encode()
        of_word, (begin, length, flat) = self._word_parts(coded.dictionary)
        parts = of_word[coded.indices.to_numpy()].ravel()
        sizes = length[parts]
        after = np.cumsum(sizes)
        ends = np.r_[0, after][2 * held]
        # Place of every id in ``flat``: where its part begins, and how far inside it is.
        places = np.repeat((begin[parts] - (after - sizes)).astype(np.int32), sizes)
        places += np.arange(len(places), dtype=np.int32)
        return flat[places], ends

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        ids, ends = self.slice_ids(pa.array(list(texts), pa.string()))
        for begin, end in zip(np.r_[0, ends][:-1].tolist(), ends.tolist(), strict=True):
            yield ids[begin:end].tobytes()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``_SLICE_BYTES`` of text; a longer row is alone or last."""
    bytes_ = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = bytes_[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(bytes_, before + _SLICE_BYTES, side="right")))
        yield at, stop
        at = stop


def pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of at most ``capacity`` tokens."""
    with open(tokenizer_path, encoding="utf-8") as file:
        traits = docs.sparkSession.sparkContext.broadcast(Traits(file.read()))
    tail = np.array([end_id], dtype="<u4").tobytes()
    kinds = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, pool = traits.value.encoder(), pa.default_memory_pool()
        pool.release_unused()  # a worker may come from another operator
        for batch in batches:
            doc_ids, texts = batch.columns
            for at, stop in _slices(texts):
                ids, ends = encoder.slice_ids(texts.slice(at, stop - at))
                rows, begin = [], 0
                for doc_id, end in zip(doc_ids.slice(at, stop - at).to_pylist(), ends.tolist(), strict=True):
                    size = end - begin + 1
                    for piece, start in enumerate(range(0, size, capacity)):
                        stretch = min(capacity, size - start)
                        crc = zlib.crc32(ids[begin + start : min(begin + start + stretch, end)])
                        if start + stretch == size:
                            crc = zlib.crc32(tail, crc)
                        rows.append((doc_id, piece, start, stretch, crc))
                    begin = end
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k.type) for c, k in zip(columns, kinds, strict=True)], schema=kinds
                )
                pool.release_unused()

    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return texts.mapInArrow(cut, PIECE_SCHEMA)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths; rows of ``PLAN_SCHEMA``.

    Bins with the same room are ranges of bin numbers. A row sends ranks
    [rank_from, rank_to) of a length to bins from ``bin_from`` on, ``per_bin`` in each,
    after the ``used`` tokens that these bins hold already. The number of rows depends
    on the lengths there are, not on how many documents have them.
    """
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> [first, last) bins
    rooms: list[int] = []  # heap of rooms with bins, smallest first
    plan, bins = [], 0

    def put(room: int, first: int, last: int) -> None:
        if room and first < last:
            if not ranges[room]:
                heappush(rooms, room)
            ranges[room].append((first, last))

    for length in sorted(counts, reverse=True):
        rank, left, passed = 0, counts[length], []
        while left:
            while rooms and (rooms[0] < length or not ranges[rooms[0]]):
                room = heappop(rooms)
                if ranges[room]:
                    passed.append(room)
            if rooms:
                room = rooms[0]
                first, last = ranges[room].pop()
            else:
                room, first, last = capacity, bins, bins - (-left // (capacity // length))
                bins = last
            each = room // length
            full = min(last - first, left // each)
            if full:
                plan.append((length, rank, rank + full * each, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                put(room - each * length, first, first + full)
            first += full
            if first < last and left and left < each:  # the rest of this length goes to one more bin
                plan.append((length, rank, rank + left, first, each, capacity - room))
                put(room - left * length, first, first + 1)
                rank, left, first = rank + left, 0, first + 1
            put(room, first, last)
        for room in passed:
            heappush(rooms, room)
    return plan


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run within hand workers ``_BATCH_ROWS`` rows at once at most: both sides hold whole batches of text."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(min(_BATCH_ROWS, int(before)) if int(before) > 0 else _BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def packed(pieces_: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add sequence_id and offset to a table with a column ``length``."""
    spark = pieces_.sparkSession
    # Written once: encoding is the costly part, and places in the files stay fixed.
    with _small_batches(spark):
        held = stage(pieces_.withColumn("_place", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["count"] for r in held.groupBy("length").count().collect()}
    plan = spark.createDataFrame(plan_bins(counts, capacity), PLAN_SCHEMA)
    ranked = number_by_chunk(held, ["length"], F.shiftright("_place", _CHUNK_BITS), ["_place"], "_rank")
    slot = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "_length")), F.expr(
            "length = _length and _rank >= rank_from and _rank < rank_to"
        ))
        .withColumn("sequence_id", F.expr("bin_from + (_rank - rank_from) div per_bin"))
        .withColumn("offset", F.col("used") + slot % F.col("per_bin") * F.col("length"))
        .select(*pieces_.columns, "sequence_id", "offset")
    )


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 4096,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.

    Null and empty texts have the end id only. Longer documents are cut into whole
    sequences and a rest. Ids may be null and rows may repeat: each row is a document
    of its own. Ids are whole numbers.
    """
    return packed(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), capacity)

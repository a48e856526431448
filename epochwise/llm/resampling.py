"""Importance resampling towards a target, with n-gram buckets from prefix CRCs.

Texts of a batch become one stream of words, each followed by one space, which is
scanned once: the stream lies in equal stripes, and every step takes one byte of all
stripes. A CRC register that starts at zero is linear, so for any two places a <= b

    register(a..b) = register(0..b) xor shift(register(0..a), b - a)

where ``shift`` multiplies by x^8 for each byte, in GF(2) modulo the polynomial. The CRC
of every run of one to three words follows from the registers kept at its two ends.

Two passes read the texts: one sums bucket counts (a fixed number of buckets, so what
the driver gets does not grow), one adds up each document's gains. Draws come from a
hash of the id and are ranked by a range shuffle of ids and scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import id_and_text
from epochwise.operators.numbering import number_by_range
from epochwise.storage import stage

# The reflected polynomial of CRC-32, and where its register begins.
_POLYNOMIAL = 0xEDB88320
_ALL_ONES = 0xFFFFFFFF
_SPACE = 32
# Bytes of a stripe of the stream, and of text worked on at once (one text is never cut).
_STRIPE = 256
_SLICE_BYTES = 2 << 20


@lru_cache(maxsize=1)
def _byte_steps() -> np.ndarray:
    """What one byte makes of a register whose low byte it was added to."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ np.where(table & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    return table


def _through(table: np.ndarray, at: np.ndarray | int, registers: np.ndarray) -> np.ndarray:
    """Registers through the linear maps ``table[at]``, given as 4 x 256 words for each map."""
    flat = table.reshape(-1)
    base = np.asarray(at, dtype=np.int64) * 1024
    out = flat[base + (registers & 0xFF)]
    out ^= flat[base + (256 + ((registers >> 8) & 0xFF))]
    out ^= flat[base + (512 + ((registers >> 16) & 0xFF))]
    out ^= flat[base + (768 + (registers >> 24))]
    return out


@lru_cache(maxsize=1)
def _short_shifts() -> np.ndarray:
    """Maps for 0 to _STRIPE bytes of zeros: (_STRIPE + 1) x 4 x 256."""
    steps = _byte_steps()
    maps = np.empty((_STRIPE + 1, 4, 256), dtype=np.uint32)
    maps[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(_STRIPE):
        maps[n + 1] = steps[maps[n] & 0xFF] ^ (maps[n] >> 8)
    return maps


@lru_cache(maxsize=64)
def _long_shift(power: int) -> np.ndarray:
    """The map for _STRIPE * 2 ** power bytes, 1 x 4 x 256."""
    if power == 0:
        return _short_shifts()[_STRIPE][None]
    half = _long_shift(power - 1)
    return _through(half, 0, half[0])[None]


def shifted(registers: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Registers moved on by so many bytes of zeros."""
    out = _through(_short_shifts(), lengths % _STRIPE, registers)
    far = lengths // _STRIPE
    power = 0
    while len(far) and int(far.max()) >> power:
        some = np.flatnonzero((far >> power) & 1)
        out[some] = _through(_long_shift(power), 0, out[some])
        power += 1
    return out


def prefix_registers(stream: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Registers, begun at zero, after the first ``places[i]`` bytes of the stream."""
    steps, stripes = _byte_steps(), len(stream) // _STRIPE + 1
    padded = np.zeros(stripes * _STRIPE, dtype=np.uint8)
    padded[: len(stream)] = stream
    by_step = np.ascontiguousarray(padded.reshape(stripes, _STRIPE).T)
    kept = np.empty((_STRIPE + 1, stripes), dtype=np.uint32)
    kept[0] = 0
    for n in range(_STRIPE):
        kept[n + 1] = steps[(kept[n] ^ by_step[n]) & 0xFF] ^ (kept[n] >> 8)
    # What comes in at the front of each stripe: doubling spans of stripes.
    before, power = kept[_STRIPE].copy(), 0
    while 1 << power < stripes:
        before[1 << power :] ^= _through(_long_shift(power), 0, before[: -(1 << power)])
        power += 1
    before = np.concatenate([np.zeros(1, dtype=np.uint32), before[:-1]])
    stripe, offset = np.divmod(places, _STRIPE)
    return kept[offset, stripe] ^ shifted(before[stripe], offset)


@lru_cache(maxsize=1)
def _byte_kinds() -> np.ndarray:
    """Bytes of words, A-Z lower-cased; all other bytes become a space."""
    kinds = np.full(256, _SPACE, dtype=np.uint8)
    for first, last in ((ord("0"), ord("9")), (ord("a"), ord("z")), (0x80, 0xFF)):
        kinds[first : last + 1] = np.arange(first, last + 1)
    kinds[ord("A") : ord("Z") + 1] = kinds[ord("a") : ord("z") + 1]
    return kinds


def word_stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of texts that end in a separator: stream, places of the spaces, words before each text."""
    kinds = _byte_kinds()[data]
    word = kinds != _SPACE
    keep = word.copy()
    keep[1:] |= word[:-1]
    stream = kinds[keep]
    spaces = np.flatnonzero(stream == _SPACE)
    held = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(keep)])[offsets]
    return stream, spaces, np.searchsorted(spaces, held)


def ngram_crcs(stream: np.ndarray, spaces: np.ndarray, orders: int) -> Iterator[np.ndarray]:
    """For n = 1, 2, ... the CRC-32 of every n consecutive words of the stream, joined by a space."""
    starts = np.concatenate([np.zeros(1, dtype=np.int64), spaces + 1])[:-1]
    at_end = prefix_registers(stream, spaces)
    # One more byte, the space, leads from a word's end to the next one's start.
    after = _byte_steps()[(at_end ^ _SPACE) & 0xFF] ^ (at_end >> 8)
    at_start = np.concatenate([np.zeros(1, dtype=np.uint32), after])[:-1]
    for n in range(1, orders + 1):
        first, last = starts[: len(starts) - n + 1], spaces[n - 1 :]
        # Beginning at all ones instead of zero is one more register to shift.
        begun = at_start[: len(first)] ^ np.uint32(_ALL_ONES)
        yield at_end[n - 1 :] ^ shifted(begun, last - first) ^ np.uint32(_ALL_ONES)


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most about _SLICE_BYTES of text, one row at least."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + _SLICE_BYTES, side="right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, end
        begin = end


def _buckets(column: pa.Array, orders: int, buckets: int) -> Iterator[tuple[int, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """Per slice of rows: its first row, words before each row, and for each n the valid places and buckets."""
    column = column.cast(pa.large_binary())
    for begin, end in _slices(column):
        part = column.slice(begin, end - begin)
        offsets = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]]
        stream, spaces, words = word_stream(data, offsets - offsets[0])
        found = []
        for n, crcs in enumerate(ngram_crcs(stream, spaces, orders), start=1):
            # Words of a run of n that begin in one text and end in the next do not count.
            valid = np.ones(len(spaces), dtype=bool)
            for back in range(1, n):
                lasts = words[1:] - back
                valid[lasts[lasts >= words[:-1]]] = False
            valid = valid[: len(crcs)]
            found.append((np.flatnonzero(valid), (crcs[valid] % np.uint32(buckets)).astype(np.int64)))
        yield begin, words, found


def bucket_counts(docs: DataFrame, text_col: str = "text", orders: int = 3, buckets: int = 10_000) -> np.ndarray:
    """How many word runs of all texts fall into each bucket: ``buckets`` whole numbers on the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, found in _buckets(batch.column(0), orders, buckets):
                for _, numbers in found:
                    total += np.bincount(numbers, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    texts = id_and_text(docs, text_col, text_col).select(F.concat("text", F.lit(" ")).alias("text"))
    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(buckets, dtype=np.int64)
    for row in rows:
        total[row.bucket] = row.n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of both smoothed distributions, rounded down."""
    size, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [
            math.floor(1000 * math.log((float(b) + 1) * (s + size) / ((float(a) + 1) * (t + size))))
            for a, b in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def document_weights(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = 3
) -> DataFrame:
    """Per row: doc_id, n_words, n_features and weight, the sum of its features' gains."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    names = ["doc_id", "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n_words, n_features, weight = (np.zeros(rows, dtype=np.int64) for _ in range(3))
            for begin, words, found in _buckets(batch.column(1), orders, len(shared.value)):
                here = slice(begin, begin + len(words) - 1)
                n_words[here] = np.diff(words)
                for places, numbers in found:
                    sums = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(shared.value[numbers])])
                    cuts = np.searchsorted(places, words)
                    n_features[here] += np.diff(cuts)
                    weight[here] += np.diff(sums[cuts])
            columns = [batch.column(0), *(pa.array(c) for c in (n_words, n_features, weight))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    texts = id_and_text(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.concat("text", F.lit(" ")).alias("text")
    )
    return texts.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def drawn_by_gumbel(weights: DataFrame, share: tuple[int, int], min_words: int, seed: int) -> DataFrame:
    """Add score, a weight with noise from the id's hash, and rank: 1, 2, ... for the rows drawn.

    Highest scores first, then smaller ids (null last); ``share`` of the rows with
    ``min_words`` words are drawn, rounded down.
    """
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    number = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((number + 0.5) / 4294967296.0)))
    scored = stage(
        weights.withColumn("score", F.col("weight") + noise)
        .withColumn("eligible", F.col("n_words") >= min_words)
        .withColumn("down", -F.col("score"))
        .withColumn("no_id", F.col("doc_id").isNull())
        .withColumn("row", F.monotonically_increasing_id()),
        "resampling-scores",
    )
    ranked, totals = number_by_range(scored, ["eligible"], ["down", "no_id", "doc_id", "row"], "place")
    counted = totals.where("eligible").first()
    drawn = share[0] * (counted["rows"] if counted else 0) // share[1]
    rank = F.when(F.col("eligible") & (F.col("place") < drawn), F.col("place") + 1)
    return ranked.withColumn("rank", rank).select(*weights.columns, "score", "rank")


def resampled(
    docs: DataFrame,
    target: DataFrame,
    share: tuple[int, int] = (5, 100),
    min_words: int = 20,
    seed: int = 42,
    orders: int = 3,
    buckets: int = 10_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score and rank (null: not drawn).

    Words are runs of digits, letters a-z (A-Z lower-cased) and all characters beyond
    ASCII; features are the runs of one to ``orders`` words. Null and empty texts have no
    words and weight 0. Rows that repeat an id share its noise and are drawn one by one. A
    null id hashes as an empty one. An empty target has smoothed counts only; an empty
    table has no rows. Ids are whole numbers; other columns are not looked at.
    """
    source_counts = bucket_counts(docs, text_col, orders, buckets)
    target_counts = bucket_counts(target, target_text_col, orders, buckets)
    weights = document_weights(docs, bucket_gains(source_counts, target_counts), id_col, text_col, orders)
    return drawn_by_gumbel(weights, share, min_words, seed)

"""Exact duplicates by an exchange of Golomb-coded fingerprints.

1. Each partition reduces its texts to 48-bit fingerprints, sorts them, and sends
   every owner (a range of fingerprints) its share as Golomb-Rice coded gaps.
2. Owners decode and merge what they get and answer with duplicate bitmaps: one bit
   for each 27-bit fingerprint prefix that more than one text has. All bitmaps
   together have at most 16 MB, so they reach the partitions as a broadcast.
3. Only suspects, texts whose bit is set, are shuffled. Their whole normalised texts
   are the grouping key, so equality is decided by bytes; copies are summed up
   before they move, so a text that a third of all rows share moves once per task.

Fingerprints choose suspects only: a collision costs a shuffled row, never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import marked_by_bitmaps, named, squeezed

FINGERPRINT_BITS = 48
_PREFIX_BITS = 27
_BITMAP_BITS = 15
# Fingerprints of one message at most; a partition sends as many as it needs.
_MESSAGE = 1 << 18
# Longest id: keep keys are length * _ID_SPAN - id.
_ID_SPAN = "20000000000000000000"
_NO_ID = "9300000000000000000"


def golomb_encode(values: np.ndarray) -> tuple[int, bytes, bytes]:
    """(k, unary, rest) of strictly increasing values: gaps as quotient and k-bit remainder."""
    gaps = np.diff(values, prepend=0)
    k = max(0, int(values[-1] // len(values)).bit_length() - 1)
    ends = np.cumsum((gaps >> k) + 1)
    unary = np.zeros(int(ends[-1]), dtype=np.uint8)
    unary[ends - 1] = 1
    rest = ((gaps[:, None] >> np.arange(k)) & 1).astype(np.uint8)
    return k, np.packbits(unary).tobytes(), np.packbits(rest).tobytes()


def golomb_decode(n: int, k: int, unary: bytes, rest: bytes) -> np.ndarray:
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(unary, dtype=np.uint8)))[:n] + 1
    quotients = np.diff(ends, prepend=0) - 1
    bits = np.unpackbits(np.frombuffer(rest, dtype=np.uint8))[: n * k].reshape(n, k)
    return np.cumsum((quotients.astype(np.int64) << k) + (bits.astype(np.int64) << np.arange(k)).sum(axis=1))


def _messages(hashes: np.ndarray, owner_bits: int) -> pa.RecordBatch:
    """One message for each owner: its distinct fingerprints, and which of them came twice."""
    prints, times = np.unique(hashes.view(np.uint64) >> np.uint64(64 - FINGERPRINT_BITS), return_counts=True)
    prints = prints.astype(np.int64)
    owners = prints >> (FINGERPRINT_BITS - owner_bits)
    cuts = np.flatnonzero(np.diff(owners, prepend=-1))
    rows = []
    for begin, end in zip(cuts, np.r_[cuts[1:], len(prints)], strict=True):
        owner = int(owners[begin])
        within = prints[begin:end] - (owner << (FINGERPRINT_BITS - owner_bits))
        k, unary, rest = golomb_encode(within)
        rows.append((owner, int(end - begin), k, unary, rest, np.packbits(times[begin:end] > 1).tobytes()))
    names = ("owner", "n", "k", "unary", "rest", "twice")
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=list(names)
    )


def duplicate_bitmaps(hashed: DataFrame) -> DataFrame:
    """Bitmaps (bitmap_no, bitmap) of the prefixes of repeated 64-bit hashes; ``hashed`` has one column."""
    partitions = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    owner_bits = min(_PREFIX_BITS - _BITMAP_BITS, max(1, (partitions - 1).bit_length()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False))
            n += len(held[-1])
            while n >= _MESSAGE:
                every = np.concatenate(held)
                yield _messages(every[:_MESSAGE], owner_bits)
                held, n = [every[_MESSAGE:]], n - _MESSAGE
        if n:
            yield _messages(np.concatenate(held), owner_bits)

    def answer(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        parts = [golomb_decode(m.n, m.k, m.unary, m.rest) for m in got.itertuples()]
        twice = [np.unpackbits(np.frombuffer(m.twice, dtype=np.uint8))[: m.n] for m in got.itertuples()]
        every, flags = np.concatenate(parts), np.concatenate(twice)
        prints, places, times = np.unique(every, return_inverse=True, return_counts=True)
        again = (times > 1) | (np.bincount(places, weights=flags) > 0)
        full = prints[again] + (int(key[0]) << (FINGERPRINT_BITS - owner_bits))
        prefix = np.unique(full >> (FINGERPRINT_BITS - _PREFIX_BITS))
        numbers, rows = prefix >> _BITMAP_BITS, []
        for number in np.unique(numbers):
            bits = np.zeros(1 << _BITMAP_BITS, dtype=np.uint8)
            bits[prefix[numbers == number] & ((1 << _BITMAP_BITS) - 1)] = 1
            rows.append((int(number), np.packbits(bits, bitorder="little").tobytes()))
        return pd.DataFrame(rows, columns=["bitmap_no", "bitmap"])

    sent = hashed.mapInArrow(send, "owner int, n int, k int, unary binary, rest binary, twice binary")
    return sent.groupBy("owner").applyInPandas(answer, "bitmap_no long, bitmap binary")


def _normalised(docs: DataFrame, id_col: str, text_col: str, *carried: Column) -> DataFrame:
    """doc_id, code points n, normalised text ``bare``, and what is carried along."""
    text = F.coalesce(named(text_col), F.lit(""))
    return docs.select(
        *carried, named(id_col).cast("long").alias("doc_id"), F.length(text).alias("n"), squeezed(text).alias("bare")
    )


def _digest() -> Column:
    return F.unhex(F.sha2(F.col("bare"), 256))


def _groups(suspects: DataFrame) -> DataFrame:
    """(digest, group_size, first_id) of each text that more than one suspect has, compared by bytes.

    Length and id make one whole number, so that the sums of a text have a fixed width
    and are taken before the shuffle.
    """
    order = F.expr(
        f"cast(n as decimal(38,0)) * {_ID_SPAN} - coalesce(cast(doc_id as decimal(20,0)), {_NO_ID})"
    ).cast("decimal(38,0)")
    return (
        suspects.groupBy("bare")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("n").alias("longest"), F.max(order).alias("best"))
        .where("group_size > 1")
        .select(
            _digest().alias("digest"),
            "group_size",
            F.expr(f"cast(longest as decimal(38,0)) * {_ID_SPAN} - best").alias("first"),
        )
        .selectExpr("digest", "group_size", f"if(first = {_NO_ID}, null, cast(first as long)) as first_id")
    )


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept and text_sha256.

    Texts are equal if they are after deleting all white space; null counts as empty.
    Of equal texts the one with the most code points, then the smallest id, stays.
    Repeated rows count in group_size and share the ``kept`` of their id; a null id
    comes after all others. Ids are whole numbers.
    """
    texts = _normalised(docs, id_col, text_col)
    fingerprint = F.xxhash64("bare")
    bitmaps = duplicate_bitmaps(texts.select(fingerprint.alias("h")))
    groups = _groups(marked_by_bitmaps(texts, fingerprint, bitmaps, "suspect").where("suspect"))
    rows = texts.select("doc_id", _digest().alias("digest"))
    alone = F.col("group_size").isNull()
    return rows.join(groups, "digest", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("doc_id").eqNullSafe(F.col("first_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with exactly one row of each group of equal texts.

    Rows that are no suspects pass without a shuffle. Of repeated rows one stays.
    """
    whole = F.struct(*(named(c) for c in docs.columns)).alias("whole")
    texts = _normalised(docs, id_col, text_col, whole)
    fingerprint = F.xxhash64("bare")
    bitmaps = duplicate_bitmaps(texts.select(fingerprint.alias("h")))
    marked = marked_by_bitmaps(texts, fingerprint, bitmaps, "suspect")
    suspects = marked.where("suspect")
    best = (
        suspects.withColumn("digest", _digest())
        .join(_groups(suspects), "digest", "left")
        .where("group_size is null or doc_id <=> first_id")
        .dropDuplicates(["digest"])
    )
    return marked.where("not suspect").select("whole.*").unionAll(best.select("whole.*"))

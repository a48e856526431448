"""Token counts of a byte-level BPE vocabulary by rank-synchronous merging.

Pre-tokens of a batch lie in one ragged array of symbols. Each round looks up the
ranks of all neighbouring pairs, takes the lowest rank of every sequence and
applies that pair everywhere in its sequence at once; sequences without a known
pair leave. What survives is the number of tokens.

A merge can only make pairs of higher rank than its own, so joining all places of
the lowest pair at once gives the same symbols as joining them one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import id_and_text

# The pre-token pattern of byte-level vocabularies.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Counts of short pre-tokens are kept between texts; at most so many, then afresh.
_REMEMBERED = 400_000
_REMEMBERED_CHARS = 40
# Characters of text whose pre-tokens are held at once.
_CHUNK_CHARS = 2_000_000
_NO_RANK = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in vocabulary files."""
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(moved)) for b in range(256)]


class MergeTable:
    """Symbols of the bytes and ranks of the pairs, as arrays; a few MB for any vocabulary file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, pre = told["model"], told["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and told["normalizer"] is None
            and pre == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
            and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "end_of_word_suffix"))
            and not any(a[k] for a in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip"))
        )
        if not plain:
            raise ValueError(f"{path}: only plain byte-level BPE is supported")
        ids = model["vocab"]
        self.width = max(ids.values()) + 1
        self.of_byte = np.array([ids[s] for s in byte_symbols()], dtype=np.int64)
        pairs = np.array([(ids[a], ids[b], ids[a + b]) for a, b in model["merges"]], dtype=np.int64)
        keys = pairs[:, 0] * self.width + pairs[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.joined = keys[order], order.astype(np.int32), pairs[order, 2]
        # Joining all places of the lowest pair at once needs that what a merge makes has later pairs only.
        made = np.full(self.width, -1, dtype=np.int64)
        np.maximum.at(made, pairs[:, 2], np.arange(len(pairs)))
        if (made[pairs[:, :2]] >= np.arange(len(pairs))[:, None]).any():
            raise ValueError(f"{path}: a pair ranks before the merge that makes its part")
        # Special strings stand for one token each; the longest wins where several begin.
        self.special = sorted((a["content"] for a in told["added_tokens"]), key=len, reverse=True)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NO_RANK``: none) and its place in the table."""
        keys = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NO_RANK), at

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Tokens of each non-empty byte sequence."""
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        out = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(owner)])
            out[owner[first]] = sizes
            rank, at = self.find(symbols[:-1], symbols[1:])
            rank[first[1:] - 1] = _NO_RANK  # no pair reaches over the end of a sequence
            rank = np.r_[rank, np.int32(_NO_RANK)]
            lowest = np.minimum.reduceat(rank, first)
            hit = np.flatnonzero((rank == np.repeat(lowest, sizes)) & (rank != _NO_RANK))
            if not len(hit):
                break
            # In a run of equal symbols the pairs overlap: every other one is joined.
            begins = np.r_[True, np.diff(hit) != 1]
            run = np.maximum.accumulate(np.where(begins, hit, 0))
            hit = hit[(hit - run) % 2 == 0]
            symbols[hit] = self.joined[at[hit]]
            stays = np.repeat(lowest != _NO_RANK, sizes)
            stays[hit + 1] = False
            symbols, owner = symbols[stays], owner[stays]
        return out


class Counter:
    """Counts the tokens of texts, remembering the counts of short pre-tokens."""

    def __init__(self, table: MergeTable) -> None:
        self.table = table
        self.find = regex.compile(PRE_TOKEN).findall
        self.split = regex.compile("|".join(map(regex.escape, table.special))).split if table.special else None
        self.known: dict[str, int] = {}

    def pre_tokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of a text and the special strings between them."""
        parts = self.split(text) if self.split else [text]
        if len(parts) == 1:
            return self.find(text), 0
        return [t for p in parts for t in self.find(p)], len(parts) - 1

    def _flush(self, held: list[tuple[list[str], int]]) -> Iterator[int]:
        new = list({t for tokens, _ in held for t in tokens} - self.known.keys())
        extra: dict[str, int] = {}
        if new:
            for token, n in zip(new, self.table.counts([t.encode() for t in new]).tolist(), strict=True):
                (self.known if len(token) <= _REMEMBERED_CHARS else extra)[token] = n
        known = self.known | extra if extra else self.known
        for tokens, special in held:
            yield sum(map(known.__getitem__, tokens)) + special
        if len(self.known) > _REMEMBERED:
            self.known.clear()

    def counts(self, texts: Iterable[str]) -> Iterator[int]:
        held, chars = [], 0
        for text in texts:
            held.append(self.pre_tokens(text))
            chars += len(text)
            if chars >= _CHUNK_CHARS:
                yield from self._flush(held)
                held, chars = [], 0
        yield from self._flush(held)


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 512,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    The vocabulary is read once on the driver and sent as a few MB of arrays; the
    rest is one pass without a shuffle. A null or empty text has no tokens, special
    strings count as one token each, null ids and repeated rows stay as they are.
    """
    table = docs.sparkSession.sparkContext.broadcast(MergeTable(tokenizer_path))

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(table.value)
        for texts in batches:
            yield pd.Series(np.fromiter(counter.counts(texts), dtype=np.int64, count=len(texts)))

    return id_and_text(docs, id_col, text_col).select(
        "doc_id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        counted("text").alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

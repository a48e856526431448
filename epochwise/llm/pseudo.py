"""Masked pseudo-likelihood of documents under a bidirectional window network.

1. Words of the whole corpus are counted. All that occur ``MIN_COUNT`` times are the
   vocabulary, however many they are; the others have hashed symbols within their
   length. Vocabulary symbols form classes of about equal mass, in order of frequency.
2. Texts become arrays of symbols, written once.
3. The network sums an embedding for each place of a window around a token (two on
   either side, never the token itself), takes the hyperbolic tangent, and predicts
   the token's class, then the token within it: by decisions down a binary tree over
   the class, each of which depends on the hidden state too and starts from the shares
   in the corpus. It is trained in numpy where the texts are: each round every task runs over its part of
   the corpus, and Spark averages the parameters by tokens. All rounds together read
   every document once.
4. A document's score is the sum of the log-probabilities of its tokens.
"""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.llm.common import SPACE_CLASS, id_and_text
from epochwise.storage import stage

# A word that occurs so often has a symbol of its own; rarer ones share hashed symbols.
MIN_COUNT = 10
# Hashed symbols for each length.
BUCKETS = 4096
# Parameter rows of a place and of the tree nodes: the first half is each a symbol's (node's) own,
# in order of frequency, the others are shared by all that follow.
TABLE_ROWS = 16_384
CLASSES = 24
WIDTH = 8
ROUNDS = 2
PLACES = (-2, -1, 1, 2)
_BATCH = 4096
_RATE = 0.5
# Characters of text encoded at once; one text at least.
_TEXT_CHARS = 16_000_000
# Tokens held at once, and scored at once.
_CHUNK = 200_000
_SCORED = 16_384
# Longest length with a symbol of its own for words outside the vocabulary.
_LENGTHS = 16
_BLOCK = 4096
_OTHER_SPACES = "\t\n\x0b\x0c\r"


class Symbols:
    """Words and their symbols: lengths first (0: no word, beyond the text), the vocabulary, hashed other words.

    ``hashed`` has a row (length, bucket, tokens, distinct words) for each bucket that
    occurs. Without it the other words of a length are one symbol.
    """

    def __init__(
        self,
        words: list[str],
        counts: list[int],
        rest: dict[int, tuple[int, int]],
        classes: int,
        hashed: list[tuple[int, int, int, int]] | None = None,
    ) -> None:
        hashed = sorted(hashed or [], key=lambda x: (-x[2], x[0], x[1]))
        self.ids = {w: _LENGTHS + 1 + i for i, w in enumerate(words)}
        first = _LENGTHS + 1 + len(words)
        self.buckets = {x[0] * BUCKETS + x[1]: first + i for i, x in enumerate(hashed)}
        self.size = first + len(hashed)
        mass = np.array(counts, dtype=np.float64)
        before = np.cumsum(mass) - mass
        own = np.minimum(classes - 1, (before / max(1.0, mass.sum()) * classes).astype(np.int64))
        lengths = np.array([x[0] for x in hashed], dtype=np.int64)
        # Classes: one for each length of other words, then the frequency classes.
        self.class_of = np.r_[np.arange(_LENGTHS + 1), _LENGTHS + 1 + own, lengths].astype(np.int64)
        self.classes = _LENGTHS + 1 + classes
        every = np.r_[np.zeros(_LENGTHS + 1), mass, np.array([x[2] for x in hashed], dtype=np.float64)]
        total = np.bincount(self.class_of, weights=every, minlength=self.classes)
        share = np.zeros(self.size)
        share[_LENGTHS + 1 :] = np.log(every[_LENGTHS + 1 :] / total[self.class_of[_LENGTHS + 1 :]])
        # What is left below a leaf of the tree: each word of a length, or of a bucket, alike.
        self.below = np.zeros(self.size)
        for length, (_, distinct) in rest.items():
            self.below[length] = -np.log(max(1, distinct))
        self.below[first:] = -np.log(np.array([max(1, x[3]) for x in hashed], dtype=np.float64))
        self.within = (share + self.below).astype(np.float32)
        self._grow(every)

    def _grow(self, mass: np.ndarray) -> None:
        """A binary tree over each class, halved by mass; ``leaf`` and ``up`` lead to the root.

        ``depth`` is the number of decisions. The others hold 0 (root) or the number of the node above plus one, negative on its right side.
        """
        order = np.lexsort((-mass[_LENGTHS + 1 :], self.class_of[_LENGTHS + 1 :])) + _LENGTHS + 1
        sums = np.r_[0.0, np.cumsum(mass[order])]
        self.leaf, self.depth = np.zeros(self.size, dtype=np.int32), np.zeros(self.size, dtype=np.int16)
        starts = np.flatnonzero(np.r_[True, np.diff(self.class_of[order]) != 0]) if len(order) else np.zeros(0, dtype=np.int64)
        lo, hi, code = starts, np.r_[starts[1:], len(order)][: len(starts)], np.zeros(len(starts), dtype=np.int64)
        made, level, up, prior, weight = 0, 0, [], [], []
        while len(lo):
            single = hi - lo == 1
            self.leaf[order[lo[single]]], self.depth[order[lo[single]]] = code[single], level
            level += 1
            lo, hi, code = lo[~single], hi[~single], code[~single]
            mid = np.clip(np.searchsorted(sums, (sums[lo] + sums[hi]) / 2), lo + 1, hi - 1)
            up.append(code)
            prior.append(np.log((sums[mid] - sums[lo]) / (sums[hi] - sums[mid])))
            weight.append(sums[hi] - sums[lo])
            own = made + 1 + np.arange(len(lo))
            made += len(lo)
            lo, hi, code = np.r_[lo, mid], np.r_[mid, hi], np.r_[own, -own]
        empty = [np.zeros(0)]
        self.up = np.concatenate(up or empty).astype(np.int32)
        self.prior = np.concatenate(prior or empty).astype(np.float32)
        self.node_row = np.zeros(made, dtype=np.int64)
        self.node_row[np.argsort(-np.concatenate(weight or empty), kind="stable")] = table_rows(np.arange(made))

    def deepest_first(self, target: np.ndarray) -> np.ndarray:
        """The order of tokens in which those with most decisions come first."""
        return np.argsort(-self.depth[target], kind="stable")

    def levels(self, target: np.ndarray) -> Iterator[np.ndarray]:
        """Level by level from the leaf up, node and side (as in ``leaf``) of the tokens that have a decision
        there: of tokens in that order, the first ones.
        """
        code = self.leaf[target]
        for size in (len(target) - np.cumsum(np.bincount(self.depth[target]))[:-1]).tolist():
            code = code[:size]
            yield code
            code = self.up[np.abs(code) - 1]

    def without_words(self) -> Symbols:
        """A copy that cannot encode, for tasks that read symbols only."""
        light = copy.copy(self)
        light.ids, light.buckets = {}, {}
        return light

    def _other(self, word: str) -> int:
        length = min(len(word), _LENGTHS)
        return self.buckets.get(length * BUCKETS + zlib.crc32(word.encode()) % BUCKETS, length)

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Symbols of each text; Arrow splits the texts, and each distinct word is looked up once."""
        lowered = [text.lower() for text in texts]
        for space in _OTHER_SPACES:
            lowered = [text.replace(space, " ") for text in lowered]
        split = pc.split_pattern(pa.array(lowered, pa.large_string()), " ")
        coded, get = split.values.dictionary_encode(), self.ids.get
        # No word has symbol 0, and there is none between two spaces.
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        found = np.array([(get(w) or self._other(w)) if w else 0 for w in words], dtype="<u4")[coded.indices.to_numpy()]
        held = np.r_[0, np.cumsum(found != 0)][split.offsets.to_numpy()].tolist()
        found = found[found != 0]
        return [found[a:b] for a, b in zip(held[:-1], held[1:], strict=True)]


def table_rows(number: np.ndarray) -> np.ndarray:
    """The parameter row of a symbol or node."""
    half = TABLE_ROWS // 2
    return np.where(number < half, number, half + number % half)


def count_words(texts: DataFrame, min_count: int = MIN_COUNT, classes: int = CLASSES) -> Symbols:
    """Vocabulary and other words of all texts; the driver gets the vocabulary and a row per bucket that occurs."""
    words = texts.select(F.explode(F.split(F.lower("text"), SPACE_CLASS + "+")).alias("word")).where("word <> ''")
    counts = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    top = counts.where(F.col("n") >= min_count).toArrow()
    frequent = sorted(zip(top["n"].to_pylist(), top["word"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
    others = (
        counts.where(F.col("n") < min_count)
        .groupBy(
            F.least(F.length("word"), F.lit(_LENGTHS)).alias("length"), (F.crc32("word") % BUCKETS).cast("int").alias("bucket")
        )
        .agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("distinct"))
        .toArrow()
    )
    hashed = list(zip(*(others[c].to_pylist() for c in ("length", "bucket", "n", "distinct")), strict=True))
    rest: dict[int, tuple[int, int]] = {}
    for length, _, n, distinct in hashed:
        before = rest.get(length, (0, 0))
        rest[length] = (before[0] + n, before[1] + distinct)
    return Symbols([w for _, w in frequent], [n for n, _ in frequent], rest, classes, hashed)


class Network:
    """Parameters as one flat array: embeddings per place, hidden bias, output weights and bias, tree nodes."""

    def __init__(self, size: int, classes: int, width: int = WIDTH) -> None:
        rows = min(size, TABLE_ROWS)
        self.shapes = [(len(PLACES), rows, width), (width,), (width, classes), (classes,), (rows, width)]
        draw = np.random.Generator(np.random.PCG64(7))
        first = draw.normal(0, 0.1, self.shapes[0]), np.zeros(width), draw.normal(0, 0.1, self.shapes[2]), np.zeros(classes)
        first += (np.zeros(self.shapes[4]),)  # at first, decisions follow the shares in the corpus
        self.set(np.concatenate([p.ravel() for p in first]).astype(np.float32))

    def set(self, flat: np.ndarray) -> None:
        self.flat, at, parts = flat.astype(np.float32), 0, []
        for shape in self.shapes:
            size = int(np.prod(shape))
            parts.append(self.flat[at : at + size].reshape(shape))
            at += size
        self.embed, self.bias, self.out, self.out_bias, self.nodes = parts

    def hidden(self, window: np.ndarray) -> np.ndarray:
        """Hidden states of windows of parameter rows."""
        total = np.take(self.embed[0], window[0], axis=0)
        for k in range(1, len(PLACES)):
            total += np.take(self.embed[k], window[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def _logits(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes x tokens), so that sums and maxima over the classes run along the tokens, and what to take off."""
        logits = self.out.T @ hidden.T
        logits += self.out_bias[:, None]
        logits -= logits.max(axis=0)
        return logits, np.log(_column_sums(np.exp(logits)))

    def log_class(self, hidden: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Log-probabilities of the tokens' classes."""
        logits, off = self._logits(hidden)
        return logits[goal, np.arange(len(goal))] - off

    def _decisions(self, states: np.ndarray, order: np.ndarray, target: np.ndarray, symbols: Symbols) -> Iterator[tuple[np.ndarray, ...]]:
        """Of each level of decisions: node rows, sides, logits, and the nodes by component.

        The first tokens in this order have a decision on the level; ``states`` are theirs, by component.
        """
        for code in symbols.levels(target[order]):
            node, side = np.abs(code) - 1, np.sign(code).astype(np.float32)
            row = symbols.node_row[node]
            own = np.ascontiguousarray(np.take(self.nodes, row, axis=0).T)
            yield row, side, symbols.prior[node] + np.einsum("ij,ij->j", states[:, : len(row)], own), own

    def log_within(self, hidden: np.ndarray, target: np.ndarray, symbols: Symbols) -> np.ndarray:
        """Log-probabilities of tokens within their classes, given the hidden state."""
        order = symbols.deepest_first(target)
        states, lost = np.ascontiguousarray(np.take(hidden, order, axis=0).T), np.zeros(len(target))
        for _, side, z, _ in self._decisions(states, order, target, symbols):
            z *= -side
            lost[: len(z)] += np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))
        out = symbols.below[target]
        out[order] -= lost
        return out

    def _within_errors(self, hidden: np.ndarray, target: np.ndarray, symbols: Symbols, rate: float) -> np.ndarray:
        """Errors of the decisions, sent back to the hidden state; moves the nodes by their means."""
        order = symbols.deepest_first(target)
        states = np.ascontiguousarray(np.take(hidden, order, axis=0).T)
        total = int(symbols.depth[target].sum())
        back, rows, near, at = np.zeros(states.shape), np.empty(total, dtype=np.int64), np.empty((len(states), total)), 0
        for row, side, z, own in self._decisions(states, order, target, symbols):
            n = len(row)
            error = -side / (1 + np.exp(np.clip(side * z, -30, 30)))
            own *= error
            back[:, :n] += own.astype(np.float64)
            rows[at : at + n] = row
            near[:, at : at + n] = states[:, :n] * error
            at += n
        self._move(self.nodes, rows, near, rate)
        out = np.empty(hidden.shape, dtype=np.float32)
        out[order] = back.T
        return out

    @staticmethod
    def _move(table: np.ndarray, rows: np.ndarray, errors: np.ndarray, rate: float) -> None:
        """Sums by row over a batch, errors by component; each row moves by its mean, damped where it is rare."""
        scale = rate / (np.bincount(rows, minlength=len(table)) + 16)
        for column, error in zip(table.T, errors, strict=True):
            column -= np.bincount(rows, weights=error, minlength=len(table)) * scale

    def _move_few(self, window: np.ndarray, errors: np.ndarray, rate: float) -> None:
        """The same for the embeddings of each place, of which a batch has few rows."""
        used = np.zeros(self.embed.shape[1], dtype=bool)
        used[window] = True
        hit, place = np.flatnonzero(used), np.cumsum(used) - 1
        for table, rows in zip(self.embed, place[window], strict=True):
            few = np.take(table, hit, axis=0)
            self._move(few, rows, errors, rate)
            table[hit] = few

    def learn(self, window: np.ndarray, target: np.ndarray, symbols: Symbols, rate: float) -> None:
        """One step down the mean gradient of a batch; rare symbols step by their own rows only."""
        n, goal = len(target), symbols.class_of[target]
        hidden = self.hidden(window)
        error, off = self._logits(hidden)
        error -= off
        np.exp(error, out=error)
        error[goal, np.arange(n)] -= 1
        error = np.ascontiguousarray(error.T)
        back = error @ self.out.T + self._within_errors(hidden, target, symbols, rate)
        back *= 1 - hidden * hidden
        self.out -= rate / n * (hidden.T @ error)
        self.out_bias -= rate / n * error.sum(axis=0)
        self.bias -= rate / n * back.sum(axis=0)
        self._move_few(window, back.T.astype(np.float64), rate)


def _column_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the first axis, eight running ones added in pairs."""
    whole = len(x) // 8 * 8
    part = x[:8].copy()
    for at in range(8, whole, 8):
        part += x[at : at + 8]
    total = ((part[0] + part[1]) + (part[2] + part[3])) + ((part[4] + part[5]) + (part[6] + part[7]))
    for rest in x[whole:]:
        total += rest
    return total


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places x tokens) parameter rows of the neighbours of all tokens, 0 beyond a text, and the tokens."""
    pad, reach = np.zeros(max(map(abs, PLACES)), dtype=np.int64), max(map(abs, PLACES))
    line = np.concatenate([pad, *(p for x in ids for p in (x.astype(np.int64), pad))])
    at = np.flatnonzero(line)
    assert reach == len(pad)
    rows = table_rows(line)
    return np.stack([rows[at + p] for p in PLACES]), line[at]


def _chunks(rows: list[bytes]) -> Iterator[list[np.ndarray]]:
    held, size = [], 0
    for row in rows:
        held.append(np.frombuffer(row, dtype="<u4"))
        size += len(held[-1])
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _text_chunks(texts: list[str]) -> Iterator[list[str]]:
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= _TEXT_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def _average(trained: DataFrame, size: int) -> np.ndarray:
    """Parameters averaged by tokens; each block is summed by Spark, the driver gets one array."""

    def add(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(v, dtype="<f4").astype(np.float64) * n for v, n in zip(parts["v"], parts["n"], strict=True))
        return pd.DataFrame({"block": [key[0]], "v": [(total / parts["n"].sum()).astype("<f4").tobytes()]})

    flat = np.zeros(size, dtype=np.float32)
    for row in trained.groupBy("block").applyInPandas(add, "block int, v binary").collect():
        part = np.frombuffer(row.v, dtype="<f4")
        flat[row.block * _BLOCK :][: len(part)] = part
    return flat


def train(encoded: DataFrame, symbols: Symbols, rounds: int = ROUNDS) -> Network:
    """Each round takes the documents of one remainder of the row hash, so all are read once."""
    network = Network(symbols.size, symbols.classes)
    sent = encoded.sparkSession.sparkContext.broadcast(symbols.without_words())
    for turn in range(rounds):
        start, rate = network.flat.copy(), _RATE / (1 + turn)

        def run(batches: Iterator[pd.DataFrame], start: np.ndarray = start, rate: float = rate) -> Iterator[pd.DataFrame]:
            symbols, tokens = sent.value, 0
            own = Network(symbols.size, symbols.classes)
            own.set(start)
            for batch in batches:
                for ids in _chunks(batch["ids"].tolist()):
                    window, target = windows(ids)
                    for at in range(0, len(target), _BATCH):
                        own.learn(window[:, at : at + _BATCH], target[at : at + _BATCH], symbols, rate)
                    tokens += len(target)
            if tokens:
                blocks = range(0, len(own.flat), _BLOCK)
                parts = [own.flat[b : b + _BLOCK].astype("<f4").tobytes() for b in blocks]
                yield pd.DataFrame({"block": range(len(parts)), "n": float(tokens), "v": parts})

        part = encoded.where((F.col("turn") == turn) & (F.length("ids") > 0)).select("ids")
        trained = stage(part.mapInPandas(run, "block int, n double, v binary"), "trained")
        if not trained.isEmpty():
            network.set(_average(trained, len(start)))
    return network


def document_scores(network: Network, symbols: Symbols, ids: list[np.ndarray]) -> np.ndarray:
    """Summed conditional log-probabilities of each text's tokens."""
    window, target = windows(ids)
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    out = np.zeros(len(ids))
    for at in range(0, len(target), _SCORED):
        own = target[at : at + _SCORED]
        hidden = network.hidden(window[:, at : at + _SCORED])
        log_p = network.log_class(hidden, symbols.class_of[own]) + network.log_within(hidden, own, symbols)
        out += np.bincount(owner[at : at + _SCORED], weights=log_p, minlength=len(ids))
    return out


def pseudo_likelihood(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_tokens, score (summed) and mean_score of every whole text.

    Tokens are lower-cased words; those that occur ``min_count`` times have symbols of
    their own. Null, empty and wordless texts have no tokens, score 0
    and a null mean. Null ids and repeated rows stay as they are.
    """
    texts = id_and_text(docs, id_col, text_col)
    symbols = count_words(texts, min_count)
    sent = docs.sparkSession.sparkContext.broadcast(symbols)

    @F.pandas_udf("binary")
    def encoded_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            parts = (sent.value.encode_all(texts) for texts in _text_chunks(batch.tolist()))
            yield pd.Series([ids.tobytes() for part in parts for ids in part], dtype="object")

    encoded = stage(
        texts.select("doc_id", encoded_ids("text").alias("ids")).withColumn("turn", F.pmod(F.xxhash64("ids"), F.lit(rounds))),
        "encoded",
    )
    network = train(encoded, symbols, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(network.flat)
    light = docs.sparkSession.sparkContext.broadcast(symbols.without_words())

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Network(light.value.size, light.value.classes)
        own.set(shared.value)
        for batch in batches:
            parts = [document_scores(own, light.value, ids) for ids in _chunks(batch.tolist())]
            yield pd.Series(np.concatenate([np.zeros(0), *parts]))

    n = (F.length("ids") / 4).cast("long")
    return encoded.select("doc_id", n.alias("n_tokens"), scored("ids").alias("score")).withColumn(
        "mean_score", F.expr("try_divide(score, n_tokens)")
    )

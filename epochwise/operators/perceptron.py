"""Multilayer perceptrons trained where the rows are, with weight penalty and early stopping.

In a round every block trains on its own rows, in small batches, from the parameters that
the round began with; the mean of what the blocks arrive at, weighted by their rows, begins
the next one. A tenth of the rows, chosen by a hash of their ids, is never trained on:
before it trains, each block counts how many of its held-out rows the incoming parameters
get right. A model stops when this share has not grown for ten rounds, and keeps its best
parameters. Models that differ in penalty or in the rows they do without share the
passes. Parameters and counts are all that moves; orders of rows are hashes of the round
and the block, so a block that is trained again arrives at the same parameters.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators.boosted import with_part_codes
from epochwise.operators.row_blocks import NONE, NUMBER_BITS, rows_of, sums_by_key, width_of, write_blocks
from epochwise.operators.splits import ROW_ID
from epochwise.storage import new_path, stage

SEED = 42
# Hidden layers, penalties and rounds.
HIDDEN = (256, 128, 64)
ALPHAS = (1e-6, 1e-4)
MAX_ROUNDS = 30_000
PATIENCE, LEAST_GAIN, HELD_OUT = 10, 1e-4, 0.1
BATCH, STEP = 32, 1e-3
# Batches of a round at least: a block of few rows goes through them more than once.
LEAST_BATCHES = 32
# Parameters of all models that are trained at the same time.
_MOST_NUMBERS = 4_000_000


@dataclass(frozen=True)
class Task:
    """One model: its penalty, and the part and the fold that it does without."""

    alpha: float = 1e-4
    part: int = NONE
    fold: int = NONE

    def kept(self, part: np.ndarray, fold: np.ndarray) -> np.ndarray:
        return ((self.part == NONE) | (part != self.part)) & ((self.fold == NONE) | (fold != self.fold))


def shapes(width: int, hidden: Sequence[int] = HIDDEN) -> list[tuple[int, int]]:
    sizes = [width, *hidden, 1]
    return list(zip(sizes[:-1], sizes[1:], strict=True))


def _layers(flat: np.ndarray, sizes: Sequence[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views (weights, intercepts) of a flat vector of parameters."""
    out, at = [], 0
    for n, m in sizes:
        out.append((flat[at : at + n * m].reshape(n, m), flat[at + n * m : at + n * m + m]))
        at += n * m + m
    return out


def first_parameters(sizes: Sequence[tuple[int, int]], seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for n, m in sizes:
        limit = np.sqrt(6 / (n + m))
        parts += [rng.uniform(-limit, limit, n * m), rng.uniform(-limit, limit, m)]
    return np.concatenate(parts).astype(np.float32)


def log_odds(flat: np.ndarray, sizes: Sequence[tuple[int, int]], x: np.ndarray) -> np.ndarray:
    layers = _layers(flat, sizes)
    for w, b in layers[:-1]:
        x = np.maximum(x @ w + b, 0)
    w, b = layers[-1]
    return (x @ w + b)[:, 0]


def gradient(flat: np.ndarray, sizes: Sequence[tuple[int, int]], x: np.ndarray, y: np.ndarray, alpha: float) -> np.ndarray:
    """Of the mean log loss of a batch plus alpha / (2 n) times the squared weights."""
    layers, held = _layers(flat, sizes), [x]
    for w, b in layers[:-1]:
        held.append(np.maximum(held[-1] @ w + b, 0))
    w, b = layers[-1]
    out = np.zeros_like(flat)
    back = ((1 / (1 + np.exp(-(held[-1] @ w + b)))) - y[:, None]) / len(x)
    for (w, _), (gw, gb), a in reversed(list(zip(layers, _layers(out, sizes), held, strict=True))):
        gw[:] = a.T @ back + alpha / len(x) * w
        gb[:] = back.sum(axis=0)
        back = (back @ w.T) * (a > 0)
    return out


def train_locally(flat: np.ndarray, sizes: Sequence[tuple[int, int]], x: np.ndarray, y: np.ndarray, alpha: float, rng: np.random.Generator) -> np.ndarray:
    """One round over the rows in small batches, with moments of the gradients."""
    flat, one, two = flat.copy(), np.zeros_like(flat), np.zeros_like(flat)
    if not len(x):
        return flat
    times = -(-LEAST_BATCHES // -(-len(x) // BATCH))
    batches = [order[at : at + BATCH] for order in (rng.permutation(len(x)) for _ in range(times)) for at in range(0, len(x), BATCH)]
    for n, some in enumerate(batches, start=1):
        g = gradient(flat, sizes, x[some], y[some], alpha)
        one += 0.1 * (g - one)
        two += 0.001 * (g * g - two)
        flat -= np.float32(STEP * np.sqrt(1 - 0.999**n) / (1 - 0.9**n)) * one / (np.sqrt(two) + np.float32(1e-8))
    return flat


@dataclass(frozen=True)
class Fitted:
    sizes: list[tuple[int, int]]
    tasks: list[Task]
    parameters: np.ndarray  # models x numbers
    held_out: np.ndarray  # best share of held-out rows that were right
    rounds: np.ndarray


_MEAN = "key int, v binary, counts array<double>"


def _mean(key: int, v: np.ndarray) -> dict:
    """A model's mean parameters, taken where the sums are, and its counts; the first of them is of trained rows."""
    counts = v[-4:]
    return {"key": key, "v": (v[:-4] / max(counts[0], 1.0)).astype("<f4").tobytes(), "counts": counts.tolist()}


def fit(
    blocks: DataFrame, tasks: Sequence[Task], hidden: Sequence[int] = HIDDEN, max_rounds: int = MAX_ROUNDS, seed: int = SEED
) -> Fitted:
    """Train all ``tasks`` together; ``blocks`` hold one random number for each row.

    Where no row at all is held out, the rows that were trained on are counted instead.
    """
    tasks, sizes = list(tasks), shapes(width_of(blocks), hidden)
    start = first_parameters(sizes, seed)
    now = np.tile(start, (len(tasks), 1))
    best, score = now.copy(), np.full(len(tasks), -1.0)
    waited, rounds, active = np.zeros(len(tasks), int), np.zeros(len(tasks), int), np.ones(len(tasks), dtype=bool)
    limit = int(HELD_OUT * 2.0**NUMBER_BITS)
    for n in range(max_rounds + 1):
        if not active.any():
            break
        at = np.flatnonzero(active)
        shared = blocks.sparkSession.sparkContext.broadcast((at, now[at]))

        def train(block, n=n, shared=shared) -> dict[int, np.ndarray]:
            r = rows_of(block)
            x, y, out = r.x.astype(np.float32), r.y.astype(np.float32), r.u[:, 0] < limit
            found = {}
            for i, flat in zip(*shared.value, strict=True):
                kept = tasks[i].kept(r.part, r.fold)
                right = (log_odds(flat, sizes, x) > 0) == (y > 0)
                own, rng = kept & ~out, np.random.default_rng([seed, n, int(block.id)])
                after = train_locally(flat, sizes, x[own], y[own], tasks[i].alpha, rng)
                counts = [own.sum(), (kept & out & right).sum(), (kept & out).sum(), (own & right).sum()]
                found[int(i)] = np.concatenate([after.astype(float) * own.sum(), counts])
            return found

        told = {r.key: r for r in sums_by_key(blocks, train, _mean, _MEAN, len(at) * (len(start) + 4))}
        shared.destroy()
        for i in at:
            trained, right, held, known = told[i].counts
            if not trained:
                raise ValueError("a model has no training rows")
            share = right / held if held else known / trained
            if n == 0 or share > score[i] + LEAST_GAIN:
                waited[i] = 0
            else:
                waited[i] += 1
            if share > score[i] or n == 0:
                score[i], best[i] = share, now[i]
            rounds[i], active[i] = n, waited[i] <= PATIENCE
            now[i] = np.frombuffer(told[i].v, dtype="<f4")
    return Fitted(sizes, tasks, best, score, rounds)


def _groups(blocks: DataFrame, tasks: Sequence[Task], hidden: Sequence[int]) -> Iterator[list[Task]]:
    numbers = sum(n * m + m for n, m in shapes(width_of(blocks), hidden))
    step = max(1, _MOST_NUMBERS // numbers)
    return (list(tasks[i : i + step]) for i in range(0, len(tasks), step))


def _predict(rows: DataFrame, key: Column, fitted: Fitted, of: dict[int, list[int]], path: str, part: str) -> None:
    """Append predictions of rows whose ``key`` is in ``of`` by the models listed there."""
    shared = rows.sparkSession.sparkContext.broadcast((fitted, of))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, models = shared.value
        for batch in batches:
            for code, same in batch.groupby("code"):
                x = np.stack(same["x"].to_numpy()).astype(np.float32)
                for i in models.get(int(code), []):
                    found = (log_odds(known.parameters[i], known.sizes, x) > 0).astype(np.int32)
                    yield same[[*ROW_ID, "label", "code"]].assign(alpha=known.tasks[i].alpha, prediction=found, role=part)

    schema = "SubjectID string, EpochID string, label int, code int, alpha double, prediction int, role string"
    own = rows.select(*ROW_ID, F.col("label").cast("int").alias("label"), key.cast("int").alias("code"), vector_to_array("features").alias("x"))
    own.where(F.col("code").between(min(of), max(of))).mapInPandas(run, schema).write.mode("append").parquet(path)


def leave_one_subject_out(
    rows: DataFrame, alpha: float = 1e-6, hidden: Sequence[int] = HIDDEN, max_rounds: int = MAX_ROUNDS, seed: int = SEED
) -> DataFrame:
    """SubjectID, EpochID, label and prediction of every row by a model trained without its subject."""
    coded, _, count = with_part_codes(rows)
    if count < 2:
        raise ValueError("leaving one subject out takes two subjects or more")
    held = stage(coded.select(*ROW_ID, "label", "features", "code"), "perceptron-rows")
    blocks, path = write_blocks(held, 1, seed, F.col("code")), new_path(rows.sparkSession, "perceptron-predictions")
    for tasks in _groups(blocks, [Task(alpha, part=s) for s in range(count)], hidden):
        fitted = fit(blocks, tasks, hidden, max_rounds, seed)
        _predict(held, F.col("code"), fitted, {t.part: [i] for i, t in enumerate(tasks)}, path, "cv")
    return rows.sparkSession.read.parquet(path).select(*ROW_ID, "label", "prediction")


def grid_predictions(
    train: DataFrame, test: DataFrame | None, folds: int, alphas: Sequence[float] = ALPHAS,
    hidden: Sequence[int] = HIDDEN, max_rounds: int = MAX_ROUNDS, seed: int = SEED,
) -> DataFrame:
    """Predictions for every penalty: alpha, part (cv, train, test), fold, SubjectID, EpochID, label, prediction.

    ``train`` has a column fold. A fold's rows are predicted by the model trained without
    it (cv); training and test rows by the model of all training rows (fold -1).
    """
    held = stage(train.select(*ROW_ID, "label", "features", "fold"), "perceptron-rows")
    blocks, path = write_blocks(held, 1, seed), new_path(train.sparkSession, "perceptron-predictions")
    for tasks in _groups(blocks, [Task(a, fold=f) for a in alphas for f in [*range(folds), NONE]], hidden):
        fitted, of = fit(blocks, tasks, hidden, max_rounds, seed), {}
        for i, t in enumerate(tasks):
            of.setdefault(t.fold, []).append(i)
        whole = {k: v for k, v in of.items() if k == NONE}
        if by_fold := {k: v for k, v in of.items() if k != NONE}:
            _predict(held, F.col("fold"), fitted, by_fold, path, "cv")
        if whole:
            _predict(held, F.lit(NONE), fitted, whole, path, "train")
            if test is not None:
                _predict(test, F.lit(NONE), fitted, whole, path, "test")
    return train.sparkSession.read.parquet(path).withColumnsRenamed({"code": "fold", "role": "part"})

"""Boosted trees for many left-out parts, grown level by level together.

Leaving out every subject (or every fold, or a fold of what is left without a subject)
takes as many models as there are parts. All of them read the same rows: one pass over
the blocks adds up, for each model, the histograms of its own residuals over the nodes of
the level that is being grown; Spark sums them, the best splits are found where the sums
are, and only splits come back. The number of passes is rounds times depth, whatever the
number of subjects; more models than fit together are taken in groups.

Trees follow the usual gradient boosting of the log loss: the residual is label minus
probability, splits gain n_left * n_right / n * (difference of means)^2, leaves take one
Newton step. Features are cut into bins at quantiles of all rows first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.operators.row_blocks import NONE, rows_of, summed, sums_by_key, width_of, write_blocks
from epochwise.operators.splits import ROW_ID
from epochwise.storage import new_path, stage

ROUNDS, DEPTH, RATE, BINS = 100, 3, 0.1, 32
# Rounds after which scores are written beside the rows, so that only later trees are run again.
_WRITTEN_EVERY = 10
# Numbers in the histograms of all models of a group, and rows of a block worked on at once.
_MOST_NUMBERS = 4_000_000

_BLOCK = "n int, b binary, y binary, part binary, fold binary, f binary"


@dataclass
class Trees:
    """Trees of models: models x rounds x inner nodes (feature, bin) and models x rounds x leaves."""

    exclude: list[tuple[int, int]]  # the part and the fold that each model does without
    start: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray


def bin_edges(rows: DataFrame, bins: int = BINS) -> np.ndarray:
    """Features x (bins - 1) upper limits, by approximate quantiles of all rows; as many rows as features."""
    shares = ", ".join(str(i / bins) for i in range(1, bins))
    found = (
        rows.select(F.posexplode(vector_to_array("features")).alias("pos", "v"))
        .groupBy("pos")
        .agg(F.expr(f"percentile_approx(v, array({shares}), 10000)").alias("q"))
        .collect()
    )
    return np.array([r.q for r in sorted(found, key=lambda r: r.pos)], dtype=float).reshape(len(found), bins - 1)


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of every value: values up to the first limit are in bin 0."""
    out = np.empty(x.shape, dtype=np.uint8)
    for j, limits in enumerate(edges):
        out[:, j] = np.searchsorted(limits, x[:, j], side="left")
    return out


def _binned_blocks(blocks: DataFrame, edges: np.ndarray, start: np.ndarray) -> DataFrame:
    shared = blocks.sparkSession.sparkContext.broadcast(edges)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block in batch.itertuples(index=False):
                f = np.tile(start, (block.n, 1)).astype("<f8")
                yield pd.DataFrame(
                    {"n": [block.n], "b": [binned(rows_of(block).x, shared.value).tobytes()], "y": [block.y],
                     "part": [block.part], "fold": [block.fold], "f": [f.tobytes()]}
                )

    return stage(blocks.mapInPandas(run, _BLOCK), "binned-blocks")


def _kept(part: np.ndarray, fold: np.ndarray, without: tuple[int, int]) -> np.ndarray:
    """The training rows of a model."""
    kept = np.ones(len(part), dtype=bool)
    if without[0] != NONE:
        kept &= part != without[0]
    if without[1] != NONE:
        kept &= fold != without[1]
    return kept


def _walk(b: np.ndarray, feature: np.ndarray, bin_: np.ndarray, depth: int) -> np.ndarray:
    """The node of ``depth`` that each row reaches in one tree."""
    node, row = np.zeros(len(b), dtype=np.int64), np.arange(len(b))
    for level in range(depth):
        at = node + (1 << level) - 1
        node = 2 * node + (b[row, feature[at]] > bin_[at])
    return node


def _added(f: np.ndarray, b: np.ndarray, trees: tuple[np.ndarray, np.ndarray, np.ndarray], model: int, rate: float, depth: int) -> np.ndarray:
    """One model's scores with all its trees added."""
    feature, bin_, leaf = trees
    total = f.copy()
    for t in range(feature.shape[1]):
        total += rate * leaf[model, t][_walk(b, feature[model, t], bin_[model, t], depth)]
    return total


def _split_of(hist: np.ndarray) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Best (feature, bin) of a node's histogram (features x bins x 3), and the sums left and right of it."""
    upto, total = np.cumsum(hist, axis=1), hist[0].sum(axis=0)
    left = upto[:, :-1]
    right = total - left
    n = left[..., 0] * right[..., 0]
    both = np.where(n > 0, n, 1.0)
    mean = np.where(n > 0, left[..., 1] * right[..., 0] - right[..., 1] * left[..., 0], 0.0) / both
    gain = np.where(n > 0, n / max(total[0], 1.0) * mean * mean, 0.0)
    best = int(np.argmax(gain))
    feature, at = divmod(best, gain.shape[1])
    if gain[feature, at] <= 1e-12 * max(total[0], 1.0):
        return 0, hist.shape[1], total, total  # all rows go left; both leaves alike
    return feature, at, left[feature, at], right[feature, at]


_SPLIT = "key int, feature array<int>, bin array<int>, sums array<double>"


def _grow(blocks: DataFrame, per_block: Callable[[object], dict[int, np.ndarray]], count: int, nodes: int, width: int, bins: int) -> list:
    """Sums of histograms, and on the same workers the best split of each model's nodes."""

    def best(key: int, v: np.ndarray) -> dict:
        found = [_split_of(h) for h in v.reshape(nodes, width, bins, 3)]
        sums = np.concatenate([np.concatenate(s[2:]) for s in found]).tolist()
        return {"key": key, "feature": [s[0] for s in found], "bin": [s[1] for s in found], "sums": sums}

    return sums_by_key(blocks, per_block, best, _SPLIT, count * nodes * width * bins * 3)


def fit(
    blocks: DataFrame, edges: np.ndarray, exclude: Sequence[tuple[int, int]],
    rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE,
) -> Trees:
    """Trees of one group of models: model i is trained on the rows outside ``exclude[i]`` (part, fold)."""
    exclude = list(exclude)
    count, width, bins = len(exclude), edges.shape[0], edges.shape[1] + 1

    def totals(block) -> dict[int, np.ndarray]:
        r = rows_of(block)
        kept = [_kept(r.part, r.fold, e) for e in exclude]
        return {i: np.array([k.sum(), r.y[k].sum()], dtype=float) for i, k in enumerate(kept)}

    sizes = summed(blocks, totals, 2 * count)
    if any(not sizes[i][0] for i in range(count)):
        raise ValueError("a model has no training rows")
    share = np.array([sizes[i][1] / sizes[i][0] for i in range(count)]).clip(1e-9, 1 - 1e-9)
    start = np.log(share / (1 - share))
    current = _binned_blocks(blocks, edges, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    trees = Trees(exclude, start, np.zeros((count, rounds, inner), np.int32), np.zeros((count, rounds, inner), np.int32),
                  np.zeros((count, rounds, leaves)))
    context = blocks.sparkSession.sparkContext

    def arrays(block) -> tuple[np.ndarray, ...]:
        b = np.frombuffer(block.b, dtype=np.uint8).reshape(block.n, width)
        y, part, fold = (np.frombuffer(v, dtype="<i4") for v in (block.y, block.part, block.fold))
        return b, y, part, fold, np.frombuffer(block.f, dtype="<f8").reshape(block.n, count)

    written = 0
    for t in range(rounds):
        for level in range(depth):
            shared = context.broadcast(
                ((trees.feature[:, written:t], trees.bin[:, written:t], trees.leaf[:, written:t]), trees.feature[:, t], trees.bin[:, t])
            )
            nodes = 1 << level

            def histograms(block, shared=shared, level=level, nodes=nodes) -> dict[int, np.ndarray]:
                done, feature, bin_ = shared.value
                b, y, part, fold, f = arrays(block)
                column, out = np.arange(width) * bins, {}
                for i, e in enumerate(exclude):
                    kept = _kept(part, fold, e)
                    own = b[kept]
                    p = 1 / (1 + np.exp(-_added(f[kept, i], own, done, i, rate, depth)))
                    node = _walk(own, feature[i], bin_[i], level)
                    cells = ((node * width * bins)[:, None] + column + own).ravel()
                    sums = [np.repeat(v, width) for v in (y[kept] - p, p * (1 - p))]
                    size = nodes * width * bins
                    out[i] = np.stack([np.bincount(cells, minlength=size), *(np.bincount(cells, weights=v, minlength=size) for v in sums)], axis=1)
                return out

            for row in _grow(current, histograms, count, nodes, width, bins):
                at = slice(nodes - 1, 2 * nodes - 1)
                trees.feature[row.key, t, at], trees.bin[row.key, t, at] = row.feature, row.bin
                if level == depth - 1:
                    sums = np.array(row.sums).reshape(leaves, 3)
                    trees.leaf[row.key, t] = np.where(sums[:, 2] > 1e-150, sums[:, 1] / np.where(sums[:, 2] > 1e-150, sums[:, 2], 1.0), 0.0)
            shared.destroy()
        if t + 1 - written == _WRITTEN_EVERY and t + 1 < rounds:
            done = context.broadcast(tuple(v[:, written : t + 1] for v in (trees.feature, trees.bin, trees.leaf)))

            def score(batches: Iterator[pd.DataFrame], done=done) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    for block in batch.itertuples(index=False):
                        b, *_, f = arrays(block)
                        new = np.stack([_added(f[:, i], b, done.value, i, rate, depth) for i in range(count)], axis=1)
                        yield pd.DataFrame({**{c: [getattr(block, c)] for c in ("n", "b", "y", "part", "fold")}, "f": [new.astype("<f8").tobytes()]})

            current, written = stage(current.mapInPandas(score, _BLOCK), "scored-blocks"), t + 1
    return trees


def scores(trees: Trees, model: int, b: np.ndarray, rate: float = RATE, depth: int = DEPTH) -> np.ndarray:
    """Log odds of binned rows by one model."""
    return _added(np.full(len(b), trees.start[model]), b, (trees.feature, trees.bin, trees.leaf), model, rate, depth)


def with_part_codes(rows: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Rows with a code 0, 1, ... for their subject; the codes as a written table, and their number."""
    codes = stage(
        rows.select("SubjectID").distinct().withColumn("code", F.row_number().over(Window.orderBy("SubjectID")) - 1),
        "subject-codes",
    )
    return rows.join(codes, "SubjectID"), codes, codes.count()


def _predicted(
    rows: DataFrame, key: Column, of: dict[int, int], trees: Trees, edges: np.ndarray, rate: float, depth: int, path: str, role: str = "cv"
) -> None:
    """Append predictions of the rows whose ``key`` is in ``of``, each by the model named there."""
    shared = rows.sparkSession.sparkContext.broadcast((of, trees, edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models, fitted, limits = shared.value
        for batch in batches:
            for code, same in batch.groupby("code"):
                b = binned(np.stack(same.pop("x").to_numpy()), limits)
                found = (scores(fitted, models[int(code)], b, rate, depth) > 0).astype(np.int32)
                yield same.assign(prediction=found, role=role)

    own = rows.select(
        *ROW_ID, F.col("label").cast("int").alias("label"), key.cast("int").alias("code"), vector_to_array("features").alias("x")
    ).where(F.col("code").between(min(of), max(of)))
    schema = "SubjectID string, EpochID string, label int, code int, prediction int, role string"
    own.mapInPandas(run, schema).write.mode("append").parquet(path)


def _together(width: int, depth: int, bins: int) -> int:
    return max(1, _MOST_NUMBERS // ((1 << (depth - 1)) * max(width, 1) * bins * 3))


def _groups(blocks: DataFrame, exclude: Sequence[tuple[int, int]], depth: int, bins: int) -> Iterator[list[tuple[int, int]]]:
    step = _together(width_of(blocks), depth, bins)
    return (list(exclude[i : i + step]) for i in range(0, len(exclude), step))


def leave_one_subject_out(rows: DataFrame, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> DataFrame:
    """SubjectID, EpochID, label and prediction of every row by trees grown without its subject.

    ``rows`` holds SubjectID, EpochID, label (0/1) and features. The subjects stay in a table:
    the driver knows how many there are, and holds the trees of one group of models.
    """
    coded, _, count = with_part_codes(rows)
    if count < 2:
        raise ValueError("leaving one subject out takes two subjects or more")
    held = stage(coded.select(*ROW_ID, "label", "features", "code"), "boosted-rows")
    blocks, edges = write_blocks(held, part=F.col("code")), bin_edges(held, bins)
    path = new_path(rows.sparkSession, "boosted-predictions")
    for exclude in _groups(blocks, [(s, NONE) for s in range(count)], depth, bins):
        trees = fit(blocks, edges, exclude, rounds, depth, rate)
        _predicted(held, F.col("code"), {s: i for i, (s, _) in enumerate(exclude)}, trees, edges, rate, depth, path)
    return rows.sparkSession.read.parquet(path).select(*ROW_ID, "label", "prediction")


def report_predictions(
    train: DataFrame, test: DataFrame | None, k: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS
) -> DataFrame:
    """SubjectID, EpochID, label, part (cv, train, test), fold and prediction.

    Each fold's rows by trees grown on the other folds (cv), training and test rows by
    trees grown on all training rows (fold -1).
    """
    held = stage(train.select(*ROW_ID, "label", "features", "fold"), "boosted-rows")
    blocks, edges = write_blocks(held), bin_edges(held, bins)
    path = new_path(train.sparkSession, "boosted-predictions")
    for exclude in _groups(blocks, [(NONE, f) for f in [*range(k), *([NONE] if test is not None else [])]], depth, bins):
        trees = fit(blocks, edges, exclude, rounds, depth, rate)
        of = {f: i for i, (_, f) in enumerate(exclude)}
        whole = {NONE: of.pop(NONE)} if NONE in of else {}
        if of:
            _predicted(held, F.col("fold"), of, trees, edges, rate, depth, path)
        if whole:
            _predicted(held, F.lit(NONE), whole, trees, edges, rate, depth, path, "train")
            _predicted(test, F.lit(NONE), whole, trees, edges, rate, depth, path, "test")
    return train.sparkSession.read.parquet(path).withColumnsRenamed({"code": "fold", "role": "part"})


def cross_validate(rows: DataFrame, k: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS) -> DataFrame:
    """SubjectID, EpochID, label, fold and prediction: every fold by trees grown on the others."""
    return report_predictions(rows, None, k, rounds, depth, rate, bins).drop("part")


def nested_scores(
    rows: DataFrame, k: int = 5, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS
) -> DataFrame:
    """For each left-out subject, cross-validation on the rows of all others: SubjectID, cv_mean and cv_std.

    ``rows`` has the column fold (0..k-1), the same for all subjects; a subject's models
    do without it and without one fold, and are judged on the rest of that fold.
    """
    coded, codes, count = with_part_codes(rows)
    held = stage(coded.select(*ROW_ID, "label", "features", "fold", "code"), "nested-rows")
    blocks, edges = write_blocks(held, part=F.col("code")), bin_edges(held, bins)
    step, found = max(k, _together(width_of(blocks), depth, bins) // k * k), None
    every = [(s, f) for s in range(count) for f in range(k)]
    path = new_path(rows.sparkSession, "nested-scores")
    for begin in range(0, len(every), step):
        exclude = every[begin : begin + step]
        shared = rows.sparkSession.sparkContext.broadcast((fit(blocks, edges, exclude, rounds, depth, rate), edges))

        def judge(batches: Iterator[pd.DataFrame], shared=shared, exclude=exclude) -> Iterator[pd.DataFrame]:
            trees, limits = shared.value
            for batch in batches:
                for block in batch.itertuples(index=False):
                    r = rows_of(block)
                    b = binned(r.x, limits)
                    for i, (s, f) in enumerate(exclude):
                        some = (r.part != s) & (r.fold == f)
                        right = ((scores(trees, i, b[some], rate, depth) > 0) == r.y[some]).sum()
                        yield pd.DataFrame({"code": [s], "fold": [f], "right": [int(right)], "n": [int(some.sum())]})

        blocks.mapInPandas(judge, "code int, fold int, right long, n long").write.mode("append").parquet(path)
    counted = rows.sparkSession.read.parquet(path).groupBy("code", "fold").agg((F.sum("right") / F.sum("n")).alias("accuracy"))
    return counted.join(codes, "code").groupBy("SubjectID").agg(
        F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std")
    )

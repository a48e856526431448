"""Linear classifiers of a whole grid, trained together.

A grid of bagged linear classifiers needs one weight vector for each cost, share of rows,
kind of sampling, member and held-out fold. They differ only in the weights of the rows,
so one pass over the rows serves all of them: every task multiplies its blocks by all
weight vectors at once and adds up all losses and gradients, Spark sums these, and the
driver moves each vector on by its own quasi-Newton step (a few numbers for each vector
and feature, however many rows there are). Members of a smaller ensemble are the first
members of a larger one, so the largest is trained only.

Rows lie in written blocks, next to one random number for each member that follows from
a hash of the row's id: whatever is computed again draws alike. Drawing without
replacement takes exactly ``int(rows * fraction)`` rows, those below a threshold that is
found by counting digits of the numbers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.operators.row_blocks import NONE, NUMBER_BITS, row_number, rows_of, summed, width_of, write_blocks
from epochwise.operators.splits import ROW_ID
from epochwise.storage import stage

SEED = 42
# The grid of the bagged linear classifier.
BAG_C = (0.01, 0.1, 1.0, 10.0)
BAG_MEMBERS = (5, 10, 20)
BAG_FRACTIONS = (0.1, 0.5, 1.0)
BAG_BOOTSTRAP = (False, True)

# Bits of one digit of a row's number.
_DIGIT = 10
# The hinge is rounded off over this width of the margin, so that it has a curvature.
ROUNDING = 0.1
_MEMORY = 6
# Numbers of all weight vectors that are moved at the same time.
_MOST_NUMBERS = 4_000_000
_WHOLE = NONE


@dataclass(frozen=True)
class Grid:
    """Costs, sizes of ensembles, shares of rows and kinds of sampling."""

    c: Sequence[float] = BAG_C
    members: Sequence[int] = BAG_MEMBERS
    fractions: Sequence[float] = BAG_FRACTIONS
    bootstrap: Sequence[bool] = BAG_BOOTSTRAP

    @property
    def draws(self) -> list[tuple[float, bool]]:
        return list(product(self.fractions, self.bootstrap))

    @property
    def configurations(self) -> list[tuple[float, int, float, bool]]:
        return [(c, n, f, b) for (f, b), c, n in product(self.draws, self.c, self.members)]


@dataclass(frozen=True)
class Fitted:
    """Weight vectors: parts (held-out folds, the whole last) x draws x members x costs x (features + 1)."""

    grid: Grid
    parts: list[int]
    weights: np.ndarray
    thresholds: np.ndarray  # parts x fractions x members
    passes: int


def _kept(fold: np.ndarray, part: int) -> np.ndarray:
    return np.ones(len(fold), dtype=bool) if part == _WHOLE else fold != part


def exact_thresholds(blocks: DataFrame, parts: Sequence[int], members: int, fractions: Sequence[float]) -> np.ndarray:
    """Per part, fraction and member: rows with a smaller number are int(rows * fraction) in all.

    The number of that rank is found digit by digit; a pass counts one digit of the
    numbers that share all digits found before.
    """
    digits = 1 << _DIGIT
    sizes = summed(blocks, lambda b: {p: np.array([_kept(rows_of(b).fold, p).sum()], dtype=float) for p in parts}, len(parts))
    shape = (len(parts), len(fractions), members)
    need = np.array([[[int(int(sizes[p][0]) * f)] * members for f in fractions] for p in parts], dtype=np.int64)
    if (need == 0).any():
        raise ValueError("a member would draw no training rows")
    prefix, shift = np.zeros(shape, dtype=np.int64), NUMBER_BITS
    limit = np.full(shape, -1, dtype=np.int64)
    limit[:, [i for i, f in enumerate(fractions) if f >= 1]] = 1 << NUMBER_BITS
    while shift and (limit < 0).any():
        shift -= _DIGIT
        known, at, open_ = prefix.copy(), shift, limit < 0

        def count(block) -> dict[int, np.ndarray]:
            rows = rows_of(block)
            high, digit = rows.u >> (at + _DIGIT), (rows.u >> at) & (digits - 1)
            out = {}
            for i, p in enumerate(parts):
                kept, found = _kept(rows.fold, p), np.zeros((len(fractions), members, digits))
                for f, m in np.argwhere(open_[i]):
                    here = kept & (high[:, m] == known[i, f, m])
                    found[f, m] = np.bincount(digit[here, m], minlength=digits)
                out[i] = found
            return out

        counted = summed(blocks, count, limit.size * digits)
        for i, f, m in np.argwhere(limit < 0):
            upto = np.cumsum(counted[i].reshape(len(fractions), members, digits)[f, m]).astype(np.int64)
            digit = int(np.searchsorted(upto, need[i, f, m]))
            prefix[i, f, m] = (prefix[i, f, m] << _DIGIT) + digit
            if upto[digit] == need[i, f, m] or shift == 0:
                limit[i, f, m] = (prefix[i, f, m] + 1) << shift
            else:
                need[i, f, m] -= upto[digit - 1] if digit else 0
    return limit


def _poisson_steps(mean: float) -> np.ndarray:
    """Numbers from which on a row is drawn at least once, twice, ...: Poisson draws with that mean."""
    probability = total = float(np.exp(-mean))
    steps, i = [], 0
    while 1 - total > 2.0**-30 and i < 40 + 4 * mean:
        steps.append(int(total * 2.0**NUMBER_BITS))
        i += 1
        probability *= mean / i
        total += probability
    return np.array(steps, dtype=np.int64)


def draw_weights(u: np.ndarray, grid: Grid, limits: np.ndarray) -> np.ndarray:
    """How often each row is drawn: rows x draws x members; ``limits``: fractions x members."""
    out = np.empty((len(u), len(grid.draws), u.shape[1]))
    for k, (fraction, bootstrap) in enumerate(grid.draws):
        if bootstrap:
            out[:, k] = np.searchsorted(_poisson_steps(fraction), u, side="right")
        else:
            out[:, k] = u < limits[list(grid.fractions).index(fraction)]
    return out


def _loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded hinge and its slope."""
    short = np.clip(1 - margin, 0, None)
    inside = short < ROUNDING
    return np.where(inside, short * short / (2 * ROUNDING), short - ROUNDING / 2), -np.where(inside, short / ROUNDING, 1.0)


class _Moves:
    """Quasi-Newton steps of many vectors, each at its own pace."""

    def __init__(self, x: np.ndarray) -> None:
        count, size = x.shape
        self.x, self.f, self.g = x, np.full(count, np.inf), np.zeros_like(x)
        self.s, self.y = np.zeros((count, _MEMORY, size)), np.zeros((count, _MEMORY, size))
        self.rho = np.zeros((count, _MEMORY))
        self.p, self.t, self.slope = np.zeros_like(x), np.zeros(count), np.zeros(count)
        self.active, self.quiet = np.ones(count, dtype=bool), np.zeros(count, dtype=int)

    def trial(self, at: np.ndarray) -> np.ndarray:
        return self.x[at] + self.t[at, None] * self.p[at]

    def _aim(self, at: np.ndarray) -> None:
        q, a = self.g[at].copy(), np.zeros((len(at), _MEMORY))
        for i in range(_MEMORY):
            a[:, i] = self.rho[at, i] * np.einsum("ij,ij->i", self.s[at, i], q)
            q -= a[:, i, None] * self.y[at, i]
        yy = np.einsum("ij,ij->i", self.y[at, 0], self.y[at, 0])
        first = self.rho[at, 0] > 0
        scale = np.where(first, 1 / np.where(first, self.rho[at, 0] * yy, 1.0), 1 / np.maximum(np.linalg.norm(q, axis=1), 1e-12))
        q *= scale[:, None]
        for i in reversed(range(_MEMORY)):
            b = self.rho[at, i] * np.einsum("ij,ij->i", self.y[at, i], q)
            q += (a[:, i] - b)[:, None] * self.s[at, i]
        slope = -np.einsum("ij,ij->i", q, self.g[at])
        up = slope >= 0  # not downhill: start again from the gradient
        q[up], slope[up] = self.g[at][up], -np.einsum("ij,ij->i", self.g[at][up], self.g[at][up])
        self.rho[at[up]] = 0
        self.p[at], self.slope[at], self.t[at] = -q, slope, 1.0

    def take(self, at: np.ndarray, f: np.ndarray, g: np.ndarray, tolerance: float) -> None:
        """Losses and gradients at the trial points of the vectors ``at``."""
        good = f <= self.f[at] + 1e-4 * self.t[at] * self.slope[at]
        good |= np.isinf(self.f[at])
        self.t[at[~good]] *= 0.5
        self.active[at[~good][self.t[at[~good]] < 1e-7]] = False
        won = at[good]
        step, change = self.t[won, None] * self.p[won], g[good] - self.g[won]
        curve = np.einsum("ij,ij->i", step, change)
        keep = curve > 1e-12
        for held, new in ((self.s, step), (self.y, change)):
            held[won[keep], 1:] = held[won[keep], :-1]
            held[won[keep], 0] = new[keep]
        self.rho[won[keep], 1:] = self.rho[won[keep], :-1]
        self.rho[won[keep], 0] = 1 / curve[keep]
        small = self.f[won] - f[good] <= tolerance * np.maximum(np.abs(f[good]), 1e-3)
        self.quiet[won] = np.where(small, self.quiet[won] + 1, 0)
        self.x[won] += step
        self.f[won], self.g[won] = f[good], g[good]
        flat = np.abs(self.g[won]).max(axis=1) <= tolerance
        self.active[won[(self.quiet[won] >= 2) | flat]] = False
        self._aim(won)


def fit(blocks: DataFrame, folds: int, grid: Grid, passes: int = 100, tolerance: float = 1e-5) -> Fitted:
    """All weight vectors of the grid, for every held-out fold and for all rows.

    ``blocks`` come from ``write_blocks`` with max(grid.members) members. Each vector
    minimises |w|^2 / 2 + C * sum of rounded hinge losses over its draws; the intercept is
    free. At most ``passes`` passes over the blocks are made.
    """
    members, parts = max(grid.members), [*range(folds), _WHOLE]
    limits = exact_thresholds(blocks, parts, members, grid.fractions)
    width = width_of(blocks)
    per_part = len(grid.draws) * members * len(grid.c)
    shape = (len(grid.draws), members, len(grid.c), width + 1)
    together = max(1, _MOST_NUMBERS // (per_part * (width + 1)))
    found, made = [], 0
    for begin in range(0, len(parts), together):
        some = parts[begin : begin + together]
        moves = _Moves(np.zeros((len(some) * per_part, width + 1)))
        drawn = np.zeros(len(some) * per_part)
        for n in range(passes):
            at = np.flatnonzero(moves.active)
            if not len(at):
                break
            points = blocks.sparkSession.sparkContext.broadcast((at, moves.trial(at)))

            def sums(block) -> dict[int, np.ndarray]:
                """Per part: loss, gradient and (at first) drawn rows of each of its active vectors."""
                rows = rows_of(block)
                active, vectors = points.value
                out = {}
                for i, p in enumerate(some):
                    mine = (active // per_part) == i
                    if not mine.any():
                        continue
                    kept = _kept(rows.fold, p)
                    x, y = rows.x[kept], 2.0 * rows.y[kept, None] - 1
                    w = draw_weights(rows.u[kept], grid, limits[begin + i]).reshape(len(x), -1)
                    w = w[:, active[mine] % per_part // len(grid.c)]
                    v = vectors[mine]
                    loss, slope = _loss(y * (x @ v[:, :-1].T + v[:, -1]))
                    slope *= w * y
                    out[i] = np.column_stack([(w * loss).sum(axis=0), slope.T @ x, slope.sum(axis=0), w.sum(axis=0)])
                return out

            told = summed(blocks, sums, len(at) * (width + 3))
            points.destroy()
            made += 1
            sums_of = np.concatenate([told[i].reshape(-1, width + 3) for i in sorted(told)])
            if not n:
                drawn = sums_of[:, -1]
                if (drawn == 0).any():
                    raise ValueError("a member drew no training rows")
            trial, ridge = moves.trial(at), 1 / (np.array(grid.c)[at % len(grid.c)] * drawn[at])
            f = sums_of[:, 0] / drawn[at] + ridge / 2 * (trial[:, :-1] ** 2).sum(axis=1)
            g = sums_of[:, 1:-1] / drawn[at, None]
            g[:, :-1] += ridge[:, None] * trial[:, :-1]
            moves.take(at, f, g, tolerance)
        found.append(moves.x.reshape(len(some), *shape))
    return Fitted(grid, parts, np.concatenate(found), limits, made)


def votes(fitted: Fitted, part: int, x: np.ndarray) -> np.ndarray:
    """Predictions 0/1 of every configuration: rows x configurations; ties go to 0."""
    grid, w = fitted.grid, fitted.weights[fitted.parts.index(part)]
    above = (np.einsum("nd,kmcd->nkmc", x, w[..., :-1], optimize=True) + w[..., -1]) > 0
    upto = np.cumsum(above, axis=2, dtype=np.int32)
    out = [2 * upto[:, :, n - 1, :] > n for n in grid.members]
    # rows x draws x costs x sizes, in the order of grid.configurations
    return np.stack(out, axis=3).reshape(len(x), -1).astype(np.int32)


def _counts(blocks: DataFrame, fitted: Fitted, roles: Sequence[str]) -> DataFrame:
    """(configuration, part, fold, right, n): hits of held-out folds (cv) and of the whole fit (train, test)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple[str, int], list] = {}
        for batch in batches:
            for block in batch.itertuples(index=False):
                rows = rows_of(block)
                wanted = [(r, _WHOLE, np.ones(len(rows.x), dtype=bool)) for r in roles if r != "cv"]
                if "cv" in roles:
                    wanted += [("cv", int(p), rows.fold == p) for p in np.unique(rows.fold)]
                for role, part, some in wanted:
                    right = (votes(fitted_.value, part, rows.x[some]) == rows.y[some, None]).sum(axis=0)
                    held = total.setdefault((role, part), [0, 0])
                    held[0], held[1] = held[0] + right, held[1] + int(some.sum())
        for (role, part), (right, n) in total.items():
            yield pd.DataFrame({"configuration": np.arange(len(right)), "part": role, "fold": part, "right": right, "n": n})

    fitted_ = blocks.sparkSession.sparkContext.broadcast(fitted)
    counted = blocks.mapInPandas(run, "configuration int, part string, fold int, right long, n long")
    return counted.groupBy("configuration", "part", "fold").agg(F.sum("right").alias("right"), F.sum("n").alias("n"))


def grid_scores(train: DataFrame, test: DataFrame, folds: int, grid: Grid | None = None, seed: int = SEED) -> DataFrame:
    """Accuracies of the whole grid: c, members, fraction, bootstrap, part (cv, train, test), fold, accuracy.

    ``train`` (with a column fold) and ``test`` hold SubjectID, EpochID, label and
    features. Rows with null labels or features are not meant to be here.
    """
    grid = grid or Grid()
    members = max(grid.members)
    blocks = write_blocks(train, members, seed)
    fitted = fit(blocks, folds, grid)
    counts = _counts(blocks, fitted, ["cv", "train"]).unionAll(_counts(write_blocks(test.drop("fold"), members, seed), fitted, ["test"]))
    names = train.sparkSession.createDataFrame(
        [(i, *c) for i, c in enumerate(grid.configurations)],
        "configuration int, c double, members int, fraction double, bootstrap boolean",
    )
    return counts.join(F.broadcast(names), "configuration").select(
        "c", "members", "fraction", "bootstrap", "part", "fold", (F.col("right") / F.col("n")).alias("accuracy")
    )


def grid_predictions(train: DataFrame, folds: int, grid: Grid | None = None, seed: int = SEED) -> DataFrame:
    """Predictions for every row by the vectors that were trained without its fold.

    SubjectID, EpochID, label, fold, c, members, fraction, bootstrap and prediction.
    """
    grid = grid or Grid()
    rows = stage(train.select(*ROW_ID, "label", "fold", "features"), "grid-rows")
    fitted = fit(write_blocks(rows, max(grid.members), seed), folds, grid)
    shared = rows.sparkSession.sparkContext.broadcast(fitted)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, same in batch.groupby("fold"):
                found = votes(shared.value, int(part), np.stack(same.pop("x").to_numpy()))
                yield same.assign(predictions=list(found))[[*ROW_ID, "label", "fold", "predictions"]]

    plain = rows.select(*ROW_ID, F.col("label").cast("int"), F.col("fold").cast("int"), vector_to_array("features").alias("x"))
    schema = "SubjectID string, EpochID string, label int, fold int, predictions array<int>"
    names = ", ".join(f"struct({i} AS i, {c}D AS c, {n} AS members, {f}D AS fraction, {str(b).lower()} AS bootstrap)"
                      for i, (c, n, f, b) in enumerate(grid.configurations))
    return plain.mapInPandas(predict, schema).selectExpr(
        *ROW_ID, "label", "fold", f"inline(transform(array({names}), s -> struct(s.c, s.members, s.fraction, s.bootstrap, predictions[s.i] AS prediction)))"
    )


def drawn_rows(rows: DataFrame, grid: Grid | None = None, seed: int = SEED) -> DataFrame:
    """How often each row is drawn by each member when all rows are trained on.

    SubjectID, EpochID, fraction, bootstrap, member and draws (rows not drawn are absent).
    """
    grid = grid or Grid()
    members = max(grid.members)
    held = stage(rows.select(*ROW_ID, "label", "features"), "drawn-rows")
    limits = exact_thresholds(write_blocks(held, members, seed), [_WHOLE], members, grid.fractions)[0]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            found = draw_weights(np.array(batch["u"].tolist(), dtype=np.int64), grid, limits).astype(np.int32)
            row, k, m = np.nonzero(found)
            ids = batch.iloc[row]
            fraction, bootstrap = (np.array(v)[k] for v in zip(*grid.draws, strict=True))
            yield pd.DataFrame(
                {"SubjectID": ids["SubjectID"].to_numpy(), "EpochID": ids["EpochID"].to_numpy(), "fraction": fraction,
                 "bootstrap": bootstrap, "member": m, "draws": found[row, k, m]}
            )

    numbers = F.expr(f"array({', '.join(row_number(seed, m) for m in range(members))})")
    schema = "SubjectID string, EpochID string, fraction double, bootstrap boolean, member int, draws int"
    return held.select(*ROW_ID, numbers.alias("u")).mapInPandas(draw, schema)

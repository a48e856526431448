"""Exact neighbour search over an index of pivot cells.

Pivots are rows chosen by a hash of their key. Every reference belongs to the cell of its
nearest pivot, and a cell knows how near and how far its rows are from the pivot. By the
triangle inequality a query needs a cell only if the least distance that any row of the
cell can have is not above the distance of its k-th best neighbour so far.

Cells lie in bundles, and bundles in written blocks of bounded size. A task holds one block
of queries with the k best of each and reads the blocks of references one after the other
from where they are written, so neither side is ever copied for the other and what is on
disk grows with the rows, not with the pairs of blocks. A query first meets the bundle of
its own nearest pivot, and within it its own cell first. The distance found there decides
which other bundles it meets at all. Results do not depend on pivots, cells, bundles or on
the order of the blocks; only the number of compared pairs does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from epochwise.storage import stage

# Rows of a cell on average, cells at most, and numbers that the pivots may hold together.
CELL_ROWS = 512
MAX_CELLS = 4096
MAX_PIVOT_NUMBERS = 2_000_000
# Rows of a bundle, queries that meet it in one task, and distances held at once.
BLOCK_ROWS = 32_768
LEAST_ROWS = 256
TILE_NUMBERS = 262_144
# Least distances of queries to cells of a bundle held at once; more cells mean fewer queries.
LOWER_NUMBERS = 4_194_304
# Numbers that stay in the cache while components are added up, and pairs whose exact distances are taken at once.
CACHE_NUMBERS = 32_768
PAIRS = 32_768
# Share of a tile's pairs beyond which the k-th nearest of the tile is looked for.
MANY = 1 / 16

# Least distances of a block's queries to all bundles; more bundles mean fewer queries in a block.
REACH_NUMBERS = 16_777_216

_PLACED = pa.schema(
    [("metric", pa.string()), ("cell", pa.int32()), ("grp", pa.string()), ("n", pa.int64()), ("near", pa.float64()), ("far", pa.float64())]
)
_BLOCK = "block int, rest binary, x binary"
_REF = pa.schema([("key", pa.string()), ("label", pa.int32()), ("grp", pa.string()), ("cell", pa.int32())])
_QUERY = pa.schema([("key", pa.string()), ("label", pa.int32()), ("grp", pa.string()), ("tau", pa.float64()), ("both", pa.bool_())])


def matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float, copy=False)


def _squared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the expanded form, with a bound of its error per row."""
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    d = (a * -2.0) @ b.T
    d += aa[:, None]
    d += bb
    slack = 16 * a.shape[1] * np.finfo(float).eps * (aa + bb.max(initial=0.0))
    return d, slack


def _absolute(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d, columns = np.zeros((len(a), len(b))), np.ascontiguousarray(b.T)
    step = max(1, CACHE_NUMBERS // max(len(b), 1))
    for at in range(0, len(a), step):
        some, total = a[at : at + step], d[at : at + step]
        gap = np.empty_like(total)
        for i in range(a.shape[1]):
            np.subtract(some[:, i : i + 1], columns[i], out=gap)
            np.abs(gap, out=gap)
            total += gap
    return d, 16 * a.shape[1] * np.finfo(float).eps * d.max(axis=1, initial=0.0)


ROUGH = {"euclidean": _squared, "manhattan": _absolute}


class Steps:
    """Manhattan distances of rows in whole steps: |x - y| summed is x + y less twice the smaller of both.

    Sums of the smaller ones are taken in 16 bits, four times as many at once as doubles.
    Every component is off by half a step at most, so the error of a distance has a bound.
    """

    COMPONENTS = 64  # that one 16-bit sum can hold

    def __init__(self, a: np.ndarray, b: np.ndarray):
        low = np.minimum(a.min(axis=0), b.min(axis=0))
        high = np.maximum(a.max(axis=0), b.max(axis=0))
        width = a.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            spread = float((high - low).max(initial=0.0))
        levels = 65_535 // max(1, min(width, self.COMPONENTS))
        self.step = spread / levels
        self.usable = bool(np.isfinite(spread)) and self.step > np.finfo(float).tiny
        if self.usable:
            self.a, self.b = (np.rint((x - low) / self.step).clip(0, levels).astype(np.uint16) for x in (a, b))
            self.sums = [x.sum(axis=1, dtype=np.int64) for x in (self.a, self.b)]
            self.error = (width + 1) * self.step

    def rough(self, rows: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of ``rows`` of a to rows begin..end of b, with a bound of their error per row."""
        columns, refs = np.ascontiguousarray(self.a[rows].T), self.b[begin:end]
        d = np.empty((end - begin, len(rows)))
        step = max(1, 4 * CACHE_NUMBERS // max(len(rows), 1))
        for at in range(0, len(refs), step):
            some = refs[at : at + step]
            least, total = np.empty((len(some), len(rows)), np.uint16), np.zeros((len(some), len(rows)))
            for first in range(0, refs.shape[1], self.COMPONENTS):
                part = np.zeros_like(least)
                for i in range(first, min(first + self.COMPONENTS, refs.shape[1])):
                    np.minimum(some[:, i : i + 1], columns[i], out=least)
                    part += least
                total -= part
            total *= 2
            total += self.sums[1][begin + at : begin + at + len(some), None]
            total += self.sums[0][rows]
            np.multiply(total, self.step, out=d[at : at + step])
        return d.T, np.full(len(rows), self.error)


    def marks(self, rows: np.ndarray, begin: int, end: int, tau: np.ndarray) -> np.ndarray:
        rough, near = self.rough(rows, begin, end)
        return rough <= (tau + near)[:, None]


class Coarse:
    """Manhattan distances of rows in few whole steps, summed in 8 bits: a pair may be nearer than they say, by a bounded error.

    Components far from the mean are cut to the last step, which brings no two rows further apart.
    """

    TOGETHER = 3  # smaller ones that 8 bits can hold the sum of
    LEVELS = 255 // TOGETHER
    DEVIATIONS = 5.0  # that the steps span

    def __init__(self, a: np.ndarray, b: np.ndarray):
        width = a.shape[1]
        levels = min(self.LEVELS, 16_383 // max(width, 1))
        with np.errstate(over="ignore", invalid="ignore"):
            middle, spread = b.mean(axis=0), self.DEVIATIONS * float(b.std(axis=0).max(initial=0.0))
            self.step = spread / max(levels, 1)
            self.usable = levels > 15 and bool(np.isfinite(spread)) and self.step > np.finfo(float).tiny and bool(np.isfinite(a).all())
        if self.usable:
            low = middle - spread / 2
            self.a, self.b = (np.rint((x - low) / self.step).clip(0, levels).astype(np.uint8) for x in (a, b))
            self.sums = [x.sum(axis=1, dtype=np.int16) for x in (self.a, self.b)]
            self.error = (width + 1) * self.step

    def marks(self, rows: np.ndarray, begin: int, end: int, tau: np.ndarray) -> np.ndarray:
        """The pairs of ``rows`` of a and rows begin..end of b that may not be farther apart than tau."""
        columns, refs = np.ascontiguousarray(self.a[rows].T), self.b[begin:end]
        # x + y - 2 * least <= tau, in steps
        least = (self.sums[0][rows] - np.floor((tau + self.error) / self.step) - 1).clip(-32_768, 32_767).astype(np.int16)
        marks = np.empty((end - begin, len(rows)), bool)
        step = max(1, 4 * CACHE_NUMBERS // max(len(rows), 1))
        for at in range(0, len(refs), step):
            some = refs[at : at + step]
            total = np.zeros((len(some), len(rows)), np.int16)
            one, part = np.empty(total.shape, np.uint8), np.empty(total.shape, np.uint8)
            for first in range(0, refs.shape[1], self.TOGETHER):
                np.minimum(some[:, first : first + 1], columns[first], out=part)
                for i in range(first + 1, min(first + self.TOGETHER, refs.shape[1])):
                    np.minimum(some[:, i : i + 1], columns[i], out=one)
                    part += one
                total += part
            total += total
            total -= self.sums[1][begin + at : begin + at + len(some), None]
            np.greater_equal(total, least, out=marks[at : at + step])
        return marks.T


class Singles:
    """Squared distances of rows in single precision, less the query's own square, with a bound of their error."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        largest = max(float(np.abs(x).max(initial=0.0)) for x in (a, b))
        self.usable = 1e-10 < largest < 1e15
        if self.usable:
            self.own, other = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
            self.a = np.concatenate([a * -2.0, np.ones((len(a), 1))], axis=1).astype(np.float32)
            self.b = np.concatenate([b, other[:, None]], axis=1).astype(np.float32)
            # The last term is for products too small for single precision.
            self.slack = 32 * self.a.shape[1] * float(np.finfo(np.float32).eps) * (self.own + other.max(initial=0.0)) + 1e-30

    def marks(self, rows: np.ndarray, begin: int, end: int, tau: np.ndarray) -> np.ndarray:
        """The pairs of ``rows`` of a and rows begin..end of b that may not be farther apart than tau."""
        with np.errstate(over="ignore"):
            bound = (tau * tau + self.slack[rows] - self.own[rows]).astype(np.float32)
        return self.a[rows] @ self.b[begin:end].T <= np.nextafter(bound, np.float32(np.inf))[:, None]


class Screen:
    """The cheapest of some rough distances that leaves few pairs of a tile; one that did not of late is seldom tried."""

    KINDS = {"euclidean": (Singles,), "manhattan": (Coarse, Steps)}
    MISSES, TURNS = 4, 16

    def __init__(self, metric: str, a: np.ndarray, b: np.ndarray):
        self.kinds = [x for x in (kind(a, b) for kind in self.KINDS[metric]) if x.usable]
        self.missed, self.turn = [0] * len(self.kinds), 0

    def marks(self, rows: np.ndarray, begin: int, end: int, tau: np.ndarray) -> np.ndarray | None:
        self.turn += 1
        for at, kind in enumerate(self.kinds):
            if self.missed[at] >= self.MISSES and self.turn % self.TURNS and not isinstance(kind, Steps):
                continue
            marks = kind.marks(rows, begin, end, tau)
            if _few(marks):
                self.missed[at] = 0
                return marks
            self.missed[at] += 1
        return None


def _few(marks: np.ndarray) -> bool:
    return np.count_nonzero(marks) <= MANY * marks.size


def exact(metric: str, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows."""
    gap = a - b
    if metric == "manhattan":
        return np.abs(gap).sum(axis=1)
    return np.sqrt((gap * gap).sum(axis=1))


def exact_pairs(metric: str, a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distances of rows i of a and j of b, a bounded number of them at a time."""
    out = np.empty(len(i))
    for at in range(0, len(i), PAIRS):
        some = slice(at, at + PAIRS)
        out[some] = exact(metric, a[i[some]], b[j[some]])
    return out


def _marked(marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the marks, in the order in which they are stored."""
    if marks.flags.f_contiguous:
        j, i = np.divmod(np.flatnonzero(marks.T), max(marks.shape[0], 1))
        return i, j
    return np.divmod(np.flatnonzero(marks), max(marks.shape[1], 1))


def _rough_limit(metric: str, tau: np.ndarray) -> np.ndarray:
    return tau if metric == "manhattan" else tau * tau


def distances(metric: str, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs, with a bound of their error per row of ``a``."""
    d, slack = ROUGH[metric](a, b)
    if metric == "manhattan":
        return d, slack
    return np.sqrt(np.maximum(d, 0.0)), np.sqrt(slack)


def tiles(rows: int, width: int) -> Iterator[slice]:
    step = max(1, TILE_NUMBERS // max(width, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


def _strips(rows: int, cells: int) -> Iterator[slice]:
    step = max(LEAST_ROWS, LOWER_NUMBERS // max(cells, 1))
    return (slice(at, min(at + step, rows)) for at in range(0, rows, step))


@dataclass(frozen=True)
class Cells:
    """What workers know of one metric's cells; all arrays have a row for each pivot."""

    metric: str
    pivots: np.ndarray
    between: np.ndarray  # distances of the pivots, rather too large
    bundle: np.ndarray
    rows: np.ndarray
    nearest: np.ndarray  # of a cell's rows to its pivot
    farthest: np.ndarray
    spare: np.ndarray  # rows outside the cell's largest group
    error: float  # of any reference's distance to its pivot

    def lower(self, d: np.ndarray, slack: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """The least distance of any row of ``cells`` to queries at distances ``d`` from their pivots."""
        least = np.maximum(d - self.farthest[cells], self.nearest[cells] - d)
        # A row of a cell is no nearer to any other pivot than to its own.
        home = np.argmin(d, axis=1)
        ahead = d - d[np.arange(len(d)), home][:, None]
        least = np.maximum(least, ahead / 2)
        if self.metric == "euclidean":
            apart = self.between[np.ix_(cells[home], cells)]
            both = d + d[np.arange(len(d)), home][:, None]
            # Errors of the distances grow where pivots lie close together.
            wrong = 2 * slack[:, None] * both + 4 * self.error * (np.maximum(self.farthest[cells], 0) + self.error)
            least = np.maximum(least, (ahead * both - wrong) / (2 * np.where(apart > 0, apart, np.inf)))
        return least - 2 * slack[:, None] - self.error

    def first_limit(self, d: np.ndarray, slack: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every query has k references of other groups."""
        far = np.where(self.rows > 0, d + self.farthest, np.inf)
        order = np.argsort(far, axis=1)
        enough = np.cumsum(self.spare[order], axis=1) >= k
        at = np.argmax(enough, axis=1)
        rows = np.arange(len(d))
        limit = far[rows, order[rows, at]] + slack + self.error
        return np.where(enough[:, -1], limit, np.inf)


@dataclass(frozen=True)
class Index:
    """Indexed references in written blocks, what each block holds, and the cells of each metric."""

    blocks: DataFrame
    places: list[tuple[str, int]]  # metric and bundle of a block
    cells: dict[str, Cells]
    bundles: int


def _vectors(values: pa.ListArray) -> np.ndarray:
    if values.null_count:
        raise ValueError("a row has no vector")
    sizes = np.diff(values.offsets.to_numpy())
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return values.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(values), -1 if sizes.sum() else 0)


def _numbers(x: np.ndarray) -> bytes:
    """The numbers of some vectors, with their width; in single precision where that keeps all of them."""
    with np.errstate(over="ignore", invalid="ignore"):
        single = x.astype("<f4")
    kept = single if np.array_equal(single, x, equal_nan=True) else x.astype("<f8")
    return x.shape[1].to_bytes(4, "little") + kept.dtype.itemsize.to_bytes(4, "little") + kept.tobytes()


def _matrix_of(x: bytes, rows: int) -> np.ndarray:
    width, size = (int.from_bytes(x[at : at + 4], "little") for at in (0, 4))
    return np.frombuffer(x, dtype=f"<f{size}", offset=8).astype(float).reshape(rows, width)


def _bytes(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _piece(block: int, rest: pa.Table, x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {"block": pa.array([block], pa.int32()), "rest": pa.array([_bytes(rest)], pa.binary()), "x": pa.array([_numbers(x)], pa.binary())}
    )


def _pieces(rest: pa.Table, x: np.ndarray, block: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of each block."""
    order = np.argsort(block, kind="stable")
    found, starts = np.unique(block[order], return_index=True)
    for one, rows in zip(found, np.split(order, starts[1:]), strict=True):
        yield _piece(int(one), rest.take(pa.array(rows)), x[rows])


def _blocks(pieces: DataFrame, count: int, order: str | None = None) -> DataFrame:
    """One row for each of ``count`` blocks, each in a partition of its own, its rows ordered by a column."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[pa.Table, np.ndarray]]] = {}
        for batch in batches:
            for piece in batch.to_pylist():
                rest = _table(piece["rest"])
                held.setdefault(piece["block"], []).append((rest, _matrix_of(piece["x"], len(rest))))
        for block in sorted(held):
            some = held.pop(block)
            rest, x = pa.concat_tables([r for r, _ in some]).combine_chunks(), np.concatenate([v for _, v in some])
            if order is not None:
                rows = np.argsort(rest[order].to_numpy(), kind="stable")
                rest, x = rest.take(pa.array(rows)), x[rows]
            yield _piece(block, rest, x)

    return pieces.repartitionById(count, "block").mapInArrow(join, _BLOCK)


def build_index(refs: DataFrame, metrics: Sequence[str]) -> Index | None:
    """The index of ``refs`` (key, label, grp, values), a written table; None if it has no rows."""
    spark = refs.sparkSession
    n = refs.count()
    if not n:
        return None
    width = refs.select(F.size("values").alias("d")).first().d
    count = max(1, min(n // CELL_ROWS, MAX_CELLS, MAX_PIVOT_NUMBERS // max(width, 1)))
    bundles = min(count, -(-n // BLOCK_ROWS))
    chosen = refs.orderBy(F.md5("key"), "key").limit(count).select("values").collect()
    pivots = np.array([r["values"] for r in chosen], dtype=float)
    between = {}
    for metric in metrics:
        d, slack = distances(metric, pivots, pivots)
        between[metric] = d + slack[:, None]
    bundle_of = {m: np.argmin(between[m][:, :bundles], axis=1) for m in metrics}
    shared = spark.sparkContext.broadcast(pivots)

    def placed(metric: str, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row and the distance from its pivot."""
        at = shared.value
        cell, away = np.empty(len(a), dtype=np.int64), np.empty(len(a))
        for tile in tiles(len(a), len(at)):
            d = distances(metric, a[tile], at)[0]
            cell[tile] = np.argmin(d, axis=1)
            away[tile] = d[np.arange(len(d)), cell[tile]]
        return cell, away

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, grp = _vectors(batch["values"]), batch["grp"].to_pandas()
            for metric in metrics:
                cell, away = placed(metric, a)
                some = pd.DataFrame({"cell": cell, "grp": grp, "away": away}).groupby(["cell", "grp"], dropna=False)["away"]
                rows = some.agg(n="size", near="min", far="max").reset_index().assign(metric=metric)
                yield from pa.Table.from_pandas(rows, schema=_PLACED, preserve_index=False).to_batches()

    # At most one row for each metric and pivot.
    stats = (
        refs.select("grp", "values")
        .mapInArrow(measure, "metric string, cell int, grp string, n long, near double, far double")
        .groupBy("metric", "cell", "grp")
        .agg(F.sum("n").alias("n"), F.min("near").alias("near"), F.max("far").alias("far"))
        .groupBy("metric", "cell")
        .agg(
            F.sum("n").alias("rows"),
            F.max(F.when(F.col("grp").isNotNull(), F.col("n")).otherwise(0)).alias("largest"),
            F.min("near").alias("near"),
            F.max("far").alias("far"),
        )
        .collect()
    )
    largest = float(np.abs(pivots).max(initial=0.0))
    every, places, first, splits = {}, [], {}, {}
    for metric in metrics:
        rows, spare = np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
        near, far = np.full(count, np.inf), np.full(count, -np.inf)
        for s in stats:
            if s.metric == metric:
                rows[s.cell], spare[s.cell] = s.rows, s.rows - s.largest
                near[s.cell], far[s.cell] = s.near, s.far
        reach = largest + float(far.max())
        eps = 32 * width * np.finfo(float).eps
        error = eps * width * reach if metric == "manhattan" else np.sqrt(eps * width) * reach
        every[metric] = Cells(metric, pivots, between[metric], bundle_of[metric], rows, near, far, spare, error)
        # Blocks of a bundle: one, or more where it is large.
        splits[metric] = np.maximum(1, -(-np.bincount(bundle_of[metric], weights=rows, minlength=bundles).astype(np.int64) // BLOCK_ROWS))
        first[metric] = len(places) + np.cumsum(splits[metric]) - splits[metric]
        places += [(metric, b) for b in range(bundles) for _ in range(splits[metric][b])]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            a, dealt = _vectors(batch["values"]), batch["dealt"].to_numpy()
            for metric in metrics:
                cell = placed(metric, a)[0]
                bundle = bundle_of[metric][cell]
                rest = pa.table([batch["key"], batch["label"], batch["grp"], pa.array(cell, pa.int32())], schema=_REF)
                yield from _pieces(rest, a, first[metric][bundle] + dealt % splits[metric][bundle])

    rows = refs.select("key", F.col("label").cast("int").alias("label"), "grp", "values", F.xxhash64("key").alias("dealt"))
    return Index(stage(_blocks(rows.mapInArrow(deal, _BLOCK), len(places), "cell"), "cells"), places, every, bundles)


def _query_blocks(index: Index, queries: DataFrame) -> DataFrame:
    """Blocks of queries (key, label, grp, values, tau, both): bounded in size, and as many for each core."""
    n, cores = queries.count(), queries.sparkSession.sparkContext.defaultParallelism
    most = max(LEAST_ROWS, min(BLOCK_ROWS, REACH_NUMBERS // index.bundles))
    parts = max(1, min(-(-n // (most * cores)) * cores, -(-n // LEAST_ROWS)), -(-n // most))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield from _pieces(pa.table([batch[c] for c in _QUERY.names], schema=_QUERY), _vectors(batch["values"]), batch["block"].to_numpy())

    # All rows of a key lie in one block.
    block = F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("block")
    return _blocks(queries.select(*_QUERY.names, "values", block).mapInArrow(deal, _BLOCK), parts)


def _met(index: Index, blocks: DataFrame, rounds: int, task: Callable[[pa.Table, np.ndarray], Task], schema: str) -> DataFrame:
    """What a ``task`` makes of each block of queries and all blocks of references, which it meets one by one.

    For each metric, the references are read ``rounds`` times.
    """
    spark = blocks.sparkSession
    metrics = [m for m, _ in index.places]
    read = [
        index.blocks.where(F.col("block").between(metrics.index(m), len(metrics) - 1 - metrics[::-1].index(m))).withColumn("round", F.lit(at))
        for m in index.cells
        for at in range(rounds)
    ]
    refs = read[0]
    for more in read[1:]:
        refs = refs.unionByName(more)
    places = index.places

    def run(pairs: Iterator[tuple[Row, Row]]) -> Iterator[tuple[bytes]]:
        held: dict[int, Task] = {}
        for q, r in pairs:
            if q.block not in held:
                rest = _table(q.rest)
                held[q.block] = task(rest, _matrix_of(q.x, len(rest)))
            rest = _table(r.rest)
            for found in held[q.block].meet(*places[r.block], r["round"], rest, _matrix_of(r.x, len(rest))):
                yield (_bytes(found),)
        for one in held.values():
            for found in one.end():
                yield (_bytes(found),)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in batch.column(0):
                yield from _table(found.as_buffer()).to_batches()

    # One partition of references, read anew by each block of queries: no row moves and none is kept.
    met = blocks.rdd.cartesian(refs.coalesce(1).rdd).mapPartitions(run)
    return spark.createDataFrame(met, "found binary", verifySchema=False).mapInArrow(rows, schema)


class Task:
    """A block of queries: for each metric its least distances to the bundles and the bundle it is at home in."""

    def __init__(self, cells: dict[str, Cells], rest: pa.Table, x: np.ndarray):
        self.cells, self.rest, self.x = cells, rest, x
        self.known = np.nan_to_num(rest["tau"].to_numpy(), nan=np.inf, posinf=np.inf)
        self.at: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def limit(self, cells: Cells, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
        return np.full(len(d), np.inf)

    def placed(self, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Least distances to the bundles, rather too small, the bundles at home, and first limits."""
        if metric not in self.at:
            cells, a = self.cells[metric], self.x
            every, order = np.arange(len(cells.pivots)), np.argsort(cells.bundle, kind="stable")
            present, starts = np.unique(cells.bundle[order], return_index=True)
            bundles = int(cells.bundle.max()) + 1
            least, home, tau = np.empty((len(a), bundles), np.float32), np.empty(len(a), np.int64), self.known.copy()
            for tile in tiles(len(a), len(every) + bundles):
                d, slack = distances(metric, a[tile], cells.pivots)
                tau[tile] = np.minimum(tau[tile], self.limit(cells, d, slack))
                lower = np.where(cells.rows > 0, cells.lower(d, slack, every), np.inf)
                reach = np.full((len(d), bundles), np.inf)
                reach[:, present] = np.minimum.reduceat(lower[:, order], starts, axis=1)
                home[tile] = np.argmin(reach, axis=1)
                with np.errstate(over="ignore"):
                    short = reach.astype(np.float32)
                least[tile] = np.where(short > reach, np.nextafter(short, np.float32(-np.inf)), short)
            self.at[metric] = least, home, tau
        return self.at[metric]

    def meet(self, metric: str, bundle: int, at: int, rest: pa.Table, x: np.ndarray) -> Iterator[pa.Table]:
        raise NotImplementedError

    def end(self) -> Iterator[pa.Table]:
        return iter(())


def _groups(q: pd.Series, r: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Integer codes of both group columns; NULL never equals anything."""
    codes = pd.factorize(pd.concat([q, r], ignore_index=True))[0]
    left, right = codes[: len(q)].copy(), codes[len(q) :].copy()
    left[left < 0] = -2
    return left, right


def _least(cells: Cells, a: np.ndarray, present: np.ndarray) -> np.ndarray:
    """The least distances of queries to the rows of ``present`` cells."""
    lower = np.empty((len(a), len(present)))
    for tile in tiles(len(a), len(present)):
        lower[tile] = cells.lower(*distances(cells.metric, a[tile], cells.pivots[present]), present)
    return lower


def _rounds(lower: np.ndarray) -> Iterator[tuple[int, np.ndarray | None]]:
    """Cells of a bundle in order: first each with the queries at home there, then each with all others."""
    home = np.argmin(lower, axis=1)
    for cell in range(lower.shape[1]):
        yield cell, home == cell
    for cell in range(lower.shape[1]):
        yield cell, home != cell


def _best_rows(
    a: np.ndarray, left: np.ndarray, tau: np.ndarray, b: np.ndarray, right: np.ndarray, key_order: np.ndarray, cell: np.ndarray,
    cells: Cells, k: int, work: Accumulator | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Distances and rows of the k nearest references within ``tau``, NaN and -1 where there are fewer.

    ``tau`` has a row for the references of other groups and may have one for all of them; so
    have the results. Rows of ``b`` are ordered by their cell, ``key_order`` settles ties.
    """
    metric, lists, tau = cells.metric, len(tau), tau.copy()
    present, starts = np.unique(cell, return_index=True)
    ends = np.append(starts[1:], len(b))
    key_order = np.append(key_order, len(b))
    screen = Screen(metric, a, b)
    best_d, best_j = np.full((lists, len(a), k), np.inf), np.full((lists, len(a), k), -1)
    compared = 0

    def add(which: int, rows: np.ndarray, i: np.ndarray, j: np.ndarray, found: np.ndarray) -> None:
        kept = found <= tau[which, rows[i]]
        if not kept.any():
            return
        i, j, found = i[kept], j[kept], found[kept]
        order = np.lexsort((key_order[j], found, i))
        i, j, found = i[order], j[order], found[order]
        met, i = np.unique(i, return_inverse=True)
        rank = np.arange(len(i)) - np.searchsorted(i, i, side="left")
        kept = rank < k
        rows = rows[met]
        new_d, new_j = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1)
        new_d[i[kept], rank[kept]], new_j[i[kept], rank[kept]] = found[kept], j[kept]
        both_d = np.concatenate([best_d[which, rows], new_d], axis=1)
        both_j = np.concatenate([best_j[which, rows], new_j], axis=1)
        order = np.lexsort((key_order[both_j], both_d), axis=1)[:, :k]
        best_d[which, rows] = np.take_along_axis(both_d, order, axis=1)
        best_j[which, rows] = np.take_along_axis(both_j, order, axis=1)
        tau[which, rows] = np.minimum(tau[which, rows], best_d[which, rows, -1])

    def compare(rows: np.ndarray, begin: int, end: int) -> None:
        """Take the pairs that may be nearer than what is known, and more of a cell only where ties ask for it."""
        limit = tau[:, rows].max(axis=0)
        marks = screen.marks(rows, begin, end, limit) if np.isfinite(limit).all() else None
        if marks is None:
            rough, near = ROUGH[metric](a[rows], b[begin:end])
            marks = rough <= (_rough_limit(metric, limit) + near)[:, None]
        if _few(marks):
            i, j = _marked(marks)
            j = begin + j
            other = left[rows[i]] != right[j]
            if lists == 1:
                i, j = i[other], j[other]
            found = exact_pairs(metric, a, rows[i], b, j)
            if lists == 2:
                add(1, rows, i, j, found)
                i, j, found = i[other], j[other], found[other]
            add(0, rows, i, j, found)
            return
        place = min(k, end - begin) - 1
        for which in reversed(range(lists)):
            if which == 0:
                rough[left[rows][:, None] == right[None, begin:end]] = np.inf
            limit = _rough_limit(metric, tau[which, rows])
            limit = np.minimum(np.partition(rough, place, axis=1)[:, place] + near, limit)
            i, j = _marked((rough <= (limit + near)[:, None]) & np.isfinite(rough))
            add(which, rows, i, begin + j, exact_pairs(metric, a, rows[i], b, begin + j))

    for strip in _strips(len(a), len(present)):
        lower = _least(cells, a[strip], present)
        for cell_at, these in _rounds(lower):
            active = strip.start + np.flatnonzero(these & (lower[:, cell_at] <= tau[:, strip].max(axis=0)))
            begin, end = int(starts[cell_at]), int(ends[cell_at])
            compared += len(active) * (end - begin)
            for tile in tiles(len(active), end - begin):
                compare(active[tile], begin, end)
    if work is not None:
        work.add(compared)
    best_d[best_j < 0] = np.nan
    return best_d, best_j


def _best_of_bundle(q: pd.DataFrame, r: pd.DataFrame, cells: Cells, k: int, work: Accumulator | None) -> pd.DataFrame:
    """The k nearest references of each query among a bundle's rows, ties by reference key."""
    r = r.sort_values("cell", kind="stable")
    left, right = _groups(q["grp"], r["grp"])
    keys, tau = r["key"].to_numpy(), q["tau"].to_numpy(dtype=float)[None]
    order = np.argsort(np.argsort(keys))
    (best_d,), (best_j,) = _best_rows(
        matrix(q["values"]), left, tau, matrix(r["values"]), right, order, r["cell"].to_numpy(), cells, k, work
    )
    i, place = np.nonzero(best_j >= 0)
    j = best_j[i, place]
    return pd.DataFrame(
        {
            "key": q["key"].to_numpy()[i],
            "metric": cells.metric,
            "dist": best_d[i, place],
            "ref_key": keys[j],
            "ref_label": r["label"].to_numpy()[j],
        }
    )


class Best(Task):
    """The k best references of a block's queries, of other groups and, where asked, of all groups."""

    def __init__(self, cells: dict[str, Cells], rest: pa.Table, x: np.ndarray, k: int, work: Accumulator | None):
        super().__init__(cells, rest, x)
        self.k, self.work = k, work
        self.both = rest["both"].to_numpy()
        self.grp, self.found = rest["grp"].to_pandas(), {}

    def limit(self, cells: Cells, d: np.ndarray, slack: np.ndarray) -> np.ndarray:
        return cells.first_limit(d, slack, self.k)

    def state(self, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distances, keys (after a sign, none for NULL) and labels of the best; a NaN where there are fewer."""
        if metric not in self.found:
            shape = (1 + bool(self.both.any()), len(self.x), self.k)
            self.found[metric] = [np.full(shape, np.nan), np.zeros(shape, "S1"), np.full(shape, np.nan)]
        return self.found[metric]

    def meet(self, metric: str, bundle: int, at: int, rest: pa.Table, x: np.ndarray) -> Iterator[pa.Table]:
        least, home, first = self.placed(metric)
        dist, key, label = self.state(metric)
        tau = np.fmin(first, dist[:, :, -1])
        if len(tau) == 2:
            tau[1, ~self.both] = -np.inf
        reach = least[:, bundle]
        rows = np.flatnonzero(((home == bundle) == (at == 0)) & np.isfinite(reach) & (reach <= tau.max(axis=0)))
        if not len(rows):
            return
        keys = np.array([b"" if v is None else b"+" + v.encode() for v in rest["key"].to_pylist()])
        left, right = _groups(self.grp.iloc[rows], rest["grp"].to_pandas())
        cell, order = rest["cell"].to_numpy(), np.argsort(np.argsort(keys, kind="stable"))
        new_d, new_j = _best_rows(
            self.x[rows], left, tau[:, rows], x, right, order, cell, self.cells[metric], self.k, self.work
        )
        labels = rest["label"].to_numpy().astype(float)
        if keys.dtype.itemsize > key.dtype.itemsize:
            key = self.found[metric][1] = key.astype(keys.dtype)
        for which in range(len(new_d)):
            some = np.flatnonzero(new_j[which, :, 0] >= 0)
            j = new_j[which, some]
            both = [
                np.concatenate([old[which, rows[some]], new], axis=1)
                for old, new in ((dist, new_d[which, some]), (key, keys[j]), (label, labels[j]))
            ]
            order = _order(both[0], both[1])[:, : self.k]
            for old, new in zip((dist, key, label), both, strict=True):
                old[which, rows[some]] = np.take_along_axis(new, order, axis=1)
        yield from ()

    def end(self) -> Iterator[pa.Table]:
        keys = self.rest.select(["key", "label", "grp"]).to_pandas()
        first = ~keys.duplicated("key").to_numpy()
        for metric in list(self.found):
            found = self.found.pop(metric)
            for which in range(len(found[0])):
                dist, key, label = (v[which] for v in found)
                if not first.all():
                    dist, key, label = _merged(keys["key"], dist, key, label)
                # A row that says the same of the same key comes once.
                rows = ~keys.duplicated().to_numpy() if which == 0 else self.both & ~keys.duplicated(["key", "label"]).to_numpy()
                rows &= ~np.isnan(dist[:, 0])
                rows = np.flatnonzero(rows)
                for at in range(0, len(rows), LEAST_ROWS * 16):
                    some = rows[at : at + LEAST_ROWS * 16]
                    yield _lists(self.rest.take(pa.array(some)), metric, which == 1, first[some], dist[some], key[some], label[some])


def _order(dist: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order of each row's distances, NaN last, ties by key."""
    order = np.argsort(dist, axis=1, kind="stable")
    ordered = np.take_along_axis(dist, order, axis=1)
    ties = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    order[ties] = np.lexsort((key[ties], dist[ties]), axis=1)
    return order


def _merged(keys: pd.Series, dist: np.ndarray, key: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same where all rows of a key have the best of all of them."""
    dist, key, label = dist.copy(), key.copy(), label.copy()
    codes = pd.factorize(keys, use_na_sentinel=False)[0]
    repeated = np.flatnonzero(np.bincount(codes)[codes] > 1)
    for rows in pd.Series(repeated).groupby(codes[repeated]).indices.values():
        rows = repeated[rows]
        order = _order(dist[rows].reshape(1, -1), key[rows].reshape(1, -1))[:, : dist.shape[1]]
        for v in (dist, key, label):
            v[rows] = np.take_along_axis(v[rows].reshape(1, -1), order, axis=1)
    return dist, key, label


_LISTS = (
    "key string, label int, grp string, metric string, everyone boolean, first boolean, "
    "dist array<double>, ref_key array<string>, ref_label array<int>"
)


def _lists(rest: pa.Table, metric: str, everyone: bool, first: np.ndarray, dist: np.ndarray, key: np.ndarray, label: np.ndarray) -> pa.Table:
    found = ~np.isnan(dist)
    offsets = pa.array(np.append(0, np.cumsum(found.sum(axis=1))), pa.int32())
    key, label, n = key[found], label[found], len(rest)
    lists = (
        pa.array(dist[found]),
        pa.array([v[1:].decode() if v else None for v in key.tolist()], pa.string()),
        pa.array(np.nan_to_num(label).astype(np.int32), mask=np.isnan(label)),
    )
    return pa.table(
        {
            **{c: rest[c] for c in ("key", "label", "grp")},
            "metric": pa.array([metric] * n),
            "everyone": pa.array([everyone] * n),
            "first": pa.array(first),
            **{c: pa.ListArray.from_arrays(offsets, v) for c, v in zip(("dist", "ref_key", "ref_label"), lists, strict=True)},
        }
    )


def search(queries: DataFrame, index: Index, k: int, work: Accumulator | None = None) -> DataFrame:
    """The k nearest references of each query and metric as lists: dist, ref_key and ref_label, nearest first.

    ``queries`` has key, label, grp, values and both: whether the k nearest of all groups are
    asked for as well, which one comparison finds (``everyone``). Rows of a key share its k
    best; ``first`` marks one of them. ``work`` adds up the compared pairs. Each action
    searches anew.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)

    def task(rest: pa.Table, x: np.ndarray) -> Task:
        return Best(shared.value, rest, x, k, work)

    blocks = _query_blocks(index, queries.select("*", F.lit(None).cast("double").alias("tau")))
    return _met(index, blocks, 1 if index.bundles == 1 else 2, task, _LISTS)


class Within(Task):
    """What a function makes of queries and the references of a block that may be within their distance."""

    def __init__(self, cells: dict[str, Cells], rest: pa.Table, x: np.ndarray, compare: Callable[[pd.DataFrame, pd.DataFrame, Cells], pa.Table]):
        super().__init__(cells, rest, x)
        self.compare = compare
        self.q = rest.select(["key", "label", "grp"]).to_pandas().assign(values=list(x), tau=self.known)

    def meet(self, metric: str, bundle: int, at: int, rest: pa.Table, x: np.ndarray) -> Iterator[pa.Table]:
        least, _, tau = self.placed(metric)
        rows = np.flatnonzero(np.isfinite(least[:, bundle]) & (least[:, bundle] <= tau))
        if len(rows):
            yield self.compare(self.q.iloc[rows], rest.to_pandas().assign(values=list(x)), self.cells[metric])


def within(
    queries: DataFrame,
    index: Index,
    compare: Callable[[pd.DataFrame, pd.DataFrame, Cells], pa.Table],
    schema: str,
) -> DataFrame:
    """Compare queries with all references within their own distance, column ``tau``, of one metric.

    ``compare`` gets queries and the rows of a block and returns a table of ``schema``.
    """
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)

    def task(rest: pa.Table, x: np.ndarray) -> Task:
        return Within(shared.value, rest, x, compare)

    ready = queries.select("key", F.col("label").cast("int").alias("label"), "grp", "values", "tau", F.lit(False).alias("both"))
    return _met(index, _query_blocks(index, ready), 1, task, schema)


def nearer(q: pd.DataFrame, r: pd.DataFrame, cells: Cells) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query rows, reference rows, distances) of all pairs that are not farther apart than the query's tau."""
    metric = cells.metric
    a, b = matrix(q["values"]), matrix(r["values"])
    cell, tau = r["cell"].to_numpy(), q["tau"].to_numpy(dtype=float)
    present = np.unique(cell)
    for strip in _strips(len(a), len(present)):
        lower = _least(cells, a[strip], present)
        for at, one in enumerate(present):
            refs, active = np.flatnonzero(cell == one), strip.start + np.flatnonzero(lower[:, at] <= tau[strip])
            for tile in tiles(len(active), len(refs)):
                rows = active[tile]
                rough, near = ROUGH[metric](a[rows], b[refs])
                i, j = np.nonzero(rough <= (_rough_limit(metric, tau[rows]) + near)[:, None])
                found = exact_pairs(metric, a, rows[i], b, refs[j])
                kept = found <= tau[rows[i]]
                yield rows[i[kept]], refs[j[kept]], found[kept]

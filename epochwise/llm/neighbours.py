"""Approximate nearest neighbours by counting collisions on single projections.

Each block of vectors is indexed by ``projections`` sorted arrays, one for each random
direction. A query opens a window around its own place in every array; a vector inside the
window collides with it there. A vector that collides in ``threshold`` of all arrays is
verified by its true inner product. Windows widen level by level (virtual rehashing: the
arrays stay, only the bounds move) until the k-th best verified vector is so near that,
at this width, vectors as near as it collide often enough with probability ``recall``.

The largest inner product becomes the smallest distance by one more coordinate: vectors
are divided by the block's largest norm M and completed to length one, queries are
divided by their own norm and completed by 0. Then distance^2 = 2 - 2 * product / (|q| M).

All rows are indexed; nothing is fitted. Blocks have a bounded number of rows, dealt out
by a hash of the row, so copies of one vector do not gather; every chunk of queries meets
every block, and only the k best of a query leave a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from epochwise.llm.common import named
from epochwise.storage import stage

# Rows of a block, and queries that meet it in one task.
BLOCK_ROWS = 8192
CHUNK_QUERIES = 2048
PROJECTIONS = 128
# Share of the arrays in which a vector must collide to be verified.
THRESHOLD = 0.8
# Probability that a vector as near as the k-th best is verified; nearer ones have more.
RECALL = 0.8
_SEED = 42
# Half widths of the windows: from the first one on, each so many times the one before.
_FIRST_WIDTH, _WIDER = 2.0**-8, 2.0**0.125
# Queries that go through all levels to find where the others begin.
_PILOTS = 16
_PAIRS_AT_ONCE = 1 << 16

_FOUND = "query_row long, query_id long, vec_id long, score double"


def directions(dimension: int, projections: int) -> np.ndarray:
    """Random directions as columns, orthogonal in groups, of length sqrt(dimension)."""
    rng = np.random.default_rng(_SEED)
    groups = [
        np.linalg.qr(rng.standard_normal((dimension, dimension)))[0] for _ in range(-(-projections // dimension))
    ]
    return np.concatenate(groups, axis=1)[:, :projections] * math.sqrt(dimension)


def near_share(threshold: float, projections: int, recall: float) -> float:
    """Window half width over distance at which a vector collides often enough with that probability.

    One array's difference at distance d is about normal with deviation d; collisions are
    counted as independent, which orthogonal directions can only make safer.
    """
    spread = math.sqrt(threshold * (1 - threshold) / projections)
    share = min(threshold + NormalDist().inv_cdf(recall) * spread, 1 - 0.5 / projections)
    return NormalDist().inv_cdf((1 + share) / 2)


class Block:
    """The sorted arrays of a block of vectors (rows of ``vectors``)."""

    def __init__(self, vectors: np.ndarray, projections: int) -> None:
        self.vectors = vectors
        size, dimension = vectors.shape
        # Scaled first, so that squares neither overflow nor vanish.
        self.scale = float(np.abs(vectors).max())
        scaled = vectors / self.scale
        squares = (scaled * scaled).sum(axis=1)
        self.norm = math.sqrt(float(squares.max()))
        rest = np.sqrt(np.maximum(1 - squares / self.norm**2, 0))
        self.directions = directions(dimension + 1, projections)
        placed = np.concatenate([scaled / self.norm, rest[:, None]], axis=1) @ self.directions
        order = np.argsort(placed.T, axis=1, kind="stable")
        self.sorted = np.take_along_axis(placed.T, order, axis=1)
        self.order = order
        kind = np.uint16 if size < 1 << 16 else np.uint32
        self.places = np.empty(order.shape, dtype=kind)
        np.put_along_axis(self.places, order, np.arange(size, dtype=kind)[None, :], axis=1)

    def windows(self, at: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last places of the windows of queries that stand ``at`` (projections x queries)."""
        first, last = np.empty(at.shape, dtype=np.int64), np.empty(at.shape, dtype=np.int64)
        for j, values in enumerate(self.sorted):
            first[j] = np.searchsorted(values, at[j] - width, side="left")
            last[j] = np.searchsorted(values, at[j] + width, side="right")
        return first, last

    def collisions(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """How many windows of one query hold each vector."""
        inside = last - first
        if inside.sum() * 16 < self.places.size:
            held = [o[a:b] for o, a, b in zip(self.order, first.tolist(), last.tolist(), strict=True)]
            return np.bincount(np.concatenate(held), minlength=len(self.vectors))
        # Wide windows: whether each place lies inside, by one unsigned comparison.
        kind = self.places.dtype
        moved = self.places - first.astype(kind)[:, None]
        within = moved < np.minimum(inside, np.iinfo(kind).max).astype(kind)[:, None]
        return within.sum(axis=0, dtype=np.uint16)

    def products(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Inner products in double precision; the same for equal vectors, whatever stands beside them."""
        parts = [
            (self.vectors[rows[i : i + _PAIRS_AT_ONCE]] * query).sum(axis=1) for i in range(0, len(rows), _PAIRS_AT_ONCE)
        ]
        return np.concatenate(parts) if parts else np.zeros(0)


def search(
    block: Block, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int, threshold: float, recall: float
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For every query its number, and the rows and products of its k best in the block.

    Rows with the query's own id are left out; of equal products the smaller id comes first.
    ``ids`` must ascend.
    """
    size, projections = len(ids), len(block.sorted)
    need, share = math.ceil(threshold * projections), near_share(threshold, projections, recall)
    top = np.abs(queries).max(axis=1, keepdims=True)
    norms = np.sqrt(((queries / top) ** 2).sum(axis=1))
    at = (((queries / top) / norms[:, None]) @ block.directions[:-1]).T
    # Products over this are the cosines of the completed vectors.
    longest = norms * top[:, 0] * block.scale * block.norm
    own = [np.searchsorted(ids, query_ids, side=s) for s in ("left", "right")]

    # Of a query whose windows still widen: which rows are verified, and the best of them.
    seen: dict[int, np.ndarray] = {}
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def verify(number: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best once what collides often enough for the first time is verified too."""
        enough = counts >= need
        enough[own[0][number] : own[1][number]] = False
        rows = np.flatnonzero(enough & ~seen[number]) if number in seen else np.flatnonzero(enough)
        seen[number] = enough
        scores = block.products(rows, queries[number])
        if number in best:
            rows, scores = (np.concatenate(pair) for pair in zip(best[number], (rows, scores), strict=True))
        if len(rows) > k:
            floor = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= floor], scores[scores >= floor]
        order = np.lexsort((rows, -scores))[:k]
        best[number] = rows[order], scores[order]
        return best[number]

    stopped: list[int] = []
    for numbers in (np.arange(min(_PILOTS, len(queries))), np.arange(_PILOTS, len(queries))):
        # Beginning with a wider window than needed verifies more and loses nothing.
        level = max(int(np.median(stopped)) - 1, 0) if stopped else 0
        while len(numbers):
            width = _FIRST_WIDTH * _WIDER**level
            first, last = block.windows(at[:, numbers], width)
            inside = last - first
            whole, possible = (inside == size).all(axis=0), inside.sum(axis=0) >= need
            wider = []
            for i, number in enumerate(numbers.tolist()):
                rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
                if possible[i]:  # else no vector can have collided often enough
                    rows, scores = verify(number, block.collisions(first[:, i], last[:, i]))
                near = len(rows) == k and math.sqrt(max(2 - 2 * scores[-1] / longest[number], 0)) * share <= width
                if near or whole[i]:
                    stopped.append(level)
                    seen.pop(number, None)
                    best.pop(number, None)
                    yield number, rows, scores
                else:
                    wider.append(number)
            numbers = np.array(wider, dtype=np.int64)
            level += 1


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(lists), -1)


def _met(vectors: pa.Table, queries: pa.Table, k: int, projections: int, threshold: float, recall: float) -> pa.Table:
    """The k best of every query of a chunk in one block."""
    kinds = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
    if not len(vectors) or not len(queries):
        return kinds.empty_table()
    # Null ids last: beyond any id, they are nobody's own.
    vectors = vectors.sort_by([("vec_id", "ascending")])
    queries = queries.sort_by([("row", "ascending")])
    known = len(vectors) - vectors["vec_id"].null_count
    ids = vectors["vec_id"].fill_null(0).to_numpy()
    block = Block(_matrix(vectors["vector"]), projections)
    query_rows, query_ids = queries["row"].to_numpy(), queries["vec_id"].to_numpy()
    own = np.concatenate([ids[:known], np.full(len(ids) - known, np.iinfo(np.int64).max)])
    told: list[list[np.ndarray]] = [[], [], [], []]
    for number, rows, scores in search(block, own, _matrix(queries["vector"]), query_ids, k, threshold, recall):
        for column, values in zip(
            told, (np.full(len(rows), query_rows[number]), np.full(len(rows), query_ids[number]), rows, scores), strict=True
        ):
            column.append(values)
    query_row, query_id, rows, score = (np.concatenate(c) for c in told)
    return pa.table(
        [pa.array(query_row), pa.array(query_id), pa.array(ids[rows], mask=rows >= known), pa.array(score)], schema=kinds
    )


def usable(vector: Column) -> Column:
    """Whether a vector is not null, not zero, and has finite components only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    projections: int = PROJECTIONS,
    threshold: float = THRESHOLD,
    recall: float = RECALL,
) -> DataFrame:
    """The k nearest of every query row: query_id, rank (from 1), vec_id and score.

    Candidates are all rows with usable vectors, but those with the query's id: rows that
    repeat an id are no neighbours of each other. Ties go to the smaller id, null ids last.
    A null id is a candidate and never a query. Vectors of another length than the
    query's are no candidates. Repeated query rows have a result each. Where there are
    fewer than k candidates, all are returned; an empty table has no rows. ``is_query``
    is read against ``vectors``. Ids are whole numbers.
    """
    # Written once: row numbers stay what they are whatever is computed again.
    held = stage(
        vectors.select(
            named(id_col).cast("long").alias("vec_id"),
            named(vector_col).alias("vector"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
            F.monotonically_increasing_id().alias("row"),
        ).where(usable(F.col("vector"))),
        "neighbour-vectors",
    ).withColumn("dim", F.size("vector"))
    queries = held.where(F.col("asks") & F.col("vec_id").isNotNull())
    sizes = held.agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).first()
    blocks, chunks = -(-max(sizes["n"], 1) // BLOCK_ROWS), -(-max(sizes["q"], 1) // CHUNK_QUERIES)

    def dealt(df: DataFrame, own: str, n: int, others: str, m: int) -> DataFrame:
        return df.select(
            "dim",
            F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias(own),
            F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(others),
            "vec_id",
            "vector",
            "row",
        )

    keys = ("dim", "block", "chunk")
    met = (
        dealt(held, "block", blocks, "chunk", chunks)
        .groupBy(*keys)
        .cogroup(dealt(queries, "chunk", chunks, "block", blocks).groupBy(*keys))
        .applyInArrow(partial(_met, k=k, projections=projections, threshold=threshold, recall=recall), _FOUND)
    )
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (
        met.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )

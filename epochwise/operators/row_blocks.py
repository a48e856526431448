"""Rows packed into written blocks, and passes over them that send back sums only.

Trainers that need many passes read their rows as blocks of matrices: nothing is parsed or
shuffled again, each task works through its own blocks, and what leaves a task are sums of
a size that follows from the model, not from the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from epochwise.storage import stage

BLOCK_ROWS = 2048
# Bits of a row's number.
NUMBER_BITS = 60
NONE = -1
# Sums of a key that one task adds up, beyond which they are added in two steps.
_TOGETHER = 64
# Numbers that the driver adds up itself: it gets them in every pass, so they are few.
_DRIVER_NUMBERS = 200_000

_SCHEMA = "id long, n int, x binary, y binary, part binary, fold binary, u binary"


_SUMS = "key int, at int, v binary"


def row_number(seed: int, member: int) -> str:
    """A whole number below 2^60 for a row's id and a member, as SQL: a repeatable random number."""
    return f"cast(conv(substr(md5(concat_ws('|', SubjectID, EpochID, '{seed}', '{member}')), 1, 15), 16, 10) as bigint)"


@dataclass(frozen=True)
class Rows:
    """One block: features, label 0/1, codes of the part and the fold (NONE: in no part), numbers."""

    x: np.ndarray
    y: np.ndarray
    part: np.ndarray
    fold: np.ndarray
    u: np.ndarray


def rows_of(block) -> Rows:
    def ints(data: bytes, kind: str) -> np.ndarray:
        return np.frombuffer(data, dtype=kind)

    return Rows(
        np.frombuffer(block.x, dtype="<f8").reshape(block.n, -1),
        ints(block.y, "<i4"),
        ints(block.part, "<i4"),
        ints(block.fold, "<i4"),
        ints(block.u, "<i8").reshape(block.n, -1),
    )


def write_blocks(
    rows: DataFrame, numbers: int = 0, seed: int = 42, part: Column | None = None, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Written blocks of ``rows`` (SubjectID, EpochID, label 0/1, features, maybe fold).

    ``part`` is the code of a row's part; ``numbers`` random numbers go with each row.
    """
    ready = rows.select(
        vector_to_array("features").alias("x"),
        F.col("label").cast("int").alias("y"),
        (F.lit(NONE) if part is None else part.cast("int")).alias("part"),
        (F.col("fold").cast("int") if "fold" in rows.columns else F.lit(NONE)).alias("fold"),
        F.expr(f"array({', '.join(row_number(seed, m) for m in range(numbers))})").cast("array<bigint>").alias("u"),
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), block_rows):
                some = batch.iloc[at : at + block_rows]
                packed = {c: [some[c].to_numpy(dtype="<i4").tobytes()] for c in ("y", "part", "fold")}
                packed["x"] = [np.stack(some["x"].to_numpy()).astype("<f8").tobytes()]
                packed["u"] = [np.array(some["u"].tolist(), dtype="<i8").tobytes()]
                yield pd.DataFrame({"id": [0], "n": [len(some)], **packed})[["id", "n", "x", "y", "part", "fold", "u"]]

    held = stage(ready, "block-rows")
    # Few rows still keep all cores at work.
    spread = max(rows.sparkSession.sparkContext.defaultParallelism, -(-held.count() // (8 * block_rows)))
    packed = held.repartition(spread).mapInPandas(pack, _SCHEMA)
    return stage(packed.withColumn("id", F.monotonically_increasing_id()), "row-blocks")


def width_of(blocks: DataFrame) -> int:
    """Features of the rows in the blocks; 0 if there are none."""
    first = blocks.selectExpr("length(x) div (8 * n) AS d").first()
    return int(first.d) if first else 0


def sums_by_key(
    blocks: DataFrame,
    per_block: Callable[[object], dict[int, np.ndarray]],
    finish: Callable[[int, np.ndarray], dict],
    schema: str,
    numbers: int,
) -> list[Row]:
    """What ``finish`` makes of each key and the sum of its arrays over all blocks, as rows of ``schema``.

    A task sends its own sums, one row for each key, at most ``numbers`` numbers in all.
    Where these are few, the driver adds them; else Spark does, in two steps if many tasks
    have sums of a key, so that nobody gathers more than a few dozen of them. Either way they
    are added in the order of the tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.itertuples(index=False):
                for key, values in per_block(block).items():
                    total[key] = total[key] + values if key in total else values
        at = TaskContext.get().partitionId()
        for key, values in total.items():
            yield pd.DataFrame({"key": [key], "at": [at], "v": [values.astype("<f8").tobytes()]})

    def add(parts: list[bytes]) -> np.ndarray:
        total = np.frombuffer(parts[0], dtype="<f8").copy()
        for part in parts[1:]:
            total += np.frombuffer(part, dtype="<f8")
        return total

    def some(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"key": [key[0]], "at": [key[1]], "v": [add(got.sort_values("at")["v"].tolist()).tobytes()]})

    def last(key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        parts = got.sort_values("at")["v"].tolist()
        return pd.DataFrame({name: [value] for name, value in finish(int(key[0]), add(parts)).items()})

    files = len(blocks.inputFiles())
    sums = blocks.mapInPandas(run, _SUMS)
    if files * numbers <= _DRIVER_NUMBERS:
        got = sums.toArrow().sort_by([("key", "ascending"), ("at", "ascending")])
        held: dict[int, list[bytes]] = {}
        for key, part in zip(got["key"].to_pylist(), got["v"], strict=True):
            held.setdefault(key, []).append(part.as_buffer())
        return [Row(**finish(key, add(parts))) for key, parts in held.items()]
    if files > _TOGETHER:
        sums = sums.groupBy("key", (F.col("at") % _TOGETHER).alias("sub")).applyInPandas(some, _SUMS)
    return sums.groupBy("key").applyInPandas(last, schema).collect()


def summed(blocks: DataFrame, per_block: Callable[[object], dict[int, np.ndarray]], numbers: int) -> dict[int, np.ndarray]:
    """The sums themselves, of a size that the model bounds."""

    def whole(key: int, v: np.ndarray) -> dict:
        return {"key": key, "v": v.tobytes()}

    return {r.key: np.frombuffer(r.v, dtype="<f8") for r in sums_by_key(blocks, per_block, whole, "key int, v binary", numbers)}

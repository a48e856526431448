"""Row numbers inside groups that may be too large for one task.

``row_number()`` over a group sends the whole group to one task. Here rows are
numbered inside small chunks whose order is known, and every chunk adds the
count of the chunks before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epochwise.storage import stage

# monotonically_increasing_id keeps the partition above bit 33.
_POSITION_BITS = 33


def _before(sizes: DataFrame, keys: Sequence[str], chunk: str) -> DataFrame:
    """Add the rows of earlier chunks, and of the group, to a table of chunk sizes."""
    w = Window.partitionBy(*keys).orderBy(chunk)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).withColumn(
        "_group_rows", F.sum("_rows").over(everything)
    )


def number_by_range(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], alias: str
) -> tuple[DataFrame, DataFrame]:
    """Number rows from 0 within ``keys`` in ``order``; also return the group sizes.

    One range shuffle on (keys, order) cuts even a single giant group into even
    parts. The sorted rows are written once with their place in the part, so
    part borders stay fixed whatever is computed again. Keys plus order must
    be unique.
    """
    by = [*keys, *order]
    placed = (
        df.repartitionByRange(*by)
        .sortWithinPartitions(*by)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = stage(placed, f"ordered-{alias}").withColumn(
        "_part", F.shiftright("_place", _POSITION_BITS)
    )
    sizes = placed.groupBy(*keys, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    # At most (parts + groups) rows, written so that its size is known.
    sizes = stage(_before(sizes, keys, "_part"), f"sizes-{alias}")
    numbered = (
        placed.join(sizes.drop("_rows", "_group_rows"), [*keys, "_part"])
        .withColumn(alias, F.col("_before") + F.col("_place") - F.col("_first"))
        .drop("_place", "_part", "_first", "_before")
    )
    totals = sizes.groupBy(*keys).agg(F.sum("_rows").alias("rows"))
    return numbered, totals


def number_by_chunk(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[Column | str],
    alias: str,
    total: str | None = None,
) -> DataFrame:
    """Number rows from 0 within ``keys`` where ``chunk`` follows the order.

    ``total`` names a column for the size of the row's group.

    ``chunk`` must be non-decreasing along ``order`` and split every group into
    pieces of bounded size. Rows shuffle once, on (keys, chunk). The chunk table
    may come from unfolded ranges, whose size Spark underestimates, so it is
    merged rather than broadcast.
    """
    chunked = df.withColumn("_chunk", chunk)
    sizes = chunked.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_rows"))
    before = _before(sizes, keys, "_chunk").drop("_rows")
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    numbered = (
        chunked.withColumn("_inside", F.row_number().over(inside) - 1)
        .join(before.hint("merge"), [*keys, "_chunk"])
        .withColumn(alias, (F.col("_before") + F.col("_inside")).cast("long"))
    )
    if total is not None:
        numbered = numbered.withColumn(total, F.col("_group_rows"))
    return numbered.drop("_chunk", "_inside", "_before", "_group_rows")


def number_by_hash(
    df: DataFrame,
    keys: Sequence[str],
    digest: Column,
    ties: Sequence[str],
    alias: str,
    total: str | None = None,
) -> DataFrame:
    """Number rows in the order of a hexadecimal digest, which spreads evenly.

    The first four digits form up to 65,536 even chunks per group.
    """
    hashed = df.withColumn("_digest", digest)
    chunk = F.substring("_digest", 1, 4)
    return number_by_chunk(hashed, keys, chunk, ["_digest", *ties], alias, total).drop("_digest")

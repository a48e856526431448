"""Column expressions shared by the operators.

Operators that touch many columns write their expressions as SQL text: Spark
parses one string much faster than Python assembles the same expression call by
call.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A sequence longer than this is unfolded in two steps.
RANGE_CHUNK = 4096


def name(column: str) -> Column:
    """Reference a column whose name may hold dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def quoted(column: str) -> str:
    """The name of a column inside SQL text."""
    return "`" + column.replace("`", "``") + "`"


def number(value: float) -> str:
    """A double inside SQL text."""
    return f"{float(value)!r}D"


def numbers(values: Iterable[float]) -> str:
    return "array(" + ", ".join(number(v) for v in values) + ")"


def usable_spread(spread: Column) -> Column:
    """Divisor that leaves constants alone: 1.0 where the spread is NULL or zero."""
    return F.when(spread.isNotNull() & (spread != 0), spread).otherwise(F.lit(1.0))


def unfold(df: DataFrame, low: Column, high: Column, alias: str) -> DataFrame:
    """One row per integer in [low, high]; no array exceeds the chunk by much."""
    chunk = F.lit(RANGE_CHUNK)
    first = F.floor(low / chunk).cast("long")
    last = F.floor(high / chunk).cast("long")
    base = (
        df.withColumn("_low", low.cast("long"))
        .withColumn("_high", high.cast("long"))
        .where("_low <= _high")
        .withColumn("_chunk", F.explode(F.sequence(first, last)))
    )
    inside = F.sequence(
        F.greatest(F.col("_low"), F.col("_chunk") * chunk),
        F.least(F.col("_high"), F.col("_chunk") * chunk + (chunk - 1)),
    )
    return base.withColumn(alias, F.explode(inside)).drop("_low", "_high", "_chunk")

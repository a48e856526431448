"""Scaling of feature columns, globally or per subject.

Global statistics are one row, fitted like the model of an estimator and put
into the plan as literals: applying them needs no join. Statistics per subject
are a written table, so the join strategy follows from its true size and a
subject that holds most rows is only ever pre-aggregated, never gathered.
The standard deviation is that of a sample; a spread of NULL or 0 divides by 1.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.functions.columns import number, quoted, usable_spread
from epochwise.storage import stage

Pair = tuple[DataFrame, DataFrame]


def _one_row(df: DataFrame, cols: Sequence[str], *aggregates: str) -> list[list[float | None]]:
    """Several aggregates of all columns from one pass; a single row comes back."""
    exprs = [
        F.expr("array(" + ", ".join(f"double({a}({quoted(c)}))" for c in cols) + ")")
        for a in aggregates
    ]
    return [list(v) for v in df.agg(*exprs).first()]


def _literal(value: float | None) -> str:
    return "double(NULL)" if value is None else number(value)


def _replace(df: DataFrame, cols: Sequence[str], make: Callable[[str, int], str]) -> DataFrame:
    """One projection that rewrites ``cols``."""
    place = {c: i for i, c in enumerate(cols)}
    return df.selectExpr(
        *[
            f"{make(quoted(c), place[c])} AS {quoted(c)}" if c in place else quoted(c)
            for c in df.columns
        ]
    )


def minmax_global(
    train: DataFrame,
    test: DataFrame,
    cols: Sequence[str],
    target_min: float = -1.0,
    target_max: float = 1.0,
) -> Pair:
    """Scale by the range of the training rows; a constant maps to ``target_min``."""
    low, high = _one_row(train, cols, "min", "max")

    def scaled(c: str, i: int) -> str:
        lo, hi = low[i], high[i]
        spread = hi - lo if lo is not None and hi != lo else 1.0
        unit = f"({c} - {_literal(lo)}) / {number(spread)}"
        return f"{unit} * {number(target_max - target_min)} + {number(target_min)}"

    return _replace(train, cols, scaled), _replace(test, cols, scaled)


def zscore_global(
    train: DataFrame, test: DataFrame, cols: Sequence[str], keys: Sequence[str]
) -> Pair:
    """Standardise by the training rows; NULL becomes 0, columns come out sorted."""
    mean, std = _one_row(train, cols, "avg", "stddev")

    def scaled(c: str, i: int) -> str:
        z = f"(double({c}) - {_literal(mean[i])}) / {number(std[i] or 1.0)}"
        return f"coalesce({z}, 0D)"

    def apply(df: DataFrame) -> DataFrame:
        kept = df.selectExpr(*[quoted(c) for c in (*keys, *sorted(cols))])
        return _replace(kept, cols, scaled)

    return apply(train), apply(test)


def _by_subject(
    df: DataFrame, cols: Sequence[str], centre: str, spread: str, id_col: str, label: str
) -> DataFrame:
    """``centre`` and ``spread`` are aggregates with a place for the column."""

    def array(aggregate: str) -> str:
        return "array(" + ", ".join(aggregate.format(quoted(c)) for c in cols) + ")"

    usable = "transform({}, s -> if(s IS NULL OR s = 0, 1D, s))"
    stats = df.groupBy(id_col).agg(
        F.expr(f"{array(centre)} AS _centre"),
        F.expr(f"{usable.format(array(spread))} AS _spread"),
    )
    joined = df.join(stage(stats, label), id_col, "left")
    scaled = _replace(joined, cols, lambda c, i: f"({c} - _centre[{i}]) / _spread[{i}]")
    return scaled.drop("_centre", "_spread")


def zscore_by_subject(df: DataFrame, cols: Sequence[str], id_col: str = "SubjectID") -> DataFrame:
    """Standardise within each subject."""
    return _by_subject(df, cols, "avg({})", "stddev({})", id_col, "subject-zscore")


def minmax_by_subject(df: DataFrame, cols: Sequence[str], id_col: str = "SubjectID") -> DataFrame:
    """Scale to [0, 1] within each subject."""
    spread = "double(max({0}) - min({0}))"
    return _by_subject(df, cols, "min({})", spread, id_col, "subject-minmax")


def minmax_vector_by_subject(
    df: DataFrame, feature_col: str = "features", id_col: str = "SubjectID"
) -> DataFrame:
    """Scale the components of a vector column to [0, 1] within each subject."""
    limits = df.groupBy(id_col).agg(
        Summarizer.metrics("min", "max").summary(F.col(feature_col)).alias("_s")
    )
    limits = limits.select(
        id_col,
        vector_to_array("_s.min").alias("_low"),
        vector_to_array("_s.max").alias("_high"),
    )
    shifted = F.zip_with(vector_to_array(feature_col), "_low", lambda v, lo: v - lo)
    ranges = F.zip_with("_high", "_low", lambda hi, lo: usable_spread(hi - lo))
    scaled = array_to_vector(F.zip_with(shifted, ranges, lambda v, r: v / r))
    return (
        df.join(stage(limits, "subject-vector-minmax"), id_col, "left")
        .withColumn(feature_col, scaled)
        .drop("_low", "_high")
    )


def standardise_vectors(train: DataFrame, test: DataFrame, feature_col: str = "features") -> Pair:
    """Centre and scale the components of a vector column by the training rows.

    The deviation is that of a population here; a constant component is only centred.
    """
    component = F.posexplode(vector_to_array(feature_col)).alias("pos", "v")
    found = train.select(component).groupBy("pos").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    # As many rows as components.
    stats = {r.pos: (r.m, r.s) for r in found.collect()}
    means = ", ".join(_literal(stats[i][0]) for i in range(len(stats)))
    spreads = ", ".join(_literal(stats[i][1] or 1.0) for i in range(len(stats)))

    def apply(df: DataFrame) -> DataFrame:
        values = vector_to_array(feature_col)
        centred = F.zip_with(values, F.expr(f"array({means})"), lambda v, m: v - m)
        scaled = F.zip_with(centred, F.expr(f"array({spreads})"), lambda v, s: v / s)
        return df.withColumn(feature_col, array_to_vector(scaled))

    return apply(train), apply(test)


def zscore_power(train: DataFrame, test: DataFrame) -> Pair:
    """Standardise ``Power`` by (Electrode, WaveBand) of the training rows.

    Rows whose pair is unseen in training drop out.
    """
    by = ["Electrode", "WaveBand"]
    stats = stage(
        train.groupBy(*by).agg(F.avg("Power").alias("_mean"), F.stddev("Power").alias("_std")),
        "power-zscore",
    )

    def apply(df: DataFrame) -> DataFrame:
        z = (F.col("Power") - F.col("_mean")) / usable_spread(F.col("_std"))
        return df.join(stats, by).withColumn("Power", z).drop("_mean", "_std")

    return apply(train), apply(test)

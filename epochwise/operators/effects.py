"""Effect size of each feature between two labels, and selection by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: features below this absolute effect size are left out.
THRESHOLD = 0.5


def _of(label: int, aggregate, value: Column) -> Column:
    return aggregate(F.when(F.col("label") == label, value))


def effect_size(rows: DataFrame, feature: str = "pivot", value: str = "value") -> DataFrame:
    """Cohen's d (pooled deviation), Welch's t and its degrees of freedom.

    ``rows`` is long: feature, label 0/1, value. The groups are combined before
    the shuffle, so neither a frequent feature nor a frequent label is gathered.
    """
    v = F.col(value)
    stats = rows.groupBy(F.col(feature).alias("Feature")).agg(
        *[_of(i, F.count, v).alias(f"n{i}") for i in (0, 1)],
        *[_of(i, F.avg, v).alias(f"m{i}") for i in (0, 1)],
        *[_of(i, F.var_samp, v).alias(f"v{i}") for i in (0, 1)],
    )
    n0, n1, v0, v1 = (F.col(c) for c in ("n0", "n1", "v0", "v1"))
    gap = F.col("m1") - F.col("m0")
    pooled = F.sqrt(F.try_divide((n1 - 1) * v1 + (n0 - 1) * v0, n0 + n1 - 2))
    e0, e1 = F.try_divide(v0, n0), F.try_divide(v1, n1)
    d = F.try_divide(gap, pooled)
    return stats.select(
        "Feature",
        "n0",
        "n1",
        d.alias("Cohen_d"),
        F.abs(d).alias("Abs_Cohen_d"),
        F.try_divide(gap, F.sqrt(e0 + e1)).alias("t"),
        F.try_divide(
            (e0 + e1) * (e0 + e1),
            F.try_divide(e0 * e0, n0 - 1) + F.try_divide(e1 * e1, n1 - 1),
        ).alias("dof"),
    )


def strong_features(effects: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Effects strictly above the threshold."""
    return effects.where(F.col("Abs_Cohen_d") > threshold)


def strong_names(effects: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """Their names, sorted: column names of a matrix, hence few."""
    rows = strong_features(effects, threshold).select("Feature").collect()
    return sorted(r["Feature"] for r in rows)

"""Long feature rows to wide matrices and back."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.functions.columns import name, quoted
from epochwise.operators.features import (
    BAND_FEATURES,
    ELECTRODE_FEATURES,
    EPOCH_FEATURES,
    LEVELS,
)

KEYS = ["SubjectID", "EpochID", "label"]


def pivot_key() -> Column:
    """Electrode_WaveBand_Feature; missing parts are left out with their underscore."""
    return F.concat_ws("_", "Electrode", "WaveBand", "FeatureName")


def wide_names(
    electrodes: Sequence[str], s: Settings, levels: Sequence[str] = LEVELS
) -> list[str]:
    """All pivot keys, sorted, from metadata; no job looks for them in the data."""
    out: list[str] = []
    for e in electrodes:
        if "electrode" in levels:
            out += [f"{e}_{f}" for f in ELECTRODE_FEATURES]
        if "band" in levels:
            out += [f"{e}_{b.name}_{f}" for b in s.bands for f in BAND_FEATURES]
    if "epoch" in levels:
        out += EPOCH_FEATURES
    return sorted(out)


def feature_columns(df: DataFrame) -> list[str]:
    """Every column but the keys."""
    return [c for c in df.columns if c not in KEYS]


def fill_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """NULL features become 0.0; the keys stay as they are."""
    cols = set(cols)
    return df.selectExpr(
        *[
            f"coalesce({quoted(c)}, 0D) AS {quoted(c)}" if c in cols else quoted(c)
            for c in df.columns
        ]
    )


def to_wide(rows: DataFrame, names: Sequence[str], fill: bool = True) -> DataFrame:
    """One row per epoch and one column per pivot key, in the order of ``names``."""
    wide = (
        rows.select(*KEYS, pivot_key().alias("pivot"), "FeatureValue")
        .groupBy(*KEYS)
        .pivot("pivot", list(names))
        .agg(F.first("FeatureValue"))
    )
    return fill_features(wide, names) if fill else wide


def to_wide_by_level(
    rows: DataFrame, electrodes: Sequence[str], s: Settings
) -> DataFrame:
    """The same matrix from one pivot per level and outer joins on the keys."""
    parts = []
    for level in LEVELS:
        level_rows = rows.where(F.col("table_type") == level)
        parts.append(to_wide(level_rows, wide_names(electrodes, s, [level]), fill=False))
    joined = reduce(lambda a, b: a.join(b, KEYS, "outer"), parts)
    return fill_features(joined, feature_columns(joined))


def power_matrix(rows: DataFrame, names: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Wide ``Power`` by Electrode_WaveBand for PCA: (matrix, feature columns)."""
    wide = (
        rows.select(*KEYS, F.concat_ws("_", "Electrode", "WaveBand").alias("pivot"), "Power")
        .groupBy(*KEYS)
        .pivot("pivot", sorted(names))
        .agg(F.first("Power"))
    )
    cols = feature_columns(wide)
    return fill_features(wide, cols), cols


def band_power_rows(rows: DataFrame) -> DataFrame:
    """The Power rows of the long table as (keys, Electrode, WaveBand, Power)."""
    return rows.where((F.col("table_type") == "band") & (F.col("FeatureName") == "Power")).select(
        *KEYS, "Electrode", "WaveBand", F.col("FeatureValue").alias("Power")
    )


def melt(df: DataFrame, cols: Sequence[str], feature: str = "pivot") -> DataFrame:
    """One row per epoch and feature; values become double. No features give no rows."""
    if not cols:
        nothing = (F.lit(None).cast("string").alias(feature), F.lit(None).cast("double").alias("value"))
        return df.select(*KEYS, *nothing).where(F.lit(False))
    ready = df.selectExpr(*KEYS, *[f"double({quoted(c)}) AS {quoted(c)}" for c in cols])
    return ready.unpivot(KEYS, [name(c) for c in cols], feature, "value")


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)

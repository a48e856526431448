"""Time-domain features of an epoch's channel, from its moments.

Variances are population variances. A ratio with a zero divisor is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epochwise.operators.epochs import CHANNEL, EPOCH

MOBILITY = "sqrt(try_divide(d1_var, y_var))"


def hjorth(channels: DataFrame) -> DataFrame:
    """Activity, mobility, complexity and the index made of the last two."""
    step = channels.selectExpr("*", "y_var AS HjorthActivity", f"{MOBILITY} AS HjorthMobility")
    step = step.selectExpr(
        "*",
        "try_divide(sqrt(try_divide(d2_var, d1_var)), HjorthMobility) AS HjorthComplexity",
    )
    return step.selectExpr(
        "*", "2 * HjorthComplexity + try_divide(100D, 2 * HjorthMobility) AS HjorthIndex"
    )


def _mean_of_all(value: str) -> str:
    """Mean that is NULL as soon as one channel has no value."""
    return f"if(count({value}) = count(1), avg({value}), NULL)"


def epoch_statistics() -> list[Column]:
    """Aggregates over the channels of an epoch."""
    values = {
        "Mean": "y_mean",
        "Std": "sqrt(y_var)",
        "Variance": "y_var",
        "RMS": "sqrt(y_square)",
        "HjorthMobility": MOBILITY,
    }
    return [F.expr(f"{_mean_of_all(v)} AS {name}") for name, v in values.items()]


def epoch_stats(channels: DataFrame) -> DataFrame:
    """Mean, Std, Variance, RMS and mobility averaged over the channels."""
    return channels.groupBy(*EPOCH).agg(*epoch_statistics())


def band_hjorth(channels: DataFrame, bands: Sequence[str]) -> DataFrame:
    """Long rows of the unfiltered channel's ratios, once per band; no spectrum is needed."""
    names = ", ".join(f"'{b}'" for b in bands)
    ratios = ("HjorthMobility", "HjorthComplexity", "HjorthIndex")
    pairs = ", ".join(f"struct('{r}' AS FeatureName, {r} AS FeatureValue)" for r in ratios)
    rows = hjorth(channels).selectExpr("*", f"explode(array({names})) AS WaveBand")
    return rows.selectExpr("SubjectID", "EpochID", "Electrode", "WaveBand", f"inline(array({pairs}))")


def shape_moments(detrended: DataFrame, keys: Sequence[str] = CHANNEL) -> DataFrame:
    """Population skewness and excess kurtosis of each channel in each epoch.

    Moments of parts of an epoch are merged, so no sample needs to move for them.
    """
    return detrended.groupBy(*keys).agg(
        F.skewness("y").alias("Skewness"), F.kurtosis("y").alias("Kurtosis")
    )

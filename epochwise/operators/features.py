"""The long feature table: electrode, band and epoch rows from one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epochwise.config import Settings
from epochwise.operators import spectral, temporal
from epochwise.operators.channels import whole_epochs
from epochwise.operators.epochs import EPOCH, keep_epochs

LEVELS = ("electrode", "band", "epoch")

FEATURE_SCHEMA = T.StructType(
    [
        T.StructField("SubjectID", T.StringType(), False),
        T.StructField("EpochID", T.StringType(), False),
        T.StructField("Electrode", T.StringType()),
        T.StructField("WaveBand", T.StringType()),
        T.StructField("FeatureName", T.StringType()),
        T.StructField("FeatureValue", T.FloatType()),
        T.StructField("table_type", T.StringType()),
    ]
)

# The features of each level.
ELECTRODE_FEATURES = (
    "TotalPower",
    "TotalEnergy",
    "SpectralEntropy",
    "HjorthActivity",
    "HjorthMobility",
    "HjorthComplexity",
    "HjorthIndex",
)
BAND_FEATURES = ("Power", "SpectralEntropy", "HjorthMobility", "HjorthComplexity", "HjorthIndex")
EPOCH_FEATURES = ("Mean", "Std", "Variance", "RMS", "HjorthMobility")


def _row(electrode: str, band: str, feature: str, value: str, level: str) -> str:
    return (
        f"struct({electrode} AS Electrode, {band} AS WaveBand, '{feature}' AS FeatureName, "
        f"double({value}) AS FeatureValue, '{level}' AS table_type)"
    )


_NOTHING = "string(NULL)"


def _channel_rows(s: Settings, levels: Sequence[str]) -> list[str]:
    rows = []
    if "electrode" in levels:
        rows += [_row("Electrode", _NOTHING, f, f, "electrode") for f in ELECTRODE_FEATURES]
    if "band" in levels:
        for b in s.bands:
            bins = spectral.band_bins(s, b)
            values = {"Power": spectral.mean_power(bins), "SpectralEntropy": spectral.entropy(bins)}
            rows += [
                _row("Electrode", f"'{b.name}'", f, values.get(f, f), "band")
                for f in BAND_FEATURES
            ]
    return rows


def feature_rows(
    channels: DataFrame, epochs: DataFrame, s: Settings, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Long feature rows of the surviving epochs; ``FeatureValue`` is double.

    Channels of an epoch sit in one partition, so averaging over them and
    unfolding the rows adds no shuffle of the channel rows.
    """
    unknown = set(levels) - set(LEVELS)
    if unknown or not levels:
        raise ValueError(f"levels must be among {LEVELS}, not {sorted(unknown)}")
    spectrum = "electrode" in levels or "band" in levels
    ready = temporal.hjorth(channels)
    if spectrum:
        ready = spectral.spectrum_features(spectral.relative(ready))
        rows = ", ".join(_channel_rows(s, levels))
        ready = ready.selectExpr("*", f"array({rows}) AS _rows")
    aggregates, parts = [], []
    if spectrum:
        aggregates.append(F.expr("flatten(collect_list(_rows)) AS _rows"))
        parts.append("_rows")
    if "epoch" in levels:
        aggregates += temporal.epoch_statistics()
        rows = ", ".join(_row(_NOTHING, _NOTHING, f, f, "epoch") for f in EPOCH_FEATURES)
        parts.append(f"array({rows})")
    grouped = ready.groupBy(*EPOCH).agg(*aggregates)
    merged = grouped.selectExpr(*EPOCH, f"concat({', '.join(parts)}) AS _rows")
    return keep_epochs(merged, epochs).selectExpr("SubjectID", "EpochID", "inline(_rows)")


def feature_long(
    signal: DataFrame, epochs: DataFrame, s: Settings, levels: Sequence[str] = LEVELS
) -> DataFrame:
    """Signal to long feature table; levels not asked for are not computed."""
    channels = whole_epochs(signal, s, spectrum="electrode" in levels or "band" in levels)
    return feature_rows(channels, epochs, s, levels)


def per_rate(
    signal: DataFrame, recs: DataFrame, settings: Sequence[Settings], extract
) -> DataFrame:
    """Extract recordings of different sampling rates, each with its own settings."""
    out = None
    for s in settings:
        same = recs.where(F.col("sfreq") == F.lit(float(s.rate)))
        part = extract(signal.join(same.select("SubjectID"), "SubjectID", "left_semi"), same, s)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no settings given")
    return out


def feature_rejects(channels: DataFrame, epochs: DataFrame, s: Settings) -> DataFrame:
    """Channels of surviving epochs that cannot give all features, with the reason.

    The epochs carry the ``electrodes`` of their recording, so a long recording is not
    one key of a join.
    """
    expected = epochs.select(*EPOCH, "EpochID", F.explode("electrodes").alias("Electrode"))
    # The epoch table is unfolded, so its estimated size must not make it broadcast.
    found = channels.select(*EPOCH, "Electrode", "y_n", "y_var")
    reason = (
        F.when(F.col("y_n").isNull(), "no samples")
        .when(F.col("y_n") < s.epoch_samples, "short epoch")
        .when(F.col("y_var") == 0, "flat channel")
    )
    return (
        expected.join(found.hint("merge"), [*EPOCH, "Electrode"], "left")
        .select("SubjectID", "EpochID", "Electrode", reason.alias("reason"))
        .where("reason is not null")
    )


def to_feature_schema(rows: DataFrame) -> DataFrame:
    """Columns and types of the stored table; values become 32-bit here only."""
    return rows.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURE_SCHEMA.fields]
    )


def feature_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("table_type").agg(F.count(F.lit(1)).alias("rows"))

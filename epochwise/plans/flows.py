"""The three end-to-end flows: extraction, reduction with PCA, selection by effect size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.operators import components, effects, normalize, reshape
from epochwise.operators.channels import channel_epochs
from epochwise.operators.epochs import centred, channel_lengths, epoch_table, recordings
from epochwise.operators.features import LEVELS, feature_long, feature_rejects, feature_rows
from epochwise.sources.feature_store import append_manifest, read_features, write_features
from epochwise.storage import stage


def extract(
    signal: DataFrame,
    s: Settings,
    annotations: DataFrame | None = None,
    levels: Sequence[str] = LEVELS,
) -> DataFrame:
    """Signal to long features."""
    epochs = epoch_table(recordings(channel_lengths(signal), s), s, annotations)
    return feature_long(signal, epochs, s, levels)


def extract_to(
    signal: DataFrame,
    s: Settings,
    path: str,
    log_path: str,
    annotations: DataFrame | None = None,
) -> DataFrame:
    """Extract, store and log a feature table; returns the stored table.

    Channels that cannot give all features of an epoch are stored beside it, in
    ``path`` with ``-rejects``, with the reason. Both come from one written table of all
    channels in all candidate epochs, so the samples are summed up once.
    """
    lengths = stage(channel_lengths(signal), "lengths")
    found = stage(channel_epochs(centred(signal, lengths), s), "channel-epochs")
    kept = stage(epoch_table(recordings(lengths, s), s, annotations, ["electrodes"]), "epochs")
    write_features(feature_rows(found.where(F.col("y_n") == s.epoch_samples), kept, s), path)
    feature_rejects(found, kept, s).write.mode("overwrite").parquet(f"{path}-rejects")
    stored = read_features(signal.sparkSession, path)
    append_manifest(stored, path, s, log_path)
    return stored


def reduce_with_pca(
    train: DataFrame, test: DataFrame, cols: Sequence[str], variance_target: float = 0.95
) -> tuple[DataFrame, DataFrame, components.Components]:
    """Standardise per subject, project, and scale the scores per subject.

    Components come from the training rows only; each subject is scaled by its
    own rows, in the test set too. The standardised rows and the scores are each
    read more than once and are written in between.
    """
    fitted = None
    scaled = []
    for df, name in ((train, "train"), (test, "test")):
        ready = reshape.fill_features(normalize.zscore_by_subject(df, cols), cols)
        if fitted is None:
            ready = stage(ready, name)
            fitted = components.fit_pca(ready, cols, variance_target)
        scores = stage(components.project(ready, fitted), f"{name}-scores")
        scaled.append(normalize.minmax_vector_by_subject(scores))
    return scaled[0], scaled[1], fitted


def select_by_effect(
    df: DataFrame, cols: Sequence[str], threshold: float = effects.THRESHOLD, may_be_none: bool = False
) -> tuple[DataFrame, list[str]]:
    """Keep strong features and scale them to [-1, 1]: (matrix, kept columns).

    Where no feature is strong, that is an error, or with ``may_be_none`` a matrix of keys only.
    """
    kept = effects.strong_names(effects.effect_size(reshape.melt(df, cols)), threshold)
    if not kept:
        if may_be_none:
            return df.select(*reshape.KEYS), kept
        raise ValueError(f"no feature has an effect above {threshold}")
    chosen = df.select(*reshape.KEYS, *kept)
    return normalize.minmax_global(chosen, chosen, kept)[0], kept

"""Named queries over the sample tables, one or more per operator.

Every query reads whole tables. Values are rounded and aliased so that another
engine can repeat them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochwise.functions.columns import quoted
from epochwise.operators import (
    boosted,
    channels,
    components,
    effects,
    epochs,
    evaluation,
    features,
    linear_grid,
    models,
    neighbours,
    normalize,
    perceptron,
    reshape,
    spectral,
    splits,
    temporal,
)
from epochwise.plans import flows
from epochwise.sources import feature_store, participants, signals
from epochwise.sources import sample_tables as tables
from epochwise.sources.sample_tables import VECTOR_FEATURES
from epochwise.storage import new_path, stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Fixed values of the queries.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "MACHINERY")
ELECTRODES = ("click", "error", "purchase", "signup", "view")
EFFECT_LIMIT = 0.05
LOSO_K = 5
FOLDS = 5
BASE_FOLDS = 15


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _round(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    cols = set(cols)
    return df.selectExpr(
        *[
            f"round({quoted(c)}, {digits}) + 0D AS {quoted(c)}" if c in cols else quoted(c)
            for c in df.columns
        ]
    )


def _annotated(r: tables.Recorded) -> DataFrame:
    return tables.event_annotations(r.signal, r.settings)


def _epochs(r: tables.Recorded) -> DataFrame:
    return epochs.epoch_table(r.recs, r.settings, _annotated(r))


def _channels(r: tables.Recorded, spectrum: bool = True) -> DataFrame:
    return epochs.keep_epochs(channels.whole_epochs(r.signal, r.settings, spectrum), _epochs(r))


def _detrended(r: tables.Recorded) -> DataFrame:
    lines = epochs.keep_epochs(epochs.epoch_lines(r.signal, r.settings), _epochs(r))
    return epochs.residuals(r.signal, lines, r.settings)


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return features.feature_long(r.signal, _epochs(r), r.settings)


# --- sources and sinks ---------------------------------------------------------------


@query
def subjects_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = tables.table(spark, sf_dir, "customer")
    return participants.select_subjects(customers, SEGMENTS, "c_name", "c_mktsegment")


@query
def subject_prefix_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    mixed = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sub-"), user)).otherwise(user)
    return events.groupBy(signals.subject_key(mixed).alias("SubjectID")).agg(
        F.count(F.lit(1)).alias("samples")
    )


@query
def missing_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = tables.table(spark, sf_dir, "customer").select(
        signals.subject_key(F.col("c_custkey")).alias("SubjectID")
    )
    recorded = tables.table(spark, sf_dir, "events").select(
        signals.subject_key(F.col("user_id")).alias("SubjectID")
    )
    return signals.missing_recordings(subjects, recorded)


@query
def feature_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = stage(features.to_feature_schema(_long(spark, sf_dir)), "features")
    path = new_path(spark, "store")
    feature_store.write_features(written, path)
    loaded = feature_store.read_features(spark, path)
    differing = feature_store.differences(written, loaded)
    counts = features.feature_counts(loaded)
    lost = features.feature_counts(differing).withColumnRenamed("rows", "differences")
    return counts.join(lost, "table_type", "left").select(
        "table_type", "rows", F.coalesce("differences", F.lit(0).cast("long")).alias("differences")
    )


@query
def dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    rows = features.feature_long(r.signal, _epochs(r), r.settings, ["epoch"])
    entry = feature_store.manifest(rows, "features", r.settings)
    return entry.select(
        "path",
        "subjects",
        "rows",
        *[F.col("settings")[k].alias(k) for k in ("windowLength", "stepSize", "method")],
    )


# --- epochs --------------------------------------------------------------------------


@query
def epoch_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return epochs.epoch_grid(r.recs, r.settings)


@query
def epoch_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    assigned = epochs.assign_samples(r.signal, r.settings)
    ep = epochs.epoch_table(r.recs, r.settings)
    return epochs.keep_epochs(assigned, ep).select(
        "SubjectID", "EpochID", "Electrode", "n", "j", "x"
    )


@query
def epoch_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return _round(_detrended(r).select("SubjectID", "EpochID", "Electrode", "j", "y"), ["y"])


@query
def epoch_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    spans = epochs.bad_spans(epochs.mark_bad(_annotated(r)))
    touched = epochs.touched_epochs(spans, r.settings)
    grid = epochs.epoch_grid(r.recs, r.settings)
    return grid.join(touched.hint("merge"), epochs.EPOCH, "left_semi")


@query
def annotations_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return _round(epochs.mark_bad(_annotated(r)), ["onset"])


@query
def epoch_renumbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return _epochs(r).select("SubjectID", "epoch_ix", "epoch_no", "EpochID", "start_sample")


# --- spectra -------------------------------------------------------------------------


def _psd(r: tables.Recorded, found: DataFrame, column: str = "psd") -> DataFrame:
    rows = spectral.psd_long(found, r.settings, column).drop("epoch_ix")
    return _round(rows, ["p"], 8 if column == "rel" else 6)


@query
def psd_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return _psd(r, _channels(r))


@query
def psd_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return _psd(r, spectral.relative(_channels(r)), "rel")


@query
def psd_no_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All epochs, from the start of Delta to the end of Beta."""
    r = tables.event_recordings(spark, sf_dir)
    s = r.settings.between("Delta", "Beta")
    found = channels.whole_epochs(r.signal, s)
    kept = epochs.keep_epochs(found, epochs.epoch_table(r.recs, s))
    return _round(spectral.psd_long(kept, s).drop("epoch_ix"), ["p"])


@query
def psd_multitaper(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir, method="multitaper")
    return _psd(r, _channels(r))


@query
def band_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    rows = spectral.band_power(spectral.relative(_channels(r)), r.settings)
    return _round(
        rows.select("SubjectID", "EpochID", "Electrode", "WaveBand", "Power"), ["Power"], 8
    )


@query
def total_power_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    rows = spectral.spectrum_features(spectral.relative(_channels(r)))
    cols = ["TotalPower", "TotalEnergy"]
    return _round(rows.select("SubjectID", "EpochID", "Electrode", *cols), cols, 8)


@query
def spectral_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all bins (WaveBand NULL) and over each band."""
    r = tables.event_recordings(spark, sf_dir)
    rel = spectral.relative(_channels(r))
    keys = ["SubjectID", "EpochID", "Electrode", "WaveBand", "SpectralEntropy"]
    bins = {f"'{b.name}'": spectral.band_bins(r.settings, b) for b in r.settings.bands}
    structs = ", ".join(
        f"struct({band} AS WaveBand, {spectral.entropy(part)} AS SpectralEntropy)"
        for band, part in {"string(NULL)": "rel", **bins}.items()
    )
    rows = rel.selectExpr("SubjectID", "EpochID", "Electrode", f"inline(array({structs}))")
    return _round(rows.select(*keys), ["SpectralEntropy"])


# --- time domain ---------------------------------------------------------------------

_HJORTH = ["HjorthMobility", "HjorthComplexity", "HjorthIndex"]


@query
def epoch_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    stats = temporal.epoch_stats(channels.whole_epochs(r.signal, r.settings, spectrum=False))
    kept = epochs.keep_epochs(stats, _epochs(r)).drop("epoch_ix")
    return _round(kept, features.EPOCH_FEATURES)


@query
def hjorth_electrode(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    cols = ["HjorthActivity", *_HJORTH]
    rows = temporal.hjorth(_channels(r, spectrum=False))
    return _round(rows.select("SubjectID", "EpochID", "Electrode", *cols), cols)


@query
def hjorth_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unfiltered channel's values, once per band."""
    r = tables.event_recordings(spark, sf_dir)
    rows = temporal.band_hjorth(_channels(r, spectrum=False), [b.name for b in r.settings.bands])
    return _round(rows, ["FeatureValue"])


@query
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    shapes = temporal.shape_moments(_detrended(r), ["SubjectID", "EpochID", "Electrode"])
    return _round(shapes, ["Skewness", "Kurtosis"])


# --- the feature table ---------------------------------------------------------------


@query
def feature_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_long(spark, sf_dir), ["FeatureValue"])


@query
def feature_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels that lack samples of an epoch, or are flat in it."""
    r = tables.event_recordings(spark, sf_dir)
    ep = epochs.epoch_table(r.recs, r.settings, carry=["electrodes"])
    found = channels.channel_epochs(r.signal, r.settings, spectrum=False)
    return features.feature_rejects(found, ep, r.settings)


@query
def feature_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.feature_counts(_long(spark, sf_dir))


def _labelled_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.subject_labels(_long(spark, sf_dir))


@query
def feature_wide_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pivots, which read the staged rows, and two outer joins."""
    s = tables.settings()
    rows = stage(_labelled_long(spark, sf_dir), "labelled")
    wide = reshape.to_wide_by_level(rows, ELECTRODES, s)
    return _round(wide, reshape.feature_columns(wide))


@query
def feature_wide_single_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = reshape.wide_names(ELECTRODES, tables.settings())
    return _round(reshape.to_wide(_labelled_long(spark, sf_dir), names), names)


@query
def feature_pca_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    rows = features.feature_long(r.signal, _epochs(r), r.settings, ["band"])
    power = reshape.band_power_rows(tables.subject_labels(rows))
    names = [f"{e}_{b.name}" for e in ELECTRODES for b in r.settings.bands]
    wide, cols = reshape.power_matrix(power, names)
    return _round(wide, cols)


@query
def feature_melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.embedding_matrix(spark, sf_dir)
    return _round(reshape.melt(wide, VECTOR_FEATURES), ["value"])


# --- splits --------------------------------------------------------------------------


def _labelled_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = tables.event_recordings(spark, sf_dir)
    return tables.subject_labels(_epochs(r).select("SubjectID", "EpochID"))


def _both(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.withColumn("part", F.lit("train")).unionByName(
        test.withColumn("part", F.lit("test"))
    )


@query
def holdout_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = tables.subject_labels(tables.event_samples(spark, sf_dir).select("SubjectID"))
    return splits.first_subjects(labelled, 2)


@query
def distinct_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.subjects(tables.event_samples(spark, sf_dir))


@query
def train_test_split_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(*splits.hold_out(_labelled_epochs(spark, sf_dir), 2))


@query
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffled by hash, and in the order of the ids."""
    rows = tables.embedding_rows(spark, sf_dir).drop("values")
    shuffled = splits.stratified_folds(rows, FOLDS, alias="fold_shuffled")
    return splits.stratified_folds(shuffled, FOLDS, shuffle=False, alias="fold_ordered")


@query
def subject_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.random_split(tables.embedding_rows(spark, sf_dir).drop("values"), 0.3)


# --- scaling -------------------------------------------------------------------------


def _split_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return splits.hold_out(tables.embedding_matrix(spark, sf_dir), 1)


@query
def minmax_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = normalize.minmax_global(*_split_matrix(spark, sf_dir), VECTOR_FEATURES)
    return _round(_both(*scaled), VECTOR_FEATURES)


@query
def zscore_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = normalize.zscore_global(
        *_split_matrix(spark, sf_dir), VECTOR_FEATURES, reshape.KEYS
    )
    return _round(_both(*scaled), VECTOR_FEATURES)


@query
def zscore_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.embedding_matrix(spark, sf_dir)
    return _round(normalize.zscore_by_subject(wide, VECTOR_FEATURES), VECTOR_FEATURES)


@query
def minmax_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.embedding_matrix(spark, sf_dir)
    return _round(normalize.minmax_by_subject(wide, VECTOR_FEATURES), VECTOR_FEATURES)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.embedding_rows(spark, sf_dir)
    return rows.select(*reshape.KEYS, array_to_vector("values").alias("features"))


@query
def minmax_vector_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = normalize.minmax_vector_by_subject(_vectors(spark, sf_dir))
    rows = scaled.select(
        *reshape.KEYS, F.posexplode(vector_to_array("features")).alias("pos", "value")
    )
    return _round(rows, ["value"])


@query
def zscore_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.power_rows(spark, sf_dir)
    held = F.col("l_orderkey") % 5 == 0
    return _round(_both(*normalize.zscore_power(rows.where(~held), rows.where(held))), ["Power"])


# --- effect sizes and components -------------------------------------------------------


def _melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.melt(tables.embedding_matrix(spark, sf_dir), VECTOR_FEATURES)


@query
def effect_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = effects.effect_size(_melted(spark, sf_dir))
    return _round(found, ["Cohen_d", "Abs_Cohen_d", "t", "dof"])


@query
def effect_size_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selecting in long form: only strong features would reach a pivot."""
    rows = _melted(spark, sf_dir)
    strong = effects.strong_features(effects.effect_size(rows), EFFECT_LIMIT)
    names = strong.select(F.col("Feature").alias("pivot"))
    return _round(rows.join(names, "pivot", "left_semi"), ["value"])


@query
def minmax_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = tables.embedding_matrix(spark, sf_dir)
    scaled, kept = flows.select_by_effect(wide, VECTOR_FEATURES, EFFECT_LIMIT, may_be_none=True)
    return _round(reshape.melt(scaled, kept), ["value"])


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, components.Components]:
    wide = tables.embedding_matrix(spark, sf_dir)
    return wide, components.fit_pca(wide, VECTOR_FEATURES)


@query
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, fitted = _fitted(spark, sf_dir)
    rows = components.explained_variance(wide, fitted)
    return _round(rows, ["ev", "cum_ev"]).withColumn("kept", F.col("pc") <= fitted.k)


@query
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole reduction: subject-wise scores, projection, subject-wise ranges."""
    train, test, _ = flows.reduce_with_pca(*_split_matrix(spark, sf_dir), VECTOR_FEATURES)
    rows = _both(train, test).select(
        *reshape.KEYS, "part", F.posexplode(vector_to_array("features")).alias("pc", "value")
    )
    return _round(rows, ["value"])


@query
def pca_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components together only rotate: the length of each row stays."""
    wide = tables.embedding_matrix(spark, sf_dir)
    whole = components.fit_pca(wide, VECTOR_FEATURES, variance_target=2.0)
    scores = components.project(wide, whole).withColumn("s", vector_to_array("features"))
    rows = scores.selectExpr(
        *reshape.KEYS, "size(s) AS components", "sqrt(aggregate(s, 0D, (t, v) -> t + v * v)) AS length"
    )
    return _round(rows, ["length"])


@query
def pca_top_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, fitted = _fitted(spark, sf_dir)
    return _round(components.top_loadings(wide, fitted), ["weight"])


def _whole_pca(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, components.Components, DataFrame]:
    """The matrix, all its components, and a table (pc, eigenvalue)."""
    wide = tables.embedding_matrix(spark, sf_dir)
    whole = components.fit_pca(wide, VECTOR_FEATURES, variance_target=2.0)
    total = wide.agg(F.expr(" + ".join(f"var_samp({c})" for c in VECTOR_FEATURES)).alias("total")).first().total
    shares = components.explained_variance(wide, whole)
    return wide, whole, shares.select("pc", (F.col("ev") * F.lit(total)).alias("eigenvalue"))


@query
def pca_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues and loadings put the covariance matrix together again."""
    wide, whole, eigenvalues = _whole_pca(spark, sf_dir)
    one = components.loadings(wide, whole)
    a = one.toDF("pc", "feature_a", "weight_a")
    b = one.toDF("pc", "feature_b", "weight_b")
    rows = (
        a.join(b, "pc")
        .where("feature_a <= feature_b")
        .join(F.broadcast(eigenvalues), "pc")
        .groupBy("feature_a", "feature_b")
        .agg(F.sum(F.expr("eigenvalue * weight_a * weight_b")).alias("covariance"))
    )
    return _round(rows, ["covariance"])


@query
def pca_loadings_orthonormal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products of all pairs of components: the identity."""
    wide, whole, _ = _whole_pca(spark, sf_dir)
    one = components.loadings(wide, whole)
    a, b = one.toDF("pc_a", "feature", "weight_a"), one.toDF("pc_b", "feature", "weight_b")
    rows = a.join(b, "feature").where("pc_a <= pc_b").groupBy("pc_a", "pc_b").agg(
        F.sum(F.expr("weight_a * weight_b")).alias("product")
    )
    return _round(rows, ["product"])


@query
def pca_scores_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores are uncorrelated, and their variances are the eigenvalues: no gap anywhere."""
    wide, whole, eigenvalues = _whole_pca(spark, sf_dir)
    scores = components.project(wide, whole).select(vector_to_array("features").alias("s"))
    k = whole.k
    # One row holds k * (k + 1) / 2 pairs; they are summed up before the shuffle.
    pairs = scores.selectExpr(
        "s", f"explode(flatten(transform(sequence(1, {k}), a -> transform(sequence(a, {k}), b -> struct(a, b))))) AS at"
    ).selectExpr("at.a AS pc_a", "at.b AS pc_b", "s[at.a - 1] AS x", "s[at.b - 1] AS y")
    found = pairs.groupBy("pc_a", "pc_b").agg(F.covar_samp("x", "y").alias("found"))
    rows = found.join(F.broadcast(eigenvalues), F.col("pc_a") == F.col("pc")).selectExpr(
        "pc_a", "pc_b", "found - if(pc_a = pc_b, eigenvalue, 0D) AS gap"
    )
    return _round(rows, ["gap"])


# --- neighbours ----------------------------------------------------------------------


def _neighbour_rows(df: DataFrame, group: str | None) -> DataFrame:
    return df.select(
        F.col("EpochID").alias("key"),
        "label",
        "values",
        (F.lit(None) if group is None else F.col(group)).cast("string").alias("grp"),
    )


def _with_truth(predictions: DataFrame, rows: DataFrame, *extra: str) -> DataFrame:
    truth = rows.select(F.col("EpochID").alias("key"), "SubjectID", "EpochID", "label", *extra)
    return predictions.join(truth, "key").drop("key")


@query
def knn_grid_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 28 configurations in one comparison of the folds."""
    rows = splits.stratified_folds(tables.embedding_rows(spark, sf_dir), FOLDS)
    rows = stage(rows, "folds")
    vectors = _neighbour_rows(rows, "fold")
    found = neighbours.nearest(vectors, vectors, max(neighbours.K_VALUES))
    predictions = _with_truth(neighbours.vote(found), rows, "fold")
    report = evaluation.grid_report(predictions, ["metric", "k", "weights"])
    return _round(report, ["cv_mean", "cv_std", "best_fold_accuracy"])


@query
def knn_grid_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """28 configurations by 15 folds, training rows and held-out subjects, from one comparison."""
    train, test = splits.hold_out(tables.embedding_rows(spark, sf_dir), 1)
    rows = stage(splits.stratified_folds(train, BASE_FOLDS), "report-folds")
    found = neighbours.by_role(rows, test, max(neighbours.K_VALUES))
    votes = neighbours.vote_lists(found, ["metric", "part", "fold", "label"])
    scores = evaluation.accuracy(votes, ["metric", "k", "weights", "part", "fold"])
    report = evaluation.whole_report(scores, ["metric", "k", "weights"])
    return _round(report, evaluation.REPORT_SCORES)


@query
def knn_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = splits.hold_out(tables.embedding_rows(spark, sf_dir), 1)
    found = neighbours.nearest(
        _neighbour_rows(test, None), _neighbour_rows(train, None), max(neighbours.K_VALUES)
    )
    predictions = _with_truth(neighbours.vote(found), test)
    scores = evaluation.accuracy(predictions, ["metric", "k", "weights"])
    return _round(scores, ["accuracy"])


@query
def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of other subjects, by both metrics."""
    vectors = _neighbour_rows(tables.embedding_rows(spark, sf_dir), "SubjectID")
    return _round(neighbours.nearest(vectors, vectors, LOSO_K), ["dist"])


def _loso(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.embedding_rows(spark, sf_dir)
    vectors = _neighbour_rows(rows, "SubjectID")
    found = neighbours.nearest(vectors, vectors, LOSO_K, ["euclidean"])
    votes = neighbours.vote(found, [LOSO_K], ["uniform"])
    return _with_truth(votes.select("key", "prediction"), rows)


@query
def loso_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loso(spark, sf_dir).select("SubjectID", "EpochID", "label", "prediction")


@query
def subject_identification_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.embedding_rows(spark, sf_dir)
    marked = stage(splits.random_split(rows, 0.3), "marked").withColumnRenamed("EpochID", "key")
    ranked = stage(neighbours.ranked_subjects(rows), "ranked")
    found = neighbours.identification_recall(
        marked.where(~F.col("is_test")), marked.where("is_test"), ranked, ranked.count()
    )
    return _round(found, ["Recall"])


# --- reports -------------------------------------------------------------------------


@query
def correctness_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.correctness(_loso(spark, sf_dir))


@query
def subject_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.subject_accuracy(_loso(spark, sf_dir)), ["accuracy"])


@query
def majority_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.majority_counts(_loso(spark, sf_dir)), ["share_above"])


@query
def subject_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subject_summary(_loso(spark, sf_dir))


@query
def accuracy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.subject_summary(_loso(spark, sf_dir))
    return evaluation.accuracy_histogram(stage(summary, "summary"))


_SCORES = ["precision", "recall", "f1"]


@query
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.classification_report(_loso(spark, sf_dir)), _SCORES)


@query
def macro_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(evaluation.macro_recall(_loso(spark, sf_dir)), ["macro_recall"])


@query
def group_report_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.subject_summary(_loso(spark, sf_dir))
    return _round(evaluation.epoch_group_report(summary), _SCORES)


@query
def group_report_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = evaluation.subject_summary(_loso(spark, sf_dir))
    return _round(evaluation.subject_group_report(summary), _SCORES)


# --- models --------------------------------------------------------------------------


def _cv(spark: SparkSession, sf_dir: str, predictor: models.Predictor, prepare=None) -> DataFrame:
    rows = splits.stratified_folds(_vectors(spark, sf_dir), FOLDS)
    predictions = models.cross_validate(rows, FOLDS, predictor, prepare=prepare)
    return _round(evaluation.accuracy(predictions, ["fold"]), ["accuracy"])


@query
def cv_decision_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cv(spark, sf_dir, models.with_estimator(lambda train: models.decision_tree()))


@query
def cv_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified_folds(_vectors(spark, sf_dir), BASE_FOLDS)
    scores = evaluation.accuracy(boosted.cross_validate(rows, BASE_FOLDS), ["fold"])
    return _round(scores, ["accuracy"])


def _grid_cv(spark: SparkSession, sf_dir: str, grid: linear_grid.Grid) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    rows, _ = normalize.standardise_vectors(vectors, vectors)
    scores = linear_grid.grid_scores(splits.stratified_folds(rows, BASE_FOLDS), rows, BASE_FOLDS, grid)
    return _round(scores.where("part = 'cv'").select("fold", "accuracy"), ["accuracy"])


@query
def cv_linear_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One vector on all rows for each fold."""
    return _grid_cv(spark, sf_dir, _SVM)


@query
def cv_bagged_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid_cv(spark, sf_dir, _BAG)


@query
def bagged_svm_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 72 points of the bagging grid in one report: folds, training rows, held-out subjects."""
    train, test = normalize.standardise_vectors(*splits.hold_out(_vectors(spark, sf_dir), 1))
    scores = linear_grid.grid_scores(splits.stratified_folds(train, BASE_FOLDS), test, BASE_FOLDS)
    report = evaluation.whole_report(scores, ["c", "members", "fraction", "bootstrap"])
    return _round(report, evaluation.REPORT_SCORES)


def _separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors with one more component that tells the classes apart."""
    rows = tables.embedding_rows(spark, sf_dir)
    values = F.concat("values", F.array((F.col("label") * 20 - 10).cast("double")))
    return rows.select(*reshape.KEYS, array_to_vector(values).alias("features"))


@query
def bagged_svm_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one component decides, every configuration predicts every held-out row right."""
    rows = splits.stratified_folds(_separable(spark, sf_dir), FOLDS)
    return linear_grid.grid_predictions(rows, FOLDS)


@query
def bag_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each member of each sampling draws each row."""
    return linear_grid.drawn_rows(_vectors(spark, sf_dir))


@query
def standardised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = normalize.standardise_vectors(*splits.hold_out(_vectors(spark, sf_dir), 1))
    rows = _both(train, test).select(
        *reshape.KEYS, "part", F.posexplode(vector_to_array("features")).alias("pos", "value")
    )
    return _round(rows, ["value"])


@query
def cv_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.stratified_folds(_vectors(spark, sf_dir), FOLDS)
    found = perceptron.grid_predictions(rows, None, FOLDS, [1e-4]).where("part = 'cv'")
    return _round(evaluation.accuracy(found, ["fold"]), ["accuracy"])


@query
def mlp_alpha_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All penalties in one report: folds, training rows, held-out subjects."""
    train, test = splits.hold_out(_vectors(spark, sf_dir), 1)
    found = perceptron.grid_predictions(splits.stratified_folds(train, FOLDS), test, FOLDS)
    report = evaluation.whole_report(evaluation.accuracy(found, ["alpha", "part", "fold"]), ["alpha"])
    return _round(report, evaluation.REPORT_SCORES)


@query
def loso_mlp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.subject_summary(perceptron.leave_one_subject_out(_vectors(spark, sf_dir)))


@query
def loso_mlp_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one component decides, perceptrons predict every left-out row right."""
    return perceptron.leave_one_subject_out(_separable(spark, sf_dir))


_BAG = linear_grid.Grid((1.0,), (10,), (0.1,), (False,))
_SVM = linear_grid.Grid((1.0,), (1,), (1.0,), (False,))


def _baseline_scores(train: DataFrame, test: DataFrame, folds: int) -> DataFrame:
    """Scores of the four baseline models."""
    train, test = stage(train, "baseline-train"), stage(test, "baseline-test")
    tree = models.model_scores(
        train, test, folds, {"DecisionTree": models.with_estimator(lambda rows: models.decision_tree())}
    )
    boosted_scores = evaluation.accuracy(boosted.report_predictions(train, test, folds), ["part", "fold"])
    scores = [tree, boosted_scores.withColumn("model", F.lit("GradientBoosting"))]
    for name, grid in (("BaggingSVM", _BAG), ("SVM", _SVM)):
        found = linear_grid.grid_scores(train, test, folds, grid)
        scores.append(found.select("part", "fold", "accuracy", F.lit(name).alias("model")))
    return reshape.union_all(scores)


@query
def model_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds, training rows and held-out subjects for the four baseline models."""
    train, test = normalize.standardise_vectors(*splits.hold_out(_vectors(spark, sf_dir), 1))
    scores = _baseline_scores(splits.stratified_folds(train, BASE_FOLDS), test, BASE_FOLDS)
    return _round(evaluation.whole_report(scores, ["model"]), evaluation.REPORT_SCORES)


@query
def model_report_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one component decides, all baseline models are right everywhere."""
    train, test = splits.hold_out(_separable(spark, sf_dir), 1)
    scores = _baseline_scores(splits.stratified_folds(train, FOLDS), test, FOLDS)
    return evaluation.whole_report(scores, ["model"])


@query
def loso_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each subject predicted by trees grown on all others, all subjects together."""
    return evaluation.subject_summary(boosted.leave_one_subject_out(_vectors(spark, sf_dir)))


@query
def loso_gbt_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one component decides, trees predict every left-out row right."""
    return boosted.leave_one_subject_out(_separable(spark, sf_dir))

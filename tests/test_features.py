import numpy as np
import pytest
from conftest import signal_of
from pyspark.sql import functions as F

from epochwise.config import Band, Settings
from epochwise.operators import channels, epochs, features, reshape
from epochwise.plans import flows
from epochwise.sources import feature_store

S = Settings(rate=32.0, window=1.0, step=0.5, nfft=16)


@pytest.fixture(scope="module")
def signal(spark):
    rng = np.random.default_rng(5)
    data = {
        (f"sub-{i}", e): 10 * rng.normal(size=110 + 3 * j)
        for i in range(2)
        for j, e in enumerate(["Cz", "O1.x"])
    }
    return signal_of(spark, data)


@pytest.fixture(scope="module")
def rows(spark, signal, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features")) + "/rows"
    flows.extract(signal, S).write.parquet(path)
    return spark.read.parquet(path)


def test_rows_per_epoch(rows):
    per_epoch = rows.groupBy("SubjectID", "EpochID").count().collect()
    assert {r["count"] for r in per_epoch} == {2 * (7 + 5 * 4) + 5}
    assert len(per_epoch) == 2 * 5
    counts = {r["table_type"]: r["rows"] for r in features.feature_counts(rows).collect()}
    assert counts == {"electrode": 140, "band": 400, "epoch": 50}


def test_nulls_by_level(rows):
    assert rows.where("table_type = 'electrode' and WaveBand is not null").count() == 0
    assert rows.where("table_type = 'epoch' and Electrode is not null").count() == 0
    assert rows.where("table_type = 'band' and (WaveBand is null or Electrode is null)").count() == 0


def test_band_rows_repeat_the_channel(rows):
    mobility = rows.where("FeatureName = 'HjorthMobility' and Electrode is not null")
    per_channel = mobility.groupBy("SubjectID", "EpochID", "Electrode").agg(
        F.count_distinct("FeatureValue").alias("n"), F.count("*").alias("rows")
    )
    assert {(r["n"], r["rows"]) for r in per_channel.collect()} == {(1, 5)}


@pytest.mark.parametrize("levels", [["epoch"], ["band"], ["electrode", "epoch"]])
def test_single_levels_equal_the_whole(signal, rows, levels):
    part = flows.extract(signal, S, levels=levels)
    want = rows.where(F.col("table_type").isin(levels))
    key = ["SubjectID", "EpochID", "Electrode", "WaveBand", "FeatureName", "table_type"]
    a = part.select(*key, F.round("FeatureValue", 9).alias("v"))
    b = want.select(*key, F.round("FeatureValue", 9).alias("v"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_time_domain_alone_joins_no_weights(signal):
    plan = channels.channel_epochs(signal, S, spectrum=False)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "re0" not in text and "BroadcastHashJoin" not in text


def test_samples_shuffle_once(signal):
    """Two shuffles in all: samples in chunks, then sums by epoch."""
    plan = channels.channel_epochs(signal, S)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_unknown_level_is_refused(signal):
    with pytest.raises(ValueError):
        flows.extract(signal, S, levels=["second"])


def test_overlapping_and_empty_bands(signal):
    s = Settings(
        rate=32.0, window=1.0, step=0.5, nfft=16,
        bands=(Band("Alpha", 8, 12), Band("custom1", 9, 11), Band("gap", 8.5, 9.5)),
    )
    found = flows.extract(signal, s, levels=["band"]).where("EpochID = 'ep-0'")
    power = found.where("FeatureName = 'Power' and SubjectID = 'sub-0' and Electrode = 'Cz'")
    values = {r["WaveBand"]: r["FeatureValue"] for r in power.collect()}
    assert values["gap"] is None and values["Alpha"] > 0 and values["custom1"] > 0
    entropy = found.where("FeatureName = 'SpectralEntropy' and WaveBand = 'gap'")
    assert {r["FeatureValue"] for r in entropy.collect()} == {0.0}


def test_rejects_name_the_reason(spark):
    rng = np.random.default_rng(1)
    data = {("a", "long"): rng.normal(size=80), ("a", "short"): rng.normal(size=50),
            ("a", "flat"): [2.0] * 80}
    signal = signal_of(spark, data)
    lengths = epochs.channel_lengths(signal)
    expected = epochs.epoch_table(epochs.recordings(lengths, S), S, carry=["electrodes"])
    found = features.feature_rejects(channels.channel_epochs(signal, S, spectrum=False), expected, S)
    got = {(r["EpochID"], r["Electrode"]): r["reason"] for r in found.collect()}
    assert got == {
        ("ep-0", "flat"): "flat channel", ("ep-1", "flat"): "flat channel",
        ("ep-2", "flat"): "flat channel", ("ep-2", "short"): "short epoch",
    }


def test_round_trip_and_manifest(spark, rows, tmp_path):
    path = feature_store.stamped(str(tmp_path), "A")
    feature_store.write_features(rows, path)
    loaded = feature_store.read_features(spark, path)
    assert loaded.schema["FeatureValue"].dataType.typeName() == "float"
    assert feature_store.differences(features.to_feature_schema(rows), loaded).isEmpty()
    other = loaded.where("EpochID <> 'ep-0'")
    assert feature_store.differences(loaded, other).count() == 2 * 59
    log = str(tmp_path / "log")
    for _ in range(2):
        feature_store.append_manifest(loaded, path, S, log)
    entries = spark.read.parquet(log).collect()
    assert len(entries) == 2 and entries[0]["subjects"] == 2 and entries[0]["rows"] == 590
    assert entries[0]["settings"]["freqBands.Alpha"] == "8.0-12.0"


def test_stored_levels_are_pruned(spark, rows, tmp_path):
    path = str(tmp_path / "f")
    feature_store.write_features(rows, path)
    plan = feature_store.read_features(spark, path).where("table_type = 'band'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(table_type" in text


def test_extract_to_stores_and_logs(spark, signal, tmp_path):
    stored = flows.extract_to(signal, S, str(tmp_path / "f"), str(tmp_path / "log"))
    assert stored.count() == 590
    assert spark.read.parquet(str(tmp_path / "log")).count() == 1


def test_recordings_of_two_rates(spark):
    rng = np.random.default_rng(2)
    signal = signal_of(spark, {("a", "e"): rng.normal(size=100), ("b", "e"): rng.normal(size=200)})
    recs = spark.createDataFrame(
        [("a", 100, 32.0), ("b", 200, 64.0)], "SubjectID string, n_samples long, sfreq double"
    )
    fast = Settings(rate=64.0, window=1.0, step=0.5, nfft=32)
    found = features.per_rate(
        signal, recs, [S, fast],
        lambda sig, r, s: features.feature_long(sig, epochs.epoch_table(r, s), s, ["electrode"]),
    )
    per = {r["SubjectID"]: r["n"] for r in
           found.groupBy("SubjectID").agg(F.count_distinct("EpochID").alias("n")).collect()}
    assert per == {"a": 5, "b": 5}


def labelled(rows):
    return rows.withColumn("label", F.when(F.col("SubjectID") == "sub-0", 0).otherwise(1))


def test_both_wide_forms_agree(rows):
    electrodes = ["Cz", "O1.x"]
    one = reshape.to_wide(labelled(rows), reshape.wide_names(electrodes, S))
    three = reshape.to_wide_by_level(labelled(rows), electrodes, S)
    assert sorted(one.columns) == sorted(three.columns)
    assert len(reshape.feature_columns(one)) == 59
    cols = [f"`{c}`" for c in one.columns]
    a, b = one.select(*cols), three.select(*cols)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 10


def test_fill_spares_the_keys(spark):
    df = spark.createDataFrame(
        [("a", "ep-0", None, None)], "SubjectID string, EpochID string, label int, v double"
    )
    row = reshape.fill_features(df, ["v"]).first()
    assert row["label"] is None and row["v"] == 0.0


def test_power_matrix(rows):
    power = reshape.band_power_rows(labelled(rows))
    names = [f"{e}_{b.name}" for e in ("O1.x", "Cz") for b in S.bands]
    wide, cols = reshape.power_matrix(power, names)
    assert cols == sorted(names) and wide.count() == 10


def test_melt_inverts_the_pivot(spark):
    df = spark.createDataFrame(
        [("a", "ep-0", 1, 1.5, 2), ("b", "ep-1", 0, None, 4)],
        "SubjectID string, EpochID string, label int, `x.y` double, z int",
    )
    got = sorted((r["SubjectID"], r["pivot"], r["value"]) for r in reshape.melt(df, ["x.y", "z"]).collect() if r["value"] is not None)
    assert got == [("a", "x.y", 1.5), ("a", "z", 2.0), ("b", "z", 4.0)]


@pytest.mark.parametrize("offset", [0.0, 1e6, 1e8])
def test_levels_cost_no_digits(spark, offset):
    """Moments of a channel on a high level, through the whole extraction."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=40)
    got = flows.extract(signal_of(spark, {("a", "e"): x + offset}), S).where("Electrode = 'e' AND WaveBand IS NULL")
    value = {(r.EpochID, r.FeatureName): r.FeatureValue for r in got.collect()}
    size = S.epoch_samples
    for epoch in sorted({e for e, _ in value}):
        start = int(int(epoch[3:]) * S.step * S.rate)
        part = x[start : start + size] + offset - offset  # what the sum of both still holds
        j = np.arange(size)
        y = part - np.polyval(np.polyfit(j, part, 1), j)
        d, dd = np.diff(y), np.diff(y, 2)
        assert value[epoch, "HjorthActivity"] == pytest.approx(np.var(y), rel=1e-6)
        assert value[epoch, "HjorthMobility"] == pytest.approx(np.sqrt(np.var(d) / np.var(y)), rel=1e-6)
        want = np.sqrt(np.var(dd) / np.var(d)) / np.sqrt(np.var(d) / np.var(y))
        assert value[epoch, "HjorthComplexity"] == pytest.approx(want, rel=1e-6)


def test_gaps_give_no_features(spark):
    """Epochs with missing samples have no rows; the others are as without the gap."""
    x = np.random.default_rng(3).normal(size=60)
    whole = signal_of(spark, {("a", "e"): x})
    gapped = whole.where("n NOT BETWEEN 20 AND 23")
    key = ["EpochID", "FeatureName", "WaveBand"]
    every = {tuple(r[k] for k in key): r.FeatureValue for r in flows.extract(whole, S).where("Electrode = 'e'").collect()}
    left = {tuple(r[k] for k in key): r.FeatureValue for r in flows.extract(gapped, S).where("Electrode = 'e'").collect()}
    starts = {e: int(int(e[3:]) * S.step * S.rate) for e, _, _ in every}
    spoilt = {e for e, s in starts.items() if s <= 23 and s + S.epoch_samples > 20}
    assert spoilt and {e for e, _, _ in left} == set(starts) - spoilt
    for k, v in left.items():
        assert v == pytest.approx(every[k], rel=1e-9)


def test_rejects_are_stored_beside_the_features(spark, tmp_path):
    x = np.random.default_rng(4).normal(size=60)
    signal = signal_of(spark, {("a", "long"): x, ("a", "short"): x[:30], ("a", "flat"): np.zeros(60)})
    flows.extract_to(signal, S, str(tmp_path / "f"), str(tmp_path / "log"))
    rejects = spark.read.parquet(str(tmp_path / "f-rejects"))
    reasons = {(r.Electrode, r.reason) for r in rejects.collect()}
    assert ("flat", "flat channel") in reasons and "short" in {e for e, _ in reasons} and "long" not in {e for e, _ in reasons}

import numpy as np
import pytest
from conftest import signal_of
from pyspark.sql import functions as F

from epochwise.config import Band, Settings
from epochwise.functions.tapers import fourier_plan, slepian
from epochwise.operators import channels, epochs, spectral, tapered, temporal
from epochwise.storage import stage


def line_free(x):
    t = np.arange(len(x))
    return x - np.polyval(np.polyfit(t, x, 1), t)


def welch(y, s):
    n = s.nfft
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)
    parts = [y[i * n : (i + 1) * n] for i in range(len(y) // n)]
    power = [np.abs(np.fft.rfft((p - p.mean()) * window)) ** 2 for p in parts]
    psd = np.mean(power, axis=0) / (s.rate * np.sum(window**2))
    psd[1 : -1 if n % 2 == 0 else None] *= 2
    return psd[[k for k, _ in s.bins()]]


def multitaper(y, s):
    n = len(y)
    t = np.arange(n)
    w = 4.0 / n
    share, vectors = np.linalg.eigh(2 * w * np.sinc(2 * w * (t[:, None] - t[None, :])))
    kept = [i for i in range(n - 1, n - 9, -1) if share[i] > 0.9]
    power = sum(share[i] * np.abs(np.fft.rfft((y - y.mean()) * vectors[:, i])) ** 2 for i in kept)
    psd = 2 * power / share[kept].sum()
    psd[0] /= 2
    if n % 2 == 0:
        psd[-1] /= 2
    return psd[[k for k, _ in s.bins()]]


def spread_out(rate, n, seed=3):
    """Noise on a tone, a drift and a large offset."""
    rng = np.random.default_rng(seed)
    t = np.arange(n) / rate
    return 50 + 4 * t + np.sin(2 * np.pi * 10 * t) + rng.normal(size=n)


CASES = [
    Settings(rate=32.0, window=1.0, step=0.5, nfft=16),
    Settings(rate=64.0, window=2.0, step=0.75, nfft=25),
    Settings(rate=250.0, window=2.0, step=1.5, nfft=256),  # several lane groups
    Settings(rate=32.0, window=2.0, step=1.0, method="multitaper"),
    Settings(rate=33.0, window=1.0, step=0.4, method="multitaper", inclusive_end=False),
]


@pytest.mark.parametrize("s", CASES)
def test_spectrum_matches_numpy(spark, s):
    n = 3 * s.epoch_samples + 5
    data = {("a", "e1"): spread_out(s.rate, n), ("a", "e2"): spread_out(s.rate, n, 4)}
    reference = welch if s.method == "welch" else multitaper
    rows = channels.channel_epochs(signal_of(spark, data), s).where("psd is not null").collect()
    assert len(rows) >= 4
    for r in rows:
        start = int(r["epoch_ix"] * s.step * s.rate)
        y = line_free(data[("a", r["Electrode"])][start : start + s.epoch_samples])
        np.testing.assert_allclose(r["psd"], reference(y, s), rtol=1e-7, atol=1e-12)


def test_lane_groups_are_exercised():
    assert fourier_plan(CASES[2]).groups > 1


def test_tapers_are_orthonormal_and_concentrated():
    tapers, share = slepian(101)
    np.testing.assert_allclose(tapers @ tapers.T, np.eye(len(tapers)), atol=1e-10)
    assert len(tapers) == 7 and (share > 0.9).all() and (share <= 1 + 1e-12).all()


def test_epochs_across_chunks(spark):
    """Differences and sums do not notice where a chunk ends."""
    s = Settings(rate=100.0, window=2.0, step=1.0, nfft=64)
    x = spread_out(s.rate, channels.CHUNK_SAMPLES * 2 + 300)
    rows = channels.channel_epochs(signal_of(spark, {("a", "e"): x}), s)
    rows = temporal.hjorth(rows.where("psd is not null")).collect()
    assert len(rows) == (len(x) - s.epoch_samples) // 100 + 1
    for r in rows:
        start = r["epoch_ix"] * 100
        y = line_free(x[start : start + s.epoch_samples])
        d1, d2 = np.diff(y), np.diff(y, n=2)
        np.testing.assert_allclose(r["y_var"], y.var(), rtol=1e-8)
        mobility = np.sqrt(d1.var() / y.var())
        np.testing.assert_allclose(r["HjorthMobility"], mobility, rtol=1e-8)
        complexity = np.sqrt(d2.var() / d1.var()) / mobility
        np.testing.assert_allclose(r["HjorthComplexity"], complexity, rtol=1e-8)
        index = 2 * complexity + 100 / (2 * mobility)
        np.testing.assert_allclose(r["HjorthIndex"], index, rtol=1e-8)
        np.testing.assert_allclose(r["psd"], welch(y, s), rtol=1e-7)


def test_offset_cancels_after_centring(spark):
    s = CASES[0]
    x = spread_out(s.rate, 100) + 1e6
    signal = signal_of(spark, {("a", "e"): x})
    level = epochs.channel_lengths(signal)
    rows = channels.channel_epochs(epochs.centred(signal, level), s)
    for r in rows.where("psd is not null").collect():
        start = r["epoch_ix"] * 16
        y = line_free(x[start : start + 33] - x.mean())
        np.testing.assert_allclose(r["psd"], welch(y, s), rtol=1e-8)


def test_flat_channel_has_no_ratios(spark):
    s = CASES[0]
    signal = signal_of(spark, {("a", "flat"): [0.1] * 60, ("a", "ok"): spread_out(s.rate, 60)})
    found = temporal.hjorth(channels.channel_epochs(signal, s, spectrum=False))
    flat = found.where("Electrode = 'flat' and epoch_ix = 0").first()
    assert flat["HjorthActivity"] == 0.0
    assert flat["HjorthMobility"] is None and flat["HjorthIndex"] is None
    stats = temporal.epoch_stats(found).where("epoch_ix = 0").first()
    assert stats["HjorthMobility"] is None and stats["Variance"] > 0


def test_flat_channel_has_no_power(spark):
    s = CASES[0]
    signal = signal_of(spark, {("a", "flat"): [0.0] * 60})
    rel = spectral.relative(channels.channel_epochs(signal, s)).where("epoch_ix = 0")
    row = spectral.spectrum_features(rel).first()
    assert row["TotalPower"] is None and row["SpectralEntropy"] is None


def test_epoch_statistics_match_numpy(spark):
    s = CASES[0]
    data = {("a", f"e{i}"): spread_out(s.rate, 60, i) for i in range(3)}
    found = channels.channel_epochs(signal_of(spark, data), s, spectrum=False)
    row = temporal.epoch_stats(found).where("epoch_ix = 1").first()
    ys = [line_free(x[16:49]) for x in data.values()]
    want = {
        "Mean": 0.0,
        "Std": np.mean([y.std() for y in ys]),
        "Variance": np.mean([y.var() for y in ys]),
        "RMS": np.mean([np.sqrt(np.mean(y**2)) for y in ys]),
        "HjorthMobility": np.mean([np.sqrt(np.diff(y).var() / y.var()) for y in ys]),
    }
    for name, value in want.items():
        np.testing.assert_allclose(row[name], value, rtol=1e-9, atol=1e-9)


def test_sine_peaks_in_its_bin_and_band(spark):
    s = Settings(
        rate=128.0, window=2.0, step=1.0, nfft=128,
        bands=(*Settings(rate=128.0, nfft=8).bands, Band("custom1", 9, 11), Band("none", 0.6, 0.9)),
    )
    t = np.arange(400) / s.rate
    signal = signal_of(spark, {("a", "e"): np.sin(2 * np.pi * 10 * t)})
    rel = spectral.relative(channels.channel_epochs(signal, s)).where("epoch_ix = 0")
    row = spectral.spectrum_features(rel).first()
    assert s.bins()[int(np.argmax(row["rel"]))][1] == 10.0
    np.testing.assert_allclose(sum(row["rel"]), 1.0)
    np.testing.assert_allclose(row["TotalPower"], 1 / len(s.bins()))
    assert row["SpectralEntropy"] < 0.5 * np.log2(len(s.bins()))
    bands = {r["WaveBand"]: r for r in spectral.band_power(rel, s).collect()}
    power = {name: r["Power"] for name, r in bands.items()}
    assert max(power, key=lambda b: power[b] or 0) == "custom1"
    assert power["none"] is None and bands["none"]["SpectralEntropy"] == 0.0


def test_upper_edge_belongs_to_the_next_band(spark):
    s = Settings(rate=32.0, window=1.0, step=0.5, nfft=16)
    theta = next(b for b in s.bands if b.name == "Theta")
    df = spark.range(1).selectExpr(
        "transform(sequence(1, 8), k -> cast(2 * k as double)) as rel"
    )
    row = df.selectExpr(spectral.band_bins(s, theta) + " AS v").first()
    assert row["v"] == [4.0, 6.0]


def test_shape_moments_are_population_values(spark):
    s = CASES[0]
    x = spread_out(s.rate, 60) ** 2
    rows = epochs.detrend(epochs.gather(epochs.assign_samples(signal_of(spark, {("a", "e"): x}), s)))
    row = temporal.shape_moments(rows.where("epoch_ix = 0")).first()
    y = line_free(x[:33])
    z = y - y.mean()
    np.testing.assert_allclose(row["Skewness"], np.mean(z**3) / np.mean(z**2) ** 1.5, rtol=1e-8)
    np.testing.assert_allclose(row["Kurtosis"], np.mean(z**4) / np.mean(z**2) ** 2 - 3, rtol=1e-8)


def dense_tapers(n):
    """Eigenvectors of the whole matrix, and their energy inside the band by the sinc kernel."""
    t, w = np.arange(n), 4.0 / n
    off = t[1:] * (n - t[1:]) / 2
    matrix = np.diag(((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * w)) + np.diag(off, 1) + np.diag(off, -1)
    vectors = np.linalg.eigh(matrix)[1][:, ::-1][:, :8].T
    kernel = 2 * w * np.sinc(2 * w * (t[:, None] - t[None, :]))
    return vectors, np.einsum("ti,ij,tj->t", vectors, kernel, vectors)


@pytest.mark.parametrize("n", [8, 9, 33, 64, 250, 1501])
def test_tapers_match_dense_eigenvectors(n):
    tapers, share = slepian(n)
    vectors, shares = dense_tapers(n)
    assert len(tapers) == max(1, (shares > 0.9).sum())
    np.testing.assert_allclose(share, shares[: len(share)], rtol=1e-9)
    np.testing.assert_allclose(np.abs(np.sum(tapers * vectors[: len(tapers)], axis=1)), 1.0, rtol=1e-9)


def test_tapers_of_a_minute():
    tapers, share = slepian(30_000)  # 60 s at 500 Hz
    np.testing.assert_allclose(tapers @ tapers.T, np.eye(7), atol=1e-9)
    assert (np.diff(share) < 1e-12).all() and share[-1] > 0.9


def test_multitaper_over_run_borders_gaps_and_small_blocks(spark, monkeypatch):
    """Runs and blocks do not show; epochs with gaps have the same moments as by sums."""
    s = Settings(rate=32.0, window=2.0, step=0.75, method="multitaper")
    monkeypatch.setattr(tapered, "RUN_SAMPLES", 70)
    monkeypatch.setattr(tapered, "BLOCK_VALUES", 130)
    x = spread_out(s.rate, 700)
    signal = signal_of(spark, {("a", "e"): x, ("a", "flat"): [0.3] * 300}).where("n <> 200 OR Electrode <> 'e'")
    found = {(r.Electrode, r.epoch_ix): r for r in channels.channel_epochs(signal, s).collect()}
    sums = channels.channel_epochs(signal, s, spectrum=False).collect()
    assert set(found) == {(r.Electrode, r.epoch_ix) for r in sums} and len(sums) > 40
    for r in sums:
        got = found[r.Electrode, r.epoch_ix]
        assert got.y_n == r.y_n and (got.psd is not None) == (r.y_n == s.epoch_samples)
        for m in ("y_var", "y_square", "d1_var", "d2_var"):
            if r[m] is None:
                assert got[m] is None
            else:
                assert got[m] == pytest.approx(r[m], rel=1e-7, abs=1e-9)
        if got.psd is not None and r.Electrode == "e":
            start = int(r.epoch_ix * 0.75 * 32)
            np.testing.assert_allclose(got.psd, multitaper(line_free(x[start : start + s.epoch_samples]), s), rtol=1e-7)
    assert found["flat", 0].psd == [0.0] * len(s.bins())


@pytest.mark.parametrize("offset", [0.0, 1e8])
def test_residuals_and_moments_match_numpy(spark, offset):
    s = Settings(rate=32.0, window=1.0, step=0.375, nfft=16)
    drift = np.linspace(0, 1, 400) ** 2 * offset / 100
    data = {("a", "e1"): spread_out(s.rate, 400) ** 2 + offset + drift, ("a", "e2"): spread_out(s.rate, 90, 5) + offset}
    signal = signal_of(spark, data).where("n <> 150").repartition(7)
    lines = epochs.epoch_lines(signal, s).withColumn("EpochID", F.concat(F.lit("ep-"), "epoch_ix"))
    rows = epochs.residuals(signal, lines, s)
    got = {}
    for r in rows.collect():
        got.setdefault((r.Electrode, r.epoch_ix), {})[r.j] = r.y
    shapes = temporal.shape_moments(rows, ["EpochID", "Electrode"]).collect()
    width = s.epoch_samples
    want = {
        (e, i): line_free(v[k : k + width] - v[k])
        for (_, e), v in data.items()
        for i, k in ((i, i * 12) for i in range(40))
        if k + width <= len(v) and not (k <= 150 < k + width)
    }
    assert set(got) == set(want) == {(r.Electrode, int(r.EpochID[3:])) for r in shapes}
    for key, y in want.items():
        np.testing.assert_allclose([got[key][j] for j in range(width)], y, atol=1e-7 if offset else 1e-9)
    for r in shapes:
        z = want[r.Electrode, int(r.EpochID[3:])]
        np.testing.assert_allclose(r.Skewness, np.mean(z**3) / np.mean(z**2) ** 1.5, rtol=1e-6, atol=1e-6)
        np.testing.assert_allclose(r.Kurtosis, np.mean(z**4) / np.mean(z**2) ** 2 - 3, rtol=1e-6, atol=1e-6)


def test_no_exploded_sample_is_shuffled_for_lines_and_moments(spark):
    """Behind every unfolding of samples into epochs there is a partial sum before the next shuffle."""
    s = CASES[0]
    signal = stage(signal_of(spark, {("a", "e"): spread_out(s.rate, 200)}), "signal")
    rows = epochs.residuals(signal, epochs.epoch_lines(signal, s), s)
    plan = temporal.shape_moments(rows)._jdf.queryExecution().sparkPlan().toString()
    assert "partial_regr_slope" in plan and "partial_skewness" in plan and "Window" not in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan

import math

import numpy as np
import pytest
from conftest import signal_of

from epochwise.config import Settings
from epochwise.operators import epochs

SMALL = Settings(rate=8.0, window=1.0, step=0.5, nfft=8)


def recs(spark, **lengths):
    rows = [(k, v) for k, v in lengths.items()]
    return spark.createDataFrame(rows, "SubjectID string, n_samples long")


def reference_starts(n_samples, rate, window, step):
    count = max(0, math.ceil(((n_samples - 1) / rate - window) / step))
    return [int(i * step * rate) for i in range(count)]


@pytest.mark.parametrize(
    "n, rate, window, step",
    [(15_000, 500.0, 3.0, 1.5), (5_000, 500.0, 3.0, 0.3), (700, 33.0, 1.5, 1.5), (9, 8.0, 1.0, 0.5)],
)
def test_grid(spark, n, rate, window, step):
    s = Settings(rate=rate, window=window, step=step, nfft=8)
    got = epochs.epoch_grid(recs(spark, a=n), s).orderBy("epoch_ix").collect()
    assert [r["start_sample"] for r in got] == reference_starts(n, rate, window, step)
    assert all(r["end_sample"] - r["start_sample"] == s.epoch_samples for r in got)


def test_thirty_seconds_give_eighteen_epochs(spark):
    s = Settings(rate=500.0)
    assert epochs.epoch_grid(recs(spark, a=15_000), s).count() == 18


def test_recording_shorter_than_a_window(spark):
    assert epochs.epoch_grid(recs(spark, a=5), SMALL).count() == 0


@pytest.mark.parametrize("rate, window, step", [(8.0, 1.0, 0.5), (10.0, 1.0, 0.3), (33.0, 1.0, 0.7)])
@pytest.mark.parametrize("inclusive", [True, False])
def test_samples_reach_exactly_their_epochs(spark, rate, window, step, inclusive):
    s = Settings(rate=rate, window=window, step=step, nfft=8, inclusive_end=inclusive)
    signal = signal_of(spark, {("a", "e"): range(200)})
    grid = epochs.epoch_grid(recs(spark, a=200), s)
    rows = epochs.assign_samples(signal, s).join(grid, epochs.EPOCH).collect()
    got = sorted((r["epoch_ix"], r["j"], r["n"]) for r in rows)
    starts = reference_starts(200, rate, window, step)
    want = [(i, j, st + j) for i, st in enumerate(starts) for j in range(s.epoch_samples)]
    assert got == sorted(want)


def test_detrend_removes_a_line(spark):
    ramp = [3.0 + 0.5 * i for i in range(40)]
    rng = np.random.default_rng(0)
    noise = rng.normal(size=40)
    signal = signal_of(spark, {("a", "ramp"): ramp, ("a", "noise"): noise})
    rows = epochs.detrend(epochs.gather(epochs.assign_samples(signal, SMALL)))
    for r in rows.where("Electrode = 'ramp'").collect():
        assert r["y"] is None or abs(r["y"]) < 1e-9
    got = rows.where("Electrode = 'noise' and epoch_ix = 2").orderBy("j").collect()
    x = noise[8:17]
    t = np.arange(9)
    want = x - np.polyval(np.polyfit(t, x, 1), t)
    np.testing.assert_allclose([r["y"] for r in got], want, atol=1e-12)


def annotations(spark, rows):
    return spark.createDataFrame(
        rows, "SubjectID string, onset double, duration double, description string"
    )


def test_only_bad_spans_reject(spark):
    marked = epochs.mark_bad(
        annotations(
            spark,
            [
                ("a", 0.1, 0.1, "a boundary here"),
                ("a", 1.0, 0.1, "bad_x"),
                ("a", 2.0, 0.1, "not bad"),
                ("a", 3.0, 0.1, "BAD"),
            ],
        )
    )
    kinds = sorted(r["description"] for r in marked.collect())
    assert kinds == ["BAD", "BAD_boundary", "bad_x", "not bad"]
    assert epochs.bad_spans(marked).count() == 3


@pytest.mark.parametrize(
    "onset, duration, touched",
    [
        (1.0, 0.25, [1, 2]),  # epoch 0 ends exactly where the span starts
        (0.75, 0.25, [0, 1]),  # epoch 2 starts exactly where the span ends
        (1.2, 0.0, [1, 2]),
        (0.0, 100.0, [0, 1, 2, 3, 4, 5, 6]),
    ],
)
def test_touching_an_edge_does_not_reject(spark, onset, duration, touched):
    grid = epochs.epoch_grid(recs(spark, a=37), SMALL)
    spans = epochs.bad_spans(annotations(spark, [("a", onset, duration, "bad")]))
    found = grid.join(epochs.touched_epochs(spans, SMALL), epochs.EPOCH, "left_semi")
    assert sorted(r["epoch_ix"] for r in found.collect()) == touched


def test_survivors_are_renumbered_without_gap(spark):
    table = epochs.epoch_table(
        recs(spark, a=29, b=29), SMALL, annotations(spark, [("a", 0.55, 0.0, "bad_x")])
    )
    rows = table.where("SubjectID = 'a'").orderBy("epoch_ix").collect()
    assert [r["epoch_ix"] for r in rows] == [2, 3, 4]
    assert [r["EpochID"] for r in rows] == ["ep-0", "ep-1", "ep-2"]
    assert table.where("SubjectID = 'b'").count() == 5


def test_recording_is_as_long_as_its_longest_channel(spark):
    signal = signal_of(spark, {("a", "e1"): range(30), ("a", "e2"): range(20)})
    row = epochs.recordings(epochs.channel_lengths(signal), SMALL).first()
    assert (row["n_samples"], row["sfreq"]) == (30, 8.0)

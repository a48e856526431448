"""Multitaper spectra: runs of epochs are transformed where their samples are.

Every epoch is one segment as long as its window, so weights per sample, taper and bin
would grow with the square of the window. Instead the samples shuffle once into runs
of neighbouring epochs (a run also receives the window behind it, at most as many
samples again), and numpy takes out the lines and transforms all epochs of a run
together. What goes to the workers besides is eight tapers of one window.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.config import Settings
from epochwise.functions.tapers import slepian
from epochwise.operators.epochs import epoch_range

# Samples between the starts of two runs, at least one window.
RUN_SAMPLES = 16_384
# Values of a block of epochs; a run is worked on block by block.
BLOCK_VALUES = 1 << 20

_RUN = ["SubjectID", "Electrode", "run"]
_MOMENTS = ("y_mean", "y_square", "y_var", "d1_var", "d2_var")
SCHEMA = (
    "SubjectID string, Electrode string, epoch_ix long, y_n long, "
    + ", ".join(f"{m} double" for m in _MOMENTS)
    + ", psd array<double>"
)


def epochs_per_run(s: Settings) -> int:
    return max(1, math.ceil(max(RUN_SAMPLES, s.epoch_samples) / s.stride))


def in_runs(signal: DataFrame, s: Settings) -> DataFrame:
    """Give each sample to the runs whose epochs may hold it: one or two of them."""
    low, high = epoch_range(F.col("n"), s)
    per = epochs_per_run(s)
    known = signal.where("n IS NOT NULL AND x IS NOT NULL").select("SubjectID", "Electrode", "n", "x")
    ranged = known.withColumn("_low", low).withColumn("_high", high).where("_low <= _high")
    runs = F.sequence(F.expr(f"_low div {per}"), F.expr(f"_high div {per}"))
    return ranged.select("SubjectID", "Electrode", "n", "x", F.explode(runs).alias("run"))


def _moments(x: np.ndarray, held: np.ndarray) -> dict[str, float]:
    """Moments of one epoch with gaps: least-squares line out, differences of neighbours only."""
    place = np.flatnonzero(held)
    found = dict.fromkeys(_MOMENTS, np.nan)
    if len(place) > 1:
        j, v = place - place.mean(), x[place] - x[place].mean()
        y = v - (v @ j) / (j @ j) * j
        found["y_mean"] = y.mean()
        found["y_var"] = 0.0 if np.ptp(v) == 0 else y.var()
        found["y_square"] = found["y_var"] + found["y_mean"] ** 2
    one = (x[1:] - x[:-1])[held[1:] & held[:-1]]
    two = (x[2:] - 2 * x[1:-1] + x[:-2])[held[2:] & held[1:-1] & held[:-2]]
    found["d1_var"] = one.var() if len(one) else np.nan
    found["d2_var"] = two.var() if len(two) else np.nan
    return found


def _whole_moments(x: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Moments of epochs without gaps, one a row, and the epochs without their lines."""
    j = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
    centred = x - x.mean(axis=1, keepdims=True)
    y = centred - np.outer(centred @ j / max(j @ j, 1.0), j)
    y[np.ptp(x, axis=1) == 0] = 0.0
    found = {"y_mean": y.mean(axis=1), "y_var": y.var(axis=1)}
    found["y_square"] = found["y_var"] + found["y_mean"] ** 2
    nothing = np.full(len(x), np.nan)
    found["d1_var"] = np.diff(x, axis=1).var(axis=1) if x.shape[1] > 1 else nothing
    found["d2_var"] = np.diff(x, n=2, axis=1).var(axis=1) if x.shape[1] > 2 else nothing
    return found, y


def _worker(s: Settings) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    width, step, rate = s.epoch_samples, float(s.step), float(s.rate)
    per, block = epochs_per_run(s), max(1, BLOCK_VALUES // s.epoch_samples)
    tapers, concentration = slepian(width)
    shares = concentration / concentration.sum()
    bins = np.array([k for k, _ in s.bins()], dtype=int)
    if bins.size == 0:
        raise ValueError("no frequency bin lies inside the bands")
    sides = np.where((bins == 0) | ((width % 2 == 0) & (bins == width // 2)), 1.0, 2.0)

    def power(y: np.ndarray) -> np.ndarray:
        total = np.zeros((len(y), len(bins)))
        for taper, share in zip(tapers, shares, strict=True):
            lanes = np.fft.rfft(y * taper, axis=1)[:, bins]
            total += share * (lanes.real**2 + lanes.imag**2)
        return total * sides

    def described(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        numbers = np.arange(key[2] * per, (key[2] + 1) * per)
        starts = (numbers * step * rate).astype(np.int64)
        at = rows["n"].to_numpy() - starts[0]
        size = starts[-1] + width - starts[0]
        inside = (at >= 0) & (at < size)
        samples, present = np.zeros(size), np.zeros(size, dtype=bool)
        samples[at[inside]] = rows["x"].to_numpy()[inside]
        present[at[inside]] = True
        parts = []
        for b in range(0, per, block):
            places = (starts[b : b + block] - starts[0])[:, None] + np.arange(width)
            held = present[places]
            counts = held.sum(axis=1)
            out = pd.DataFrame({"epoch_ix": numbers[b : b + block], "y_n": counts, **dict.fromkeys(_MOMENTS, np.nan)})
            out["psd"] = None
            whole = np.flatnonzero(counts == width)
            if len(whole):
                found, y = _whole_moments(samples[places[whole]])
                for name, values in found.items():
                    out.loc[whole, name] = values
                spectra = power(y)
                out["psd"] = pd.Series(list(spectra), index=whole, dtype=object).reindex(out.index)
            for i in np.flatnonzero((counts > 0) & (counts < width)):
                for name, value in _moments(samples[places[i]], held[i]).items():
                    out.loc[i, name] = value
            parts.append(out[counts > 0])
        found = pd.concat(parts, ignore_index=True)
        found["psd"] = found["psd"].astype(object).where(found["psd"].notna(), None)
        found.insert(0, "SubjectID", key[0])
        found.insert(1, "Electrode", key[1])
        return found

    return described


def tapered_epochs(signal: DataFrame, s: Settings) -> DataFrame:
    """Moments and multitaper spectrum ``psd`` of all candidate epochs of a signal.

    Like ``channels.channel_epochs``: one row per channel and epoch with any sample;
    ``psd`` is NULL for an epoch with gaps. Sample numbers are unique in a channel.
    """
    keys = ["SubjectID", "epoch_ix", "Electrode"]
    found = in_runs(signal, s).groupBy(*_RUN).applyInPandas(_worker(s), SCHEMA)
    return found.select(*keys, "y_n", *_MOMENTS, "psd")

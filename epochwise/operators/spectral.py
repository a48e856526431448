"""Features of a channel's power spectrum.

``psd`` is an array over the retained bins. Bins are ordered by frequency, so a
band is a slice whose limits follow from the settings. Expressions over the bins
are SQL text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epochwise.config import Band, Settings
from epochwise.functions.columns import number, numbers
from epochwise.operators.epochs import CHANNEL

# Fixed value: keeps the logarithm finite for empty bins.
LOG_FLOOR = 1e-12


def array_sum(bins: str) -> str:
    return f"aggregate({bins}, 0D, (total, p) -> total + p)"


def relative(channels: DataFrame) -> DataFrame:
    """Divide the spectrum by its sum (column ``rel``); NULL bins if the sum is zero."""
    summed = channels.selectExpr("*", f"{array_sum('psd')} AS _total")
    return summed.selectExpr("*", "transform(psd, p -> try_divide(p, _total)) AS rel").drop("_total")


def band_bins(s: Settings, band: Band, spectrum: str = "rel") -> str:
    """The bins with fmin <= f < fmax."""
    inside = [i for i, (_, f) in enumerate(s.bins()) if band.fmin <= f < band.fmax]
    return f"slice({spectrum}, {(inside[0] if inside else 0) + 1}, {len(inside)})"


def mean_power(bins: str) -> str:
    """Mean over the bins; NULL without any."""
    return f"try_divide({array_sum(bins)}, size({bins}))"


def energy(bins: str) -> str:
    return f"aggregate({bins}, 0D, (total, p) -> total + p * p)"


def entropy(bins: str) -> str:
    """Shannon entropy in bits of the bins scaled to sum 1; 0 without any."""
    # A one-element array holds the sum, so that it is taken once per row.
    shares = (
        f"flatten(transform(array({array_sum(bins)}), "
        f"total -> transform({bins}, p -> try_divide(p, total))))"
    )
    return f"aggregate({shares}, 0D, (acc, q) -> acc - q * log2(q + {number(LOG_FLOOR)}))"


def psd_long(channels: DataFrame, s: Settings, column: str = "psd") -> DataFrame:
    """One row per bin: index ``k``, frequency ``freq``, power ``p``."""
    keys = [c for c in (*CHANNEL, "EpochID") if c in channels.columns]
    ks = ", ".join(str(k) for k, _ in s.bins())
    return channels.select(*keys, F.posexplode(column).alias("_i", "p")).selectExpr(
        *keys, f"array({ks})[_i] AS k", f"{numbers(f for _, f in s.bins())}[_i] AS freq", "p"
    )


def band_power(rel: DataFrame, s: Settings) -> DataFrame:
    """Mean relative power and entropy per band, one row each."""
    keys = [c for c in (*CHANNEL, "EpochID") if c in rel.columns]
    rows = ", ".join(
        f"struct('{b.name}' AS WaveBand, {mean_power(band_bins(s, b))} AS Power, "
        f"{entropy(band_bins(s, b))} AS SpectralEntropy)"
        for b in s.bands
    )
    return rel.selectExpr(*keys, f"inline(array({rows}))")


def spectrum_features(rel: DataFrame) -> DataFrame:
    """TotalPower, TotalEnergy and SpectralEntropy over all retained bins."""
    return rel.selectExpr(
        "*",
        f"{mean_power('rel')} AS TotalPower",
        f"{energy('rel')} AS TotalEnergy",
        f"{entropy('rel')} AS SpectralEntropy",
    )

"""Parameters of one extraction run."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from math import floor
from typing import Any

METHODS = ("welch", "multitaper")


@dataclass(frozen=True)
class Band:
    """A frequency band; a bin belongs to it when fmin <= f < fmax."""

    name: str
    fmin: float
    fmax: float

    def __post_init__(self) -> None:
        if not self.fmin < self.fmax:
            raise ValueError(f"band {self.name}: fmin must be below fmax")


# The default frequency bands in Hz.
DEFAULT_BANDS = (
    Band("Delta", 0.5, 4.0),
    Band("Theta", 4.0, 8.0),
    Band("Alpha", 8.0, 12.0),
    Band("Beta", 12.0, 30.0),
)


@dataclass(frozen=True)
class Settings:
    """Sampling rate, epoch grid and spectral parameters.

    ``window`` and ``step`` are seconds. An epoch holds both its end points
    (``window * rate + 1`` samples) unless ``inclusive_end`` is off. The spectrum
    reaches from the lowest to the highest band limit unless ``limits`` says otherwise.
    """

    rate: float
    window: float = 3.0
    step: float = 1.5
    nfft: int = 256
    bands: tuple[Band, ...] = field(default=DEFAULT_BANDS)
    method: str = "welch"
    inclusive_end: bool = True
    limits: tuple[float, float] | None = None

    def __post_init__(self) -> None:
        if self.method not in METHODS:
            raise ValueError(f"method must be one of {METHODS}, not {self.method!r}")
        if self.rate <= 0 or self.window <= 0 or self.step <= 0:
            raise ValueError("rate, window and step must be positive")
        if self.step * self.rate < 1:
            raise ValueError("step must cover at least one sample")
        if not self.bands:
            raise ValueError("at least one band is needed")
        if len({b.name for b in self.bands}) != len(self.bands):
            raise ValueError("band names must be unique")
        if self.method == "welch" and self.nfft > self.epoch_samples:
            raise ValueError("nfft must not exceed the samples of an epoch")

    @property
    def stride(self) -> float:
        """Samples between the starts of neighbouring epochs."""
        return self.step * self.rate

    @property
    def epoch_samples(self) -> int:
        return int(floor(self.window * self.rate + 0.5)) + int(self.inclusive_end)

    @property
    def fmin(self) -> float:
        return self.limits[0] if self.limits else min(b.fmin for b in self.bands)

    @property
    def fmax(self) -> float:
        return self.limits[1] if self.limits else max(b.fmax for b in self.bands)

    def between(self, low: str, high: str) -> Settings:
        """The same with a spectrum from the start of one band to the end of another."""
        named = {b.name: b for b in self.bands}
        return replace(self, limits=(named[low].fmin, named[high].fmax))

    @property
    def fft_length(self) -> int:
        """Welch cuts segments of ``nfft``; multitaper takes the whole epoch."""
        return self.nfft if self.method == "welch" else self.epoch_samples

    def bins(self) -> list[tuple[int, float]]:
        """Retained bins as (index, Hz), both limits included."""
        width = self.rate / self.fft_length
        return [
            (k, k * width)
            for k in range(self.fft_length // 2 + 1)
            if self.fmin <= k * width <= self.fmax
        ]

    @classmethod
    def from_mapping(cls, values: Mapping[str, Any], rate: float, **extra: Any) -> Settings:
        """Read the keys of a YAML configuration (``freqBands``, ``windowLength``, ...)."""
        bands = tuple(Band(n, float(r[0]), float(r[1])) for n, r in values["freqBands"].items())
        return cls(
            rate=rate,
            window=float(values.get("windowLength", cls.window)),
            step=float(values.get("stepSize", cls.step)),
            method=str(values.get("method", cls.method)).lower(),
            bands=bands,
            **extra,
        )

    def as_strings(self) -> dict[str, str]:
        """Flat form for the dataset log."""
        out = {
            "rate": str(self.rate),
            "windowLength": str(self.window),
            "stepSize": str(self.step),
            "nfft": str(self.nfft),
            "method": self.method,
        }
        out.update({f"freqBands.{b.name}": f"{b.fmin}-{b.fmax}" for b in self.bands})
        return out

"""Windows and Fourier weights: small tables that depend on parameters only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import types as T

from epochwise.config import Settings

# Weights per table row; wider sums would leave generated code.
LANES = 24

# Fixed values of the multitaper method: half of the time-bandwidth product and
# the least spectral concentration a taper may have.
HALF_NBW = 4.0
MIN_CONCENTRATION = 0.9


def hamming(n: int) -> np.ndarray:
    """Periodic Hamming window."""
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / n)


def _below(diagonal: np.ndarray, squares: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a symmetric tridiagonal matrix lie below each shift."""
    tiny = np.finfo(float).eps ** 2 * np.abs(diagonal).max()
    pivot = diagonal[0] - shifts
    count = (pivot < 0).astype(int)
    for d, square in zip(diagonal[1:].tolist(), squares.tolist(), strict=True):
        pivot[pivot == 0] = tiny
        pivot = (d - shifts) - square / pivot
        count += pivot < 0
    return count


def _largest(diagonal: np.ndarray, off: np.ndarray, count: int) -> np.ndarray:
    """The largest eigenvalues, largest first: every bracket is cut at many shifts in one sweep."""
    n, squares = len(diagonal), off**2
    reach = np.r_[np.abs(off), 0] + np.r_[0, np.abs(off)]
    low = np.full(count, (diagonal - reach).min() - 1)
    high = np.full(count, (diagonal + reach).max() + 1)
    wanted = n - 1 - np.arange(count)  # eigenvalues below the one looked for
    cuts = 64
    inner = np.arange(1, cuts + 1) / (cuts + 1)
    for _ in range(12):
        shifts = low[:, None] + (high - low)[:, None] * inner
        below = _below(diagonal, squares, shifts.ravel()).reshape(count, cuts)
        edges = np.c_[low, shifts, high]
        passed = (below <= wanted[:, None]).sum(axis=1)
        low, high = edges[np.arange(count), passed], edges[np.arange(count), passed + 1]
        if (high - low <= 4 * np.spacing(np.abs(high))).all():
            break
    return (low + high) / 2


def _vectors(diagonal: np.ndarray, off: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (columns): eliminated from both ends, joined where both agree best."""
    n, tiny = len(diagonal), np.finfo(float).eps * np.abs(diagonal).max()
    shifted = diagonal[:, None] - values

    def pivots(own: np.ndarray, beside: np.ndarray) -> np.ndarray:
        found = own.copy()
        for i in range(1, n):
            found[i] -= beside[i - 1] ** 2 / found[i - 1]
            found[i] = np.where(np.abs(found[i]) < tiny, tiny, found[i])
        return found

    down = pivots(shifted, off)
    up = pivots(shifted[::-1], off[::-1])[::-1]
    joint = np.abs(down + up - shifted).argmin(axis=0)
    z = np.zeros_like(shifted)
    z[joint, np.arange(len(values))] = 1.0
    for i in range(n - 2, -1, -1):
        z[i] = np.where(i < joint, -off[i] * z[i + 1] / down[i], z[i])
    for i in range(1, n):
        z[i] = np.where(i > joint, -off[i - 1] * z[i - 1] / up[i], z[i])
    # What rounding leaves between them goes.
    return np.linalg.qr(z / np.linalg.norm(z, axis=0))[0]


def slepian(n: int, half_nbw: float = HALF_NBW) -> tuple[np.ndarray, np.ndarray]:
    """Unit-energy Slepian tapers (rows) and their concentrations.

    The tapers are eigenvectors of a symmetric tridiagonal matrix; the concentration
    is the quadratic form with the sinc kernel, taken over the taper's autocorrelation.
    Memory is that of a few vectors.
    """
    w = half_nbw / n
    t = np.arange(n)
    diagonal = ((n - 1 - 2 * t) / 2) ** 2 * np.cos(2 * np.pi * w)
    off = t[1:] * (n - t[1:]) / 2
    count = min(int(2 * half_nbw), n)
    tapers = _vectors(diagonal, off, _largest(diagonal, off, count)).T
    power = np.abs(np.fft.rfft(tapers, 2 * n, axis=1)) ** 2
    lagged = np.fft.irfft(power, 2 * n, axis=1)[:, :n]
    kernel = 2 * w * np.sinc(2 * w * t)
    concentration = lagged @ np.where(t == 0, kernel, 2 * kernel)
    kept = concentration > MIN_CONCENTRATION
    if not kept.any():
        kept = concentration == concentration.max()
    return tapers[kept], concentration[kept]


def _schema(per_group: int) -> T.StructType:
    """Nothing is NULL, which keeps the generated sums short."""
    fields = [T.StructField(c, T.IntegerType(), False) for c in ("place", "g")]
    fields += [
        T.StructField(f"{part}{i}", T.DoubleType(), False)
        for part in ("c", "s")
        for i in range(per_group)
    ]
    return T.StructType(fields)


@dataclass(frozen=True)
class FourierPlan:
    """Everything needed to turn weighted sums into a power spectrum.

    A lane is one bin. ``table`` holds
    per ``place`` in the segment and lane group ``g`` the weights of the group's
    lanes. ``*_sums`` and ``*_ramps`` are the lanes of a constant 1 and of the
    place itself, which remove a line after the sums have been taken.
    """

    table: pd.DataFrame
    schema: T.StructType
    lanes: int
    per_group: int
    groups: int
    cos_sums: list[list[float]]
    sin_sums: list[list[float]]
    cos_ramps: list[list[float]]
    sin_ramps: list[list[float]]
    bin_scales: list[float]


def fourier_plan(s: Settings) -> FourierPlan:
    n = s.fft_length
    index = np.array([k for k, _ in s.bins()], dtype=int)
    if index.size == 0:
        raise ValueError("no frequency bin lies inside the bands")
    one_sided = np.where((index == 0) | ((n % 2 == 0) & (index == n // 2)), 1.0, 2.0)
    window = hamming(n)
    scales = one_sided / (s.rate * np.sum(window**2))
    # Reduce k*j before the trigonometry so that large indices stay exact.
    angle = 2 * np.pi * ((index[:, None] * np.arange(n)[None, :]) % n) / n
    cos = window * np.cos(angle)
    sin = window * np.sin(angle)

    lanes = cos.shape[0]
    per_group = min(LANES, lanes)
    groups = -(-lanes // per_group)
    pad = ((0, groups * per_group - lanes), (0, 0))
    cos = np.pad(cos, pad).reshape(groups, per_group, n)
    sin = np.pad(sin, pad).reshape(groups, per_group, n)
    blocks = []
    for g in range(groups):
        block = {"place": np.arange(n, dtype=np.int32), "g": np.full(n, g, dtype=np.int32)}
        block.update({f"c{i}": cos[g, i] for i in range(per_group)})
        block.update({f"s{i}": sin[g, i] for i in range(per_group)})
        blocks.append(pd.DataFrame(block))
    return FourierPlan(
        table=pd.concat(blocks, ignore_index=True),
        schema=_schema(per_group),
        lanes=lanes,
        per_group=per_group,
        groups=groups,
        cos_sums=cos.sum(axis=2).tolist(),
        sin_sums=sin.sum(axis=2).tolist(),
        cos_ramps=(cos @ np.arange(n)).tolist(),
        sin_ramps=(sin @ np.arange(n)).tolist(),
        bin_scales=scales.tolist(),
    )

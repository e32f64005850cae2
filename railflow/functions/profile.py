"""Density and distance to a denser time on one traveller's distinct times of the day.

The profile has at most 86,400 entries, so an Arrow batch of them always fits a task.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

# executors get the functions themselves, so this package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIGITS = 15  # of a density
DAY_SECONDS = 86_400
BITS = 48  # of a kernel value as a fixed-point number
LIMB = 12  # of them that are summed at a time
BLOCK = 512  # times evaluated at once: at most 512 x 86,400 kernel values are held


_made: dict[tuple[str, float], np.ndarray] = {}  # kernels of the bandwidths that a worker has seen


def _limbs(bandwidth: float) -> np.ndarray:
    """The Gaussian kernel of every lag in whole seconds, as fixed-point numbers cut into limbs, the highest first."""
    if ("limbs", bandwidth) in _made:
        return _made["limbs", bandwidth]
    lag = np.arange(DAY_SECONDS) / bandwidth
    fixed = np.round(np.exp(-0.5 * lag * lag) * 2.0**BITS).astype(np.int64)
    fixed = np.minimum(fixed, (1 << BITS) - 1)
    limbs = np.stack([(fixed >> shift) & ((1 << LIMB) - 1) for shift in range(BITS - LIMB, -1, -LIMB)]).astype(np.float64)
    return _made.setdefault(("limbs", bandwidth), limbs)


def _spectra(bandwidth: float) -> np.ndarray:
    if ("spectra", bandwidth) in _made:
        return _made["spectra", bandwidth]
    size = 2 * DAY_SECONDS
    limbs = _limbs(bandwidth)
    both = np.zeros((len(limbs), size))
    both[:, :DAY_SECONDS] = limbs
    both[:, DAY_SECONDS + 1 :] = limbs[:, :0:-1]  # negative lags
    return _made.setdefault(("spectra", bandwidth), np.fft.rfft(both))


def _weighted(t: np.ndarray, w: np.ndarray, bandwidth: float) -> np.ndarray:
    """Per limb the sum over all times of weight times kernel, at each time: whole numbers, and exact, so that neither the
    order of summation nor the way taken shows in them. Long profiles are convolved on the grid of seconds by Fourier
    transforms, whose error is far below one half; short ones are summed directly, which then takes fewer steps."""
    w = w.astype(np.float64)
    if len(t) * len(t) > 64 * DAY_SECONDS:
        grid = np.zeros(2 * DAY_SECONDS)
        grid[t] = w
        transformed = np.fft.rfft(grid)
        return np.stack([np.rint(np.fft.irfft(transformed * s, 2 * DAY_SECONDS)[t]) for s in _spectra(bandwidth)])
    limbs = _limbs(bandwidth)
    out = np.empty((len(limbs), len(t)))
    for at in range(0, len(t), BLOCK):
        lag = np.abs(t[at : at + BLOCK, None] - t[None, :])
        for limb, total in zip(limbs, out, strict=True):
            total[at : at + BLOCK] = limb[lag] @ w
    return out


def _density(t: np.ndarray, w: np.ndarray, bandwidth: float) -> np.ndarray:
    """Weighted Gaussian kernel density at each distinct time."""
    total = np.zeros(len(t))
    for limb in _weighted(t, w, bandwidth)[::-1]:  # lowest limb first
        total = total * 2.0**-LIMB + limb
    return total * 2.0**-LIMB / (np.sqrt(2 * np.pi) * w.sum() * bandwidth)


def _denser_before(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distance back to the last earlier time of higher density, -1 where there is none.

    Range maxima over 1, 2, 4, ... times let every position skip whole blocks that are not denser.
    """
    blocks, width = [d], 1
    while 2 * width <= len(d):
        top = blocks[-1].copy()
        top[width:] = np.maximum(top[width:], blocks[-1][:-width])
        blocks.append(top)
        width *= 2
    at = np.arange(len(d)) - 1
    for level in range(len(blocks) - 1, -1, -1):
        skip = (at >= 0) & (blocks[level][at] <= d)
        at = np.where(skip, at - (1 << level), at)
    return np.where(at >= 0, t - t[np.maximum(at, 0)], -1)


def _denser_gap(t: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Distance to the nearest denser time on either side; the whole range for the densest."""
    left = _denser_before(t, d)
    right = _denser_before(-t[::-1], d[::-1])[::-1]
    none = np.iinfo(np.int64).max
    near = np.minimum(np.where(left < 0, none, left), np.where(right < 0, none, right))
    return np.where(near == none, t[-1] - t[0], near)


def profile_udf(bandwidth: float):
    @F.pandas_udf("density array<double>, dist array<bigint>")
    def profile(times: pd.Series, weights: pd.Series) -> pd.DataFrame:
        density = [np.round(_density(t.astype(np.int64), w, bandwidth), DIGITS) for t, w in zip(times, weights)]
        dist = [_denser_gap(t.astype(np.int64), d) for t, d in zip(times, density)]
        return pd.DataFrame({"density": density, "dist": dist})

    return profile

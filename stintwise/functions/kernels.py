"""Sample-sequence kernels as Arrow batch functions.

Each takes laps as array columns and works on a whole batch of laps at once; a lap is one row, so no
shuffle is needed. Only recurrences and warping, which Spark's expressions cannot state, are here.
"""

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from stintwise.constants import CUTOFF_HZ

DOUBLES = ArrayType(DoubleType())


def length_groups(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of laps of about the same length: the longest of a group is a quarter longer than the
    shortest at most, so that one very long lap does not blow up the others' matrix."""
    bucket = np.ceil(np.log(np.maximum(sizes, 1)) / np.log(1.25)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []


def by_length(kernel: Callable[..., np.ndarray], *channels: pd.Series) -> pd.Series:
    """A kernel of (matrices of the channels, sizes, places of the laps), run on laps of about one
    length at a time: rows of a matrix are laps, with zeros for what a shorter one lacks."""
    sizes = channels[0].map(len).to_numpy(dtype=np.int64)
    out = np.empty(len(sizes), dtype=object)
    for places in length_groups(sizes):
        some = sizes[places]
        width = max(int(some.max()), 1)
        filled = np.arange(width)[None, :] < some[:, None]
        matrices = []
        for channel in channels:
            matrix = np.zeros((len(places), width))
            if some.any():
                matrix[filled] = np.concatenate([np.asarray(x, dtype=float) for x in channel.iloc[places]])
            matrices.append(matrix)
        found = kernel(*matrices, some, places)
        for place, row, n in zip(places.tolist(), found, some.tolist(), strict=True):
            out[place] = row[:n]
    return pd.Series(out, dtype=object)


def median_steps(times: pd.Series, positive_only: bool = False) -> np.ndarray:
    def one(t: np.ndarray) -> float:
        steps = np.diff(np.asarray(t, dtype=float))
        if positive_only:
            steps = steps[steps > 0]
        return float(np.median(steps)) if len(steps) else 0.1

    return np.array([one(t) for t in times])


def smooth(values: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """First-order low-pass run forward and then backward over every lap."""
    rc = 1.0 / (2.0 * np.pi * CUTOFF_HZ)
    # A lap too short or without a usable clock passes through unchanged.
    usable = (sizes >= 2) & (steps > 0)
    alpha = np.where(usable, steps / (rc + np.where(usable, steps, 1.0)), 1.0)
    keep = 1.0 - alpha
    out = values.copy()
    for k in range(1, out.shape[1]):
        out[:, k] = alpha * values[:, k] + keep * out[:, k - 1]
    for k in range(out.shape[1] - 2, -1, -1):
        back = alpha * out[:, k] + keep * out[:, k + 1]
        out[:, k] = np.where(k < sizes - 1, back, out[:, k])
    return out


def slopes(values: np.ndarray, times: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How fast each lap's values change: inside, the slope of the parabola through a sample and its two
    neighbours; at both ends that to the only one. A lap of one sample does not change."""
    out = np.zeros_like(values)
    step = np.diff(times, axis=1)
    rise = np.diff(values, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        one = rise / step  # between a sample and the next
        before, behind = step[:, :-1], step[:, 1:]
        out[:, 1:-1] = (one[:, :-1] * behind + one[:, 1:] * before) / (before + behind)
    laps = np.flatnonzero(sizes >= 2)
    last = sizes[laps] - 1
    out[laps, 0] = one[laps, 0]
    out[laps, last] = one[laps, last - 1]
    out[sizes < 2] = 0.0
    out[np.arange(values.shape[1])[None, :] >= sizes[:, None]] = 0.0
    return out


@F.pandas_udf(DOUBLES)
def lowpass(values: pd.Series, times: pd.Series) -> pd.Series:
    steps = median_steps(times)
    return by_length(lambda v, sizes, at: smooth(v, sizes, steps[at]), values)


@F.pandas_udf(DOUBLES)
def longitudinal_accel(speed_kmh: pd.Series, times: pd.Series) -> pd.Series:
    """Smoothed speed, differentiated, smoothed again (m/s2)."""
    steps = median_steps(times)

    def kernel(speed: np.ndarray, clock: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
        accel = slopes(smooth(speed, sizes, steps[at]) / 3.6, clock, sizes)
        return smooth(accel, sizes, steps[at])

    return by_length(kernel, speed_kmh, times)


@F.pandas_udf(DOUBLES)
def lateral_accel(x: pd.Series, y: pd.Series, times: pd.Series) -> pd.Series:
    """Curvature times speed squared, from positions in tenths of a metre."""
    steps = median_steps(times, positive_only=True)

    def kernel(
        xs: np.ndarray, ys: np.ndarray, clock: np.ndarray, sizes: np.ndarray, at: np.ndarray
    ) -> np.ndarray:
        vx = slopes(smooth(xs / 10.0, sizes, steps[at]), clock, sizes)
        vy = slopes(smooth(ys / 10.0, sizes, steps[at]), clock, sizes)
        ax, ay = slopes(vx, clock, sizes), slopes(vy, clock, sizes)
        v2 = vx * vx + vy * vy
        lateral = np.abs(vx * ay - vy * ax) / np.maximum(v2, 1e-6) ** 1.5 * v2
        lateral[sizes < 3] = 0.0
        return lateral

    return by_length(kernel, x, y, times)


def joined_rows(rows: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All rows one after another, and where each ends."""
    ends = np.cumsum(rows.map(len).to_numpy(dtype=np.int64))
    return np.concatenate([np.zeros(0), *[np.asarray(r, dtype=float) for r in rows]]), ends


def between(at: np.ndarray, at_lap: np.ndarray, x: np.ndarray, y: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Values at `at` on the lines through the samples (x ascending, y) of the lap `at_lap`, held flat
    beyond both ends; 0 for a lap without samples. One sort of samples and places finds for every place
    the last sample before it."""
    sizes = np.diff(ends, prepend=0)
    lap = np.concatenate([np.repeat(np.arange(len(ends)), sizes), at_lap])
    is_place = np.concatenate([np.zeros(len(x), bool), np.ones(len(at), bool)])
    order = np.lexsort((is_place, np.concatenate([x, at]), lap))
    before = np.cumsum(~is_place[order]) - 1
    left = np.empty(len(at), np.int64)
    left[order[is_place[order]] - len(x)] = before[is_place[order]]
    first, last = (ends - sizes)[at_lap], ends[at_lap] - 1
    some = sizes[at_lap] > 0
    if not some.any():
        return np.zeros(len(at))
    low = np.clip(left, first, np.maximum(last - 1, first))
    high = np.minimum(low + 1, last)
    low, high = np.where(some, low, 0), np.where(some, high, 0)
    width = x[high] - x[low]
    part = np.where(width > 0, (at - x[low]) / np.where(width > 0, width, 1.0), 0.0)
    return np.where(some, y[low] + (y[high] - y[low]) * np.clip(part, 0.0, 1.0), 0.0)


@F.pandas_udf(DOUBLES)
def interpolate(at: pd.Series, distance: pd.Series, values: pd.Series) -> pd.Series:
    """Linear interpolation of a lap's samples, held flat beyond both ends."""
    places, place_ends = joined_rows(at)
    x, ends = joined_rows(distance)
    y, _ = joined_rows(values)
    lap = np.repeat(np.arange(len(at)), np.diff(place_ends, prepend=0))
    return pd.Series(np.split(between(places, lap, x, y, ends), place_ends[:-1]), dtype=object)


@F.pandas_udf(DoubleType())
def dtw_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Dynamic time warping cost with absolute differences. Pairs of equal lengths are warped
    together, with two rows of the cost table in memory."""
    sizes = pd.MultiIndex.from_arrays([a.map(len), b.map(len)])
    out = np.empty(len(a))
    for n, m in sizes.unique():
        at = np.flatnonzero(sizes == (n, m))
        for some in np.split(at, range(PAIRS, len(at), PAIRS)):
            out[some] = warped(*(np.array(s.iloc[some].to_list(), float) for s in (a, b)), n, m)
    return pd.Series(out)


PAIRS = 2000


def warped(left: np.ndarray, right: np.ndarray, n: int, m: int) -> np.ndarray:
    if not n or not m:
        return np.where(n == m, 0.0, np.inf) * np.ones(len(left))
    above = np.full((m + 1, len(left)), np.inf)
    above[0] = 0.0
    for i in range(n):
        step = np.abs(left[:, i][None, :] - right.T)
        row = np.full_like(above, np.inf)
        least = np.minimum(above[1:], above[:-1])
        for j in range(m):
            row[j + 1] = step[j] + np.minimum(least[j], row[j])
        above = row
    return above[m]

"""Array-shaped work per region: subpeak summits of a signal's profile and strand-balance refinement. NumPy per region."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import intervals


def slope(signal: np.ndarray, window: int) -> np.ndarray:
    """First derivative by a moving least-squares parabola over an odd window, to 16 decimals.

    Its linear coefficient is the sum of k * y(k) over that of k * k. Before the start the signal is mirrored below its
    first value, after the end above its last.
    """
    half = max(1, window // 2)
    if len(signal) <= half:
        return np.zeros(len(signal))
    k = np.arange(-half, half + 1)
    before, after = np.abs(signal[half:0:-1] - signal[0]), np.abs(signal[-2 : -half - 2 : -1] - signal[-1])
    wide = np.concatenate([signal[0] - before, signal, signal[-1] + after])
    return np.round(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1) @ k / (k @ k), 16)


def maxima(signal: np.ndarray, window: int) -> np.ndarray:
    """The last position of each run of equal slope sign that a run of lower sign follows."""
    sign = np.sign(slope(signal, window))
    return np.flatnonzero(sign[1:] < sign[:-1])


def dips(signal: np.ndarray, spots: np.ndarray) -> np.ndarray:
    """The first lowest position between each two neighbours, the right one excluded."""
    return np.array([a + signal[a:b].argmin() for a, b in pairwise(spots)], int)


def peaky(signal: np.ndarray, spots: np.ndarray, least: int = 50, distinct: int = 6) -> np.ndarray:
    """The maxima that rise clearly above the dips beside them; a lone one always does.

    A dip of depth m sets the bar b = m + sqrt(m), the higher of two dips counts; the first maximum must clear b +
    sqrt(b). From the dip before it to where the signal falls under the bar after it, or to the next dip, a maximum must
    be ``least`` long and take ``distinct`` values.
    """
    if len(spots) < 2:
        return spots
    low = dips(signal, spots)
    bars = signal[low] + np.sqrt(np.maximum(signal[low], 0))
    own = np.maximum(np.r_[bars[0] + np.sqrt(max(bars[0], 0)), bars], np.r_[-np.inf, bars[1:], -np.inf])
    out = []
    for spot, bar, a, b in zip(spots, own, np.r_[0, low], np.r_[low, len(signal)]):
        under = np.flatnonzero(signal[spot:b] < bar)
        rise = signal[a : spot + under[0]] if len(under) else signal[a:b]
        if len(rise) >= least and len(np.unique(rise)) >= distinct:
            out.append(spot)
    return np.array(out, int)


def valleys(signal: np.ndarray, spots: np.ndarray, share: float = 0.8) -> np.ndarray:
    """Summits between whose neighbours the signal falls below ``share`` of the lower one.

    The shallowest dip that does not goes first: of the two summits beside it the higher stays (of equal ones the first).
    """
    spots = np.asarray(spots, int)
    while len(spots) > 1:
        depth = signal[dips(signal, spots)] / np.maximum(np.minimum(signal[spots[:-1]], signal[spots[1:]]), 1e-300)
        k = int(depth.argmax())
        if depth[k] < share:
            break
        spots = np.delete(spots, k if signal[spots[k + 1]] > signal[spots[k]] else k + 1)
    return spots


def profile(start: np.ndarray, end: np.ndarray, value: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The values of disjoint segments at every position from ``lo`` to ``hi``; 0 between them."""
    a, b = np.clip(start, lo, hi) - lo, np.clip(end, lo, hi) - lo
    n = np.maximum(b - a, 0)
    out = np.zeros(hi - lo)
    out[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(value, n)
    return out


def tops(y: np.ndarray, window: int, left: int, margin: int = 10, share: float | None = None) -> np.ndarray:
    """Offsets of the subpeaks of a region's profile ``y``, which starts at position ``left``; none where nothing stands out.

    As in the published procedure the profile is padded with twice the margin before it and nothing after it (near the
    start of the axis with what is there, and the rest behind), and the last ``margin`` positions hold no summit.
    """
    m = min(margin, left)
    wide = np.concatenate([np.zeros(2 * m), y, np.zeros(margin - m)])
    spots = maxima(wide, window)
    spots = peaky(wide, spots[(spots >= m) & (spots <= len(y) + m)])
    return (spots if share is None else valleys(wide, spots, share)) - 2 * m


def subpeaks(signal: DataFrame, regions: DataFrame, min_length: int = 200, margin: int = 10, share: float | None = None) -> DataFrame:
    """``(chrom, start, end, summit, score)``: one row per subpeak of each region; its highest point where none stands out.

    With ``share`` there must also be valleys between subpeaks. A region's profile is at base resolution, so a task holds
    one region's length of numbers.
    """
    pairs = intervals.overlap_join(signal, regions.select("chrom", "start", "end"), ("start", "end"), ("start", "end"))
    window = min_length // 2 * 2 + 1

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        chrom, start, end = key
        y = profile(pdf["start"].to_numpy(), pdf["end"].to_numpy(), pdf["value"].to_numpy(), start, end)
        spots = tops(y, window, int(start), margin, share)
        if len(spots) == 0:
            level = np.flatnonzero(y == y.max())
            spots = np.array([level[(len(level) - 1) // 2]])
        return pd.DataFrame({"chrom": chrom, "start": start, "end": end, "summit": spots + start, "score": y[np.clip(spots, 0, len(y) - 1)]})

    return pairs.groupBy("chrom", "b_start", "b_end").applyInPandas(one, "chrom string, start long, end long, summit long, score double")


def balance(plus: tuple[np.ndarray, np.ndarray], minus: tuple[np.ndarray, np.ndarray], start: int, end: int, window: int) -> tuple[int, float]:
    """Where forward tags lie left and reverse tags right: the first position of the greatest ``2 sqrt(Wl Cr) - Wr - Cl``.

    Each strand is (positions, counts).
    """
    at = np.arange(start - window, end + window + 1)

    def counter(spots, n):
        order = np.argsort(spots, kind="stable")
        spots, upto = spots[order], np.concatenate([[0], np.cumsum(n[order])])
        return lambda a, b: upto[np.searchsorted(spots, b, "right")] - upto[np.searchsorted(spots, a, "left")]

    w, c = counter(*plus), counter(*minus)
    wl, wr, cl, cr = w(at - window, at - 1), w(at, at + window), c(at - window, at - 1), c(at, at + window)
    score = 2 * np.sqrt(wl * cr) - wr - cl
    k = int(np.argmax(score))
    return int(at[k]), float(score[k])


def refine_by_balance(tags: DataFrame, regions: DataFrame, window: int = 200, cutoff: float = 5.0) -> DataFrame:
    """``(chrom, name, summit, score)``: each region's balance point; the name ends in ``_R`` above the cutoff, else ``_F``.

    Tags are folded to counts per position first, so what a region holds is bounded by its length.
    """
    folded = tags.groupBy("chrom", "pos", "strand").agg(F.count("*").alias("n"))
    pairs = intervals.points_in_windows(folded, regions.select("chrom", "start", "end", "name"), 2 * window)

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        chrom, start, end, name = key
        sides = [(x["pos"].to_numpy(), x["n"].to_numpy()) for x in (pdf[pdf["strand"] == 0], pdf[pdf["strand"] == 1])]
        at, score = balance(*sides, int(start), int(end), window)
        return pd.DataFrame([{"chrom": chrom, "name": f"{name}_{'R' if score > cutoff else 'F'}", "summit": at, "score": score}])

    return pairs.groupBy("chrom", "b_start", "b_end", "b_name").applyInPandas(one, "chrom string, name string, summit long, score double")

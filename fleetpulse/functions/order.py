"""Order statistics of many windows over one sequence, in vectorised passes."""

from __future__ import annotations

import numpy as np


def window_order(values: np.ndarray, begin: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The k-th smallest (from 0) of values[begin:end] for each window; NaN ranks last.

    Values are replaced by their ranks, and a wavelet matrix narrows all windows at once, one bit of the answer's
    rank a level: a level counts the zeros before each place, and a window goes on among its zeros or its ones. No
    window is sorted, so the cost doesn't depend on their length. Needs begin <= begin + k < end.
    """
    begin, end, k = begin.copy(), end.copy(), k.copy()
    order = np.argsort(values, kind="stable")
    rank = np.empty(len(values), np.int64)
    rank[order] = np.arange(len(values))
    found = np.zeros(len(begin), np.int64)
    for bit in reversed(range(max(len(values) - 1, 0).bit_length())):
        one = (rank >> bit & 1).astype(bool)
        zeros = np.concatenate([[0], np.cumsum(~one)])
        low, high = zeros[begin], zeros[end]
        up = k >= high - low
        k -= np.where(up, high - low, 0)
        begin = np.where(up, zeros[-1] + begin - low, low)
        end = np.where(up, zeros[-1] + end - high, high)
        found |= up.astype(np.int64) << bit
        rank = np.concatenate([rank[~one], rank[one]])
    return values[order[found]] if len(values) else np.empty(0)


def window_percentiles(values: np.ndarray, begin: np.ndarray, end: np.ndarray, percent: float) -> np.ndarray:
    """Linear-interpolation percentile of values[begin:end] for each window; NaN where it is empty."""
    out = np.full(len(begin), np.nan)
    full = np.flatnonzero(end > begin)
    begin, end = begin[full], end[full]
    at = percent / 100.0 * (end - begin - 1)
    low = np.floor(at).astype(np.int64)
    high = np.minimum(low + 1, end - begin - 1)
    both = window_order(values, np.tile(begin, 2), np.tile(end, 2), np.concatenate([low, high]))
    below, above = both[: len(full)], both[len(full) :]
    out[full] = below + (above - below) * (at - low)
    return out


def window_moments(values: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int, rows: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of values[begin:end] for windows of at most `length`; NaN where one is empty.

    Each window is added up on its own, so a NaN or a large value outside of it leaves no trace; `rows` windows at a time.
    """
    views = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(length), values]), length)
    mean, std = np.full(len(begin), np.nan), np.full(len(begin), np.nan)
    for a in range(0, len(begin), rows):
        cut = slice(a, a + rows)
        count = (end - begin)[cut]
        here = np.arange(length) >= (length - count)[:, None]
        window = np.where(here, views[end[cut]], 0.0)
        some = np.where(count > 0, count, np.nan)
        mean[cut] = window.sum(axis=1) / some
        with np.errstate(invalid="ignore"):
            window -= mean[cut][:, None]
        std[cut] = np.sqrt(np.square(window, out=window).sum(axis=1, where=here) / some)
    return mean, std

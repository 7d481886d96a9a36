"""Detection of one host's next events from its carried state, on NumPy arrays.

Used by the streaming operator. The state holds only what the next event can look back on:
the last raw rows, the training window, the current forest, the last scores and two clocks.
"""

from __future__ import annotations

import numpy as np

from fleetpulse.config import EPSILON, METRICS, DetectorConfig
from fleetpulse.functions.forest import Forest, fit_forest, score_forest
from fleetpulse.operators.cooldown import kept_rows

WIDTH = 3 * len(METRICS)
NO_CLOCK = np.iinfo(np.int64).min


def empty_state() -> dict[str, np.ndarray]:
    return {
        "n": np.array(0),
        "raw": np.empty((0, len(METRICS))),
        "train": np.empty((0, WIDTH)),
        "scores": np.empty(0),
        "times": np.empty(0, dtype=np.int64),
        "clocks": np.full(2, NO_CLOCK),
    }


def _windows(history: np.ndarray, new: np.ndarray, length: int) -> np.ndarray:
    """For each new row the last `length` rows up to it, missing ones as NaN in front."""
    rows = np.concatenate([history[max(0, len(history) - length + 1):], new])
    padding = np.full((length - 1 + len(new) - len(rows), *rows.shape[1:]), np.nan)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([padding, rows]), length, axis=0)


def _mean_std(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and population deviation of the last axis without NaN."""
    here = ~np.isnan(windows)
    count = here.sum(axis=-1)
    safe = np.maximum(count, 1)
    mean = np.where(here, windows, 0.0).sum(axis=-1) / safe
    spread = np.where(here, windows - mean[..., None], 0.0)
    return count, mean, np.sqrt((spread**2).sum(axis=-1) / safe)


def features(raw: np.ndarray, new: np.ndarray, config: DetectorConfig) -> np.ndarray:
    """Readings, z-scores and deltas. Missing rows are told by their count: a reading may be NaN itself."""
    length = config.rolling_window
    windows = _windows(raw, new, length + 1)
    count = np.minimum(len(raw) + np.arange(len(new)), length)
    here = np.arange(length) >= (length - count)[:, None, None]
    safe = np.maximum(count, 1)[:, None]
    previous = windows[..., :-1]
    mean = np.where(here, previous, 0.0).sum(axis=-1) / safe
    std = np.sqrt((np.where(here, previous - mean[..., None], 0.0) ** 2).sum(axis=-1) / safe)
    z = np.where((count >= 2)[:, None] & (std > EPSILON), (new - mean) / np.where(std > EPSILON, std, 1.0), 0.0)
    delta = np.where((count >= 1)[:, None], new - windows[..., -2], 0.0)
    return np.hstack([new, z, delta])


def _forest_scores(
    state: dict[str, np.ndarray], x: np.ndarray, n: np.ndarray, config: DetectorConfig
) -> np.ndarray:
    """Score the new rows, refitting at each version's fitting event; updates the state."""
    rows = np.concatenate([state["train"], x])
    known = len(state["train"])
    scores = np.full(len(x), np.nan)
    forest = (
        Forest(state["feature"], state["threshold"], state["size"], int(state["subsample"]))
        if "feature" in state
        else None
    )
    fits = np.flatnonzero((n >= config.warmup_events) & ((n - config.warmup_events) % config.retrain_interval == 0))
    edges = [0, *fits.tolist(), len(x)]
    for lo, hi in zip(edges[:-1], edges[1:]):
        if lo in fits:
            upto = known + lo + 1
            train = rows[max(0, upto - config.train_window):upto]
            forest = fit_forest(train, config.n_trees, config.subsample, config.seed)
        if forest is not None and hi > lo:
            scores[lo:hi] = score_forest(forest, x[lo:hi])
    scores[n <= config.warmup_events] = np.nan
    state["train"] = rows[max(0, len(rows) - config.train_window):]
    if forest is not None:
        state.update(
            feature=forest.feature, threshold=forest.threshold, size=forest.size,
            subsample=np.array(forest.subsample),
        )
    return scores


def _thresholds(windows: np.ndarray, config: DetectorConfig) -> np.ndarray:
    ordered = np.sort(windows, axis=1)  # NaN sorts last
    count = (~np.isnan(windows)).sum(axis=1)
    at = config.threshold_percentile / 100.0 * (count - 1)
    low = np.floor(at).astype(int)
    rows = np.arange(len(windows))
    below, above = ordered[rows, low], ordered[rows, np.minimum(low + 1, count - 1)]
    return np.where(count >= config.min_history, below + (above - below) * (at - low), np.nan)


def _forecasts(
    scores: np.ndarray, seconds: np.ndarray, threshold: np.ndarray, config: DetectorConfig
) -> np.ndarray:
    """Minutes to breach from windows of the last trend_window scores and their times."""
    span = config.trend_smoothing if 1 < config.trend_smoothing <= config.trend_window else 1
    y = np.lib.stride_tricks.sliding_window_view(scores, span, axis=1).mean(axis=-1)
    x = seconds[:, span - 1:] - seconds[:, -1:]
    here = ~np.isnan(y)
    count, mean_x, _ = _mean_std(np.where(here, x, np.nan))
    _, mean_y, _ = _mean_std(y)
    dx = np.where(here, x - mean_x[:, None], 0.0)
    dy = np.where(here, y - mean_y[:, None], 0.0)
    sxx, sxy, syy = (dx * dx).sum(1), (dx * dy).sum(1), (dy * dy).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        slope = sxy / sxx
        r2 = sxy**2 / (sxx * syy)
        minutes = (threshold - y[:, -1]) / slope / 60.0
        enough = (~np.isnan(scores)).sum(axis=1) >= config.trend_min_points
        good = (
            enough & (count >= 2) & (slope > 0) & (r2 >= config.trend_min_r2)
            & (minutes >= 0) & (minutes <= config.trend_horizon_minutes)
        )
    # half-up on the decimal value, as the batch operator rounds
    return np.where(good, np.floor(np.where(good, minutes, 0.0) * 10.0 + 0.5) / 10.0, np.nan)


def advance(
    state: dict[str, np.ndarray],
    metrics: np.ndarray,
    times: np.ndarray,
    config: DetectorConfig,
    given_scores: np.ndarray | None = None,
) -> dict[str, np.ndarray]:
    """Process the next events in order: updates the state, returns one array per column."""
    n = int(state["n"]) + 1 + np.arange(len(metrics))
    x = features(state["raw"], metrics, config)
    if given_scores is None:
        score = _forest_scores(state, x, n, config)
    else:
        score = np.where(n > config.warmup_events, given_scores, np.nan)

    live = np.flatnonzero(n > config.warmup_events)
    columns = {
        "n": n,
        "features": x,
        "raw_score": score,
        "ewma_mean": np.full(len(n), np.nan),
        "ewma_std": np.full(len(n), np.nan),
        "threshold": np.full(len(n), np.nan),
        "predicted_breach_minutes": np.full(len(n), np.nan),
        "is_anomaly": np.zeros(len(n), dtype=bool),
        "published": np.zeros(len(n), dtype=bool),
    }
    if len(live):
        history = _windows(state["scores"], score[live], config.score_history)
        _, columns["ewma_mean"][live], columns["ewma_std"][live] = _mean_std(history)
        threshold = _thresholds(history, config)
        columns["threshold"][live] = threshold
        anomaly = score[live] > threshold
        columns["is_anomaly"][live] = anomaly
        recent_scores = _windows(state["scores"], score[live], config.trend_window)
        recent_times = _windows(state["times"] / 1e6, times[live] / 1e6, config.trend_window)
        forecast = _forecasts(recent_scores, recent_times, threshold, config)
        forecast[anomaly] = np.nan
        columns["predicted_breach_minutes"][live] = forecast

        limit = int(config.cooldown_seconds * 1_000_000)
        for kind, candidates in enumerate((live[anomaly], live[~np.isnan(forecast)])):
            clock = int(state["clocks"][kind])
            at = times[candidates]
            kept = kept_rows(at, limit, None if clock == NO_CLOCK else clock)
            columns["published"][candidates[kept]] = True
            if kept:
                state["clocks"][kind] = at[kept[-1]]
        keep = config.score_history - 1
        state["scores"] = np.concatenate([state["scores"], score[live]])[-keep:]
        state["times"] = np.concatenate([state["times"], times[live]])[-keep:]

    raw = np.concatenate([state["raw"], metrics])
    columns["recent"] = _windows(state["raw"], metrics, config.rolling_window)
    state["raw"] = raw[max(0, len(raw) - config.rolling_window):]
    state["n"] = np.array(n[-1])
    return columns

"""A plain per-host loop over events, written from the rules, to check the operators against."""

from __future__ import annotations

from collections import deque

import numpy as np

METRICS = ("cpu_pct", "mem_pct", "latency_ms", "error_rate_pct")


def features_of(events: list[dict], window: int = 10) -> list[np.ndarray]:
    out = []
    for i, event in enumerate(events):
        now = np.array([event[m] for m in METRICS], dtype=float)
        before = np.array([[e[m] for m in METRICS] for e in events[max(0, i - window):i]], dtype=float)
        z = np.zeros(4)
        if len(before) >= 2:
            std = before.std(axis=0)
            for j in range(4):
                if std[j] > 1e-6:
                    z[j] = (now[j] - before[:, j].mean()) / std[j]
        delta = now - before[-1] if len(before) else np.zeros(4)
        out.append(np.concatenate([now, z, delta]))
    return out


def judge(scores: list[float], seconds: list[float], cooldown: float = 60.0) -> list[dict]:
    """Threshold, forecast and cooldowns for the scored events of one host."""
    history: deque = deque(maxlen=200)
    trend: deque = deque(maxlen=10)
    last = {"reactive": None, "early": None}
    out = []
    for score, now in zip(scores, seconds):
        history.append(score)
        trend.append((now, score))
        h = np.array(history)
        threshold = float(np.percentile(h, 95)) if len(h) >= 10 else None
        anomaly = threshold is not None and score > threshold
        minutes = None
        if threshold is not None and not anomaly and len(trend) >= 5:
            t = np.array([p[0] - trend[0][0] for p in trend])
            y = np.array([p[1] for p in trend])
            ma = np.array([y[i:i + 3].mean() for i in range(len(y) - 2)])
            x = t[2:]
            slope, intercept = np.polyfit(x, ma, 1)
            total = ((ma - ma.mean()) ** 2).sum()
            r2 = 1 - ((ma - slope * x - intercept) ** 2).sum() / total if total > 0 else 0.0
            if slope > 0 and r2 >= 0.7:
                m = (threshold - ma[-1]) / slope / 60
                if 0 <= m <= 20:
                    minutes = round(m, 1)
        row = {
            "threshold": threshold,
            "mean": float(h.mean()),
            "std": float(h.std()),
            "is_anomaly": anomaly,
            "severity": ("critical" if score > threshold + h.std() else "warning") if anomaly else None,
            "minutes": minutes,
            "published": None,
        }
        for kind, wanted in (("reactive", anomaly), ("early", minutes is not None)):
            if wanted and (last[kind] is None or now - last[kind] >= cooldown):
                last[kind] = now
                row["published"] = kind
        out.append(row)
    return out


def greedy_cooldown(times: list[int], limit: int) -> list[int]:
    kept, last = [], None
    for i, t in enumerate(times):
        if last is None or t - last >= limit:
            kept.append(i)
            last = t
    return kept


def versions(total: int, warmup: int = 120, step: int = 500, window: int = 1000):
    """Sequential simulation: version used per event, and (first, last) of each training set."""
    used, sets, version, since = [], [], 0, 0
    train: deque = deque(maxlen=window)
    for n in range(1, total + 1):
        train.append(n)
        since += 1
        if version == 0:
            if since >= warmup:
                version, since = 1, 0
                sets.append((train[0], train[-1], len(train)))
            used.append(None)
            continue
        if since >= step:
            version, since = version + 1, 0
            sets.append((train[0], train[-1], len(train)))
        used.append(version)
    return used, sets

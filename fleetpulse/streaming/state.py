"""Named state of one host: what the next event needs, in parts that are written on their own.

progress  value   events so far and the two cooldown clocks; written with each batch of the host
recent    value   last raw rows, last scores and their times; written with each batch of the host
train     map     training rows in chunks of CHUNK_ROWS events; a batch writes the chunks it adds to and drops old ones,
                  and reads all of them only if it holds a fitting event
forest    value   the current forest; read to score, written only when it was fitted anew

So what a batch writes does not depend on the size of the forest, nor on that of the training window.
"""

from __future__ import annotations

import io
from typing import Any

import numpy as np

from fleetpulse.config import METRICS, DetectorConfig
from fleetpulse.functions.online import WIDTH, empty_state

CHUNK_ROWS = 128

PROGRESS = "n bigint, anomaly_clock bigint, warning_clock bigint"
RECENT = "raw binary, scores binary, times binary"
TRAIN_KEY, TRAIN = "chunk bigint", "rows binary"
FOREST = "fitted_at bigint, blob binary"
_FOREST_ARRAYS = ("feature", "threshold", "size", "subsample")


def _bytes(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def fitting_event(n: int, rows: int, config: DetectorConfig) -> int | None:
    """The last event among the next `rows` after event n that a forest is fitted at."""
    last = n + rows
    if last < config.warmup_events:
        return None
    at = last - (last - config.warmup_events) % config.retrain_interval
    return at if at > n else None


class HostState:
    """Reads and writes the parts through a stateful processor's handle."""

    def __init__(self, handle: Any, config: DetectorConfig, trains: bool) -> None:
        self.config, self.trains = config, trains
        self.progress = handle.getValueState("progress", PROGRESS)
        self.recent = handle.getValueState("recent", RECENT)
        if trains:
            self.train = handle.getMapState("train", TRAIN_KEY, TRAIN)
            self.forest = handle.getValueState("forest", FOREST)

    def _chunk(self, chunk: int) -> np.ndarray:
        held = self.train.getValue((chunk,)) if self.train.containsKey((chunk,)) else None
        return np.empty((0, WIDTH)) if held is None else np.frombuffer(held[0]).reshape(-1, WIDTH)

    def load(self, rows: int) -> dict[str, np.ndarray]:
        """What the next `rows` events need, as online.advance takes it."""
        carried = empty_state()
        progress = self.progress.get()
        if progress is None:
            return carried
        n = int(progress[0])
        raw, scores, times = self.recent.get()
        carried["n"], carried["clocks"] = np.array(n), np.array(progress[1:], dtype=np.int64)
        carried["raw"] = np.frombuffer(raw).reshape(-1, len(METRICS))
        carried["scores"], carried["times"] = np.frombuffer(scores), np.frombuffer(times, dtype=np.int64)
        if not self.trains:
            return carried
        if fitting_event(n, rows, self.config) is not None:
            oldest = max(0, n - self.config.train_window)
            chunks = [self._chunk(c) for c in range(oldest // CHUNK_ROWS, (n - 1) // CHUNK_ROWS + 1)]
            carried["train"] = np.concatenate(chunks)[-min(n, self.config.train_window) :]
        forest = self.forest.get()
        if forest is not None:
            with np.load(io.BytesIO(forest[1])) as stored:
                carried.update({name: stored[name] for name in _FOREST_ARRAYS})
        return carried

    def save(self, before: int, carried: dict[str, np.ndarray], features: list[np.ndarray]) -> None:
        """Store what the events after number `before` have changed; features are their rows, in order."""
        n = int(carried["n"])
        self.progress.update((n, *map(int, carried["clocks"])))
        self.recent.update(tuple(_bytes(carried[name]) for name in ("raw", "scores", "times")))
        if not self.trains:
            return
        rows, config = np.concatenate(features), self.config
        # chunk c holds events c * CHUNK_ROWS + 1 .. (c + 1) * CHUNK_ROWS; older ones than the window are left out
        oldest = max(0, n - config.train_window)
        for chunk in range(max(before, oldest) // CHUNK_ROWS, (n - 1) // CHUNK_ROWS + 1):
            low, high = chunk * CHUNK_ROWS, (chunk + 1) * CHUNK_ROWS
            new = rows[max(0, low - before) : high - before]
            held = self._chunk(chunk) if before > low else np.empty((0, WIDTH))
            self.train.updateValue((chunk,), (_bytes(np.concatenate([held, new])),))
        for chunk in range(max(0, before - config.train_window) // CHUNK_ROWS, oldest // CHUNK_ROWS):
            if self.train.containsKey((chunk,)):
                self.train.removeKey((chunk,))
        fitted_at = fitting_event(before, n - before, config)
        if fitted_at is not None:
            out = io.BytesIO()
            np.savez(out, **{name: carried[name] for name in _FOREST_ARRAYS})
            self.forest.update((fitted_at, out.getvalue()))

    def clear(self) -> None:
        for part in (self.progress, self.recent, *((self.train, self.forest) if self.trains else ())):
            part.clear()

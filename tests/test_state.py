"""Named state of the streaming detector: what is written, and that nothing is lost between batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from fleetpulse.config import METRICS, DetectorConfig
from fleetpulse.functions.online import advance, empty_state
from fleetpulse.streaming.detect import HostProcessor
from fleetpulse.streaming.state import CHUNK_ROWS, HostState, fitting_event

CONFIG = DetectorConfig(warmup_events=100, retrain_interval=150, train_window=300, n_trees=10)


class Part:
    def __init__(self):
        self.held, self.written, self.reads = {}, 0, 0

    def _put(self, key, value):
        self.held[key] = value
        self.written += sum(len(v) if isinstance(v, bytes) else 8 for v in value)

    def get(self):
        self.reads += 1
        return self.held.get(())

    def update(self, value):
        self._put((), value)

    def getValue(self, key):  # noqa: N802
        self.reads += 1
        return self.held[key]

    def containsKey(self, key):  # noqa: N802
        return key in self.held

    def updateValue(self, key, value):  # noqa: N802
        self._put(key, value)

    def removeKey(self, key):  # noqa: N802
        del self.held[key]

    def clear(self):
        self.held.clear()


class Handle:
    """Stands for a stateful processor's handle and counts what is written."""

    def __init__(self):
        self.parts = {}

    def getValueState(self, name, schema):  # noqa: N802
        return self.parts.setdefault(name, Part())

    def getMapState(self, name, key, value):  # noqa: N802
        return self.parts.setdefault(name, Part())

    timers = ()

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers = tuple(t for t in self.timers if t != at)

    def registerTimer(self, at):  # noqa: N802
        self.timers = (*self.timers, at)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):  # noqa: N802
        return self.now


def events(total):
    rng = np.random.default_rng(5)
    times = (np.arange(total) * 3_000_000).astype(np.int64)
    return rng.gamma(2.0, 10.0, (total, 4)), times


@pytest.mark.parametrize("cuts", [[1, 2, 99, 100, 101, 249, 250, 251, 400, 900], [250, 1000], [700], list(range(7, 1000, 61))])
def test_state_between_batches_equals_one_run(cuts):
    metrics, times = events(1000)
    whole = advance(empty_state(), metrics, times, CONFIG)
    handle, parts = Handle(), []
    for low, high in zip([0, *cuts], [*cuts, 1000]):
        if low == high:
            continue
        state = HostState(handle, CONFIG, trains=True)
        carried = state.load(high - low)
        assert int(carried["n"]) == low
        found = advance(carried, metrics[low:high], times[low:high], CONFIG)
        state.save(low, carried, [found["features"]])
        parts.append(found)
    for name in ("n", "features", "raw_score", "threshold", "ewma_mean", "ewma_std", "predicted_breach_minutes", "is_anomaly", "published"):
        np.testing.assert_array_equal(np.concatenate([p[name] for p in parts]), whole[name], err_msg=name)
    assert len(handle.parts["train"].held) <= CONFIG.train_window // CHUNK_ROWS + 2


def test_a_batch_without_fit_writes_neither_forest_nor_window():
    metrics, times = events(1000)
    handle = Handle()
    per_batch, fits = [], 0
    for low in range(0, 1000, 10):
        state = HostState(handle, CONFIG, trains=True)
        carried = state.load(10)
        found = advance(carried, metrics[low : low + 10], times[low : low + 10], CONFIG)
        before = {name: (part.written, part.reads) for name, part in handle.parts.items()}
        state.save(low, carried, [found["features"]])
        written = {name: part.written - before[name][0] for name, part in handle.parts.items()}
        fit = fitting_event(low, 10, CONFIG) is not None
        fits += fit
        assert (written["forest"] > 0) == fit
        per_batch.append(sum(written.values()) - written["forest"])
    row = 12 * 8
    assert fits == 7 and max(per_batch) < 10 * 4 * 8 + 199 * 16 + (CHUNK_ROWS + 10) * row + 200
    assert len(handle.parts["forest"].held[()][1]) > 3 * max(per_batch)


def test_fitting_events():
    assert [fitting_event(0, k, CONFIG) for k in (99, 100, 101, 250)] == [None, 100, 100, 250]
    assert fitting_event(100, 149, CONFIG) is None and fitting_event(249, 1, CONFIG) == 250 and fitting_event(250, 1, CONFIG) is None


def test_given_scores_need_no_training_state():
    metrics, times = events(300)
    handle = Handle()
    for low in (0, 150):
        state = HostState(handle, CONFIG, trains=False)
        carried = state.load(150)
        found = advance(carried, metrics[low : low + 150], times[low : low + 150], CONFIG, metrics[low : low + 150, 2])
        state.save(low, carried, [found["features"]])
    assert set(handle.parts) == {"progress", "recent"}
    state.clear()
    assert int(HostState(handle, CONFIG, trains=False).load(1)["n"]) == 0


def test_an_idle_host_is_forgotten():
    metrics, times = events(40)
    rows = pd.DataFrame(metrics, columns=list(METRICS)).assign(
        event_id=[f"{i:03}" for i in range(40)], host_id="a", service_name="edge", ts=pd.to_datetime(times, unit="us"), injected_anomaly_type=None
    )
    handle = Handle()

    def run(part, now):
        processor = HostProcessor("latency_ms", CONFIG, idle_seconds=60)
        processor.init(handle)
        return [n for out in processor.handleInputRows(("a",), iter([part]), Clock(now)) for n in out["n"]], processor

    assert run(rows[:20], 1_000)[0] == list(range(1, 21)) and handle.timers == (61_000,)
    seen, processor = run(rows[20:30], 5_000)
    assert seen == list(range(21, 31)) and handle.timers == (65_000,)  # one timer, moved on
    assert list(processor.handleExpiredTimer(("a",), Clock(65_000), None)) == []
    assert run(rows[30:], 70_000)[0] == list(range(1, 11))

"""Cooldown in spans against the plain walk."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from sequential import greedy_cooldown

from fleetpulse.config import LayoutConfig
from fleetpulse.operators.cooldown import apply_cooldown, compose, exit_table, kept_rows, last_kept_from

START = dt.datetime(2024, 1, 1)


def frame(spark, times_by_key: dict[str, list[float]]):
    rows = [
        (key, START + dt.timedelta(seconds=t), i + 1)
        for key, times in times_by_key.items()
        for i, t in enumerate(sorted(times))
    ]
    return spark.createDataFrame(rows, "host_id string, ts timestamp, n bigint").repartition(5)


@pytest.mark.parametrize("span, fan", [(1, 3), (5, 4), (40, 64), (8192, 64)])
def test_spans_do_not_change_the_result(spark, span, fan):
    rng = np.random.default_rng(span)
    data = {
        "dense": np.round(np.cumsum(rng.exponential(2.0, 800)), 3).tolist(),
        "ties": np.repeat(np.cumsum(rng.integers(1, 70, 60)), 4).astype(float).tolist(),
        "sparse": np.cumsum(rng.integers(30, 4000, 60)).astype(float).tolist(),
        "exact": [60.0 * i for i in range(40)],
        "edges": [0.0, 59.0, 60.0, 121.0, 180.0, 181.0],
        "before_epoch": [-1.7e9 + 25.0 * i for i in range(50)],
        "single": [5.0],
    }
    got = apply_cooldown(frame(spark, data), layout=LayoutConfig(cooldown_span_rows=span), fan=fan).collect()
    for key, times in data.items():
        micros = [round(t * 1_000_000) for t in sorted(times)]
        want = [i + 1 for i in greedy_cooldown(micros, 60_000_000)]
        assert sorted(r.n for r in got if r.host_id == key) == want, key


def test_keys_are_independent_and_columns_kept(spark):
    df = frame(spark, {"a": [0, 10, 70], "b": [5, 64, 65]}).selectExpr("*", "n % 2 = 0 AS kind", "'x' AS note")
    got = apply_cooldown(df, keys=("host_id", "kind"))
    assert got.columns == df.columns
    assert {(r.host_id, r.n) for r in got.collect()} == {("a", 1), ("a", 3), ("a", 2), ("b", 1), ("b", 2), ("b", 3)}


def test_empty_input(spark):
    assert apply_cooldown(frame(spark, {"a": [1]}).filter("n > 5")).count() == 0


def test_kernels():
    rng = np.random.default_rng(1)
    times = np.sort(rng.integers(0, 5000, 300))
    for start in range(0, 300, 17):
        walk = greedy_cooldown(times[start:].tolist(), 60)
        assert last_kept_from(times, 60)[start] == times[start:][walk[-1]]
    assert kept_rows(times, 60, None) == greedy_cooldown(times.tolist(), 60)
    assert kept_rows(np.array([10, 69, 70]), 60, 10) == [2]


def test_composed_tables_equal_the_walk():
    rng = np.random.default_rng(2)
    for spread in (3, 40, 400):  # spans shorter, about as long and longer than the limit
        times = np.unique(rng.integers(100, 100 + spread * 60, 240))
        parts = np.array_split(times, 12)
        tables = [exit_table(p, 60) for p in parts]
        whole, pairs = tables[0], []
        for table in tables[1:]:
            whole = compose(whole, table, int(times[0]), 60)
        for left in range(0, 12, 2):
            pairs.append(compose(tables[left], tables[left + 1], int(parts[left][0]), 60))
        merged = pairs[0]
        for table in pairs[1:]:
            merged = compose(merged, table, int(times[0]), 60)
        for clock in range(100 - 61, int(times[0])):
            kept = kept_rows(times, 60, clock)
            want = times[kept[-1]] if kept else clock
            for upto, leave in (whole, merged):
                at = int(np.searchsorted(upto, clock + 60))
                assert (leave[at] if at < len(upto) else clock) == want
        assert len(whole[0]) <= int(np.searchsorted(times, times[0] + 60)) + 1


def test_a_busy_host_is_cut_by_rows(spark):
    """All candidates of one host within a minute and a half: several spans, and levels of tables above them."""
    times = (np.arange(3000) * 0.03).tolist()
    small = LayoutConfig(cooldown_span_rows=50)
    got = apply_cooldown(frame(spark, {"a": times}), seconds=0.5, layout=small, fan=4).collect()
    want = greedy_cooldown([round(t * 1e6) for t in times], 500_000)
    assert sorted(r.n for r in got) == [i + 1 for i in want]

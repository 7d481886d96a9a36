"""Order statistics and moments of windows against sorting each window."""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetpulse.config import DETECTOR, LAYOUT
from fleetpulse.functions.order import window_moments, window_order, window_percentiles
from fleetpulse.operators.threshold import add_threshold


def plain_percentile(window, percent):
    ordered = np.sort(window)
    at = percent / 100.0 * (len(ordered) - 1)
    low = int(at)
    return ordered[low] + (ordered[min(low + 1, len(ordered) - 1)] - ordered[low]) * (at - low)


VALUES = st.lists(st.sampled_from([0.0, 0.25, 0.5, 0.5, 1.0, -3.0, 1e9, math.nan]), max_size=60)


@settings(max_examples=150, deadline=None)
@given(VALUES, st.data())
def test_windows_equal_sorted_ones(values, data):
    values = np.array(values, float)
    cuts = data.draw(st.lists(st.tuples(st.integers(0, len(values)), st.integers(0, len(values))), max_size=20))
    begin, end = np.array([min(c) for c in cuts], np.int64), np.array([max(c) for c in cuts], np.int64)
    percent = data.draw(st.sampled_from([0.0, 37.5, 95.0, 100.0]))
    got = window_percentiles(values, begin, end, percent)
    mean, std = window_moments(values, begin, end, 60, rows=7)
    for i, (a, b) in enumerate(zip(begin, end, strict=True)):
        if a == b:
            assert np.isnan([got[i], mean[i], std[i]]).all()
            continue
        np.testing.assert_allclose(got[i], plain_percentile(values[a:b], percent))
        np.testing.assert_allclose([mean[i], std[i]], [values[a:b].mean(), values[a:b].std()], rtol=1e-9, atol=1e-6)


def test_each_rank_of_ties_and_nan():
    values = np.array([2.0, np.nan, 1.0, 2.0, 1.0])
    k = np.arange(5)
    np.testing.assert_array_equal(window_order(values, np.zeros(5, int), np.full(5, 5), k), np.sort(values))


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_history_over_chunks_and_batches(spark, batch):
    """Windows reach over Arrow batches and chunks, stop at hosts, skip missing scores; ties and repeated rows count."""
    layout, config = replace(LAYOUT, chunk_rows=16), replace(DETECTOR, score_history=12, min_history=3)
    scores = np.round(np.random.default_rng(5).random((3, 50)), 1)
    rows = [
        (f"h{h}", f"e{i:03}", i // 2, None if i < 4 or (i * 7 + h) % 11 == 0 else float(scores[h, i]), "x")
        for h in range(3) for i in range(50)
    ]
    rows.append(("one", "e", 0, 0.5, "x"))
    events = spark.createDataFrame(rows, "host_id string, event_id string, s long, raw_score double, percentile string")
    events = events.withColumn("ts", F.timestamp_seconds("s")).repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = {(r.host_id, r.event_id): r for r in add_threshold(events, config, layout).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(found) == len(rows)
    for host in ("h0", "h1", "h2", "one"):
        own = [r for r in rows if r[0] == host]
        for i, (_, event, _, score, _) in enumerate(own):
            got = found[host, event]
            window = np.array([r[3] for r in own[max(0, i - 11) : i + 1] if r[3] is not None])
            if score is None:
                assert got.history_count is None and got.threshold is None and got.ewma_std is None and not got.is_anomaly
                continue
            assert got.history_count == len(window) and (got.threshold is None) == (len(window) < 3)
            np.testing.assert_allclose([got.ewma_mean, got.ewma_std], [window.mean(), window.std()], atol=1e-12)
            if len(window) >= 3:
                np.testing.assert_allclose(got.threshold, plain_percentile(window, 95.0))
                assert got.is_anomaly == (score > got.threshold)
    assert add_threshold(events.limit(0), config, layout).count() == 0


def test_history_takes_the_order_of_the_chunks(spark):
    """The pass stands above one sort by chunk and below the cut of the copied rows, without an exchange of its own."""
    rows = spark.createDataFrame([("h", "e", 1, 0.5)], "host_id string, event_id string, s long, raw_score double")
    text = add_threshold(rows.withColumn("ts", F.timestamp_seconds("s")))._jdf.queryExecution().executedPlan().toString()
    top = text[: text.index("Exchange")]
    assert top.count("ArrowEvalPython") == 1 and top.index("Filter") < top.index("ArrowEvalPython") < top.index("Sort [")

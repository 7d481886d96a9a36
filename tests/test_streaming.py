"""Streams over several batches and restarts against the batch operators."""

from __future__ import annotations

import datetime as dt
import threading
import time
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_detection import SCHEMA, host_events

from fleetpulse.config import DetectorConfig
from fleetpulse.operators import alerts
from fleetpulse.plans import catalog
from fleetpulse.plans.detect import score_with_column, score_with_forest
from fleetpulse.sources import messages
from fleetpulse.streaming import dashboard as stream_dash
from fleetpulse.streaming import detect as stream
from fleetpulse.streaming.investigate import run_investigation

SMALL = DetectorConfig(n_trees=15)


@pytest.fixture(scope="module")
def fleet(spark):
    rows = []
    for i, (host, total) in enumerate({"a": 900, "b": 125, "c": 3}.items()):
        # ids of equal length: messages carry them as text, which then sorts like the number
        rows += host_events(host, total, seed=20 + i, first_id=100_000 * (i + 1))
    return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).cache()


def write_slice(telemetry, path, low, high):
    day = F.unix_seconds("ts") - F.unix_seconds(F.lit(dt.datetime(2024, 1, 1)))
    part = telemetry.filter((day >= low) & (day < high))
    messages.encode_telemetry(part).repartition(2).write.mode("append").parquet(path)


@pytest.mark.parametrize("score_col", ["latency_ms", None])
def test_restarted_stream_equals_batch(spark, fleet, tmp_path, score_col):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "checkpoint"))
    edges = [0, 400, 500, 3000, 10**9]
    for low, high in zip(edges[:-1], edges[1:]):
        write_slice(fleet, source, low, high)
        # each run is a new query that takes its state from the checkpoint
        stream.run_detection(
            messages.file_stream(spark, source, max_files_per_trigger=2), out, checkpoint, score_col, SMALL
        ).awaitTermination()

    got = {r.event_id: r for r in stream.stored(spark, f"{out}/metrics").collect()}
    batch = score_with_column(fleet, score_col, SMALL) if score_col else score_with_forest(fleet, SMALL)
    want = batch.collect()
    assert len(got) == len(want)
    assert any(r.is_anomaly for r in want) and any(r.predicted_breach_minutes is not None for r in want)
    for w in want:
        g = got[str(w.event_id)]
        for name in ("n", "is_anomaly", "severity", "model_version", "predicted_breach_minutes", "host_id", "ts"):
            assert g[name] == w[name], (name, g, w)
        for name in ("raw_score", "threshold", "ewma_mean", "ewma_std"):
            assert (g[name] is None) == (w[name] is None)
            assert w[name] is None or g[name] == pytest.approx(w[name], abs=1e-9)
        np.testing.assert_allclose(g.features, w.features, atol=1e-9)
        assert (g.recent_metrics is None) == (w.recent_metrics is None)
        if w.recent_metrics is not None:
            assert [tuple(s) for s in g.recent_metrics] == [tuple(s) for s in w.recent_metrics]

    sent = stream.stored(spark, f"{out}/alerts")
    expected = alerts.build_alerts(batch)
    assert {r.alert_id for r in sent.select("alert_id").collect()} == {r.alert_id for r in expected.select("alert_id").collect()}
    decoded = messages.decode_alerts(stream.stored(spark, f"{out}/alert_messages"))
    assert decoded.count() == sent.count()


def test_bad_messages_go_to_quarantine_and_the_stream_goes_on(spark, fleet, tmp_path):
    source = str(tmp_path / "in")
    messages.encode_telemetry(fleet).withColumn(
        "value", F.when(F.col("key") == "c", F.lit("{bad")).otherwise(F.col("value"))
    ).write.parquet(source)
    rows = messages.file_stream(spark, source)
    stream.run_quarantine(rows, str(tmp_path / "bad"), str(tmp_path / "cp1")).awaitTermination()
    stream.run_detection(rows, str(tmp_path / "out"), str(tmp_path / "cp2"), "latency_ms").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "bad")).groupBy("reject_reason").count().collect()[0]["count"] == 3
    assert stream.stored(spark, str(tmp_path / "out/metrics")).count() == 1025


def test_repeated_events_are_dropped_on_request(spark, fleet, tmp_path):
    source = str(tmp_path / "in")
    messages.encode_telemetry(fleet.unionByName(fleet.limit(400))).write.parquet(source)
    stream.run_detection(
        messages.file_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "cp"), "latency_ms", dedup=True
    ).awaitTermination()
    assert stream.stored(spark, str(tmp_path / "out/metrics")).count() == fleet.count()


def test_dashboard_buckets_update(spark, fleet, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for low, high in ((303, 10**9), (0, 303)):  # the first slice comes last, hours late for some rows
        write_slice(fleet, source, low, high)
        telemetry = messages.decode_telemetry(messages.file_stream(spark, source, max_files_per_trigger=2))
        stream_dash.run_dashboard(telemetry, out, checkpoint, trigger={"availableNow": True}).awaitTermination()
    stored = spark.read.parquet(out)
    assert "ds" in stored.columns
    got = {(r.time, r.host_id): r.cpu_pct for r in stream_dash.current(stored).collect()}
    whole = {(r.time, r.host_id): r.cpu_pct for r in stream_dash.current(stream_dash.compacted(stored)).collect()}
    assert whole.keys() == got.keys() and all(whole[k] == pytest.approx(v) for k, v in got.items())
    want = fleet.groupBy(F.window("ts", "15 seconds").start.alias("time"), "host_id").agg(F.avg("cpu_pct").alias("v")).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[(r.time, r.host_id)] == pytest.approx(r.v)


def test_late_first_copies_are_kept_and_late_repeats_dropped(spark, fleet, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for low, high in ((600, 10**9), (0, 600), (0, 600)):
        write_slice(fleet, source, low, high)
        rows = messages.decode_telemetry(messages.file_stream(spark, source, max_files_per_trigger=2))
        query = stream.deduplicated(rows).writeStream.format("parquet").option("path", out)
        query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.schema(rows.schema).parquet(out).count() == fleet.count()


def test_one_big_batch_is_worked_in_slices_and_nan_readings_agree(spark, fleet, tmp_path, monkeypatch):
    nan = F.when(F.col("event_id") % 97 == 5, F.lit(float("nan"))).otherwise(F.col("cpu_pct"))
    odd = fleet.withColumn("cpu_pct", nan)
    source = str(tmp_path / "in")
    messages.encode_telemetry(odd).write.parquet(source)
    monkeypatch.setattr(stream, "SLICE_ROWS", 70)
    stream.run_detection(messages.file_stream(spark, source), str(tmp_path / "out"), str(tmp_path / "cp"), "latency_ms", SMALL).awaitTermination()
    got = {r.event_id: r.features for r in stream.stored(spark, str(tmp_path / "out/metrics")).collect()}
    want = {str(r.event_id): r.features for r in score_with_column(odd, "latency_ms", SMALL).collect()}
    assert got.keys() == want.keys() and sum(np.isnan(v).any() for v in want.values()) > 5
    for k, v in want.items():
        np.testing.assert_allclose(np.array(got[k], float), v, atol=1e-9)  # null stands for NaN


def test_events_of_unknown_hosts_go_to_quarantine(spark, fleet, tmp_path):
    source, hosts = str(tmp_path / "in"), spark.createDataFrame([("a",), ("c",)], "host_id string")
    messages.encode_telemetry(fleet).write.parquet(source)
    rows = messages.file_stream(spark, source)
    stream.run_quarantine(rows, str(tmp_path / "bad"), str(tmp_path / "cp1"), hosts=hosts).awaitTermination()
    stream.run_detection(rows, str(tmp_path / "out"), str(tmp_path / "cp2"), "latency_ms", SMALL, hosts=hosts).awaitTermination()
    bad = spark.read.parquet(str(tmp_path / "bad")).groupBy("key", "reject_reason").count().collect()
    assert [tuple(r) for r in bad] == [("b", "unknown_host", 125)]
    kept = stream.stored(spark, str(tmp_path / "out/metrics")).groupBy("host_id").count().collect()
    assert {r.host_id for r in kept} == {"a", "c"}


def test_bounded_dedup_forgets_and_counts_late_rows(spark, fleet, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    queries = []
    # one slice after the other; then a repeat within the span, and rows that are hours late
    for low, high in ((0, 600), (600, 1200), (1100, 1200), (1200, 10**9), (0, 100)):
        write_slice(fleet, source, low, high)
        query = stream.run_detection(messages.file_stream(spark, source), out, checkpoint, "latency_ms", SMALL, dedup="5 minutes")
        query.awaitTermination()
        queries.append(query)
    assert stream.stored(spark, f"{out}/metrics").count() == fleet.count()
    seconds = F.unix_seconds("ts") - F.unix_seconds(F.lit(dt.datetime(2024, 1, 1)))
    late = fleet.filter(seconds < 100).count()
    for _ in range(50):  # progress arrives a moment after the query has ended
        counted = [p for p in (tmp_path / "out" / "late").glob("batch=*")] if (tmp_path / "out" / "late").exists() else []
        if counted:
            break
        time.sleep(0.2)
    rows = stream.stored(spark, f"{out}/late").collect()
    assert [(r.reject_reason, r.rows) for r in rows] == [("late", late)]
    states = [op for p in queries[-1].recentProgress for op in p["stateOperators"] if "dedup" in op["operatorName"].lower()]
    assert states[-1]["numRowsTotal"] < fleet.count() / 3  # ids older than the span are gone


def test_folders_of_late_rows_are_never_seen_empty(spark, tmp_path):
    out, empty, over = tmp_path / "late", [], threading.Event()

    def watch():
        while not over.is_set():
            empty.extend(p.name for p in out.glob("batch=*") if not [*p.glob("*.parquet")])

    def count(batch: int, rows: int) -> None:
        progress = SimpleNamespace(name="q", batchId=batch, stateOperators=[SimpleNamespace(numRowsDroppedByWatermark=rows)])
        listener.onQueryProgress(SimpleNamespace(progress=progress))

    listener = stream.LateRows(spark, "q", str(out))
    watcher = threading.Thread(target=watch)
    watcher.start()
    count(3, 7)
    count(5, 2)
    over.set()
    watcher.join()
    assert not empty
    count(5, 4)  # a batch that is run again replaces its count
    assert sorted(tuple(r) for r in stream.stored(spark, str(out)).collect()) == [(3, "late", 7), (5, "late", 4)]


def test_windows_are_upserted_over_restarts(spark, fleet, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "cp"))
    for low, high in ((0, 303), (303, 307), (307, 10**9)):  # cuts inside windows
        write_slice(fleet, source, low, high)
        telemetry = messages.decode_telemetry(messages.file_stream(spark, source, max_files_per_trigger=1))
        stream_dash.run_windows(telemetry, out, checkpoint, trigger={"availableNow": True}).awaitTermination()
    got = {(r.time, r.host_id): (r.cpu_pct, r.latency_ms) for r in stream_dash.latest(spark.read.parquet(out)).collect()}
    means = [F.avg(m).alias(m) for m in ("cpu_pct", "latency_ms")]
    want = fleet.groupBy(F.window("ts", "15 seconds").start.alias("time"), "host_id").agg(*means).collect()
    assert len(got) == len(want)
    for r in want:
        assert got[(r.time, r.host_id)] == pytest.approx((r.cpu_pct, r.latency_ms))


def test_chain_neither_loses_nor_doubles_alerts(spark, fleet, tmp_path):
    source, out, found, cp1, cp2 = (str(tmp_path / d) for d in ("in", "out", "found", "cp1", "cp2"))
    empty = {
        "logs": "host_id string, service_name string, ts timestamp, line string",
        "deploys": "deploy_id string, git_sha string, author string, component string, service_name string, deployed_at timestamp",
        "runbooks": "service_name string, body string",
    }
    side = [spark.createDataFrame([], schema) for schema in empty.values()]
    for low, high in ((0, 2000), (2000, 10**9)):
        write_slice(fleet, source, low, high)
        stream.run_detection(messages.file_stream(spark, source), out, cp1, "latency_ms", SMALL).awaitTermination()
        run_investigation(
            messages.file_stream(spark, f"{out}/alert_messages"), lambda: (stream.stored(spark, f"{out}/metrics"), *side), found, cp2
        ).awaitTermination()
    # the detection's first batch runs again: its folder gets new files
    again = spark.read.schema("key string, value string").parquet(f"{out}/alert_messages/batch=0").collect()
    spark.createDataFrame(again, "key string, value string").write.mode("overwrite").parquet(f"{out}/alert_messages/batch=0")
    run_investigation(
        messages.file_stream(spark, f"{out}/alert_messages"), lambda: (stream.stored(spark, f"{out}/metrics"), *side), found, cp2
    ).awaitTermination()
    sent = [r.alert_id for r in stream.stored(spark, f"{out}/alerts").collect()]
    rows = stream.stored(spark, f"{found}/diagnoses").collect()
    assert sorted(r.alert_id for r in rows) == sorted(sent) and len(sent) == len(set(sent)) > 5
    assert all(r.sample_count > 0 for r in rows)


def test_stream_sink_needs_a_target(spark, fleet, tmp_path):
    messages.encode_telemetry(fleet).write.parquet(str(tmp_path / "in"))
    with pytest.raises(ValueError, match="sink"):
        messages.stream_sink(messages.file_stream(spark, str(tmp_path / "in")), str(tmp_path / "cp"))


def test_parity_runs_the_batch_beside_the_stream(spark, monkeypatch):
    seen, detect = [], catalog.detection.detect
    monkeypatch.setattr(catalog.detection, "detect", lambda *a: seen.append(len(spark.streams.active)) or detect(*a))
    rows = catalog.stream_batch_parity(spark, "/root/testdata/sf0.001").collect()
    assert seen == [1] and len(rows) == 6 and sum(r.differences for r in rows) == 0
    assert not spark.streams.active

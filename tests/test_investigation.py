"""Evidence, diagnosis, status and tables on hand-made rows."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fleetpulse.config import METRICS, InvestigationConfig
from fleetpulse.operators import dashboard, diagnosis, evidence
from fleetpulse.sources import tables

T0 = dt.datetime(2024, 1, 1, 12)
SNAP = "struct<" + ", ".join(f"{m}: double" for m in METRICS) + ">"
ALERT_SCHEMA = (
    f"alert_id string, host_id string, service_name string, n bigint, triggered_at timestamp, severity string, "
    f"raw_score double, threshold double, metric_snapshot {SNAP}, recent_metrics array<{SNAP}>"
)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def alert(alert_id, host="h1", service="edge", n=500, when=0.0, snap=(1.0, 1.0, 1.0, 1.0), recent=()):
    return (alert_id, host, service, n, at(when), "warning", 0.7004999, 0.6, snap, list(recent))


def alerts_of(spark, *rows):
    return spark.createDataFrame(list(rows), ALERT_SCHEMA)


def metrics_of(spark, rows):
    return spark.createDataFrame(rows, "host_id string, event_id bigint, ts timestamp, " + ", ".join(f"{m} double" for m in METRICS))


def test_dominant_metric_by_zscore(spark):
    base = [(10.0, 20.0, 30.0, 40.0)] * 9
    df = alerts_of(
        spark,
        alert("spread", snap=(11.0, 20.0, 90.0, 40.0), recent=base + [(11.0, 20.0, 90.0, 40.0)]),
        alert("constant", snap=base[0], recent=base),
        alert("empty"),
        alert("mem", snap=(10.0, 99.0, 30.0, 40.0), recent=[(10.0, 20.0 + i, 30.0, 40.0) for i in range(9)]),
    )
    got = {r.alert_id: r.dominant_metric for r in evidence.dominant_by_zscore(df).collect()}
    # one outlier among ten gives the same z-score for cpu and latency: the first one wins
    assert got == {"spread": "cpu_pct", "constant": "cpu_pct", "empty": "latency_ms", "mem": "mem_pct"}


def test_recent_metrics_are_the_newest_rows_in_the_lookback(spark):
    # one row per second: 900 rows lie in 15 minutes, so the limit of 200 rows binds
    dense = [("h1", i, at(i), float(i), 1.0, 1.0, 1.0) for i in range(1, 1001)]
    # one row per minute: the lookback binds
    slow = [("h2", i, at(60 * i), float(i), 1.0, 1.0, 1.0) for i in range(1, 101)]
    metrics = metrics_of(spark, dense + slow)
    alerts = alerts_of(
        spark, alert("dense", n=900, when=900), alert("slow", host="h2", n=50, when=3000), alert("first", n=1, when=1)
    ).withColumn("wanted", F.lit(500))
    rows = evidence.recent_metrics(alerts, metrics).collect()
    by = {a: sorted(r.cpu_pct for r in rows if r.alert_id == a) for a in ("dense", "slow", "first")}
    assert by["dense"] == [float(i) for i in range(701, 901)]
    assert by["slow"] == [float(i) for i in range(35, 51)]
    assert by["first"] == [1.0]
    # minutes are clamped to 1..180, and may come from a column
    assert evidence.recent_metrics(alerts, metrics, 0).filter("alert_id = 'slow'").count() == 2
    wide = evidence.recent_metrics(alerts, metrics, "wanted").filter("alert_id = 'slow'")
    assert wide.count() == 50 and wide.first().minutes == 180

    summary = {r.alert_id: r for r in evidence.recent_metrics_summary(alerts, metrics).collect()}
    assert summary["dense"].sample_count == 200 and summary["dense"].latest_cpu_pct == 900.0
    assert summary["dense"].mean_cpu_pct == pytest.approx(800.5)
    assert summary["dense"].dominant_metric == "cpu_pct"
    assert summary["first"].dominant_metric == "cpu_pct"  # all ratios are 1: the first wins


def test_zero_means_are_skipped(spark):
    metrics = metrics_of(spark, [("h1", i, at(i), 0.0, 0.0, 0.0, 0.0) for i in range(1, 5)])
    got = evidence.recent_metrics_summary(alerts_of(spark, alert("a", n=4, when=4)), metrics).first()
    assert got.dominant_metric == "latency_ms"


def test_logs_deploys_and_runbooks(spark):
    logs = spark.createDataFrame(
        [
            ("h1", "edge", at(-60), "b: GC Pause seen"), ("h1", "edge", at(-60.5), "too old timeout"),
            ("h1", "edge", at(-5), "a: Slow Query"), ("h1", "edge", at(-5), "a: Slow Query"),
            ("h1", "edge", at(0), "nothing here"), ("h1", "edge", at(1), "0: later timeout"),
            ("h1", "core", at(-3), "0: other service timeout"), ("h2", "edge", at(-3), "0: other host timeout"),
            ("h1", "edge", at(-2), "0: OOMKilled"),
        ],
        "host_id string, service_name string, ts timestamp, line string",
    )
    deploys = spark.createDataFrame(
        [
            ("d1", "s1", "ann", "api", "edge", at(-300)), ("d2", "s2", "bob", "api", "edge", at(-117)),
            ("d0", "s0", "eve", "api", "edge", at(-300.5)), ("d3", "s3", "cat", "web", "edge", at(1)),
            ("d4", "s4", "dan", "web", "core", at(-10)),
        ],
        "deploy_id string, git_sha string, author string, component string, service_name string, deployed_at timestamp",
    )
    short = InvestigationConfig(logs_minutes=1, deploys_minutes=5)
    a = alerts_of(spark, alert("a1"), alert("a2", host="h9", service="cache"))

    lines = {(r.alert_id, r.line): (r.copies, r.line_rank) for r in evidence.log_evidence(a, logs, config=short).collect()}
    assert lines == {
        ("a1", "0: OOMKilled"): (1, 1), ("a1", "a: Slow Query"): (2, 2), ("a1", "b: GC Pause seen"): (1, 3),
        ("a1", "nothing here"): (1, 4),
    }
    judged = a.withColumn("dominant_metric", F.lit("latency_ms"))
    assert [tuple(r) for r in evidence.log_match(judged, logs, config=short).collect()] == [("a1", "a: Slow Query", 3)]

    found = evidence.deploy_correlation(a, deploys, config=short).collect()
    assert [(r.alert_id, r.deploy_count, r.deploy_id, r.minutes_before_alert) for r in found] == [("a1", 2, "d2", 2.0)]

    books = spark.createDataFrame(
        [("edge", "# x\n  1. Look.\n1. Not this"), ("default", "no steps")], "service_name string, body string"
    )
    steps = evidence.runbook_first_step(evidence.runbook_lookup(a, books)).orderBy("alert_id").collect()
    assert [(r.runbook_key, r.first_step) for r in steps] == [("edge", "1. Look."), ("default", None)]


def test_diagnosis_branches_and_runs(spark):
    gathered = spark.createDataFrame(
        [
            ("d", "cpu_pct", 2, "dep-1", "api", "ann", 3.4, "line", "1. Look."),
            ("l", "mem_pct", None, None, None, None, None, "h1 oom", "1. Look."),
            ("n", "latency_ms", None, None, None, None, None, None, "no steps"),
            ("u", "cpu_pct", 1, "dep-2", None, None, 3.4, None, None),
        ],
        "alert_id string, dominant_metric string, deploy_count bigint, deploy_id string, component string, "
        "author string, minutes_before_alert double, matched_log string, runbook string",
    )
    calls = "array_repeat(named_struct('id', '1', 'name', 'logs', 'arguments', '{}', 'result', '{}'), 4)"
    gathered = gathered.withColumn("tool_calls", F.expr(calls))
    got = {r.alert_id: r for r in diagnosis.diagnose(gathered).collect()}
    assert [(got[k].branch, got[k].confidence, got[k].severity_assessment) for k in "dln"] == [
        ("deploy", 0.90, "high"), ("log", 0.78, "high"), ("none", 0.63, "medium")
    ]
    assert "dep-1" in got["d"].root_cause and "3 min" in got["d"].root_cause
    assert "dep-2 of an unknown component by unknown" in got["u"].root_cause
    assert got["l"].root_cause == "Memory filling up, as this log line shows: h1 oom"
    assert got["l"].proposed_fix.endswith("First runbook step: 1. Look.")
    assert "First runbook step" not in got["n"].proposed_fix

    runs = spark.createDataFrame(
        [
            ("r1", "d", at(0), at(1.2345), None), ("r2", "x", at(0), at(2), None),
            ("r3", "l", at(0), at(3), "store down"),
        ],
        "run_id string, alert_id string, started_at timestamp, completed_at timestamp, error_message string",
    )
    records = {r.run_id: r for r in diagnosis.run_records(runs, diagnosis.diagnose(gathered)).collect()}
    assert records["r1"].latency_ms == 1234 and records["r1"].turn_count == 5
    assert records["r1"].status == "completed" and len(records["r1"].tool_calls) == 4
    assert records["r2"].turn_count == 1 and records["r2"].tool_calls == []
    assert records["r2"].confidence == 0.0 and "without a diagnosis" in records["r2"].root_cause
    failed = records["r3"]
    assert (failed.status, failed.error_message, failed.root_cause, failed.turn_count) == ("failed", "store down", None, None)
    assert failed.tool_calls == []

    status = {r.alert_id: r.status for r in tables.latest_status(diagnosis.lifecycle(runs)).collect()}
    assert status == {"d": "diagnosed", "x": "diagnosed", "l": "error"}


def test_status_ties_follow_the_lifecycle(spark):
    log = spark.createDataFrame(
        [("a", "diagnosed", at(5)), ("a", "investigating", at(5)), ("b", "investigating", at(9)), ("b", "error", at(3))],
        "alert_id string, status string, updated_at timestamp",
    )
    assert {tuple(r) for r in tables.latest_status(log).collect()} == {("a", "diagnosed", at(5)), ("b", "investigating", at(9))}


def test_hosts_and_orphans(spark):
    existing = spark.createDataFrame([("h1", "old")], "host_id string, service_name string")
    incoming = spark.createDataFrame([("h1", "new"), ("h2", "edge"), ("h2", "edge")], "host_id string, service_name string")
    assert {tuple(r) for r in tables.upsert_hosts(incoming, existing).collect()} == {("h1", "old"), ("h2", "edge")}
    rows = spark.createDataFrame([("h1",), ("h3",), (None,)], "host_id string")
    assert [r.host_id for r in tables.orphans(rows, existing, "host_id").collect()] == ["h3"]
    assert [r.host_id for r in tables.with_parent(rows, existing, "host_id").collect()] == ["h1"]


def test_repeated_batches_are_stored_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, at(0)), (2, at(90000))], "event_id int, ts timestamp")
    for _ in range(2):
        tables.append_batch(rows, str(tmp_path), 7, date_col="ts")
    tables.append_batch(rows, str(tmp_path), 8, date_col="ts")
    stored = spark.read.parquet(str(tmp_path))
    assert stored.count() == 4 and stored.filter("ds = DATE'2024-01-02'").count() == 2


def test_compaction_can_be_repeated_and_keeps_every_row(spark, tmp_path):
    path, view = str(tmp_path / "batches"), "compaction_test"

    def stored():
        return sorted(r.event_id for r in tables.read_by_host(spark, path, view).collect())

    def batch(number, ids):
        rows = spark.createDataFrame([("h1" if i % 3 else "h2", i, at(1800 * i)) for i in ids], "host_id string, event_id int, ts timestamp")
        tables.append_batch(rows, path, number, date_col="ts")

    def compact(upto):
        return tables.compact_batches(spark, path, view, upto, buckets=3, root=str(tmp_path / "tables"))

    batch(0, range(0, 40))
    batch(1, range(40, 70))
    assert tables.compacted_upto(spark, view) == -1 and stored() == list(range(70))
    assert compact(0) == 0 and stored() == list(range(70)) and spark.table(view).count() == 40
    assert compact(0) == 0 and spark.table(view).count() == 40
    early = spark.table(view)
    batch(2, range(70, 80))
    batch(1, range(40, 70))  # a batch written again before it is gathered
    assert compact(1) == 1 and stored() == list(range(80)) and spark.table(view).count() == 70
    assert early.count() == 40  # readers of the generation before are not disturbed
    assert compact(5) == 5 and stored() == list(range(80))
    batch(6, [])
    batch(7, [500])
    assert stored() == [*range(80), 500]
    days = spark.table(view).filter("ds = DATE'2024-01-02'")
    assert sorted(r.event_id for r in days.collect()) == list(range(24, 72))
    kept = [t.name for t in spark.catalog.listTables(pattern=f"{view}_*")]
    assert sorted(kept) == [f"{view}_1", f"{view}_5"]


def test_means_of_a_lookback_from_a_table_by_host(spark):
    rows = [("h1", i, at(60 * i), float(i), 1.0, 1.0, 1.0) for i in range(200)] + [("h2", 900, at(0), 9.0, 1.0, 1.0, 1.0)]
    stored = tables.by_host(metrics_of(spark, rows))
    asked = alerts_of(spark, alert("a", when=60 * 65), alert("b", host="h2", when=9000), alert("c", host="h3", when=60))
    got = {r.alert_id: (r.sample_count, r.mean_cpu_pct) for r in evidence.recent_means(asked, stored).collect()}
    assert got == {"a": (16, 57.5), "b": (0, None), "c": (0, None)}  # both ends of the 15 minutes count, across the hour


def test_dashboard_selection_and_latest_diagnosis(spark):
    metrics = metrics_of(spark, [("h1", 1, at(0), 1.0, 1.0, 1.0, 1.0), ("h1", 2, at(14), 2.0, 1.0, 1.0, 1.0), ("h2", 1, at(15), 9.0, 1.0, 1.0, 1.0)])
    got = dashboard.series(metrics, "cpu_pct", hosts=["h1"]).collect()
    assert [(r.time, r.metric, r.value) for r in got] == [(T0, "h1", 1.5)]
    assert dashboard.series(metrics, "cpu_pct", start=at(15), end=at(15)).count() == 1

    alerts = alerts_of(spark, alert("a1", when=0), alert("a2", when=10), alert("a3", when=20)).withColumn("status", F.lit("new"))
    runs = spark.createDataFrame(
        [("r1", "a1", "old", "f", 0.125, at(1)), ("r2", "a1", "new", "f", 0.125, at(2)), ("r3", "a3", "c", "f", None, at(3))],
        "run_id string, alert_id string, root_cause string, proposed_fix string, confidence double, created_at timestamp",
    )
    table = dashboard.alert_table(alerts, runs).collect()
    assert [(r.time, r.root_cause) for r in table] == [(at(20), "c"), (at(10), None), (at(0), "new")]
    assert float(table[2].confidence) == 0.13 and float(table[2].score) == 0.7
    assert [r.time for r in dashboard.alert_table(alerts, runs, limit=1).collect()] == [at(20)]
    assert dashboard.active_alerts(alerts, as_of=at(3600)).first().value == 2
    assert dashboard.active_alerts(alerts).first().value == 3


def test_a_failing_evidence_step_leaves_the_others(spark):
    alerts = alerts_of(spark, alert("a", n=4, when=4))
    metrics = metrics_of(spark, [("h1", i, at(i), float(i), 1.0, 1.0, 1.0) for i in range(1, 5)])
    logs = spark.createDataFrame([("h1", "edge", at(1), "x throttled")], "host_id string, service_name string, ts timestamp, line string")
    broken = spark.createDataFrame([(1,)], "unrelated int")
    gathered = diagnosis.gather(alerts, metrics, logs, broken, broken)
    got = diagnosis.diagnose(gathered).first()
    assert (got.branch, got.matched_log, got.deploy_id, got.runbook) == ("log", "x throttled", None, None)
    results = {c.name: json.loads(c.result) for c in got.tool_calls}
    assert results["recent_metrics"] == {"sample_count": 4, "dominant_metric": "cpu_pct"}
    assert results["logs"] == {"matched_log": "x throttled", "matching_lines": 1}
    assert "deployed_at" in results["deploys"]["error"] and "error" in results["runbook"]
    assert json.loads(got.tool_calls[0].arguments) == {"host_id": "h1", "minutes": 15}
    without = {k: v for k, v in diagnosis.EVIDENCE.items() if k != "logs"}
    assert diagnosis.diagnose(diagnosis.gather(alerts, metrics, logs, broken, broken, steps=without)).first().branch == "none"
    with pytest.raises(ValueError, match="metrics has no column ts"):
        diagnosis.gather(alerts, metrics.drop("ts"), logs, broken, broken)
    with pytest.raises(ValueError, match="alerts has no column triggered_at"):
        diagnosis.gather(alerts.drop("triggered_at"), metrics, logs, broken, broken)


def test_lookback_needs_no_position_and_takes_the_newest_of_equal_times(spark):
    rows = [("h1", i, at(i // 3), float(i), 1.0, 1.0, 1.0) for i in range(3 * 900)]
    metrics = metrics_of(spark, rows)
    alerts = alerts_of(spark, alert("a", when=500), alert("b", when=0.5)).select("alert_id", "host_id", "service_name", "triggered_at")
    got = evidence.recent_metrics(alerts, metrics).collect()
    a = sorted((r.recency, r.cpu_pct) for r in got if r.alert_id == "a")
    assert a == [(k + 1, float(1502 - k)) for k in range(200)]
    assert sorted(r.cpu_pct for r in got if r.alert_id == "b") == [0.0, 1.0, 2.0]
    assert evidence.recent_metrics(alerts.limit(0), metrics).count() == 0


def test_lookback_opens_the_days_of_the_alerts_only(spark, tmp_path):
    rows = [("h1", i, at(86400 * i), 1.0, 1.0, 1.0, 1.0) for i in range(6)]
    tables.append_batch(metrics_of(spark, rows), str(tmp_path), 0, date_col="ts")
    stored = spark.read.parquet(str(tmp_path))
    near = evidence.within_reach(stored, "ts", alerts_of(spark, alert("a", when=86400 * 3)), 180)
    assert [r.event_id for r in near.collect()] == [3]
    panel = dashboard.selected(stored, "ts", start=at(86400), end=at(86400 * 2))
    assert sorted(r.event_id for r in panel.collect()) == [1, 2]
    for df in (near, panel):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(ds" in text and "ds#" in text.split("PartitionFilters:")[1].split("]")[0]


def test_runbook_steps_in_any_line_format(spark):
    books = spark.createDataFrame([("edge", "# x\r\n\t1. Tabbed step \r\n2. Next"), ("core", "a\r1. Old line end\r"), ("default", "")], "service_name string, body string")
    a = alerts_of(spark, alert("a1"), alert("a2", service="core"))
    steps = {r.alert_id: r.first_step for r in evidence.runbook_first_step(evidence.runbook_lookup(a, books)).collect()}
    assert steps == {"a1": "1. Tabbed step", "a2": "1. Old line end"}


def test_a_step_that_fails_on_its_data_leaves_the_others(spark):
    alerts = alerts_of(spark, alert("a", when=100))
    metrics = metrics_of(spark, [("h1", 1, at(50), 1.0, 1.0, 1.0, 1.0)])
    logs = spark.createDataFrame([("h1", "edge", at(90), "slow query")], "host_id string, service_name string, ts timestamp, line string")
    logs = logs.withColumn("line", F.when(F.length("line") > 0, F.raise_error(F.lit("block missing")).cast("string")))
    deploys = spark.createDataFrame([("d1", "abc", "dana", "router", "edge", at(60))], "deploy_id string, git_sha string, author string, component string, service_name string, deployed_at timestamp")
    runbooks = spark.createDataFrame([("edge", "1. look")], "service_name string, body string")
    got = diagnosis.diagnose(diagnosis.gather(alerts, metrics, logs, deploys, runbooks)).first()
    results = {c.name: json.loads(c.result) for c in got.tool_calls}
    assert "block missing" in results["logs"]["error"] and set(results["logs"]) == {"error"}
    assert got.branch == "deploy" and results["recent_metrics"]["sample_count"] == 1 and results["runbook"]["runbook_key"] == "edge"


def test_keywords_with_quotes_and_in_any_case(spark):
    logs = spark.createDataFrame([("It CAN'T connect",), ("Slow Query",), ("fine \\",)], "line string")
    words = {"cpu_pct": ["can't", "\\"], "latency_ms": ["SLOW query"], "mem_pct": []}
    got = {r.line: r.m for r in logs.select("line", evidence.matched_metrics(words).alias("m")).collect()}
    assert got == {"It CAN'T connect": ["cpu_pct"], "Slow Query": ["latency_ms"], "fine \\": ["cpu_pct"]}


def test_lookback_joins_no_more_than_the_rows_it_may_return(spark, monkeypatch):
    limit = InvestigationConfig(metrics_limit=20)
    metrics = metrics_of(spark, [("h1", i, at(i / 10), float(i), 1.0, 1.0, 1.0) for i in range(6000)] + [("h2", 9000, at(5), 1.0, 1.0, 1.0, 1.0)])
    alerts = alerts_of(spark, *[alert(f"a{i}", when=50 * i + 0.05) for i in range(12)], alert("early", when=-1), alert("other", host="h2", when=800), alert("none", host="h9"))
    got = evidence.recent_metrics(alerts, metrics, 15, config=limit)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.alert_id, []).append((r.recency, r.cpu_pct))
    for i in range(12):
        newest = 500 * i
        assert sorted(rows[f"a{i}"]) == [(k + 1, float(newest - k)) for k in range(min(20, newest + 1))]
    assert rows["other"] == [(1, 1.0)] and not {"early", "none"} & set(rows)
    blocks = evidence.last_event_numbers(alerts, evidence.number_events(metrics)).filter("last > 0")
    probes = blocks.selectExpr("size(sequence(greatest(last - 20, 0) div 20, (last - 1) div 20)) AS probes").collect()
    assert max(p.probes for p in probes) <= 2


def test_positions_across_spans(spark, monkeypatch):
    monkeypatch.setattr(evidence, "ASOF_SECONDS", 7)
    times = [0, 1, 1, 8, 9, 30, 31, 100]
    metrics = metrics_of(spark, [("h1", i, at(t), 1.0, 1.0, 1.0, 1.0) for i, t in enumerate(times)])
    marks = [-5, 0, 1, 7.5, 8, 29, 30, 99, 100, 1000]
    alerts = alerts_of(spark, *[alert(str(m), when=m) for m in marks])
    got = {r.alert_id: r.last for r in evidence.last_event_numbers(alerts, evidence.number_events(metrics)).collect()}
    assert got == {str(m): sum(t <= m for t in times) for m in marks}

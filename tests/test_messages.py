from __future__ import annotations

import datetime as dt
import json

from fleetpulse.sources import messages

GOOD = {
    "event_id": "e1", "host_id": "h1", "service_name": "edge", "timestamp": "2024-01-01T00:00:03Z",
    "metrics": {"cpu_pct": 1, "mem_pct": 2.5, "latency_ms": 3.0, "error_rate_pct": 0},
    "injected_anomaly": {"active": True, "type": "spike"},
}


def changed(**fields) -> dict:
    return {k: v for k, v in (GOOD | fields).items() if v is not ...}


CASES = {
    "good": (GOOD, None),
    "numeric_text": (changed(metrics=GOOD["metrics"] | {"cpu_pct": "7.25"}), None),
    "no_label": (changed(injected_anomaly=...), None),
    "no_id": (changed(event_id=...), None),
    "epoch_time": (changed(timestamp=1704067203), None),
    "epoch_millis": (changed(timestamp=1704067203000), None),
    "epoch_text": (changed(timestamp="1704067203000"), None),
    "far_future": (changed(timestamp=10**17), "bad_timestamp"),
    "no_number": (changed(timestamp="NaN"), "bad_timestamp"),
    "extra_field": (changed(color="red"), None),
    "no_host": (changed(host_id=...), "missing_host_id"),
    "no_service": (changed(service_name=...), "missing_service_name"),
    "no_metric": (changed(metrics={"cpu_pct": 1}), "bad_metric"),
    "text_metric": (changed(metrics=GOOD["metrics"] | {"cpu_pct": "high"}), "bad_metric"),
    "bad_time": (changed(timestamp="yesterday"), "bad_timestamp"),
    "bad_label": (changed(injected_anomaly={"active": True, "type": "drift"}), "bad_injected_anomaly"),
    "broken": ("{bad", "malformed_json"),
    "empty": ("", "malformed_json"),
    "null": (None, "malformed_json"),
    "list": ("[1]", "malformed_json"),
}


def test_each_message_is_kept_or_quarantined_with_its_reason(spark):
    rows = [
        (name, body if body is None or isinstance(body, str) else json.dumps(body))
        for name, (body, _) in CASES.items()
    ]
    checked = messages.check_telemetry(spark.createDataFrame(rows, "key string, value string"))
    got = {r.key: r for r in checked.collect()}
    assert {k: r.reject_reason for k, r in got.items()} == {k: reason for k, (_, reason) in CASES.items()}
    assert got["numeric_text"].cpu_pct == 7.25
    assert got["no_label"].injected_anomaly.active is False
    assert got["good"].ts == got["epoch_time"].ts == got["epoch_millis"].ts == got["epoch_text"].ts
    assert len(got["no_id"].event_id) == 32

    decoded = messages.decode_telemetry(spark.createDataFrame(rows, "key string, value string")).collect()
    assert len(decoded) == sum(reason is None for _, reason in CASES.values())
    rejected = messages.quarantine(checked)
    assert rejected.columns == ["key", "value", "reject_reason"]
    assert rejected.count() == len(rows) - len(decoded)


def test_missing_time_takes_the_arrival_time(spark):
    arrival = dt.datetime(2024, 5, 1, 12)
    df = spark.createDataFrame([("k", json.dumps(changed(timestamp=...)), arrival)], "key string, value string, timestamp timestamp")
    assert messages.decode_telemetry(df).first().ts == arrival


def test_alert_round_trip_and_severity(spark):
    snap = {"cpu_pct": 1.0, "mem_pct": 2.0, "latency_ms": 3.0, "error_rate_pct": 4.0}
    alert = {
        "alert_id": "a1", "event_id": "7", "n": 130, "host_id": "h", "service_name": "s",
        "triggered_at": "2024-01-01T00:00:00.000Z", "raw_score": 0.7, "threshold": 0.6, "ewma_mean": 0.5,
        "ewma_std": 0.1, "severity": "critical", "metric_snapshot": snap, "recent_metrics": [snap, snap],
    }
    rows = [
        ("ok", json.dumps(alert)),
        ("sev", json.dumps(alert | {"severity": "fatal"})),
        ("score", json.dumps(alert | {"raw_score": "much"})),
        ("late", json.dumps(alert | {"triggered_at": 10**17})),
        ("snap", json.dumps(alert | {"recent_metrics": [snap, {"cpu_pct": 1}]})),
        ("bare", json.dumps({k: v for k, v in alert.items() if k not in ("recent_metrics", "n")})),
    ]
    checked = messages.check_alerts(spark.createDataFrame(rows, "key string, value string"))
    assert {r.key: r.reject_reason for r in checked.collect()} == {
        "ok": None, "sev": "bad_severity", "score": "bad_score", "snap": "bad_metric", "bare": None,
        "late": "bad_timestamp",
    }
    good = messages.valid(checked).orderBy("n").collect()
    assert good[0].n is None and good[0].recent_metrics == []
    assert good[1].is_early_warning is False and good[1].predicted_breach_minutes is None
    again = messages.decode_alerts(messages.encode(messages.valid(checked).filter("n = 130"))).first()
    assert again.asDict(recursive=True) == good[1].asDict(recursive=True)

"""Shape of the physical plans: what must hold whatever the size of the data."""

from __future__ import annotations

import re

import pytest

from fleetpulse.operators import alerts, dashboard, evidence, model
from fleetpulse.plans import catalog
from fleetpulse.plans.investigate import investigate
from fleetpulse.session import materialize
from fleetpulse.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def large_plans(spark):
    """Plans as for large tables: no table counts as small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def windows(text: str) -> list[str]:
    return [re.search(r"\], \[([^\]]*)\], \[", line).group(1) for line in text.splitlines() if " Window [" in line]


def test_detection_never_gives_one_task_a_whole_host(large_plans):
    text = plan(catalog.scored_metrics(large_plans, SF))
    parts = windows(text)
    # two per chunk, one per time cell, one per group of cells, and one over the groups of a host
    assert len(parts) == 5
    whole_host = [p for p in parts if not any(c in p for c in ("_chunk", "_cell", "_group"))]
    assert len(whole_host) == 1
    assert "SinglePartition" not in text
    assert "BroadcastExchange" not in text


def test_one_shuffle_per_direction_and_no_cross_join(large_plans):
    metrics, found = catalog._stored_alerts(large_plans, SF)
    tables = catalog._side_tables(large_plans, SF)
    detected = catalog.detection.detect(catalog._telemetry(large_plans, SF), catalog.STAND_IN)[0]
    for df in (investigate(found, metrics, *tables, catalog.SHORT), alerts.build_alerts(detected)):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoop" not in text
        assert "BroadcastExchange" not in text


def test_filters_and_columns_reach_the_scan(spark):
    metrics = materialize(catalog._judged(spark, SF), "plan")
    text = plan(alerts.alert_candidates(metrics).select("host_id"))
    assert "Or(EqualTo(is_anomaly,true),IsNotNull(predicted_breach_minutes))" in text
    panel = plan(dashboard.series(metrics, "cpu_pct", hosts=["host-1"]))
    assert "ReadSchema: struct<host_id:string,ts:timestamp,cpu_pct:double>" in panel
    assert "EqualTo(host_id,host-1)" in panel
    assert "partial_avg" in panel


def test_top_rows_are_taken_before_the_join(spark):
    runs, found = catalog._recorded(spark, SF)
    text = plan(dashboard.alert_table(found, runs))
    assert "TakeOrderedAndProject(limit=200" in text and "LeftSemi" in text


def test_table_by_host_is_read_without_an_exchange(large_plans, tmp_path):
    """Windows, aggregates and joins by host and hour start on the stored side without a shuffle."""
    metrics, found = catalog._stored_alerts(large_plans, SF)
    tables.write_by_host(tables.metrics_rows(metrics.drop("ds")), "by_host_plan", str(tmp_path / "t"), 5)
    stored = large_plans.table("by_host_plan")
    assert stored.count() == metrics.count()
    text = plan(evidence.hourly_gaps(stored))
    assert "Window" in text and "Exchange" not in text and "Bucketed: true" in text
    text = plan(evidence.recent_means(found, stored))
    join = re.search(r"SortMergeJoin \[host_id[^\n]*\n(.*?)(?=\n\s*\+- [^\n]*alert_id[^\n]*LeftOuter|\Z)", text, re.S).group(1)
    assert join.count("Exchange") == 1 and "Bucketed: true" in join  # the alerts, not the table
    large_plans.sql("DROP TABLE by_host_plan")


def test_stored_lookback_scores_the_telemetry_once(spark, monkeypatch):
    calls, score = [], catalog.detection.score_with_column
    monkeypatch.setattr(catalog.detection, "score_with_column", lambda *a, **k: calls.append(a) or score(*a, **k))
    assert catalog.stored_lookback(spark, SF).count() > 0
    assert len(calls) == 1


def test_stored_scores_keep_forests_in_small_row_groups(spark, monkeypatch, tmp_path):
    kept = {}

    def recorded(df, name, **options):
        kept[name] = (materialize(df, name, **options), options)
        return kept[name][0]

    monkeypatch.setattr(catalog, "materialize", recorded)
    events = spark.range(6 * 125).selectExpr(
        "id AS event_id", "timestamp_seconds(1704067200 + id) AS ts", "id % 77 AS user_id", "'view' AS event_type",
        "double(id * 37 % 101) AS value", """concat('{"k": ', id % 53, '}') AS props""",
    )
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.iforest_stored_scores(spark, str(tmp_path)).collect()
    assert sorted((r.model_version, r.events, r.scored, r.differences) for r in got) == [(0, 120, 0, 0)] * 6 + [(1, 5, 5, 0)] * 6
    models, options = kept["models"]
    assert models.count() == 6 and options["block_rows"] == model.block_rows()
    assert not [t for _, t in models.dtypes if t.startswith("array")]  # a list of all nodes is taken apart by element

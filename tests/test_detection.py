"""Detection operators against a sequential loop, with chunks far smaller than a host."""

from __future__ import annotations

import datetime as dt
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sequential import METRICS, features_of, judge, versions

from fleetpulse.config import DetectorConfig, LayoutConfig
from fleetpulse.operators import alerts, features, model, quality
from fleetpulse.operators.series import number_events
from fleetpulse.plans.detect import score_with_column, score_with_forest
from fleetpulse.session import materialize

START = dt.datetime(2024, 1, 1)
SCHEMA = (
    "event_id bigint, host_id string, service_name string, ts timestamp, cpu_pct double, mem_pct double, "
    "latency_ms double, error_rate_pct double, injected_anomaly_type string"
)
TINY = LayoutConfig(
    cell_micros=7_000_000, cells_per_group=3, chunk_rows=230, cooldown_span_rows=9
)


def host_events(host: str, total: int, seed: int, first_id: int = 0) -> list[dict]:
    """Events with uneven gaps; every 50th shares its timestamp with the one before."""
    rng = np.random.default_rng(seed)
    seconds = np.cumsum(rng.choice([1, 2, 3, 5, 20], total))
    rows = []
    for i in range(total):
        at = seconds[i - 1] if i and i % 50 == 0 else seconds[i]
        slope = 1 + (i % 90) / 30
        rows.append(
            dict(
                event_id=first_id + i, host_id=host, service_name="edge",
                ts=START + dt.timedelta(seconds=int(at)),
                cpu_pct=float(rng.integers(1, 100)), mem_pct=50.0,
                latency_ms=round(float(rng.gamma(2.0, 10.0) * slope), 2),
                error_rate_pct=float(rng.choice([0.5, 0.5, 0.5, 5.0])), injected_anomaly_type=None,
            )
        )
    return rows


@pytest.fixture(scope="module")
def fleet(spark):
    """One host holds most of the rows; the others sit at the edges of the warm-up."""
    sizes = {"hot": 1400, "h1": 1, "h2": 2, "h119": 119, "h120": 120, "h121": 121, "h130": 130, "h620": 620, "h621": 621}
    rows, by_host = [], {}
    for i, (host, total) in enumerate(sizes.items()):
        by_host[host] = host_events(host, total, seed=i, first_id=10_000 * i)
        rows += by_host[host]
    order = np.random.default_rng(9).permutation(len(rows))
    df = spark.createDataFrame([tuple(rows[i].values()) for i in order], SCHEMA)
    return by_host, df


def ordered(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: (r["ts"], r["event_id"]))


def test_numbering_follows_time_and_id(fleet):
    by_host, df = fleet
    got = {r.event_id: r.n for r in number_events(df, TINY).select("event_id", "n").collect()}
    for rows in by_host.values():
        assert [got[r["event_id"]] for r in ordered(rows)] == list(range(1, len(rows) + 1))


def test_numbering_around_the_epoch_ignores_an_input_column_n(spark):
    times = [dt.datetime(1970, 1, 1) + dt.timedelta(seconds=s) for s in range(-40, 40)]
    rows = [("h", 1000 - i, t, 7) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "host_id string, event_id bigint, ts timestamp, n bigint").repartition(5)
    got = {r.event_id: r.n for r in number_events(df, TINY).collect()}
    assert got == {1000 - i: i + 1 for i in range(80)}
    again = number_events(number_events(df, TINY), TINY)
    assert again.columns.count("n") == 1 and {r.event_id: r.n for r in again.collect()} == got


def test_features_match_loop_across_chunk_borders(fleet):
    by_host, df = fleet
    out = features.add_feature_vector(df, layout=LayoutConfig(cell_micros=7_000_000, chunk_rows=11))
    got = {r.event_id: r.features for r in out.select("event_id", "features").collect()}
    assert len(got) == sum(map(len, by_host.values()))
    for rows in by_host.values():
        rows = ordered(rows)
        for row, want in zip(rows, features_of(rows)):
            np.testing.assert_allclose(got[row["event_id"]], want, atol=1e-9)


def test_judgement_matches_loop(fleet):
    by_host, df = fleet
    out = score_with_column(df, "latency_ms", layout=TINY)
    got = {r.event_id: r for r in out.collect()}
    published = {
        r.event_id: "early" if r.is_early_warning else "reactive"
        for r in alerts.published(out, layout=TINY).select("event_id", "is_early_warning").collect()
    }
    seen_kinds = set()
    for rows in by_host.values():
        rows = ordered(rows)
        for row in rows[:120]:
            r = got[row["event_id"]]
            assert r.raw_score is None and r.threshold is None and r.ewma_mean is None
            assert r.is_anomaly is False and r.model_version is None and r.severity is None
        live = rows[120:]
        want = judge([r["latency_ms"] for r in live], [(r["ts"] - START).total_seconds() for r in live])
        for row, w in zip(live, want):
            r = got[row["event_id"]]
            assert (r.threshold is None) == (w["threshold"] is None)
            if w["threshold"] is not None:
                assert r.threshold == pytest.approx(w["threshold"], abs=1e-9)
            assert r.ewma_mean == pytest.approx(w["mean"], abs=1e-9)
            assert r.ewma_std == pytest.approx(w["std"], abs=1e-7)
            assert r.is_anomaly == w["is_anomaly"] and r.severity == w["severity"]
            assert r.predicted_breach_minutes == w["minutes"]
            assert published.get(row["event_id"]) == w["published"]
            seen_kinds.add(w["published"])
            if r.is_anomaly or w["minutes"] is not None:
                place = rows.index(row)
                recent = [tuple(e[m] for m in METRICS) for e in rows[max(0, place - 9):place + 1]]
                assert [tuple(s) for s in r.recent_metrics] == recent
            else:
                assert r.recent_metrics is None
    assert seen_kinds == {None, "early", "reactive"}


@pytest.mark.parametrize("total", [1, 119, 120, 121, 619, 620, 621, 1120, 2300])
def test_versions_and_training_sets_match_simulation(spark, total):
    used, sets = versions(total)
    df = spark.range(1, total + 1).selectExpr("'h' AS host_id", "id AS n")
    got = df.selectExpr("n", f"{model.version_of()} AS v").orderBy("n").collect()
    assert [r.v for r in got] == used
    stored = model.training_sets(df).orderBy("model_version").collect()
    assert [(r.first_event, r.last_event, r.n_train) for r in stored] == sets


def test_forest_scores(fleet):
    by_host, df = fleet
    small = DetectorConfig(n_trees=20)
    scored = score_with_forest(df, small, TINY)
    rows = scored.select("event_id", "host_id", "n", "raw_score", "model_version").collect()
    assert len(rows) == sum(map(len, by_host.values()))
    for r in rows:
        assert (r.raw_score is None) == (r.n <= 120)
        assert r.raw_score is None or 0 < r.raw_score <= 1
    # the same input in another order and partitioning gives the same scores
    again = score_with_forest(df.repartition(7).orderBy(F.desc("event_id")), small, LayoutConfig(chunk_rows=1000))
    other = {r.event_id: r.raw_score for r in again.select("event_id", "raw_score").collect()}
    for r in rows:
        if r.raw_score is not None:
            assert other[r.event_id] == pytest.approx(r.raw_score, abs=1e-12)


def test_models_exist_per_version(fleet):
    _, df = fleet
    small = DetectorConfig(n_trees=5)
    models = model.fit_models(features.add_features(df, small, TINY), small)
    got = {(r.host_id, r.model_version): r for r in models.collect()}
    assert set(got) == {
        ("hot", 1), ("hot", 2), ("hot", 3), ("h120", 1), ("h121", 1), ("h130", 1), ("h620", 1), ("h620", 2),
        ("h621", 1), ("h621", 2),
    }
    assert got[("hot", 1)].n_train == 120 and got[("hot", 3)].n_train == 1000
    assert got[("hot", 3)].subsample == 256 and len(got[("hot", 3)].feature) == 5 * 511


def test_clamp_keeps_missing_values(spark):
    rows = [(0.1, 120.0, None, 3.0), (5.0, 5.0, 5.0, 5.0), (None, None, None, None)]
    df = spark.createDataFrame(rows, ", ".join(f"{m} double" for m in METRICS))
    got = features.clamp_metrics(df).collect()
    assert [tuple(r) for r in got] == [
        (0.5, 100.0, None, 3.0, True), (5.0, 5.0, 5.0, 5.0, False), (None, None, None, None, False)
    ]


def test_constant_scores_give_no_alert(spark):
    rows = [e | {"latency_ms": 7.0, "cpu_pct": 3.0} for e in host_events("flat", 400, seed=3)]
    out = score_with_column(spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA), "latency_ms")
    got = out.filter("n >= 130").agg(
        F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalies"),
        F.count("predicted_breach_minutes").alias("forecasts"), F.max("ewma_std").alias("std"),
        F.min("threshold").alias("threshold"), F.max(F.abs(F.element_at("features", 7))).alias("z"),
    ).first()
    assert tuple(got) == (271, 0, 0, 0.0, 7.0, 0.0)


def test_stored_models_score_like_a_whole_pass(spark):
    config = DetectorConfig(n_trees=12, warmup_events=60, retrain_interval=100, train_window=150)
    rows = [tuple(r.values()) for host, total, seed in (("a", 330, 1), ("b", 61, 2), ("c", 20, 3)) for r in host_events(host, total, seed, 1000 * seed)]
    featured = features.add_features(spark.createDataFrame(rows, SCHEMA), config, TINY).cache()
    models = model.fit_models(featured, config, TINY).cache()
    want = {r.event_id: (r.model_version, r.raw_score) for r in model.score_events(featured, config, TINY).collect()}
    got = model.score_with_models(featured, models, config, TINY)
    assert {r.event_id: (r.model_version, r.raw_score) for r in got.collect()} == want
    new = featured.filter("n > 300")  # new events alone, and a table without one of the models they need
    assert {r.event_id: (r.model_version, r.raw_score) for r in model.score_with_models(new, models, config, TINY).collect()} == {
        r.event_id: want[r.event_id] for r in new.collect()
    }
    missing = model.score_with_models(featured, models.filter("NOT (host_id = 'a' AND model_version = 2)"), config, TINY).collect()
    for r in missing:
        gone = r.host_id == "a" and r.model_version == 2
        assert (r.model_version, r.raw_score) == (want[r.event_id][0], None if gone else want[r.event_id][1])
    assert got.columns[:-2] == featured.columns


def test_stored_models_lie_in_small_row_groups_and_are_sent_once(spark):
    config = DetectorConfig(n_trees=3, warmup_events=60, retrain_interval=50, train_window=100)
    layout = LayoutConfig(model_block_nodes=5 * 3 * 511)
    assert model.block_rows(config, layout) == 5 and model.block_rows(config, LayoutConfig(model_block_nodes=1)) == 1
    assert model.block_rows() * 100 * 511 <= 1 << 19  # a reader decodes a whole row group at once
    rows = [tuple(r.values()) for r in host_events("a", 700, 1, 0)]
    featured = features.add_features(spark.createDataFrame(rows, SCHEMA), config, TINY).cache()
    models = model.fit_models(featured, config, TINY).coalesce(1)
    stored = materialize(models, "models", block_rows=model.block_rows(config, layout))
    (file,) = stored.inputFiles()
    about = pq.ParquetFile(unquote(urlparse(file).path)).metadata
    assert [about.row_group(i).num_rows for i in range(about.num_row_groups)] == [5, 5, 3]
    packed = model.fit_models(featured, config, TINY, packed=True)
    want = {r.event_id: (r.model_version, r.raw_score) for r in model.score_events(featured, config, TINY).collect()}
    for table in (stored, materialize(packed, "models", block_rows=model.block_rows(config, layout))):
        scored = model.score_with_models(featured, table, config, TINY)
        assert {r.event_id: (r.model_version, r.raw_score) for r in scored.collect()} == want
    about = ["host_id", "model_version", "n_train", "subsample", "n_trees"]
    assert {tuple(r) for r in packed.select(about).collect()} == {tuple(r) for r in stored.select(about).collect()}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with keys too many to broadcast
    try:
        plan = model.score_with_models(featured, stored, config, TINY)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above, on_way = [], []  # the exchanges above the scan of the models
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [(d, x) for d, x in above if d < depth] + [(depth, line)]
        if "FileScan parquet" in line and "threshold" in line:
            on_way = [x for _, x in above if "Exchange" in x]
    assert len(on_way) == 1, plan


def test_blocks_of_versions_score_alike_and_copy_few_events(spark):
    config = DetectorConfig(n_trees=8, warmup_events=60, retrain_interval=50, train_window=120)
    rows = [tuple(r.values()) for host, total, seed in (("a", 1290, 1), ("b", 60, 2), ("c", 61, 3)) for r in host_events(host, total, seed, 10_000 * seed)]
    featured = features.add_features(spark.createDataFrame(rows, SCHEMA), config, TINY).cache()
    scores = []
    for size in (1, 100, 150, 10_000):  # one version a block, some, all
        layout = LayoutConfig(scoring_rows=size)
        scored = model.score_events(featured, config, layout)
        assert scored.columns == [*featured.columns, "model_version", "raw_score"]
        scores.append({r.event_id: (r.host_id, r.n, r.cpu_pct, r.model_version, r.raw_score) for r in scored.collect()})
    assert len(scores[0]) == len(rows) and all(s == scores[0] for s in scores[1:])
    default = model.scoring_blocks(featured.filter("host_id = 'a'"), config, LayoutConfig(scoring_rows=400))
    assert default.count() < 1290 * 1.4
    assert default.filter("_trains AND event_id IS NOT NULL").count() == 0


def test_detection_quality_counts_episodes(spark):
    labels = [None, None, "spike", "spike", None, "ramp", "ramp", "ramp", "spike", None, "ramp", "spike"]
    flags = [True, False, False, True, False, False, False, False, True, False, False, False]
    rows = [(h, i, START + dt.timedelta(seconds=10 * i), lab, f if h == "a" else None, 3.0 if h == "b" and i == 10 else None) for h in "ab" for i, (lab, f) in enumerate(zip(labels, flags))]
    judged = spark.createDataFrame(rows, "host_id string, event_id bigint, ts timestamp, injected_anomaly_type string, is_anomaly boolean, predicted_breach_minutes double")
    got = {r.label: r for r in quality.detection_quality(judged, LayoutConfig(chunk_rows=3)).collect()}
    spike, ramp, none, whole = (got[k] for k in ("spike", "ramp", "none", "all"))
    assert (spike.events, spike.flagged_events, spike.episodes, spike.detected_episodes, spike.mean_delay_seconds) == (8, 2, 6, 2, 5.0)
    assert (ramp.events, ramp.flagged_events, ramp.episodes, ramp.detected_episodes, ramp.mean_delay_seconds) == (8, 1, 4, 1, 0.0)
    assert (none.events, none.flagged_events, none.episodes, none.event_recall) == (8, 1, 0, None)
    assert (whole.events, whole.flagged_events, whole.precision, whole.event_recall, whole.episode_recall) == (24, 4, 0.75, 3 / 16, 0.3)
    assert quality.detection_quality(judged.limit(0)).filter("label <> 'all'").count() == 0


def test_recent_snapshots_leave_out_missing_readings_of_each_metric(spark):
    values = [(1.0, 2.0), (None, 3.0), (4.0, None), (float("nan"), 6.0)]
    rows = [(i, "h", "s", START + dt.timedelta(seconds=i), cpu, mem, 7.0, 8.0, None) for i, (cpu, mem) in enumerate(values)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.event_id: r.recent_metrics for r in features.recent_snapshots(df).collect()}
    assert [(s.cpu_pct, s.mem_pct, s.latency_ms) for s in got[2]] == [(1.0, 2.0, 7.0), (4.0, 3.0, 7.0), (None, None, 7.0)]
    assert [s.mem_pct for s in got[3]] == [2.0, 3.0, 6.0, None] and np.isnan(got[3][2].cpu_pct)


def test_recent_snapshots_keep_one_list_per_row():
    assert sum("collect_list" in w for w in features.recent_windows()) == 1

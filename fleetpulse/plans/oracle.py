"""DuckDB SQL that computes the same results as the registered queries.

The statements share common table expressions that mirror the stages of detection on the
stand-in score (raw_score = latency_ms after warm-up). They spell the rules out row by row
(ranges, recursion) and share no code with the Spark operators.
"""

from __future__ import annotations

METRICS = ("cpu_pct", "mem_pct", "latency_ms", "error_rate_pct")

EVENTS = """
base AS (
  SELECT event_id, event_type, value, user_id,
         cast(json_extract_string(props, '$.k') AS double) AS k,
         cast(event_id % 6 AS int) AS h, event_id // 6 AS tick
  FROM events),
phased AS (SELECT *, cast(tick % 400 AS int) AS ph FROM base),
shaped AS (
  SELECT *,
    CASE WHEN h % 2 = 0 AND ph = 130 THEN 3.0e0 WHEN h % 2 = 0 AND ph = 131 THEN 1.7e0
         ELSE 1.0e0 END AS spike,
    CASE WHEN h % 2 = 1 AND ph BETWEEN 140 AND 179 THEN 1.0e0 + 1.5e0 * (ph - 139) / 40.0e0
         ELSE 1.0e0 END AS ramp
  FROM phased),
tel AS (
  SELECT event_id, event_type, concat('host-', cast(h AS varchar)) AS host_id,
    CASE WHEN h < 2 THEN 'edge' WHEN h < 4 THEN 'core' WHEN h = 4 THEN 'store' ELSE 'cache' END
      AS service_name,
    timestamp '2024-01-01 00:00:00' + to_seconds(tick * 3) AS ts,
    least(greatest(k * ramp, 0.5e0), 100.0e0) AS cpu_pct,
    least(greatest((user_id % 100) * ramp, 1.0e0), 100.0e0) AS mem_pct,
    least(greatest(value * spike, 1.0e0), 5000.0e0) AS latency_ms,
    least(greatest((CASE event_type WHEN 'error' THEN 5.0e0 WHEN 'signup' THEN 1.0e0
      ELSE 0.5e0 END) * spike, 0.0e0), 100.0e0) AS error_rate_pct,
    CASE WHEN spike > 1 THEN 'spike' WHEN ramp > 1 THEN 'ramp' END AS injected_anomaly_type
  FROM shaped),
num AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY ts, event_id) AS n FROM tel)
"""

FEATURES = f"""
feat AS (
  SELECT *,
    {', '.join(f'''CASE WHEN count(*) OVER prev >= 2 AND stddev_pop({m}) OVER prev > 1e-6
        THEN ({m} - avg({m}) OVER prev) / stddev_pop({m}) OVER prev ELSE 0 END AS {m}_z,
      coalesce({m} - lag({m}) OVER (PARTITION BY host_id ORDER BY n), 0) AS {m}_delta'''
      for m in METRICS)}
  FROM num
  WINDOW prev AS (PARTITION BY host_id ORDER BY n ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
"""

JUDGED = """
hist AS (
  SELECT *, n - 120 AS k, cast(1 + (n - 120) // 500 AS int) AS model_version,
    latency_ms AS raw_score,
    count(*) OVER h AS history_count,
    quantile_cont(latency_ms, 0.95) OVER h AS p95,
    avg(latency_ms) OVER h AS ewma_mean,
    stddev_pop(latency_ms) OVER h AS ewma_std,
    avg(latency_ms) OVER (PARTITION BY host_id ORDER BY n ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
      AS ma3,
    epoch(ts - timestamp '2024-01-01 00:00:00') AS x
  FROM num WHERE n > 120
  WINDOW h AS (PARTITION BY host_id ORDER BY n ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
flagged AS (
  SELECT *, CASE WHEN history_count >= 10 THEN p95 END AS threshold,
    CASE WHEN k >= 3 THEN ma3 END AS score_ma
  FROM hist),
trend AS (
  SELECT *, coalesce(raw_score > threshold, false) AS is_anomaly,
    CASE WHEN k >= 5 THEN regr_slope(score_ma, x) OVER t END AS trend_slope,
    CASE WHEN k >= 5 THEN regr_r2(score_ma, x) OVER t END AS trend_r2
  FROM flagged
  WINDOW t AS (PARTITION BY host_id ORDER BY n ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
judged AS (
  SELECT *,
    CASE WHEN is_anomaly THEN CASE WHEN raw_score > threshold + ewma_std THEN 'critical'
      ELSE 'warning' END END AS severity,
    CASE WHEN threshold IS NOT NULL AND NOT is_anomaly AND trend_slope > 0 AND trend_r2 >= 0.7
        AND (threshold - score_ma) / trend_slope / 60 BETWEEN 0 AND 20
      THEN round((threshold - score_ma) / trend_slope / 60, 1) END AS predicted_breach_minutes
  FROM trend),
metrics AS (
  SELECT a.event_id, a.host_id, a.service_name, a.ts, a.cpu_pct, a.mem_pct, a.latency_ms,
    a.error_rate_pct, a.injected_anomaly_type, a.n, j.raw_score, j.ewma_mean, j.ewma_std,
    j.threshold, coalesce(j.is_anomaly, false) AS is_anomaly, j.severity, j.model_version,
    j.predicted_breach_minutes, j.history_count, j.score_ma, j.trend_slope, j.trend_r2
  FROM num a LEFT JOIN judged j ON a.host_id = j.host_id AND a.n = j.n)
"""

ALERTS = """
cand AS MATERIALIZED (
  SELECT *, NOT is_anomaly AS is_early_warning,
    row_number() OVER (PARTITION BY host_id, is_anomaly ORDER BY n) AS rn
  FROM judged WHERE is_anomaly OR predicted_breach_minutes IS NOT NULL),
walk AS (
  SELECT host_id, is_anomaly, rn, ts AS clock, true AS kept FROM cand WHERE rn = 1
  UNION ALL
  SELECT c.host_id, c.is_anomaly, c.rn,
    CASE WHEN c.ts - w.clock >= to_seconds(60) THEN c.ts ELSE w.clock END,
    c.ts - w.clock >= to_seconds(60)
  FROM walk w JOIN cand c
    ON c.host_id = w.host_id AND c.is_anomaly = w.is_anomaly AND c.rn = w.rn + 1),
alerts AS MATERIALIZED (
  SELECT md5(concat_ws('|', c.host_id, cast(c.event_id AS varchar),
      CASE WHEN c.is_early_warning THEN 'early' ELSE 'reactive' END)) AS alert_id,
    c.event_id, c.n, c.host_id, c.service_name, c.ts AS triggered_at, c.raw_score, c.threshold,
    c.ewma_mean, c.ewma_std,
    CASE WHEN c.is_early_warning THEN 'warning' ELSE c.severity END AS severity,
    c.cpu_pct, c.mem_pct, c.latency_ms, c.error_rate_pct, c.is_early_warning,
    c.predicted_breach_minutes
  FROM cand c JOIN walk w
    ON c.host_id = w.host_id AND c.is_anomaly = w.is_anomaly AND c.rn = w.rn
  WHERE w.kept)
"""

RECENT = """
near_rows AS (
  SELECT a.alert_id, m.ts, m.cpu_pct, m.mem_pct, m.latency_ms, m.error_rate_pct,
    row_number() OVER (PARTITION BY a.alert_id ORDER BY m.ts DESC, m.event_id DESC) AS recency
  FROM alerts a JOIN num m ON m.host_id = a.host_id
    AND m.ts BETWEEN a.triggered_at - to_minutes(15) AND a.triggered_at),
lookback AS (SELECT * FROM near_rows WHERE recency <= 200),
means AS (
  SELECT alert_id, count(*) AS sample_count, avg(cpu_pct) AS mean_cpu_pct,
    avg(mem_pct) AS mean_mem_pct, avg(latency_ms) AS mean_latency_ms,
    avg(error_rate_pct) AS mean_error_rate_pct,
    max(CASE WHEN recency = 1 THEN cpu_pct END) AS latest_cpu_pct,
    max(CASE WHEN recency = 1 THEN mem_pct END) AS latest_mem_pct,
    max(CASE WHEN recency = 1 THEN latency_ms END) AS latest_latency_ms,
    max(CASE WHEN recency = 1 THEN error_rate_pct END) AS latest_error_rate_pct
  FROM lookback GROUP BY alert_id),
ratios AS (
  SELECT alert_id, 1 AS place, 'cpu_pct' AS metric, latest_cpu_pct / mean_cpu_pct AS ratio
    FROM means WHERE mean_cpu_pct > 1e-6
  UNION ALL SELECT alert_id, 2, 'mem_pct', latest_mem_pct / mean_mem_pct
    FROM means WHERE mean_mem_pct > 1e-6
  UNION ALL SELECT alert_id, 3, 'latency_ms', latest_latency_ms / mean_latency_ms
    FROM means WHERE mean_latency_ms > 1e-6
  UNION ALL SELECT alert_id, 4, 'error_rate_pct', latest_error_rate_pct / mean_error_rate_pct
    FROM means WHERE mean_error_rate_pct > 1e-6),
dominant AS (
  SELECT m.*, coalesce((SELECT r.metric FROM ratios r WHERE r.alert_id = m.alert_id
    ORDER BY r.ratio DESC, r.place LIMIT 1), 'latency_ms') AS dominant_metric
  FROM means m)
"""

SIDE_TABLES = """
logs AS (
  SELECT host_id, service_name, ts, concat(host_id, ' ', CASE WHEN event_id % 11 <> 0 THEN 'request served'
    WHEN event_type = 'error' THEN 'upstream answered 502' WHEN event_type = 'purchase' THEN 'slow query on replica'
    WHEN event_type = 'click' THEN 'cpu throttled by limit' WHEN event_type = 'signup' THEN 'possible memory leak'
    ELSE 'nightly backup finished' END) AS line
  FROM tel),
deploys AS (
  SELECT concat('dep-', cast(event_id AS varchar)) AS deploy_id,
    left(md5(cast(event_id AS varchar)), 7) AS git_sha,
    ['dana', 'eli', 'fay', 'gus'][cast(event_id % 4 + 1 AS int)] AS author,
    ['router', 'session-store', 'index'][cast(event_id % 3 + 1 AS int)] AS component,
    service_name, ts AS deployed_at
  FROM tel WHERE event_type = 'signup' AND event_id % 97 = 3),
runbooks(service_name, body, step) AS (VALUES
  ('edge', '# Edge' || chr(10) || '1. Compare edge errors with the services behind it.' || chr(10)
    || '2. Look at cache hit rates.', '1. Compare edge errors with the services behind it.'),
  ('core', '# Core' || chr(10) || '  1. Look for exhausted connection pools.' || chr(10)
    || '2. List recent changes.', '1. Look for exhausted connection pools.'),
  ('store', '# Store' || chr(13) || chr(10) || 'Keep the primary running.' || chr(13) || chr(10) || chr(9)
    || '1. Find long transactions and lock waits.' || chr(13) || chr(10) || '2. Fail over.',
    '1. Find long transactions and lock waits.'),
  ('default', '# Any service' || chr(10) || '1. List recent changes and config edits.' || chr(10)
    || '2. Call the owning team.', '1. List recent changes and config edits.'))
"""

EVIDENCE = """
near_logs AS (
  SELECT a.alert_id, l.line FROM alerts a JOIN logs l ON l.host_id = a.host_id
    AND l.service_name = a.service_name
    AND l.ts BETWEEN a.triggered_at - to_minutes(1) AND a.triggered_at),
words(metric, word) AS (VALUES
  ('latency_ms', 'timeout'), ('latency_ms', 'pool exhausted'), ('latency_ms', 'slow query'),
  ('latency_ms', 'gc pause'), ('latency_ms', 'retry storm'),
  ('error_rate_pct', '502'), ('error_rate_pct', 'exception'), ('error_rate_pct', 'circuit breaker'),
  ('error_rate_pct', '5xx'), ('error_rate_pct', 'deserialization'),
  ('cpu_pct', 'throttled'), ('cpu_pct', 'runaway process'), ('cpu_pct', 'load average'),
  ('cpu_pct', 'reindex'), ('cpu_pct', 'thread pool'),
  ('mem_pct', 'memory usage'), ('mem_pct', 'oom'), ('mem_pct', 'memory leak'),
  ('mem_pct', 'eviction rate'), ('mem_pct', 'oomkilled')),
matched AS (
  SELECT l.alert_id, min(l.line) AS matched_log, count(*) AS matching_lines
  FROM near_logs l JOIN dominant d ON d.alert_id = l.alert_id
  WHERE EXISTS (SELECT 1 FROM words w WHERE w.metric = d.dominant_metric
    AND contains(lower(l.line), w.word))
  GROUP BY l.alert_id),
near_deploys AS (
  SELECT a.alert_id, d.*, round(epoch(a.triggered_at - d.deployed_at) / 60, 1) AS minutes_before_alert,
    count(*) OVER (PARTITION BY a.alert_id) AS deploy_count,
    row_number() OVER (PARTITION BY a.alert_id ORDER BY d.deployed_at DESC, d.deploy_id DESC) AS r
  FROM alerts a JOIN deploys d ON d.service_name = a.service_name
    AND d.deployed_at BETWEEN a.triggered_at - to_minutes(5) AND a.triggered_at),
latest_deploy AS (SELECT * FROM near_deploys WHERE r = 1),
gathered AS (
  SELECT a.*, d.dominant_metric, d.sample_count, m.matched_log, p.deploy_id, p.component, p.author,
    p.minutes_before_alert, coalesce(r.step, (SELECT step FROM runbooks WHERE service_name = 'default'))
      AS first_step,
    CASE WHEN p.deploy_count > 0 THEN 'deploy' WHEN m.matched_log IS NOT NULL THEN 'log'
      ELSE 'none' END AS branch,
    CASE d.dominant_metric WHEN 'cpu_pct' THEN 'the CPU running at its limit'
      WHEN 'mem_pct' THEN 'memory filling up'
      WHEN 'latency_ms' THEN 'requests waiting on a slow dependency'
      ELSE 'requests failing in a dependency' END AS cause,
    CASE d.dominant_metric
      WHEN 'cpu_pct' THEN 'Find the process that uses the CPU and limit it, or add capacity.'
      WHEN 'mem_pct' THEN 'Restart the process to free memory, then look for the leak.'
      WHEN 'latency_ms' THEN 'Clear the queue in front of the slow dependency.'
      ELSE 'Check the health of the dependency and stop calling it if it is down.' END AS remedy
  FROM alerts a JOIN dominant d ON d.alert_id = a.alert_id
    LEFT JOIN matched m ON m.alert_id = a.alert_id
    LEFT JOIN latest_deploy p ON p.alert_id = a.alert_id
    LEFT JOIN runbooks r ON r.service_name = a.service_name),
diagnosed AS MATERIALIZED (
  SELECT *,
    CASE branch
      WHEN 'deploy' THEN 'Deploy ' || deploy_id || ' of ' || component || ' by ' || author || ', '
        || cast(cast(round(minutes_before_alert) AS int) AS varchar)
        || ' min before the alert, probably led to ' || cause || '.'
      WHEN 'log' THEN upper(left(cause, 1)) || lower(substr(cause, 2))
        || ', as this log line shows: ' || matched_log
      ELSE 'Possibly ' || cause || '; no deploy or log line confirms it.' END AS root_cause,
    CASE branch WHEN 'deploy' THEN 'Undo deploy ' || deploy_id || ' of ' || component
        || ' and see whether ' || dominant_metric || ' recovers.'
      ELSE remedy || ' First runbook step: ' || first_step END AS proposed_fix,
    CASE branch WHEN 'deploy' THEN 0.90e0 WHEN 'log' THEN 0.78e0 ELSE 0.63e0 END AS confidence,
    CASE branch WHEN 'none' THEN 'medium' ELSE 'high' END AS severity_assessment
  FROM gathered)
"""

RUNS = """
runs AS (
  SELECT md5(concat_ws('|', alert_id, cast(attempt AS varchar))) AS run_id, alert_id, event_id,
    triggered_at + to_seconds(2) + to_minutes(cast(attempt AS int)) AS started_at,
    triggered_at + to_seconds(2) + to_minutes(cast(attempt AS int))
      + to_milliseconds(event_id % 1000 + 1) AS completed_at,
    CASE WHEN event_id % 13 = 0 AND attempt = 0 THEN 'evidence store not reachable' END AS error_message
  FROM (SELECT *, unnest(generate_series(0, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END)) AS attempt
    FROM alerts)),
run_records AS (
  SELECT r.run_id, r.alert_id, 'rules' AS provider, 'rules' AS model_name, r.started_at, r.completed_at,
    CASE WHEN error_message IS NULL THEN 5 END AS turn_count,
    CASE WHEN error_message IS NULL THEN 4 ELSE 0 END AS tool_calls,
    CASE WHEN error_message IS NULL THEN coalesce(d.root_cause,
      'The investigation ended without a diagnosis.') END AS root_cause,
    CASE WHEN error_message IS NULL THEN coalesce(d.proposed_fix, 'Look into this alert by hand.') END
      AS proposed_fix,
    CASE WHEN error_message IS NULL THEN coalesce(d.confidence, 0e0) END AS confidence,
    CASE WHEN error_message IS NULL THEN coalesce(d.severity_assessment, 'medium') END
      AS severity_assessment,
    CASE WHEN error_message IS NULL THEN 'completed' ELSE 'failed' END AS status, r.error_message,
    cast(r.event_id % 1000 + 1 AS int) AS latency_ms, r.completed_at AS created_at
  FROM runs r LEFT JOIN diagnosed d ON d.alert_id = r.alert_id AND r.event_id % 17 <> 0),
status_log AS (
  SELECT alert_id, 'investigating' AS status, started_at AS updated_at, 1 AS place FROM runs
  UNION ALL
  SELECT alert_id, CASE WHEN error_message IS NULL THEN 'diagnosed' ELSE 'error' END, completed_at,
    CASE WHEN error_message IS NULL THEN 2 ELSE 3 END FROM runs),
current_status AS (
  SELECT alert_id, status, updated_at FROM (
    SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY updated_at DESC, place DESC) AS r
    FROM status_log) WHERE r = 1)
"""

_STAGES = {
    "events": (),
    "features": ("events",),
    "judged": ("events",),
    "alerts": ("judged",),
    "side": ("events",),
    "recent": ("alerts",),
    "evidence": ("recent", "side"),
    "runs": ("evidence",),
}
_TEXT = {
    "events": EVENTS, "features": FEATURES, "judged": JUDGED, "alerts": ALERTS, "side": SIDE_TABLES,
    "recent": RECENT, "evidence": EVIDENCE, "runs": RUNS,
}


def _needed(stage: str, found: list[str]) -> list[str]:
    for parent in _STAGES[stage]:
        _needed(parent, found)
    if stage not in found:
        found.append(stage)
    return found


def _with(stage: str, select: str, *more: str) -> str:
    stages: list[str] = []
    for s in (stage, *more):
        _needed(s, stages)
    return "WITH RECURSIVE " + ",".join(_TEXT[s] for s in stages) + select


def r6(*columns: str) -> str:
    return ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in columns)


def _bucket(value: str, source: str, suffix: str = "") -> str:
    return f"""
      SELECT time_bucket(interval '15 seconds', ts) AS time, host_id || '{suffix}' AS metric,
        round(avg({value}) + 1e-9, 6) AS value
      FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL"""


_METRIC_VALUES = r6(*METRICS)
_SCORES = r6("raw_score", "ewma_mean", "ewma_std", "threshold", "predicted_breach_minutes")
_METRICS_ROW = f"""SELECT event_id, host_id, service_name, ts, {_METRIC_VALUES}, {_SCORES}, is_anomaly,
  severity, model_version, injected_anomaly_type FROM metrics"""
_ALERT_ROW = f"""SELECT alert_id, event_id, host_id, service_name, triggered_at,
  {r6('raw_score', 'threshold', 'ewma_mean', 'ewma_std', *METRICS, 'predicted_breach_minutes')},
  severity, is_early_warning FROM alerts"""
_BROKEN = """
decoded AS (
  SELECT CASE event_id % 50 WHEN 7 THEN 'malformed_json' WHEN 10 THEN 'missing_host_id' END AS reject_reason,
    CASE WHEN event_id % 50 = 9 THEN NULL ELSE injected_anomaly_type END AS label, *
  FROM tel)"""


def oracle_sql() -> dict[str, str]:
    detect_row = _with("judged", _METRICS_ROW)
    dash = {
        f"dash_{name}": _with("events", _bucket(column, "tel"))
        for name, column in zip(("cpu", "mem", "latency", "error_rate"), METRICS)
    }
    diagnosis_columns = """alert_id, branch, dominant_metric, deploy_id, matched_log, root_cause,
      proposed_fix, confidence, severity_assessment"""
    trained = """
      FROM num a JOIN ends e ON a.host_id = e.host_id
        JOIN versions v ON v.p <= e.total AND a.n <= v.p AND a.n > v.p - 1000"""
    chosen = """host_id IN ('host-1', 'host-4') AND ts BETWEEN timestamp '2024-01-01 00:05:00'
        AND timestamp '2024-01-01 00:40:00'"""
    return {
        "dash_selected_metrics": _with("events", f"""
          SELECT time_bucket(interval '15 seconds', ts) AS time, host_id, unnest(['cpu_pct', 'mem_pct', 'latency_ms',
            'error_rate_pct']) AS metric, unnest([{', '.join(f'round(avg({m}) + 1e-9, 6)' for m in METRICS)}]) AS value
          FROM tel WHERE {chosen} GROUP BY 1, 2"""),
        "dash_selected_scores": _with("judged", f"""
          SELECT * FROM (SELECT time_bucket(interval '15 seconds', ts) AS time,
            host_id || ' ' || unnest(['score', 'threshold']) AS metric,
            unnest([round(avg(raw_score) + 1e-9, 6), round(avg(threshold) + 1e-9, 6)]) AS value
          FROM metrics WHERE {chosen} GROUP BY time_bucket(interval '15 seconds', ts), host_id) WHERE value IS NOT NULL"""),
        # sources and tables
        "telemetry_decode": _with("events", f""",{_BROKEN}
          SELECT cast(event_id AS varchar) AS event_id, host_id, service_name, ts, {_METRIC_VALUES},
            label AS injected_anomaly_type
          FROM decoded WHERE reject_reason IS NULL"""),
        "telemetry_quarantine": _with("events", f""",{_BROKEN}
          SELECT host_id AS key, reject_reason, count(*) AS messages FROM decoded
          WHERE reject_reason IS NOT NULL GROUP BY ALL"""),
        "telemetry_stream": _with("events", f"""
          SELECT cast(event_id AS varchar) AS event_id, host_id, service_name, ts, {_METRIC_VALUES},
            injected_anomaly_type FROM tel"""),
        "alert_decode": _with("alerts", f"""
          SELECT alert_id, cast(event_id AS varchar) AS event_id, host_id, triggered_at,
            {r6('raw_score', 'threshold', 'latency_ms', 'predicted_breach_minutes')}, severity,
            least(n, 10) AS n_recent, is_early_warning
          FROM alerts WHERE event_id % 20 <> 3"""),
        "alert_encode": _with("alerts", f"""
          SELECT host_id AS key, alert_id, severity, triggered_at, {r6('raw_score')},
            is_early_warning FROM alerts"""),
        "metrics_table": detect_row,
        "alerts_table": _with("alerts", f"""
          SELECT alert_id, event_id, host_id, service_name, triggered_at, {r6('raw_score', 'threshold')},
            severity, {r6(*METRICS)}, 'new' AS status, is_early_warning, {r6('predicted_breach_minutes')}
          FROM alerts"""),
        "hosts_upsert": _with("events", """
          SELECT host_id, CASE WHEN service_name IN ('edge', 'store') THEN 'known-' || service_name
            ELSE service_name END AS service_name
          FROM (SELECT DISTINCT host_id, service_name FROM tel)"""),
        "orphan_rows": _with("events", """
          SELECT 'metrics.host_id' AS reference, host_id AS key, count(*) AS orphan_rows
            FROM tel WHERE service_name = 'cache' GROUP BY ALL
          UNION ALL SELECT 'alerts.host_id', host_id, count(*) FROM alerts
            WHERE service_name = 'cache' GROUP BY ALL
          UNION ALL SELECT 'alerts.event_id', host_id, count(*) FROM alerts
            WHERE event_id % 10 = 0 GROUP BY ALL
          UNION ALL SELECT 'runs.alert_id', a.host_id, count(*) FROM runs r
            JOIN alerts a ON a.alert_id = r.alert_id WHERE a.event_id % 5 = 0 GROUP BY ALL""", "runs"),
        "alert_status_latest": _with("runs", """
          SELECT a.alert_id, coalesce(s.status, 'new') AS status, s.updated_at
          FROM alerts a LEFT JOIN current_status s ON s.alert_id = a.alert_id"""),
        "diagnoses_table": _with("runs", f"""SELECT run_id, alert_id, provider, model_name, started_at,
          completed_at, turn_count, tool_calls, root_cause, proposed_fix, {r6('confidence')}, status,
          error_message, latency_ms, created_at FROM run_records"""),
        "param_sql": _with("events", f"""
          SELECT ts, {_METRIC_VALUES} FROM tel WHERE host_id = 'host-3'
            AND ts >= timestamp '2024-01-01 00:05:00' ORDER BY ts DESC LIMIT 200"""),
        # features
        "feature_raw": _with("events", f"SELECT event_id, {_METRIC_VALUES} FROM tel"),
        "feature_zscore": _with("features", f"SELECT event_id, {r6(*[f'{m}_z' for m in METRICS])} FROM feat"),
        "feature_delta": _with("features", f"SELECT event_id, {r6(*[f'{m}_delta' for m in METRICS])} FROM feat"),
        "feature_vector": _with("features", "SELECT event_id, place, round(v + 1e-9, 6) AS value FROM (" + " UNION ALL ".join(
            f"SELECT event_id, {i} AS place, {f} AS v FROM feat" for i, f in enumerate(
                [*METRICS, *[f"{m}_z" for m in METRICS], *[f"{m}_delta" for m in METRICS]])) + ")"),
        "recent_snapshots": _with("events", f"""
          SELECT a.event_id, 10 - (a.n - b.n) - (10 - least(a.n, 10)) AS place,
            {', '.join(f'round(b.{m} + 1e-9, 6) AS {m}' for m in METRICS)}
          FROM num a JOIN num b ON a.host_id = b.host_id AND b.n BETWEEN a.n - 9 AND a.n"""),
        "metric_clamp": """
          SELECT event_id, round(CASE WHEN value * 20 < 1 THEN 1 WHEN value * 20 > 5000 THEN 5000
              ELSE value * 20 END + 1e-9, 6) AS latency_ms,
            round(CASE WHEN user_id - 20 < 1 THEN 1 WHEN user_id - 20 > 100 THEN 100
              ELSE user_id - 20 END + 1e-9, 6) AS mem_pct,
            value * 20 < 1 OR value * 20 > 5000 OR user_id - 20 < 1 OR user_id - 20 > 100 AS was_clamped
          FROM events""",
        # model lifecycle
        "warmup_gate": _with("events", "SELECT event_id, n, n <= 120 AS is_warmup FROM num"),
        "model_version": _with("events", """
          SELECT event_id, n, (SELECT max(v) FROM generate_series(1, 1000) g(v)
            WHERE num.n > 120 AND 120 + 500 * (v - 1) <= num.n) AS model_version FROM num"""),
        "iforest_models": _with("events", f""",
          ends AS (SELECT host_id, max(n) AS total FROM num GROUP BY host_id),
          versions AS (SELECT v, 120 + 500 * (v - 1) AS p FROM generate_series(1, 1000) g(v)),
          sets AS (SELECT a.host_id, cast(v.v AS int) AS model_version, cast(count(*) AS int) AS n_train {trained} GROUP BY ALL)
          SELECT *, least(n_train, 256) AS subsample, 100 AS n_trees, least(n_train, 256) * 100 AS leaf_rows,
            100 AS full_roots, true AS depth_kept FROM sets"""),
        "iforest_scores": _with("events", """,
          v AS (SELECT *, CASE WHEN n > 120 THEN 1 + (n - 120) // 500 ELSE 0 END AS model_version FROM num)
          SELECT host_id, model_version, count(*) AS events, count(*) FILTER (n > 120) AS in_range,
            count(*) FILTER (n > 120 AND injected_anomaly_type = 'spike' AND (n - 1) % 400 = 130) AS far_rows,
            true AS far_rows_stand_out
          FROM v GROUP BY ALL"""),
        "training_set_sizes": _with("events", f""",
          ends AS (SELECT host_id, max(n) AS total FROM num GROUP BY host_id),
          versions AS (SELECT v, 120 + 500 * (v - 1) AS p FROM generate_series(1, 1000) g(v))
          SELECT a.host_id, v.v AS model_version, count(*) AS n_train, min(a.n) AS first_event,
            max(a.n) AS last_event {trained} GROUP BY ALL"""),
        "label_passthrough": _with("events", "SELECT event_id, injected_anomaly_type FROM tel"),
        # threshold
        "dynamic_threshold": _with("judged", f"SELECT event_id, {r6('raw_score', 'threshold')} FROM judged"),
        "threshold_warmup": _with("judged", """
          SELECT event_id, history_count, threshold IS NOT NULL AS has_threshold FROM judged"""),
        "score_stats": _with("judged", f"SELECT event_id, {r6('ewma_mean', 'ewma_std')} FROM judged"),
        "anomaly_flag": _with("judged", "SELECT event_id, is_anomaly FROM metrics"),
        "severity": _with("judged", "SELECT event_id, severity FROM judged WHERE is_anomaly"),
        "alert_cooldown": _with("alerts", "SELECT event_id, host_id, triggered_at FROM alerts WHERE NOT is_early_warning"),
        "scored_metrics": detect_row,
        # forecast
        "trend_smooth": _with("judged", f"SELECT event_id, {r6('score_ma')} FROM judged WHERE score_ma IS NOT NULL"),
        "trend_slope": _with("judged", f"SELECT event_id, {r6('trend_slope')} FROM judged WHERE trend_slope IS NOT NULL"),
        "trend_r2": _with("judged", f"SELECT event_id, {r6('trend_r2')} FROM judged WHERE trend_r2 IS NOT NULL"),
        "breach_forecast": _with("judged", """
          SELECT event_id, predicted_breach_minutes FROM judged WHERE predicted_breach_minutes IS NOT NULL"""),
        "early_warning_cooldown": _with("alerts", "SELECT event_id, host_id, triggered_at FROM alerts WHERE is_early_warning"),
        # alerts
        "reactive_alerts": _with("alerts", _ALERT_ROW + " WHERE NOT is_early_warning"),
        "early_warnings": _with("alerts", _ALERT_ROW + " WHERE is_early_warning"),
        "alert_log": _with("alerts", _ALERT_ROW),
        # investigation
        "alert_lifecycle": _with("runs", "SELECT alert_id, status, updated_at FROM status_log"),
        "dominant_metric_z": _with("alerts", """,
          snaps AS (
            SELECT a.alert_id, 1 AS place, 'cpu_pct' AS metric, a.cpu_pct AS cur, m.cpu_pct AS v
              FROM alerts a JOIN num m ON a.host_id = m.host_id AND m.n BETWEEN a.n - 9 AND a.n
            UNION ALL SELECT a.alert_id, 2, 'mem_pct', a.mem_pct, m.mem_pct
              FROM alerts a JOIN num m ON a.host_id = m.host_id AND m.n BETWEEN a.n - 9 AND a.n
            UNION ALL SELECT a.alert_id, 3, 'latency_ms', a.latency_ms, m.latency_ms
              FROM alerts a JOIN num m ON a.host_id = m.host_id AND m.n BETWEEN a.n - 9 AND a.n
            UNION ALL SELECT a.alert_id, 4, 'error_rate_pct', a.error_rate_pct, m.error_rate_pct
              FROM alerts a JOIN num m ON a.host_id = m.host_id AND m.n BETWEEN a.n - 9 AND a.n),
          zs AS (
            SELECT alert_id, place, metric, CASE WHEN stddev_pop(v) > 1e-6
              THEN abs(any_value(cur) - avg(v)) / stddev_pop(v) ELSE 0 END AS z
            FROM snaps GROUP BY ALL)
          SELECT alert_id, metric AS dominant_metric FROM (
            SELECT *, row_number() OVER (PARTITION BY alert_id ORDER BY round(z, 9) DESC, place) AS r FROM zs)
          WHERE r = 1"""),
        "recent_metrics_lookback": _with("recent", f"""
          SELECT alert_id, recency, ts, {_METRIC_VALUES},
            count(*) OVER (PARTITION BY alert_id) AS sample_count FROM lookback"""),
        "dominant_metric_ratio": _with("recent", f"""
          SELECT alert_id, sample_count, {r6(*[f'mean_{m}' for m in METRICS],
            *[f'latest_{m}' for m in METRICS])}, dominant_metric FROM dominant"""),
        "log_evidence": _with("evidence", """
          SELECT alert_id, line, count(*) AS copies,
            row_number() OVER (PARTITION BY alert_id ORDER BY line) AS line_rank
          FROM near_logs GROUP BY alert_id, line"""),
        "log_match": _with("evidence", "SELECT alert_id, matched_log, matching_lines FROM matched"),
        "runbook_lookup": _with("alerts", """
          SELECT a.alert_id, coalesce(r.service_name, 'default') AS runbook_key,
            coalesce(r.body, (SELECT body FROM runbooks WHERE service_name = 'default')) AS runbook
          FROM alerts a LEFT JOIN runbooks r ON r.service_name = a.service_name""", "side"),
        "runbook_first_step": _with("evidence", "SELECT alert_id, first_step FROM gathered"),
        "deploy_correlation": _with("evidence", """
          SELECT alert_id, deploy_count, deploy_id, git_sha, author, component, deployed_at,
            minutes_before_alert FROM latest_deploy"""),
        "diagnosis": _with("evidence", f"SELECT {diagnosis_columns} FROM diagnosed"),
        "diagnosis_confidence": _with("evidence", """
          SELECT branch, severity, confidence, severity_assessment, count(*) AS alerts
          FROM diagnosed GROUP BY ALL"""),
        "diagnosis_run": _with("runs", """
          SELECT run_id, status, turn_count, latency_ms, error_message, root_cause, confidence
          FROM run_records"""),
        "alert_brief": _with("alerts", """
          SELECT alert_id, 'Alert ' || alert_id || ' on host ' || host_id || ' of service ' || service_name
            || chr(10) || 'Severity ' || severity || ' at ' || strftime(triggered_at, '%Y-%m-%d %H:%M:%S')
            || chr(10) || 'Score ' || printf('%.3f', raw_score) AS brief_start, true AS threshold_shown
          FROM alerts"""),
        # dashboard
        "dash_hosts": _with("events", "SELECT DISTINCT host_id FROM tel ORDER BY 1"),
        **dash,
        "dash_all_metrics": _with("events", " UNION ALL ".join(
            f"""SELECT time_bucket(interval '15 seconds', ts) AS time, host_id, '{m}' AS metric,
              round(avg({m}) + 1e-9, 6) AS value FROM tel GROUP BY ALL""" for m in METRICS)),
        "dash_score": _with("judged", _bucket("raw_score", "metrics", " score")),
        "dash_threshold": _with("judged", _bucket("threshold", "metrics", " threshold")),
        "dash_score_vs_threshold": _with("judged", _bucket("raw_score", "metrics", " score") + " UNION ALL "
            + _bucket("threshold", "metrics", " threshold")),
        "dash_active_alerts": _with("alerts", """
          SELECT count(*) AS value FROM alerts
          WHERE triggered_at > (SELECT max(triggered_at) FROM alerts) - interval 1 hour"""),
        "dash_confidence": _with("runs", """
          SELECT round(avg(confidence) + 1e-9, 6) AS value FROM run_records
          WHERE created_at > (SELECT max(created_at) FROM run_records) - interval 1 hour"""),
        "dash_alert_table": _with("runs", """
          SELECT a.triggered_at AS time, a.host_id, a.service_name, a.severity,
            coalesce(s.status, 'new') AS status,
            cast(round(cast(printf('%.14e', a.raw_score) AS decimal(38, 18)), 3) AS double) AS score,
            cast(round(cast(printf('%.14e', a.threshold) AS decimal(38, 18)), 3) AS double) AS threshold,
            r.root_cause, r.proposed_fix,
            cast(round(cast(printf('%.14e', r.confidence) AS decimal(38, 18)), 2) AS double) AS confidence
          FROM alerts a LEFT JOIN current_status s ON s.alert_id = a.alert_id
          LEFT JOIN LATERAL (SELECT * FROM run_records x WHERE x.alert_id = a.alert_id
            ORDER BY x.created_at DESC, x.run_id DESC LIMIT 1) r ON true
          ORDER BY a.triggered_at DESC, a.alert_id LIMIT 200"""),
        "check_metrics_count": _with("events", "SELECT count(*) AS metrics_rows FROM tel"),
        "check_latest_alerts": _with("runs", """
          SELECT a.alert_id, a.host_id, a.severity, coalesce(s.status, 'new') AS status, a.triggered_at
          FROM alerts a LEFT JOIN current_status s ON s.alert_id = a.alert_id
          ORDER BY a.triggered_at DESC, a.alert_id LIMIT 5"""),
        "check_latest_diagnoses": _with("runs", """
          SELECT alert_id, provider, confidence, left(root_cause, 80) AS root_cause FROM run_records
          ORDER BY created_at DESC, run_id LIMIT 5"""),
        # streams
        "stream_detect": _with("judged", f"""
          SELECT cast(event_id AS varchar) AS event_id, host_id, n, {_SCORES}, is_anomaly, severity,
            model_version FROM metrics"""),
        "stream_alerts": _with("alerts", f"""
          SELECT alert_id, cast(event_id AS varchar) AS event_id, triggered_at, severity, is_early_warning,
            {r6('raw_score', 'threshold', 'predicted_breach_minutes')}, least(n, 10) AS n_recent FROM alerts"""),
        "stream_batch_parity": _with("events", """
          SELECT host_id, count(*) AS events, count(*) FILTER (n > 120) AS scored, 0 AS differences
          FROM num GROUP BY host_id"""),
        "stream_dedup": _with("events", "SELECT host_id, count(*) AS events FROM tel GROUP BY host_id"),
        "stream_dash_15s": _with("events", f"""
          SELECT time_bucket(interval '15 seconds', ts) AS time, host_id,
            {', '.join(f'round(avg({m}) + 1e-9, 6) AS {m}' for m in METRICS)} FROM tel GROUP BY ALL"""),
        "stream_dedup_bounded": _with("events", """
          SELECT host_id, count(*) AS events, count(DISTINCT event_id) AS distinct_events FROM tel GROUP BY host_id"""),
        "stream_window_15s": _with("events", f"""
          SELECT time_bucket(interval '15 seconds', ts) AS time, host_id,
            {', '.join(f'round(avg({m}) + 1e-9, 6) AS {m}' for m in METRICS)} FROM tel GROUP BY ALL"""),
        "stream_sink": _with("alerts", f"""
          SELECT alert_id, host_id, triggered_at, severity, is_early_warning, {r6('raw_score', 'threshold', 'ewma_mean', 'ewma_std',
            'predicted_breach_minutes', *METRICS)}, least(n, 10) AS n_recent FROM alerts"""),
        "stream_chain": _with("evidence", f"SELECT {diagnosis_columns} FROM diagnosed"),
        "iforest_stored_scores": _with("events", """,
          v AS (SELECT *, CASE WHEN n > 120 THEN 1 + (n - 120) // 500 ELSE 0 END AS model_version FROM num)
          SELECT host_id, model_version, count(*) AS events, count(*) FILTER (n > 120) AS scored, 0 AS differences
          FROM v GROUP BY ALL"""),
        "detection_quality": _with("judged", """,
          f AS (SELECT *, coalesce(is_anomaly, false) OR predicted_breach_minutes IS NOT NULL AS flagged,
              row_number() OVER (PARTITION BY host_id ORDER BY n) - row_number() OVER (PARTITION BY host_id, injected_anomaly_type ORDER BY n) AS island
            FROM metrics),
          e AS (SELECT host_id, injected_anomaly_type AS label, island, min(ts) AS started_at, min(ts) FILTER (flagged) AS found_at
            FROM f WHERE injected_anomaly_type IS NOT NULL GROUP BY ALL),
          ev AS (SELECT coalesce(injected_anomaly_type, 'none') AS label, count(*) AS events, count(*) FILTER (flagged) AS flagged_events FROM f GROUP BY ALL),
          ep AS (SELECT label, count(*) AS episodes, count(found_at) AS detected_episodes, sum(epoch_us(found_at) - epoch_us(started_at)) / 1e6 AS delay
            FROM e GROUP BY label),
          one AS (SELECT ev.*, coalesce(episodes, 0) AS episodes, coalesce(detected_episodes, 0) AS detected_episodes, delay,
              CASE WHEN ev.label <> 'none' THEN events END AS labelled, CASE WHEN ev.label <> 'none' THEN flagged_events END AS hits
            FROM ev LEFT JOIN ep ON ev.label = ep.label),
          al AS (SELECT * FROM one UNION ALL
            SELECT 'all', sum(events), sum(flagged_events), sum(episodes), sum(detected_episodes), sum(delay), sum(labelled), sum(hits) FROM one)
          SELECT label, cast(events AS bigint) AS events, cast(flagged_events AS bigint) AS flagged_events,
            round(hits / nullif(labelled, 0)::double + 1e-9, 6) AS event_recall,
            round(CASE WHEN label = 'all' THEN hits / nullif(flagged_events, 0)::double END + 1e-9, 6) AS precision,
            cast(episodes AS bigint) AS episodes, cast(detected_episodes AS bigint) AS detected_episodes,
            round(CASE WHEN label <> 'none' THEN detected_episodes / nullif(episodes, 0)::double END + 1e-9, 6) AS episode_recall,
            round(delay / nullif(detected_episodes, 0)::double + 1e-9, 6) AS mean_delay_seconds
          FROM al"""),
        "compacted_metrics": _with("judged", """,
          h AS (SELECT *, cast(floor(epoch_us(ts) / 3600000000) AS bigint) AS hour FROM metrics),
          g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY host_id, hour ORDER BY ts) AS gap FROM h)
          SELECT host_id, hour, count(*) AS events, count(*) FILTER (is_anomaly) AS anomalies, round(max(gap) / 1e6 + 1e-9, 6) AS largest_gap
          FROM g GROUP BY host_id, hour"""),
        "stored_lookback": _with("alerts", f"""
          SELECT a.alert_id, a.host_id, count(m.ts) AS sample_count,
            {', '.join(f'round(avg(m.{x}) + 1e-9, 6) AS mean_{x}' for x in METRICS)}
          FROM alerts a LEFT JOIN metrics m ON m.host_id = a.host_id AND m.ts BETWEEN a.triggered_at - INTERVAL 15 MINUTE AND a.triggered_at
          GROUP BY a.alert_id, a.host_id"""),
        "stream_investigate": _with("evidence", f"SELECT {diagnosis_columns} FROM diagnosed"),
    }

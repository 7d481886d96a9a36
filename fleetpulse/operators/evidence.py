"""Evidence around an alert: recent metrics, logs, deploys and runbooks.

Lookups of logs and deploys are equi-joins on a key and a bucket of time, with the exact bounds as a
residual predicate; recent metrics are found by their numbers. The cooldown allows a host at most two
alerts per minute, so a log row meets a bounded number of alerts however busy its host is. Stored tables are first cut to the
time that the alerts can see, by day folder where they have any.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.config import EPSILON, INVESTIGATION, METRICS, InvestigationConfig
from fleetpulse.operators.series import number_events

# Words that tie a log line to a metric.
LOG_KEYWORDS = {
    "latency_ms": ["timeout", "pool exhausted", "slow query", "gc pause", "retry storm"],
    "error_rate_pct": ["502", "exception", "circuit breaker", "5xx", "deserialization"],
    "cpu_pct": ["throttled", "runaway process", "load average", "reindex", "thread pool"],
    "mem_pct": ["memory usage", "oom", "memory leak", "eviction rate", "oomkilled"],
}
# Fixed value: the metric to assume when there is nothing to compare.
FALLBACK_METRIC = "latency_ms"
# Span of time of one host in which alerts are merged with its rows in one task.
ASOF_SECONDS = 600


def clamped_minutes(minutes: int | str, cap: int) -> Column:
    """A lookback in whole minutes between 1 and cap; a column name gives one per alert."""
    value = F.col(minutes) if isinstance(minutes, str) else F.lit(minutes)
    return F.least(F.greatest(value.cast("int"), F.lit(1)), F.lit(cap))


def time_span(alerts: DataFrame) -> tuple[int, int] | None:
    """Microseconds of the first and the last alert; None without alerts. One small aggregate."""
    span = alerts.agg(F.min(F.unix_micros("triggered_at")).alias("lo"), F.max(F.unix_micros("triggered_at")).alias("hi")).first()
    return None if span is None or span["lo"] is None else (span["lo"], span["hi"])


def within_reach(table: DataFrame, time_col: str, alerts: DataFrame, minutes: int) -> DataFrame:
    """Rows of a table not older than `minutes` before the first alert and not newer than the last.

    The bounds are literals, so they reach the scan; a table with the day column ds opens only
    the days in between.
    """
    span = time_span(alerts)
    if span is None:
        return table.filter("false")
    lo, hi = (F.timestamp_micros(F.lit(t)) for t in (span[0] - minutes * 60_000_000, span[1]))
    near = table.filter(F.col(time_col).between(lo, hi))
    return near.filter(F.col("ds").between(F.to_date(lo), F.to_date(hi))) if "ds" in table.columns else near


def first_largest(values: dict[str, Column], floor: float | None = None) -> Column:
    """Name of the largest value; the first one wins ties and nulls never win."""
    best_name, best = F.lit(FALLBACK_METRIC), F.lit(-1.0 if floor is None else floor)
    for name, value in values.items():
        wins = F.coalesce(value > best, F.lit(False))
        best_name = F.when(wins, name).otherwise(best_name)
        best = F.when(wins, value).otherwise(best)
    return best_name


def dominant_by_zscore(alerts: DataFrame) -> DataFrame:
    """Add dominant_metric: the one furthest from its recent history in standard deviations."""

    def deviation(m: str) -> str:
        count = "nullif(size(recent_metrics), 0)"
        values = f"transform(recent_metrics, s -> s.{m})"
        mean = f"(aggregate({values}, 0D, (a, v) -> a + v) / {count})"
        return f"""named_struct('mean', {mean}, 'std', sqrt(
            aggregate({values}, 0D, (a, v) -> a + (v - {mean}) * (v - {mean}))
            / {count}))"""

    measured = alerts.selectExpr("*", *[f"{deviation(m)} AS _{m}" for m in METRICS]).selectExpr(
        "*",
        *[
            f"""CASE WHEN _{m}.std > {EPSILON}D
                THEN abs((metric_snapshot.{m} - _{m}.mean) / nullif(_{m}.std, 0D)) ELSE 0D END AS _z_{m}"""
            for m in METRICS
        ],
    )
    best = "greatest(" + ", ".join(f"_z_{m}" for m in METRICS) + ")"
    chain = " ".join(f"WHEN _z_{m} = {best} THEN '{m}'" for m in METRICS)
    return measured.selectExpr(
        f"* EXCEPT ({', '.join([f'_{m}' for m in METRICS] + [f'_z_{m}' for m in METRICS])})",
        f"""CASE WHEN coalesce(size(recent_metrics), 0) <= 0 THEN '{FALLBACK_METRIC}'
            {chain} ELSE '{FALLBACK_METRIC}' END AS dominant_metric""",
    )


def last_event_numbers(alerts: DataFrame, numbered: DataFrame) -> DataFrame:
    """alert_id, host_id, triggered_at, last: the number of the host's last row up to the alert's time (0: none).

    An as-of merge: alerts stand among the rows in order of time, and the number runs along. It is cut into spans of
    ASOF_SECONDS; what a span has before its first row comes from a table with a row a span.
    """
    span = F.floor(F.unix_micros("ts") / (ASOF_SECONDS * 1e6)).alias("_span")
    rows = numbered.select("host_id", "ts", "n", span)
    marks = alerts.select("host_id", F.col("triggered_at").alias("ts"), "alert_id").select("*", span)
    both = rows.unionByName(marks, allowMissingColumns=True)
    order = Window.partitionBy("host_id", "_span").orderBy("ts", F.col("alert_id").isNotNull())
    seen = both.withColumn("_inside", F.max("n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = both.groupBy("host_id", "_span").agg(F.max("n").alias("_top"))
    earlier = Window.partitionBy("host_id").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("host_id", "_span", F.max("_top").over(earlier).alias("_before"))
    found = seen.filter("alert_id IS NOT NULL").join(spans, ["host_id", "_span"])
    return found.select(
        "alert_id", "host_id", F.col("ts").alias("triggered_at"), F.coalesce("_inside", "_before", F.lit(0).cast("long")).alias("last")
    )


def recent_metrics(
    alerts: DataFrame,
    metrics: DataFrame,
    minutes: int | str | None = None,
    columns: tuple[str, ...] = METRICS,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """The host's rows within the lookback up to the alert's time, newest `metrics_limit` at most.

    Alerts need alert_id (unique), host_id and triggered_at only, and metrics are the stored table. Rows
    of one time are taken in order of event_id. Adds recency (1 = newest). Rows are numbered per host, each alert
    gets the number of the last row it can see, and meets the blocks of `metrics_limit` numbers that its rows
    fall into, two at most: a lookback costs the rows it may return, however busy the host is.
    """
    limit = config.metrics_limit
    lookback = clamped_minutes(config.metrics_minutes if minutes is None else minutes, config.metrics_minutes_cap)
    near = within_reach(metrics, "ts", alerts, config.metrics_minutes_cap).select("host_id", "event_id", "ts", *columns)
    numbered = number_events(near)
    seen = last_event_numbers(alerts.select("alert_id", "host_id", "triggered_at"), numbered).filter("last > 0")
    if isinstance(minutes, str):
        seen = seen.join(alerts.select("alert_id", F.col(minutes)), "alert_id")
    left = seen.select("*", lookback.alias("_minutes")).selectExpr(
        "*", f"explode(sequence(greatest(last - {limit}, 0) div {limit}, (last - 1) div {limit})) AS _block"
    )
    joined = left.join(numbered.drop("event_id").selectExpr("*", f"(n - 1) div {limit} AS _block"), ["host_id", "_block"])
    inside = joined.filter(
        f"n <= last AND n > last - {limit} AND unix_micros(ts) >= unix_micros(triggered_at) - _minutes * 60000000L"
    )
    return inside.selectExpr("alert_id", "host_id", "_minutes AS minutes", "ts", *columns, "last - n + 1 AS recency")


def recent_means(
    alerts: DataFrame, stored: DataFrame, minutes: int | None = None, config: InvestigationConfig = INVESTIGATION
) -> DataFrame:
    """alert_id, host_id, sample_count and mean of each metric over the whole lookback, from a table by host.

    `stored` is in the layout of `write_by_host`: only the alerts are exchanged, once for each hour that
    their lookback touches, and the table's rows are joined where they are read. They are added up per alert
    before the second exchange. Alerts without a row in the lookback count 0.
    """
    width = min(max(config.metrics_minutes if minutes is None else minutes, 1), config.metrics_minutes_cap) * 60_000_000
    asked = alerts.select("alert_id", "host_id", F.unix_micros("triggered_at").alias("_upto")).selectExpr(
        "*", f"explode(sequence(floor((_upto - {width}) / 3600000000D), floor(_upto / 3600000000D))) AS hour"
    )
    near = within_reach(stored, "ts", alerts, config.metrics_minutes_cap).select("host_id", "hour", "ts", *METRICS)
    met = asked.join(near, ["host_id", "hour"]).filter(f"unix_micros(ts) BETWEEN _upto - {width} AND _upto")
    means = met.groupBy("alert_id").agg(F.count("*").alias("sample_count"), *[F.avg(m).alias(f"mean_{m}") for m in METRICS])
    return alerts.select("alert_id", "host_id").join(means, "alert_id", "left").fillna(0, ["sample_count"])


def hourly_gaps(stored: DataFrame) -> DataFrame:
    """host_id, hour, events, anomalies, largest_gap (seconds between neighbouring events inside the hour).

    On a table by host the window and the aggregate run where the rows are read.
    """
    seen = stored.selectExpr(
        "host_id", "hour", "is_anomaly",
        "unix_micros(ts) - lag(unix_micros(ts)) OVER (PARTITION BY host_id, hour ORDER BY ts) AS _gap",
    )
    return seen.groupBy("host_id", "hour").agg(
        F.count("*").alias("events"), F.count_if("is_anomaly").alias("anomalies"), (F.max("_gap") / 1e6).alias("largest_gap")
    )


def recent_metrics_summary(
    alerts: DataFrame,
    metrics: DataFrame,
    minutes: int | str | None = None,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """Per alert: sample_count, mean and newest value of each metric, and dominant_metric.

    Dominant is the metric with the largest newest-to-mean ratio; means near 0 are skipped.
    """
    rows = recent_metrics(alerts, metrics, minutes, config=config)
    summary = rows.groupBy("alert_id").agg(
        F.count("*").alias("sample_count"),
        *[F.avg(m).alias(f"mean_{m}") for m in METRICS],
        # one min_by per number keeps this a hash aggregate; a struct would force a sort
        *[F.min_by(m, "recency").alias(f"latest_{m}") for m in METRICS],
    )
    ratios = {
        m: F.when(F.col(f"mean_{m}") > EPSILON, F.try_divide(f"latest_{m}", f"mean_{m}"))
        for m in METRICS
    }
    return summary.select(
        "alert_id",
        "sample_count",
        *[f"mean_{m}" for m in METRICS],
        *[f"latest_{m}" for m in METRICS],
        first_largest(ratios).alias("dominant_metric"),
    )


def matched_metrics(keywords: dict[str, list[str]] = LOG_KEYWORDS) -> Column:
    """Array of the metrics for which `line` holds a keyword, whatever the case of either."""
    line = F.lower("line")
    hits = []
    for metric, words in keywords.items():
        held = [F.contains(line, F.lit(w.lower())) for w in words]
        hits.append(F.when(reduce(or_, held, F.lit(False)), F.lit(metric)))
    return F.array_compact(F.array(*hits).cast("array<string>"))


def _near_logs(
    alerts: DataFrame,
    logs: DataFrame,
    minutes: int | str | None,
    config: InvestigationConfig,
    extra_keys: tuple[str, ...] = (),
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """Alerts joined with the lines of their host and service within the lookback.

    Time buckets are as wide as the longest lookback in use, so an alert probes two of them.
    """
    lookback = clamped_minutes(config.logs_minutes if minutes is None else minutes, config.logs_minutes_cap)
    width = 60 * (
        config.logs_minutes_cap
        if isinstance(minutes, str)
        else max(1, min(config.logs_minutes if minutes is None else minutes, config.logs_minutes_cap))
    )
    left = alerts.select(
        "alert_id", "host_id", "service_name", "triggered_at", lookback.alias("_minutes"), *extra_keys, *extra
    ).withColumn(
        "_bucket",
        F.explode(
            F.expr(
                f"""sequence((unix_seconds(triggered_at) - _minutes * 60) div {width},
                    unix_seconds(triggered_at) div {width})"""
            )
        ),
    )
    right = within_reach(logs, "ts", alerts, config.logs_minutes_cap).withColumnRenamed("ts", "log_ts").withColumn(
        "_bucket", F.expr(f"unix_seconds(log_ts) div {width}")
    )
    return left.join(right, ["host_id", "service_name", "_bucket", *extra_keys]).filter(
        """log_ts <= triggered_at
        AND unix_micros(log_ts) >= unix_micros(triggered_at) - _minutes * 60000000L"""
    )


def log_evidence(
    alerts: DataFrame,
    logs: DataFrame,
    minutes: int | str | None = None,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """Distinct log lines per alert with their number of copies and their place in text order."""
    near = _near_logs(alerts, logs, minutes, config)
    lines = near.groupBy("alert_id", "line").agg(F.count("*").alias("copies"))
    return lines.selectExpr(
        "*", "CAST(row_number() OVER (PARTITION BY alert_id ORDER BY line) AS BIGINT) AS line_rank"
    )


def log_match(
    alerts: DataFrame,
    logs: DataFrame,
    minutes: int | str | None = None,
    keywords: dict[str, list[str]] = LOG_KEYWORDS,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """Per alert, the first line in text order with a keyword of its dominant_metric.

    Lines without any keyword are filtered out before the join, and the minimum is taken
    map-side, so no alert collects its lines.
    """
    relevant = logs.withColumn("dominant_metric", F.explode(matched_metrics(keywords)))
    near = _near_logs(alerts, relevant, minutes, config, extra_keys=("dominant_metric",))
    return near.groupBy("alert_id").agg(
        F.min("line").alias("matched_log"), F.count("*").alias("matching_lines")
    )


def runbook_lookup(alerts: DataFrame, runbooks: DataFrame) -> DataFrame:
    """Add runbook_key and runbook: the service's own text, else the one named default.

    runbooks has one row per service.
    """
    known = runbooks.select(F.col("service_name").alias("_own"))
    texts = runbooks.select(F.col("service_name").alias("runbook_key"), F.col("body").alias("runbook"))
    return (
        alerts.join(known, F.col("service_name") == F.col("_own"), "left")
        .withColumn("runbook_key", F.coalesce("_own", F.lit("default")))
        .drop("_own")
        .join(texts, "runbook_key", "left")
    )


# First line of the runbook that is a step 1, without surrounding white space.
RUNBOOK_FIRST_STEP = (
    r"try_element_at(filter(transform(split(runbook, r'\r\n|\r|\n'), "
    r"l -> regexp_replace(l, r'^\s+|\s+$', '')), l -> l LIKE '1.%'), 1)"
)


def runbook_first_step(with_runbook: DataFrame) -> DataFrame:
    return with_runbook.selectExpr("*", f"{RUNBOOK_FIRST_STEP} AS first_step")


def deploy_correlation(
    alerts: DataFrame,
    deploys: DataFrame,
    minutes: int | str | None = None,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """Per alert with a deploy of its service in the lookback: deploy_count and the latest deploy.

    Deploys are few and alerts many, so the deploys are copied to each minute they can still
    explain, and alerts meet them on (service, minute) without being copied.
    """
    default = config.deploys_minutes if minutes is None else minutes
    lookback = clamped_minutes(default, config.deploys_minutes_cap)
    reach = config.deploys_minutes_cap if isinstance(default, str) else min(max(default, 1), config.deploys_minutes_cap)
    left = alerts.select(
        "alert_id", "service_name", "triggered_at", lookback.alias("_minutes"),
        F.expr("unix_seconds(triggered_at) div 60").alias("_minute"),
    )
    right = within_reach(deploys, "deployed_at", alerts, config.deploys_minutes_cap).withColumn(
        "_minute",
        F.explode(
            F.expr(
                f"""sequence(unix_seconds(deployed_at) div 60,
                    (unix_seconds(deployed_at) + {reach * 60}) div 60)"""
            )
        ),
    )
    near = left.join(right, ["service_name", "_minute"]).filter(
        """deployed_at <= triggered_at
        AND unix_micros(deployed_at) >= unix_micros(triggered_at) - _minutes * 60000000L"""
    )
    return (
        near.groupBy("alert_id")
        .agg(
            F.count("*").alias("deploy_count"),
            F.max(
                F.struct("deployed_at", "deploy_id", "git_sha", "author", "component", "triggered_at")
            ).alias("_d"),
        )
        .selectExpr(
            "alert_id", "deploy_count", "_d.deploy_id AS deploy_id", "_d.git_sha AS git_sha",
            "_d.author AS author", "_d.component AS component", "_d.deployed_at AS deployed_at",
            """round((unix_micros(_d.triggered_at) - unix_micros(_d.deployed_at)) / 60000000D, 1)
                AS minutes_before_alert""",
        )
    )

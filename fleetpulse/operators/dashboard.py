"""Dashboard and check queries over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import METRICS

BUCKET_SECONDS = 15


def selected(
    df: DataFrame,
    time_col: str,
    start: datetime | None = None,
    end: datetime | None = None,
    hosts: Sequence[str] | None = None,
) -> DataFrame:
    """Time range (both ends included) and host selection; None selects everything.

    A table with the day column ds (as `append_batch` writes it for this time column) opens only
    the days of the range.
    """
    days = "ds" in df.columns
    if start is not None:
        df = df.filter(F.col(time_col) >= F.lit(start))
        df = df.filter(F.col("ds") >= F.to_date(F.lit(start))) if days else df
    if end is not None:
        df = df.filter(F.col(time_col) <= F.lit(end))
        df = df.filter(F.col("ds") <= F.to_date(F.lit(end))) if days else df
    if hosts is not None:
        df = df.filter(F.col("host_id").isin(*hosts))
    return df


def bucket(time_col: str = "ts", seconds: int = BUCKET_SECONDS) -> Column:
    """Start of the epoch-aligned time bucket."""
    return F.expr(f"timestamp_seconds(floor(unix_micros({time_col}) / {seconds * 1_000_000}D) * {seconds})")


def host_list(hosts: DataFrame) -> DataFrame:
    return hosts.select("host_id").orderBy("host_id")


def series(metrics: DataFrame, value: str, suffix: str = "", **selection) -> DataFrame:
    """Average of one column per host and bucket; rows without a value are left out."""
    rows = selected(metrics, "ts", **selection).filter(F.col(value).isNotNull())
    return (
        rows.groupBy(bucket().alias("time"), "host_id")
        .agg(F.avg(value).alias("value"))
        .select("time", F.concat("host_id", F.lit(suffix)).alias("metric"), "value")
        .orderBy("time", "metric")
    )


def all_metrics(metrics: DataFrame, **selection) -> DataFrame:
    """The four metric panels in one pass: time, host_id, metric, value."""
    wide = (
        selected(metrics, "ts", **selection)
        .groupBy(bucket().alias("time"), "host_id")
        .agg(*[F.avg(m).alias(m) for m in METRICS])
    )
    return wide.unpivot(["time", "host_id"], list(METRICS), "metric", "value")


def score_and_threshold(metrics: DataFrame, **selection) -> DataFrame:
    """Score and threshold series of each host in one pass."""
    wide = (
        selected(metrics, "ts", **selection)
        .groupBy(bucket().alias("time"), "host_id")
        .agg(F.avg("raw_score").alias("score"), F.avg("threshold").alias("threshold"))
    )
    long = wide.unpivot(["time", "host_id"], ["score", "threshold"], "kind", "value")
    return long.filter("value IS NOT NULL").select(
        "time", F.concat_ws(" ", "host_id", "kind").alias("metric"), "value"
    )


def _last_hour(df: DataFrame, time_col: str, as_of: datetime | None) -> DataFrame:
    """Rows later than one hour before as_of (default: the newest row's time)."""
    newest = F.lit(as_of) if as_of is not None else df.agg(F.max(time_col)).scalar()
    return df.filter(F.col(time_col) > newest - F.expr("INTERVAL 1 HOUR"))


def active_alerts(alerts: DataFrame, as_of: datetime | None = None) -> DataFrame:
    return _last_hour(alerts, "triggered_at", as_of).agg(F.count("*").alias("value"))


def average_confidence(runs: DataFrame, as_of: datetime | None = None) -> DataFrame:
    return _last_hour(runs, "created_at", as_of).agg(F.avg("confidence").alias("value"))


def _half_up(column: str, digits: int) -> Column:
    """Round through a decimal of 15 significant digits, as SQL does for float to numeric."""
    exact = F.format_string("%.14e", F.col(column)).cast("decimal(38,18)")
    return F.when(F.col(column).isNotNull(), F.round(exact, digits))


def alert_table(alerts: DataFrame, runs: DataFrame, limit: int = 200, **selection) -> DataFrame:
    """Newest alerts with their latest diagnosis.

    Each alert gives one row, so the newest alerts are taken first; only the runs of those
    few alerts are aggregated and joined.
    """
    newest = (
        selected(alerts, "triggered_at", **selection)
        .select("alert_id", "triggered_at", "host_id", "service_name", "severity", "status", "raw_score", "threshold")
        .orderBy(F.desc("triggered_at"), "alert_id")
        .limit(limit)
    )
    latest = (
        runs.join(newest.select("alert_id"), "alert_id", "left_semi")
        .groupBy("alert_id")
        .agg(
            F.max_by(
                F.struct("root_cause", "proposed_fix", "confidence"), F.struct("created_at", "run_id")
            ).alias("r")
        )
    )
    return (
        newest.join(latest, "alert_id", "left")
        .orderBy(F.desc("triggered_at"), "alert_id")
        .select(
            F.col("triggered_at").alias("time"), "host_id", "service_name", "severity", "status",
            _half_up("raw_score", 3).alias("score"),
            _half_up("threshold", 3).alias("threshold"),
            "r.root_cause", "r.proposed_fix",
            _half_up("r.confidence", 2).alias("confidence"),
        )
    )


def metrics_count(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count("*").alias("metrics_rows"))


def latest_alerts(alerts: DataFrame, limit: int = 5) -> DataFrame:
    return (
        alerts.select("alert_id", "host_id", "severity", "status", "triggered_at")
        .orderBy(F.desc("triggered_at"), "alert_id")
        .limit(limit)
    )


def latest_diagnoses(runs: DataFrame, limit: int = 5) -> DataFrame:
    return (
        runs.orderBy(F.desc("created_at"), "run_id")
        .limit(limit)
        .select("alert_id", "provider", "confidence", F.left("root_cause", F.lit(80)).alias("root_cause"))
    )

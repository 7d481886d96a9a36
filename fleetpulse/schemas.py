"""Message and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

from fleetpulse.config import METRICS

# What a keyed topic delivers; a file stream with these two columns works the same way.
MESSAGE = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]
)

# Messages are first read with every leaf as text: numbers may arrive as numeric strings,
# which a typed from_json would report as corrupt.
_TEXT_SNAPSHOT = T.StructType([T.StructField(m, T.StringType()) for m in METRICS])

RAW_TELEMETRY = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("metrics", _TEXT_SNAPSHOT),
        T.StructField(
            "injected_anomaly",
            T.StructType(
                [T.StructField("active", T.StringType()), T.StructField("type", T.StringType())]
            ),
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

RAW_ALERT = T.StructType(
    [
        T.StructField("alert_id", T.StringType()),
        T.StructField("event_id", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("host_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("triggered_at", T.StringType()),
        T.StructField("raw_score", T.StringType()),
        T.StructField("threshold", T.StringType()),
        T.StructField("ewma_mean", T.StringType()),
        T.StructField("ewma_std", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("metric_snapshot", _TEXT_SNAPSHOT),
        T.StructField("recent_metrics", T.ArrayType(_TEXT_SNAPSHOT)),
        T.StructField("is_early_warning", T.StringType()),
        T.StructField("predicted_breach_minutes", T.StringType()),
        T.StructField("_corrupt", T.StringType()),
    ]
)

# Columns of the stored tables, in order.
METRICS_COLUMNS = (
    "event_id", "host_id", "service_name", "ts", *METRICS, "features", "raw_score",
    "ewma_mean", "ewma_std", "threshold", "is_anomaly", "severity", "model_version",
    "injected_anomaly_type", "predicted_breach_minutes",
)
ALERT_COLUMNS = (
    "alert_id", "event_id", "n", "host_id", "service_name", "triggered_at", "raw_score",
    "threshold", "ewma_mean", "ewma_std", "severity", "metric_snapshot", "recent_metrics",
    "is_early_warning", "predicted_breach_minutes",
)
RUN_COLUMNS = (
    "run_id", "alert_id", "provider", "model_name", "started_at", "completed_at", "turn_count",
    "tool_calls", "root_cause", "proposed_fix", "confidence", "severity_assessment", "status",
    "error_message", "latency_ms", "created_at",
)

"""Alert records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.config import DETECTOR, LAYOUT, DetectorConfig, LayoutConfig
from fleetpulse.operators.cooldown import apply_cooldown
from fleetpulse.operators.features import SNAPSHOT
from fleetpulse.schemas import ALERT_COLUMNS


# The same alert gets the same id when a batch is run again.
ALERT_ID = """md5(concat_ws('|', host_id, CAST(event_id AS STRING),
    CASE WHEN is_early_warning THEN 'early' ELSE 'reactive' END))"""


def alert_candidates(metrics: DataFrame) -> DataFrame:
    """Rows that would alert if there were no cooldown.

    A row qualifies once at most: a forecast is only made for rows that are not anomalous.
    """
    return metrics.filter("is_anomaly OR predicted_breach_minutes IS NOT NULL").selectExpr(
        "*", "NOT is_anomaly AS is_early_warning"
    )


def published(
    metrics: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Candidates that pass the cooldown; each kind has its own clock per host."""
    return apply_cooldown(
        alert_candidates(metrics),
        keys=("host_id", "is_early_warning"),
        seconds=config.cooldown_seconds,
        layout=layout,
    )


def alert_records(passed: DataFrame) -> DataFrame:
    """Alert rows from published candidates."""
    return passed.selectExpr(
        "* EXCEPT (severity)",
        "CASE WHEN is_early_warning THEN 'warning' ELSE severity END AS severity",
        f"{ALERT_ID} AS alert_id",
        "ts AS triggered_at",
        f"{SNAPSHOT} AS metric_snapshot",
    ).select(*ALERT_COLUMNS)


def build_alerts(
    metrics: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    return alert_records(published(metrics, config, layout))

"""Batch detection: telemetry -> scored metrics -> alert log."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.config import DETECTOR, LAYOUT, DetectorConfig, LayoutConfig
from fleetpulse.operators import features, forecast, threshold
from fleetpulse.operators.alerts import build_alerts
from fleetpulse.operators.model import score_events, score_from_column
from fleetpulse.operators.series import number_events, over_chunks
from fleetpulse.session import materialize
from fleetpulse.sources.tables import with_parent


def _judge(scored: DataFrame, config: DetectorConfig, layout: LayoutConfig) -> DataFrame:
    """Features, threshold, forecast and recent snapshots in one pass over the series.

    All windows that read input columns share one Window node; only the trend line, which
    reads the smoothed scores, needs a second one on the same partitioning and order. The
    score history is read after both, from the rows as they are sorted for them.
    """
    with_features = features.DERIVED[0] in scored.columns

    def build(df: DataFrame) -> DataFrame:
        windows = [
            *features.recent_windows(config),
            *forecast.smoothing_windows(config),
        ]
        derived = []
        if with_features:
            dropped = [*features.DERIVED]
        else:
            dropped = [*features.FEATURE_WINDOW_NAMES]
            windows += features.feature_windows(config)
            derived = features.feature_columns()
        # only alert candidates need their recent snapshots; the table keeps null elsewhere
        windowed = (
            df.selectExpr("*", *windows)
            .selectExpr(
                f"* EXCEPT ({', '.join(dropped)})",
                *derived,
                f"{features.FEATURE_ARRAY} AS features",
            )
            .selectExpr("*", *forecast.trend_windows(config))
        )
        return (
            threshold.add_history(windowed, config)
            .selectExpr(f"* EXCEPT ({threshold.HISTORY})", *threshold.threshold_columns(config))
            .selectExpr("*", forecast.forecast_column(config))
            .selectExpr(
                f"* EXCEPT (_x, {features.RECENT})",
                f"""CASE WHEN is_anomaly OR predicted_breach_minutes IS NOT NULL
                    THEN {features.RECENT_SNAPSHOTS} END AS recent_metrics""",
            )
        )

    return over_chunks(scored, config.lookback, build, layout).drop(
        *([] if with_features else features.DERIVED)
    )


def score_with_column(
    telemetry: DataFrame,
    score_col: str,
    config: DetectorConfig = DETECTOR,
    layout: LayoutConfig = LAYOUT,
) -> DataFrame:
    """The metrics table with an existing column as the score."""
    return _judge(score_from_column(number_events(telemetry, layout), score_col, config), config, layout)


def score_with_forest(
    telemetry: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """The metrics table with isolation-forest scores."""
    featured = features.add_features(telemetry, config, layout)
    return _judge(score_events(featured, config, layout), config, layout)


def detect(
    telemetry: DataFrame,
    score_col: str | None = None,
    config: DetectorConfig = DETECTOR,
    layout: LayoutConfig = LAYOUT,
    hosts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, alerts). The metrics table is stored first and alerts are derived from it.

    With a hosts table, events of hosts that are not in it are left out; `sources.tables.orphans`
    gives them.
    """
    if hosts is not None:
        telemetry = with_parent(telemetry, hosts, "host_id")
    if score_col:
        metrics = score_with_column(telemetry, score_col, config, layout)
    else:
        metrics = score_with_forest(telemetry, config, layout)
    metrics = materialize(metrics, "metrics", dictionary=False)
    return metrics, build_alerts(metrics, config, layout)

"""Early-warning forecast: minutes until the score trend reaches the threshold.

Scores are smoothed by a trailing average over full windows only; a least-squares line runs
through the smoothed points of the last `trend_window` scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.config import DETECTOR, LAYOUT, DetectorConfig, LayoutConfig
from fleetpulse.operators.series import CHUNK_ORDER, last_rows, over_chunks


def _smoothing_span(config: DetectorConfig) -> int:
    return config.trend_smoothing if 1 < config.trend_smoothing <= config.trend_window else 1


def smoothing_windows(config: DetectorConfig = DETECTOR) -> list[str]:
    """score_ma, and _x for the time axis.

    _x counts seconds from the first event of the window partition, which keeps it small.
    """
    span = _smoothing_span(config)
    return [
        f"""CASE WHEN raw_score IS NOT NULL AND n - {config.warmup_events} >= {span}
            THEN avg(raw_score) {last_rows(span)} END AS score_ma""",
        f"""(unix_micros(ts) - first(unix_micros(ts)) OVER ({CHUNK_ORDER}
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) / 1000000D AS _x""",
    ]


def trend_windows(config: DetectorConfig = DETECTOR) -> list[str]:
    """Slope (score per second) and R² of the line; needs score_ma and _x."""
    frame = last_rows(config.trend_window - _smoothing_span(config) + 1)
    enough = f"raw_score IS NOT NULL AND n - {config.warmup_events} >= {config.trend_min_points}"
    return [
        f"CASE WHEN {enough} THEN regr_slope(score_ma, _x) {frame} END AS trend_slope",
        f"CASE WHEN {enough} THEN regr_r2(score_ma, _x) {frame} END AS trend_r2",
    ]


def forecast_column(config: DetectorConfig = DETECTOR) -> str:
    """Rounded minutes to breach, null unless the row is below its threshold on a clear rise."""
    minutes = "((threshold - score_ma) / nullif(trend_slope, 0D) / 60D)"
    return f"""CASE WHEN threshold IS NOT NULL AND NOT is_anomaly AND trend_slope > 0
        AND trend_r2 >= {config.trend_min_r2}D
        AND {minutes} BETWEEN 0D AND {config.trend_horizon_minutes}D
        THEN round({minutes}, 1) END AS predicted_breach_minutes"""


def add_trend(
    scored: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Add score_ma, trend_slope and trend_r2."""

    def build(df: DataFrame) -> DataFrame:
        return (
            df.selectExpr("*", *smoothing_windows(config))
            .selectExpr("*", *trend_windows(config))
            .drop("_x")
        )

    return over_chunks(scored, config.trend_window - 1, build, layout)

"""Feature engineering on a host's event series."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.config import (
    DETECTOR, EPSILON, FEATURES, LAYOUT, METRIC_BOUNDS, METRICS, DetectorConfig, LayoutConfig,
)
from fleetpulse.operators.series import CHUNK_ORDER, last_rows, over_chunks, previous_rows

DERIVED = FEATURES[len(METRICS):]
SNAPSHOT = f"named_struct({', '.join(f"'{m}', {m}" for m in METRICS)})"
FEATURE_ARRAY = f"array({', '.join(FEATURES)})"


def raw_metrics(events: DataFrame) -> DataFrame:
    """The four metrics as doubles in fixed order, from flat columns or a metrics struct."""
    nested = "metrics" in events.columns
    kept = [c for c in events.columns if c not in METRICS and c != "metrics"]
    casts = [f"CAST({'metrics.' if nested else ''}{m} AS DOUBLE) AS {m}" for m in METRICS]
    return events.selectExpr(*kept, *casts)


def clamp_metrics(events: DataFrame) -> DataFrame:
    """Force each metric into its valid range and flag rows that were changed."""
    others = [c for c in events.columns if c not in METRICS]
    # least/greatest skip nulls, so a missing reading has to stay missing explicitly
    bounded = {
        m: f"CASE WHEN {m} IS NOT NULL THEN least(greatest({m}, {lo}D), {hi}D) END"
        for m, (lo, hi) in METRIC_BOUNDS.items()
    }
    outside = " OR ".join(f"{m} < {lo}D OR {m} > {hi}D" for m, (lo, hi) in METRIC_BOUNDS.items())
    flag = f"coalesce({outside}, false) AS was_clamped"
    return events.selectExpr(*others, *[f"{e} AS {m}" for m, e in bounded.items()], flag)


def feature_windows(config: DetectorConfig = DETECTOR) -> list[str]:
    """Window columns over the previous rows that the z-scores and deltas are made of."""
    previous = previous_rows(config.rolling_window)
    return [
        f"count(*) {previous} AS _previous",
        *[f"avg({m}) {previous} AS _{m}_mean" for m in METRICS],
        *[f"stddev_pop({m}) {previous} AS _{m}_std" for m in METRICS],
        *[f"lag({m}) OVER ({CHUNK_ORDER}) AS _{m}_last" for m in METRICS],
    ]


FEATURE_WINDOW_NAMES = ("_previous", *[f"_{m}_{s}" for m in METRICS for s in ("mean", "std", "last")])


def feature_columns() -> list[str]:
    """z-scores (0 without two previous rows or without spread) and deltas (0 at the start).

    A NaN among the previous readings makes the spread NaN, which counts as none.
    """
    zscores = [
        f"""CASE WHEN _previous >= 2 AND NOT isnan(_{m}_std) AND _{m}_std > {EPSILON}D
            THEN ({m} - _{m}_mean) / nullif(_{m}_std, 0D) ELSE 0D END AS {m}_z"""
        for m in METRICS
    ]
    return zscores + [f"coalesce({m} - _{m}_last, 0D) AS {m}_delta" for m in METRICS]


def recent_windows(config: DetectorConfig = DETECTOR) -> list[str]:
    """The last readings, oldest first, the current ones included: one list for all metrics."""
    return [f"collect_list({SNAPSHOT}) {last_rows(config.rolling_window)} AS {RECENT}"]


RECENT = "_recent"
_RECENT_LISTS = ", ".join(f"array_compact({RECENT}.{m})" for m in METRICS)
_RECENT_FIELDS = ", ".join(f"'{m}', s['{i}']" for i, m in enumerate(METRICS))
# a metric's missing readings are left out of its list
RECENT_SNAPSHOTS = f"transform(arrays_zip({_RECENT_LISTS}), s -> named_struct({_RECENT_FIELDS}))"


def add_features(
    events: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Add n, the z-score and delta columns."""

    def build(df: DataFrame) -> DataFrame:
        return df.selectExpr("*", *feature_windows(config)).selectExpr(
            f"* EXCEPT ({', '.join(FEATURE_WINDOW_NAMES)})", *feature_columns()
        )

    return over_chunks(events, config.rolling_window, build, layout)


def add_feature_vector(
    events: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    return add_features(events, config, layout).selectExpr(
        f"* EXCEPT ({', '.join(DERIVED)})", f"{FEATURE_ARRAY} AS features"
    )


def recent_snapshots(
    events: DataFrame, config: DetectorConfig = DETECTOR, layout: LayoutConfig = LAYOUT
) -> DataFrame:
    """Each event with the last snapshots of its host, oldest first, its own included."""

    def build(df: DataFrame) -> DataFrame:
        return df.selectExpr("*", *recent_windows(config)).selectExpr(
            f"* EXCEPT ({RECENT})", f"{RECENT_SNAPSHOTS} AS recent_metrics"
        )

    return over_chunks(events, config.rolling_window - 1, build, layout)

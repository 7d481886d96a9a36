"""Parameters of detection and investigation."""

from __future__ import annotations

from dataclasses import dataclass

# Metric names and order, and valid ranges.
METRICS = ("cpu_pct", "mem_pct", "latency_ms", "error_rate_pct")
METRIC_BOUNDS = {
    "cpu_pct": (0.5, 100.0),
    "mem_pct": (1.0, 100.0),
    "latency_ms": (1.0, 5000.0),
    "error_rate_pct": (0.0, 100.0),
}
FEATURES = METRICS + tuple(f"{m}_z" for m in METRICS) + tuple(f"{m}_delta" for m in METRICS)

# Allowed message and table enumerations.
SEVERITIES = ("warning", "critical")
ANOMALY_TYPES = ("spike", "ramp")
ALERT_STATUSES = ("new", "investigating", "diagnosed", "error")

# Spread below this counts as none (z-scores and means).
EPSILON = 1e-6


@dataclass(frozen=True)
class DetectorConfig:
    """Detection defaults; row counts are events of one host."""

    warmup_events: int = 120
    rolling_window: int = 10
    retrain_interval: int = 500
    train_window: int = 1000
    n_trees: int = 100
    subsample: int = 256
    seed: int = 42
    threshold_percentile: float = 95.0
    score_history: int = 200
    min_history: int = 10
    cooldown_seconds: float = 60.0
    trend_window: int = 10
    trend_min_points: int = 5
    trend_horizon_minutes: float = 20.0
    trend_min_r2: float = 0.7
    trend_smoothing: int = 3

    def __post_init__(self) -> None:
        if self.warmup_events > self.train_window:
            raise ValueError("warmup_events must not exceed train_window")

    @property
    def lookback(self) -> int:
        """Rows before an event that any of its window frames can reach."""
        return max(self.rolling_window, self.score_history - 1, self.trend_window - 1)


@dataclass(frozen=True)
class LayoutConfig:
    """How one host's series is cut so that no task holds a whole host."""

    # events of one host are ranked per time cell of this width
    cell_micros: int = 1_000_000
    # counts of cells are added up in groups of so many cells, then group by group
    cells_per_group: int = 3600
    # window frames run over chunks of this many events (plus the lookback rows)
    chunk_rows: int = 2048
    # successive versions of a host that score so many events together, one at least, are fitted in one group
    scoring_rows: int = 4000
    # a row group of a stored model table holds forests of about so many nodes in all, one at least
    model_block_nodes: int = 1 << 19
    # least number of tasks per core where the work is heavy for its bytes
    tasks_per_core: int = 4
    # cooldowns are walked over spans of this many candidates (cut between cells)
    cooldown_span_rows: int = 8192


@dataclass(frozen=True)
class InvestigationConfig:
    """Lookbacks in minutes, each with the largest value a caller may ask for."""

    metrics_minutes: int = 15
    metrics_minutes_cap: int = 180
    metrics_limit: int = 200
    logs_minutes: int = 15
    logs_minutes_cap: int = 180
    deploys_minutes: int = 60
    deploys_minutes_cap: int = 360


DETECTOR = DetectorConfig()
LAYOUT = LayoutConfig()
INVESTIGATION = InvestigationConfig()

"""Investigation of an alert log: evidence, diagnosis, run records and alert status."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fleetpulse.config import INVESTIGATION, InvestigationConfig
from fleetpulse.operators.diagnosis import diagnose, gather, lifecycle, run_records
from fleetpulse.sources.tables import with_status


def investigate(
    alerts: DataFrame,
    metrics: DataFrame,
    logs: DataFrame,
    deploys: DataFrame,
    runbooks: DataFrame,
    config: InvestigationConfig = INVESTIGATION,
) -> DataFrame:
    """Alerts with their evidence and diagnosis columns.

    Alerts are read several times, so pass a stored table.
    """
    return diagnose(gather(alerts, metrics, logs, deploys, runbooks, config))


def record(alerts: DataFrame, runs: DataFrame, diagnoses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(run records, alerts with their current status)."""
    return run_records(runs, diagnoses), with_status(alerts, lifecycle(runs))

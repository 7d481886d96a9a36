"""Rule diagnosis of alerts from their evidence, and the run records."""

from __future__ import annotations

import logging

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import INVESTIGATION, METRICS, InvestigationConfig
from fleetpulse.operators import evidence
from fleetpulse.schemas import RUN_COLUMNS
from fleetpulse.session import materialize

log = logging.getLogger(__name__)

CAUSES = {
    "cpu_pct": "the CPU running at its limit",
    "mem_pct": "memory filling up",
    "latency_ms": "requests waiting on a slow dependency",
    "error_rate_pct": "requests failing in a dependency",
}
REMEDIES = {
    "cpu_pct": "Find the process that uses the CPU and limit it, or add capacity.",
    "mem_pct": "Restart the process to free memory, then look for the leak.",
    "latency_ms": "Clear the queue in front of the slow dependency.",
    "error_rate_pct": "Check the health of the dependency and stop calling it if it is down.",
}
# Confidence per branch, and the limit above which it counts as high.
CONFIDENCE = {"deploy": 0.90, "log": 0.78, "none": 0.63}
HIGH_CONFIDENCE = 0.75

# The evidence steps of one investigation, in order; each is DataFrame -> DataFrame and the
# caller may replace it.
EVIDENCE = {
    "recent_metrics": evidence.recent_metrics_summary,
    "logs": evidence.log_match,
    "deploys": evidence.deploy_correlation,
    "runbook": evidence.runbook_lookup,
}
# What a step that fails counts as having found: nothing.
_NOTHING = {
    "recent_metrics": "alert_id string, sample_count bigint, dominant_metric string",
    "logs": "alert_id string, matched_log string, matching_lines bigint",
    "deploys": """alert_id string, deploy_count bigint, deploy_id string, git_sha string, author string,
        component string, deployed_at timestamp, minutes_before_alert double""",
}
# Columns that an investigation cannot do without; evidence from other tables may be missing.
_REQUIRED = {
    "alerts": ("alert_id", "host_id", "service_name", "triggered_at"),
    "metrics": ("host_id", "event_id", "ts", *METRICS),
}
# What a step's record shows of its result.
_FOUND = {
    "recent_metrics": ("sample_count", "dominant_metric"),
    "logs": ("matched_log", "matching_lines"),
    "deploys": ("deploy_count", "deploy_id", "minutes_before_alert"),
    "runbook": ("runbook_key",),
}


def check_tables(**tables: DataFrame) -> None:
    """Raise ValueError if a required table lacks a column."""
    for name, table in tables.items():
        missing = [c for c in _REQUIRED[name] if c not in table.columns]
        if missing:
            raise ValueError(f"{name} has no column {', '.join(missing)}")


def _message(error: Exception) -> str:
    """The first line of the fault itself; Spark wraps what happened in a task into errors of the job."""
    if isinstance(error, Py4JJavaError):
        cause = error.java_exception
        while cause.getCause() is not None:
            cause = cause.getCause()
        return str(cause.getMessage()).splitlines()[0]
    return str(error).splitlines()[0]


def _attempt(name: str, steps: dict, errors: dict, alerts: DataFrame, *tables: DataFrame, **options) -> DataFrame:
    """Run one step and store its result; a missing or failing one leaves its evidence empty and its error in `errors`.

    The step's jobs run here, so a fault that only its data show stays with it too.
    """
    try:
        return materialize(steps[name](alerts, *tables, **options), f"evidence-{name}")
    except (KeyError, PySparkException, Py4JJavaError) as error:
        log.warning("evidence step %s not available: %s", name, error)
        errors[name] = f"{type(error).__name__}: {_message(error)}"
        if name == "runbook":
            return alerts.selectExpr("*", "CAST(NULL AS STRING) AS runbook_key", "CAST(NULL AS STRING) AS runbook")
        return alerts.sparkSession.createDataFrame([], _NOTHING[name])


def _tool_calls(errors: dict[str, str], config: InvestigationConfig) -> Column:
    """One record per evidence step: id, name, arguments and result (or error) as JSON."""
    minutes = {"recent_metrics": config.metrics_minutes, "logs": config.logs_minutes, "deploys": config.deploys_minutes}
    calls = []
    for place, (name, shown) in enumerate(_FOUND.items(), 1):
        arguments = [F.col("service_name" if name in ("deploys", "runbook") else "host_id")]
        if name in minutes:
            arguments.append(F.lit(minutes[name]).alias("minutes"))
        result = F.struct(F.lit(errors[name]).alias("error")) if name in errors else F.struct(*shown)
        calls.append(
            F.struct(
                F.concat_ws("-", "alert_id", F.lit(place)).alias("id"), F.lit(name).alias("name"),
                F.to_json(F.struct(*arguments)).alias("arguments"), F.to_json(result).alias("result"),
            )
        )
    return F.array(*calls)


def _choose(values: dict[str, str]) -> str:
    return "CASE dominant_metric " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def gather(
    alerts: DataFrame,
    metrics: DataFrame,
    logs: DataFrame,
    deploys: DataFrame,
    runbooks: DataFrame,
    config: InvestigationConfig = INVESTIGATION,
    steps: dict = EVIDENCE,
) -> DataFrame:
    """Alerts with dominant_metric, matched_log, latest deploy, runbook and tool_calls columns.

    Each step is run and stored on its own, keyed by alert_id. Alerts or metrics with a wrong schema
    raise; a step that fails, be it in its plan or on its data, or is missing, is recorded and the
    others go on.
    """
    check_tables(alerts=alerts, metrics=metrics)
    errors: dict[str, str] = {}
    summary = _attempt("recent_metrics", steps, errors, alerts, metrics, config=config)
    judged = alerts.join(summary.select("alert_id", "sample_count", "dominant_metric"), "alert_id", "left")
    judged = judged.withColumn(
        "dominant_metric", F.coalesce("dominant_metric", F.lit(evidence.FALLBACK_METRIC))
    )
    lines = _attempt("logs", steps, errors, judged, logs, config=config)
    latest = _attempt("deploys", steps, errors, alerts, deploys, config=config)
    found = judged.join(lines, "alert_id", "left").join(latest, "alert_id", "left")
    with_runbook = _attempt("runbook", steps, errors, found, runbooks)
    return with_runbook.withColumn("tool_calls", _tool_calls(errors, config))


def diagnose(gathered: DataFrame) -> DataFrame:
    """Add branch, root_cause, proposed_fix, confidence and severity_assessment.

    A recent deploy is the first suspect, then a matching log line, else nothing confirms.
    """
    levels = " ".join(f"WHEN '{b}' THEN {c}D" for b, c in CONFIDENCE.items())
    staged = gathered.selectExpr(
        "*",
        """CASE WHEN deploy_count > 0 THEN 'deploy' WHEN matched_log IS NOT NULL THEN 'log'
            ELSE 'none' END AS branch""",
        f"{_choose(CAUSES)} AS cause",
        f"{_choose(REMEDIES)} AS remedy",
        f"{evidence.RUNBOOK_FIRST_STEP} AS first_step",
    )
    return staged.selectExpr(
        "*",
        """CASE branch
            WHEN 'deploy' THEN concat('Deploy ', coalesce(deploy_id, 'unknown'), ' of ',
                coalesce(component, 'an unknown component'), ' by ', coalesce(author, 'unknown'), ', ',
                CAST(CAST(round(minutes_before_alert) AS INT) AS STRING),
                ' min before the alert, probably led to ', cause, '.')
            WHEN 'log' THEN concat(upper(left(cause, 1)), lower(substr(cause, 2)),
                ', as this log line shows: ', matched_log)
            ELSE concat('Possibly ', cause, '; no deploy or log line confirms it.')
            END AS root_cause""",
        """CASE WHEN branch = 'deploy'
            THEN concat('Undo deploy ', coalesce(deploy_id, 'unknown'), ' of ',
                coalesce(component, 'an unknown component'), ' and see whether ',
                dominant_metric, ' recovers.')
            ELSE concat_ws(' First runbook step: ', remedy, first_step) END AS proposed_fix""",
        f"CASE branch {levels} END AS confidence",
    ).selectExpr(
        "* EXCEPT (cause, remedy)",
        f"CASE WHEN confidence > {HIGH_CONFIDENCE} THEN 'high' ELSE 'medium' END AS severity_assessment",
    )


# Recorded when an investigation ended without a diagnosis.
NO_DIAGNOSIS = {
    "root_cause": "The investigation ended without a diagnosis.",
    "proposed_fix": "Look into this alert by hand.",
    "confidence": 0.0,
    "severity_assessment": "medium",
}
TOOL_CALLS = "array<struct<id:string,name:string,arguments:string,result:string>>"


def run_records(
    runs: DataFrame, diagnoses: DataFrame, provider: str = "rules", model_name: str = "rules"
) -> DataFrame:
    """One record per investigation run.

    runs has run_id, alert_id, started_at, completed_at and error_message, and may have
    `concluded`. A run with an error is failed and carries no result; one that did not conclude,
    or has no diagnosis, gets the default record. tool_calls holds what each evidence step was
    asked and found, or its error.
    """
    result = diagnoses.select(
        "alert_id", F.col("tool_calls").alias("_calls"), *[F.col(c).alias(f"_{c}") for c in NO_DIAGNOSIS]
    )
    concluded = F.col("concluded") if "concluded" in runs.columns else F.lit(True)
    joined = runs.withColumn("_concluded", concluded).join(result, "alert_id", "left")
    return (
        joined.withColumns({f"_{c}": F.when(F.col("_concluded"), F.col(f"_{c}")) for c in NO_DIAGNOSIS})
        .selectExpr(
            "*",
            "error_message IS NULL AS _ok",
            f"'{provider}' AS provider",
            f"'{model_name}' AS model_name",
        )
        .selectExpr(
            "*",
            f"CASE WHEN _ok AND _calls IS NOT NULL THEN _calls ELSE CAST(array() AS {TOOL_CALLS}) END AS tool_calls",
            *[
                f"CASE WHEN _ok THEN coalesce(_{c}, {repr(v) if isinstance(v, str) else f'{v}D'}) END AS {c}"
                for c, v in NO_DIAGNOSIS.items()
            ],
            # one turn per evidence step and one for the diagnosis
            "CASE WHEN _ok THEN coalesce(size(_calls), 0) + 1 END AS turn_count",
            "CASE WHEN _ok THEN 'completed' ELSE 'failed' END AS status",
            "CAST((unix_micros(completed_at) - unix_micros(started_at)) div 1000 AS INT) AS latency_ms",
            "completed_at AS created_at",
        )
        .select(*RUN_COLUMNS)
    )


def lifecycle(runs: DataFrame) -> DataFrame:
    """Status-log rows of each run: investigating at its start, then diagnosed or error."""
    return runs.selectExpr(
        "alert_id",
        """inline(array(
            named_struct('status', 'investigating', 'updated_at', started_at),
            named_struct('status', CASE WHEN error_message IS NULL THEN 'diagnosed' ELSE 'error' END,
                'updated_at', completed_at)))""",
    )


def briefs(alerts: DataFrame) -> DataFrame:
    """Add brief: what an investigator needs to know first, as one text."""
    return alerts.selectExpr(
        "*",
        r"""concat(
            'Alert ', alert_id, ' on host ', host_id, ' of service ', service_name, '\n',
            'Severity ', severity, ' at ', date_format(triggered_at, 'yyyy-MM-dd HH:mm:ss'), '\n',
            'Score ', format_number(raw_score, '0.000'),
            ' over threshold ', format_number(threshold, '0.000'), '\n',
            'Metrics ', to_json(metric_snapshot)) AS brief""",
    )

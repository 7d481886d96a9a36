"""Telemetry, logs, deploys and runbooks derived from the driver's events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TELEMETRY_SQL = """
WITH e AS (
  SELECT event_id, event_type, value, user_id,
         cast(get_json_object(props, '$.k') AS double) AS k,
         cast(event_id % 6 AS int) AS h, event_id div 6 AS tick
  FROM {events}),
o AS (SELECT *, cast(tick % 400 AS int) AS ph FROM e),
m AS (
  SELECT *,
    CASE WHEN h % 2 = 0 AND ph = 130 THEN 3.0e0 WHEN h % 2 = 0 AND ph = 131 THEN 1.7e0
         ELSE 1.0e0 END AS spike,
    CASE WHEN h % 2 = 1 AND ph BETWEEN 140 AND 179 THEN 1.0e0 + 1.5e0 * (ph - 139) / 40.0e0
         ELSE 1.0e0 END AS ramp
  FROM o)
SELECT event_id, event_type, concat('host-', cast(h AS string)) AS host_id,
  CASE WHEN h < 2 THEN 'edge' WHEN h < 4 THEN 'core' WHEN h = 4 THEN 'store' ELSE 'cache' END
    AS service_name,
  timestampadd(SECOND, tick * 3, timestamp'2024-01-01 00:00:00') AS ts,
  least(greatest(k * ramp, 0.5e0), 100.0e0) AS cpu_pct,
  least(greatest((user_id % 100) * ramp, 1.0e0), 100.0e0) AS mem_pct,
  least(greatest(value * spike, 1.0e0), 5000.0e0) AS latency_ms,
  least(greatest((CASE event_type WHEN 'error' THEN 5.0e0 WHEN 'signup' THEN 1.0e0 ELSE 0.5e0 END)
    * spike, 0.0e0), 100.0e0) AS error_rate_pct,
  CASE WHEN spike > 1 THEN 'spike' WHEN ramp > 1 THEN 'ramp' END AS injected_anomaly_type
FROM m
"""

RUNBOOKS = {
    "edge": "# Edge\n1. Compare edge errors with the services behind it.\n2. Look at cache hit rates.",
    "core": "# Core\n  1. Look for exhausted connection pools.\n2. List recent changes.",
    "store": "# Store\r\nKeep the primary running.\r\n\t1. Find long transactions and lock waits.\r\n2. Fail over.",
    "default": "# Any service\n1. List recent changes and config edits.\n2. Call the owning team.",
}


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def telemetry_from(events_df: DataFrame) -> DataFrame:
    return events_df.sparkSession.sql(TELEMETRY_SQL, events=events_df)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(events(spark, sf_dir)).drop("event_type")


def _with_event_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_from(events(spark, sf_dir))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir).select("host_id", "service_name").distinct()


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every event; most of them say nothing that a diagnosis looks for."""
    message = (
        F.when(F.col("event_id") % 11 != 0, "request served")
        .when(F.col("event_type") == "error", "upstream answered 502")
        .when(F.col("event_type") == "purchase", "slow query on replica")
        .when(F.col("event_type") == "click", "cpu throttled by limit")
        .when(F.col("event_type") == "signup", "possible memory leak")
        .otherwise("nightly backup finished")
    )
    return (
        _with_event_type(spark, sf_dir)
        .select("host_id", "service_name", "ts", F.concat_ws(" ", "host_id", message).alias("line"))
    )


def deploys(spark: SparkSession, sf_dir: str) -> DataFrame:
    def pick(modulus: int, names: list[str]) -> F.Column:
        return F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % modulus + 1).cast("int"))

    return (
        _with_event_type(spark, sf_dir)
        .filter((F.col("event_type") == "signup") & (F.col("event_id") % 97 == 3))
        .select(
            F.concat(F.lit("dep-"), F.col("event_id").cast("string")).alias("deploy_id"),
            F.substring(F.md5(F.col("event_id").cast("string")), 1, 7).alias("git_sha"),
            pick(4, ["dana", "eli", "fay", "gus"]).alias("author"),
            pick(3, ["router", "session-store", "index"]).alias("component"),
            "service_name",
            F.col("ts").alias("deployed_at"),
        )
    )


def runbooks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RUNBOOKS.items()), "service_name string, body string")

"""Stored tables: appends that can be repeated, upserts, status log and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.config import ALERT_STATUSES
from fleetpulse.schemas import METRICS_COLUMNS
from fleetpulse.session import scratch_path

HOST_LAYOUT = ("host_id", "hour")  # the bucket columns; a busy host is spread over its hours
UPTO = "fleetpulse.upto"


def append_batch(rows: DataFrame, path: str, batch_id: int | str, date_col: str | None = None) -> None:
    """Write one batch into its own folder; writing the same batch again replaces it.

    With date_col the batch is also partitioned by day, so time filters prune folders. The
    rebalance gives files of the advisory size instead of one per task and day, and splits a day
    or host that is much larger than others; sorting lets host filters skip row groups.
    """
    target = f"{path}/batch={batch_id}"
    if date_col:
        rows = rows.withColumn("ds", F.to_date(date_col)).hint("rebalance", "ds")
        rows = rows.sortWithinPartitions(*[c for c in ("ds", "host_id", date_col) if c in rows.columns])
        rows.write.mode("overwrite").partitionBy("ds").parquet(target)
    else:
        rows.write.mode("overwrite").parquet(target)


def by_host(rows: DataFrame, time_col: str = "ts") -> DataFrame:
    """Add the columns of the host layout: hour (since 1970) and the day ds."""
    hour = F.floor(F.unix_micros(time_col) / F.lit(3_600_000_000)).alias("hour")
    return rows.drop("hour", "ds").select("*", hour, F.to_date(time_col).alias("ds"))


def write_by_host(rows: DataFrame, table: str, path: str, buckets: int, time_col: str = "ts") -> None:
    """Store rows as a table bucketed by host and hour, sorted by time, in day folders.

    Joins, aggregates and windows whose keys include host_id and hour read it without an exchange. The
    rows are exchanged by the bucket columns first, so a day has one file a bucket.
    """
    placed = by_host(rows, time_col).repartition(buckets, *HOST_LAYOUT)
    writer = placed.sortWithinPartitions("ds", *HOST_LAYOUT, time_col).write.mode("overwrite").format("parquet")
    writer = writer.partitionBy("ds").bucketBy(buckets, *HOST_LAYOUT).sortBy(*HOST_LAYOUT, time_col)
    writer.option("path", path).saveAsTable(table)


def compacted_upto(spark: SparkSession, view: str) -> int:
    """Number of the last batch that the compacted view holds; -1 if there is no such view."""
    if not spark.catalog.tableExists(view):
        return -1
    found = spark.sql(f"SHOW TBLPROPERTIES {view}").filter(F.col("key") == UPTO).first()
    return int(found["value"]) if found else -1


def fresh_batches(spark: SparkSession, path: str, done: int, upto: int | None = None) -> DataFrame:
    """Rows of the batches after number `done`, in the host layout; the folders of others are not opened."""
    batches = spark.read.parquet(path).filter(F.col("batch") > done)
    return by_host(batches if upto is None else batches.filter(F.col("batch") <= upto)).drop("batch")


def compact_batches(
    spark: SparkSession, path: str, view: str, upto: int, buckets: int | None = None, root: str | None = None
) -> int:
    """Gather the numbered batch folders of `path` up to `upto` in one table by host, seen through `view`.

    `upto` must be a batch that is not written again: on a running stream the one before the newest.
    Each call writes a generation of its own from the one before and the batches since, then turns the view
    over to it, so readers see the one or the other and never a half; a call that fails changes nothing and
    can be repeated. The generation before the last one is dropped from the catalog. No files are deleted:
    old generations and batch folders are for the owner of the folder to remove. Returns the batch that
    the view goes up to.
    """
    done = compacted_upto(spark, view)
    if upto <= done:
        return done
    rows = fresh_batches(spark, path, done, upto)
    if done >= 0:
        rows = spark.table(view).unionByName(rows)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{view}_{upto}"
    target = scratch_path(spark, table) if root is None else f"{root.rstrip('/')}/{table}"
    write_by_host(rows, table, target, buckets)
    spark.sql(f"CREATE OR REPLACE VIEW {view} TBLPROPERTIES ('{UPTO}' = '{upto}', 'fleetpulse.before' = '{done}') AS SELECT * FROM {table}")
    old = [t.name for t in spark.catalog.listTables(pattern=f"{view}_*") if t.tableType == "EXTERNAL"]
    for name in old:
        if name not in (table, f"{view}_{done}") and name.rsplit("_", 1)[-1].isdigit():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    return upto


def read_by_host(spark: SparkSession, path: str, view: str) -> DataFrame:
    """All stored rows in the host layout: the compacted ones and those of the batches since."""
    done = compacted_upto(spark, view)
    rows = fresh_batches(spark, path, done)
    return rows if done < 0 else spark.table(view).unionByName(rows)


def metrics_rows(metrics: DataFrame) -> DataFrame:
    """The columns of the metrics table, one row per event, warm-up rows included."""
    return metrics.select(*METRICS_COLUMNS)


def alert_rows(alerts: DataFrame) -> DataFrame:
    """New alerts as stored: linked to their metrics row by event_id, status new."""
    return alerts.selectExpr(
        "alert_id", "host_id", "service_name", "triggered_at", "raw_score", "threshold", "severity",
        "metric_snapshot", "event_id", "'new' AS status", "is_early_warning",
        "predicted_breach_minutes", "triggered_at AS updated_at",
    )


def new_hosts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Hosts of `incoming` that are not stored yet, one row each."""
    return (
        incoming.groupBy("host_id")
        .agg(F.min("service_name").alias("service_name"))
        .join(existing.select("host_id"), "host_id", "left_anti")
    )


def upsert_hosts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Existing hosts unchanged, plus the new ones."""
    return existing.select("host_id", "service_name").unionByName(new_hosts(incoming, existing))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    """Rows whose key has no parent row; null keys count as having none to look for."""
    known = parents.select(F.col(parent_key or key).alias(key))
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left_anti")


def with_parent(rows: DataFrame, parents: DataFrame, key: str, parent_key: str | None = None) -> DataFrame:
    known = parents.select(F.col(parent_key or key).alias(key))
    return rows.join(known, key, "left_semi")


def latest_status(log: DataFrame) -> DataFrame:
    """Current status per alert from an append-only log (alert_id, status, updated_at).

    At equal times the later state of the lifecycle wins. This is a plain aggregate, so a
    long history of one alert is reduced before the shuffle.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in ALERT_STATUSES]), F.col("status"))
    return log.groupBy("alert_id").agg(
        F.max_by("status", F.struct("updated_at", order)).alias("status"),
        F.max("updated_at").alias("updated_at"),
    )


def with_status(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts with their current status; new where the log has none."""
    current = latest_status(log)
    stored = alerts.drop("status", "updated_at")
    return stored.join(current, "alert_id", "left").withColumn(
        "status", F.coalesce("status", F.lit("new"))
    )


def param_sql(spark: SparkSession, text: str, args: dict, **tables: DataFrame) -> DataFrame:
    """Run a parameterised query (:name markers) over the given tables ({name} markers)."""
    return spark.sql(text, args=args, **tables)

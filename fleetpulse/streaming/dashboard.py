"""Tumbling aggregates that follow the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.config import METRICS
from fleetpulse.operators.dashboard import BUCKET_SECONDS, bucket
from fleetpulse.sources.tables import append_batch
from fleetpulse.streaming.detect import use_rocksdb


def partial_sums(telemetry: DataFrame) -> DataFrame:
    """Sum and count of each metric per host and bucket, to be added up when read."""
    sums = [F.sum(m).alias(f"{m}_sum") for m in METRICS] + [F.count(m).alias(f"{m}_count") for m in METRICS]
    return telemetry.groupBy(bucket().alias("time"), "host_id").agg(*sums)


def run_dashboard(telemetry: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Store each batch's partial sums by day; `current` adds them up.

    No state and no watermark: a row counts however late it is, and a batch that is run again
    replaces its own folder.
    """
    return (
        telemetry.writeStream.foreachBatch(lambda rows, batch_id: append_batch(partial_sums(rows), out, batch_id, date_col="time"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def current(stored: DataFrame) -> DataFrame:
    """Average of each metric per bucket and host over all stored batches."""
    return stored.groupBy("time", "host_id").agg(*[(F.sum(f"{m}_sum") / F.sum(f"{m}_count")).alias(m) for m in METRICS])


def compacted(stored: DataFrame) -> DataFrame:
    """The same partial sums with one row per bucket and host, to replace old batches with."""
    kept = [f"{m}_{part}" for m in METRICS for part in ("sum", "count")]
    return stored.groupBy("time", "host_id").agg(*[F.sum(c).alias(c) for c in kept])


def windowed(telemetry: DataFrame, within: str, seconds: int = BUCKET_SECONDS) -> DataFrame:
    """Average of each metric per tumbling window and host; a window is closed `within` after its end, by event time."""
    windows = telemetry.withWatermark("ts", within).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "host_id")
    return windows.agg(*[F.avg(m).alias(m) for m in METRICS]).select(F.col("w.start").alias("time"), "host_id", *METRICS)


def run_windows(
    telemetry: DataFrame, out: str, checkpoint: str, within: str = "1 hour", trigger: dict | None = None
) -> StreamingQuery:
    """Store the windows that each batch changed, with their value so far; `latest` gives the newest value of each.

    The running sums are state of the query, so a stored row is a whole value and a reader adds nothing up. A batch
    that is run again replaces its own folder, which makes the table an upsert by (time, host_id). Rows later than
    `within` don't count, and closed windows leave the state; `run_dashboard` is the form without that limit.
    """
    use_rocksdb(telemetry.sparkSession)
    return (
        windowed(telemetry, within)
        .writeStream.outputMode("update")
        .foreachBatch(lambda rows, batch_id: append_batch(rows, out, batch_id, date_col="time"))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"}))
        .start()
    )


def latest(stored: DataFrame) -> DataFrame:
    """The value that the newest batch stored for each window and host."""
    return stored.groupBy("time", "host_id").agg(*[F.max_by(m, "batch").alias(m) for m in METRICS])

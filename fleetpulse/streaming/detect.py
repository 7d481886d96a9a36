"""Streaming detection with per-host state."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import (
    QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener,
)
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from fleetpulse.config import DETECTOR, METRICS, DetectorConfig
from fleetpulse.functions.online import advance
from fleetpulse.operators.alerts import alert_records
from fleetpulse.operators.model import version_of
from fleetpulse.operators.threshold import SEVERITY
from fleetpulse.sources.messages import check_telemetry, encode, quarantine
from fleetpulse.sources.tables import append_batch, with_parent
from fleetpulse.streaming.state import HostState

_SNAPSHOT = "struct<" + ",".join(f"{m}:double" for m in METRICS) + ">"
_OUTPUT = (
    "event_id string, host_id string, service_name string, ts timestamp, "
    + ", ".join(f"{m} double" for m in METRICS)
    + ", injected_anomaly_type string, n long, features array<double>, raw_score double, "
    "ewma_mean double, ewma_std double, threshold double, is_anomaly boolean, "
    f"predicted_breach_minutes double, published boolean, recent_metrics array<{_SNAPSHOT}>"
)
# rows of a host that are worked on at once; their windows take some kilobytes each
SLICE_ROWS = 2000
_INPUT = ["event_id", "host_id", "service_name", "ts", *METRICS, "injected_anomaly_type"]


class HostProcessor(StatefulProcessor):
    """Judges the events of each host in order; the host's state lives in named parts, see streaming.state."""

    def __init__(self, score_col: str | None, config: DetectorConfig, idle_seconds: float | None) -> None:
        self.score_col, self.config, self.idle_seconds, self.slice_rows = score_col, config, idle_seconds, SLICE_ROWS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = HostState(handle, self.config, trains=self.score_col is None)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # Spark's own assembly of the result warns about all-null columns
        warnings.filterwarnings("ignore", category=FutureWarning)
        rows = pd.concat(list(rows), ignore_index=True).sort_values(["ts", "event_id"], ignore_index=True)
        carried = self.state.load(len(rows))
        before, features = int(carried["n"]), []
        for start in range(0, len(rows), self.slice_rows):
            judged = self._judge(rows.iloc[start : start + self.slice_rows].reset_index(drop=True), carried)
            features.append(np.stack(judged["features"].to_numpy()))
            yield judged
        self.state.save(before, carried, features)
        if self.idle_seconds is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            now = timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + int(self.idle_seconds * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        return iter(())

    def _judge(self, rows: pd.DataFrame, carried: dict[str, np.ndarray]) -> pd.DataFrame:
        times = rows["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        given = rows[self.score_col].to_numpy(dtype=float) if self.score_col else None
        found = advance(carried, rows[list(METRICS)].to_numpy(dtype=float), times, self.config, given)
        candidate = found["is_anomaly"] | ~np.isnan(found["predicted_breach_minutes"])
        windows = found["recent"][candidate].transpose(0, 2, 1)
        whole = ~np.isnan(windows).any(axis=2)
        recent = np.full(len(rows), None, dtype=object)
        for at, window, here in zip(np.flatnonzero(candidate), windows.tolist(), whole.tolist()):
            recent[at] = [dict(zip(METRICS, s)) for s, is_whole in zip(window, here) if is_whole]
        return rows[_INPUT].assign(
            n=found["n"],
            features=list(found["features"]),
            raw_score=found["raw_score"],
            ewma_mean=found["ewma_mean"],
            ewma_std=found["ewma_std"],
            threshold=found["threshold"],
            is_anomaly=found["is_anomaly"],
            predicted_breach_minutes=found["predicted_breach_minutes"],
            published=found["published"],
            recent_metrics=recent,
        )


def use_rocksdb(spark: SparkSession) -> None:
    """Named state and large state need the RocksDB store; queries started from now on use it."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    )
    # a batch then writes its changes and not a snapshot of the store
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def detect_stream(
    telemetry: DataFrame, score_col: str | None = None, config: DetectorConfig = DETECTOR, idle_seconds: float | None = None
) -> DataFrame:
    """Metrics rows with a published flag; the state of each host lives in the checkpoint.

    Rows of one micro-batch are processed in (ts, event_id) order; across batches arrival
    order counts. Limit the batch size at the source (files or offsets per trigger), since a
    host's rows of one batch are held together. With idle_seconds, a host that sends nothing for
    so long is forgotten and starts over with a warm-up (its timer needs a trigger that goes on, not
    availableNow, which waits for the last timer); otherwise states are kept for ever.
    """
    use_rocksdb(telemetry.sparkSession)
    columns = [*_INPUT] + ([score_col] if score_col and score_col not in _INPUT else [])
    judged = (
        telemetry.select(*columns)
        .groupBy("host_id")
        .transformWithStateInPandas(
            HostProcessor(score_col, config, idle_seconds), _OUTPUT, "Append", "None" if idle_seconds is None else "ProcessingTime"
        )
    )
    # on the way back from pandas NaN becomes null; readings are never null, so they get it back,
    # while a feature that is NaN is stored as null
    judged = judged.withColumns({m: F.expr(f"coalesce({m}, CAST('NaN' AS DOUBLE))") for m in METRICS})
    return judged.selectExpr("*", f"{SEVERITY} AS severity", f"{version_of(config)} AS model_version")


def deduplicated(telemetry: DataFrame, within: str | None = None) -> DataFrame:
    """Drop repeated event_ids (off unless asked for).

    Without a span there is no watermark, so no first copy is ever taken for a repeat; the price is one id per
    event in the state for ever. With a span, such as "1 hour", repeats are known for so long after the event, by
    event time, and then forgotten; rows that arrive later than that are left out, and LateRows counts them.
    """
    use_rocksdb(telemetry.sparkSession)
    if within is None:
        return telemetry.dropDuplicates(["event_id"])
    return telemetry.withWatermark("ts", within).dropDuplicatesWithinWatermark(["event_id"])


class LateRows(StreamingQueryListener):
    """Stores how many rows each batch of a query left out for being late: batch_id, reject_reason, rows.

    Nobody can wait for the listener, so a batch's folder is moved into place with its file in it, as one that is
    seen empty can't be read.
    """

    def __init__(self, spark: SparkSession, query_name: str, out: str) -> None:
        self.spark, self.query_name, self.out, self.run = spark, query_name, out, None

    def onQueryStarted(self, event: QueryStartedEvent) -> None:  # noqa: N802
        if event.name == self.query_name:
            self.run = event.runId

    def onQueryProgress(self, event: QueryProgressEvent) -> None:  # noqa: N802
        progress = event.progress
        rows = sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)
        if progress.name == self.query_name and rows:
            late = self.spark.createDataFrame([(progress.batchId, "late", rows)], LATE_ROWS).selectExpr("*", "batch_id AS batch")
            late.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.out)

    def onQueryIdle(self, event: QueryIdleEvent) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:  # noqa: N802
        if event.runId == self.run:
            self.spark.streams.removeListener(self)


LATE_ROWS = "batch_id bigint, reject_reason string, rows bigint"


def run_detection(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    score_col: str | None = None,
    config: DetectorConfig = DETECTOR,
    trigger: dict | None = None,
    dedup: bool | str = False,
    publish: Callable[[DataFrame], None] | None = None,
    hosts: DataFrame | None = None,
    idle_seconds: float | None = None,
) -> StreamingQuery:
    """Decode, detect and store: folders metrics, alerts and alert_messages under `out`.

    A batch that is run again after a failure overwrites its own folders, and alert ids do
    not depend on the run, so every event and alert is stored once. `publish` also gets each
    batch of alert messages, for example to send them to a topic. With a hosts table, events of
    hosts that are not in it are left out; `run_quarantine` with the same table stores them. dedup may
    be a span of event time, see `deduplicated`; the counts of late rows then go to `late` under `out`.
    """
    telemetry = check_telemetry(messages).filter("reject_reason IS NULL").selectExpr(
        "* EXCEPT (key, value, reject_reason, injected_anomaly)",
        "CASE WHEN injected_anomaly.active THEN injected_anomaly.type END AS injected_anomaly_type",
    )
    if hosts is not None:
        telemetry = with_parent(telemetry, hosts, "host_id")
    if dedup:
        telemetry = deduplicated(telemetry, dedup if isinstance(dedup, str) else None)
    spark = messages.sparkSession
    name = f"detection-{uuid.uuid4().hex}"
    if isinstance(dedup, str):
        spark.streams.addListener(LateRows(spark, name, f"{out}/late"))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        append_batch(batch, f"{out}/metrics", batch_id, date_col="ts")
        stored = spark.read.schema(batch.schema).parquet(f"{out}/metrics/batch={batch_id}").select(*batch.columns)  # may have no file
        alerts = alert_records(
            stored.filter("published").withColumn("is_early_warning", ~F.col("is_anomaly"))
        )
        append_batch(alerts, f"{out}/alerts", batch_id)
        append_batch(encode(alerts), f"{out}/alert_messages", batch_id)
        if publish:
            publish(encode(spark.read.schema(alerts.schema).parquet(f"{out}/alerts/batch={batch_id}")))

    return (
        detect_stream(telemetry, score_col, config, idle_seconds)
        .writeStream.queryName(name)
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def run_quarantine(
    messages: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, hosts: DataFrame | None = None
) -> StreamingQuery:
    """Store rejected messages with their reason; with a hosts table also those of other hosts."""
    checked = check_telemetry(messages)
    if hosts is not None:
        known = hosts.select("host_id", F.lit(True).alias("_known")).distinct()
        checked = checked.join(known, "host_id", "left").withColumn(
            "reject_reason", F.coalesce("reject_reason", F.when(F.col("_known").isNull(), "unknown_host"))
        )
    return (
        quarantine(checked)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def stored(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All batches of a stored table; the day column ds, if there is one, is kept for pruning."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path).drop("batch")

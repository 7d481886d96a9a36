"""Investigation that follows the alert stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from fleetpulse.config import INVESTIGATION, InvestigationConfig
from fleetpulse.plans.investigate import investigate
from fleetpulse.sources.messages import decode_alerts
from fleetpulse.sources.tables import append_batch
from fleetpulse.streaming.detect import use_rocksdb


def run_investigation(
    messages: DataFrame,
    tables: Callable[[], tuple[DataFrame, DataFrame, DataFrame, DataFrame]],
    out: str,
    checkpoint: str,
    config: InvestigationConfig = INVESTIGATION,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Diagnose each batch of alert messages, such as the folder alert_messages that the detection writes.

    `tables` returns metrics, logs, deploys and runbooks as they are when the batch starts. An alert whose message
    comes again, say because the detection ran its batch a second time, is not investigated again; the state for
    that is an id an alert.
    """
    use_rocksdb(messages.sparkSession)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # the batch is read by several joins; store its alerts once
        append_batch(batch, f"{out}/alerts", batch_id)
        alerts = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/alerts/batch={batch_id}")
        append_batch(investigate(alerts, *tables(), config), f"{out}/diagnoses", batch_id)

    return (
        decode_alerts(messages)
        .dropDuplicates(["alert_id"])
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )

"""Detection against injected labels: events, episodes and delay.

An episode is a run of consecutive events of a host with one label. It counts as detected if the detection flags one of
its events; the delay is the time from its first event to the first one flagged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.config import LAYOUT, LayoutConfig
from fleetpulse.operators.series import CHUNK_ORDER, over_chunks

# Name under which rows without a label are reported, and the one for all rows.
NO_LABEL, ALL = "none", "all"


def episodes(judged: DataFrame, layout: LayoutConfig = LAYOUT) -> DataFrame:
    """host_id, first_event, started_at, label, first_flagged_at (null: not detected): a row an episode.

    judged: host_id, event_id, ts, injected_anomaly_type, is_anomaly, predicted_breach_minutes. Starts are found in
    chunks of a host's series; only starts and flagged events of episodes go on, and each takes the last start up to it.
    """
    flag = "coalesce(is_anomaly, false) OR predicted_breach_minutes IS NOT NULL"
    rows = judged.selectExpr("host_id", "event_id", "ts", "injected_anomaly_type AS label", f"{flag} AS flagged")
    before = f"lag(label) OVER ({CHUNK_ORDER})"
    marked = over_chunks(rows, 1, lambda df: df.selectExpr("*", f"label IS NOT NULL AND NOT coalesce(label = {before}, false) AS starts"), layout)
    labelled = marked.filter("label IS NOT NULL")
    starts = Window.partitionBy("host_id").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    few = labelled.filter("starts OR flagged").withColumn("first_event", F.max(F.expr("CASE WHEN starts THEN n END")).over(starts))
    return few.groupBy("host_id", "first_event").agg(
        F.min("ts").alias("started_at"), F.min("label").alias("label"), F.min(F.expr("CASE WHEN flagged THEN ts END")).alias("first_flagged_at")
    )


def detection_quality(judged: DataFrame, layout: LayoutConfig = LAYOUT) -> DataFrame:
    """A row for each label, for rows without one (`none`) and for all rows (`all`).

    label, events, flagged_events, event_recall, precision, episodes, detected_episodes, episode_recall,
    mean_delay_seconds. precision, in the row `all`, is the share of flagged events that have a label.
    """
    flag = F.expr("coalesce(is_anomaly, false) OR predicted_breach_minutes IS NOT NULL")
    per_event = judged.groupBy(F.coalesce("injected_anomaly_type", F.lit(NO_LABEL)).alias("label")).agg(
        F.count("*").alias("events"), F.count_if(flag).alias("flagged_events")
    )
    delay = (F.unix_micros("first_flagged_at") - F.unix_micros("started_at")) / 1e6
    per_episode = episodes(judged, layout).groupBy("label").agg(
        F.count("*").alias("episodes"), F.count("first_flagged_at").alias("detected_episodes"), F.sum(delay).alias("delay")
    )
    rows = per_event.join(per_episode, "label", "left")
    sums = ["events", "flagged_events", "episodes", "detected_episodes", "delay"]
    hits = F.sum(F.when(F.col("label") != NO_LABEL, F.col("flagged_events")))
    whole = rows.groupBy().agg(*[F.sum(c).alias(c) for c in sums], hits.alias("hits"), F.sum(F.when(F.col("label") != NO_LABEL, F.col("events"))).alias("labelled"))
    whole = whole.withColumn("label", F.lit(ALL))
    rows = rows.withColumns({"hits": F.col("flagged_events"), "labelled": F.col("events")}).unionByName(whole.select(*rows.columns, "hits", "labelled"))
    own = F.col("label") != NO_LABEL
    ratio = lambda a, b: F.when(own, F.col(a) / F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    return rows.select(
        "label", "events", "flagged_events", ratio("hits", "labelled").alias("event_recall"),
        F.when(F.col("label") == ALL, F.col("hits") / F.nullif(F.col("flagged_events").cast("double"), F.lit(0.0))).alias("precision"),
        F.coalesce("episodes", F.lit(0).cast("long")).alias("episodes"),
        F.coalesce("detected_episodes", F.lit(0).cast("long")).alias("detected_episodes"),
        ratio("detected_episodes", "episodes").alias("episode_recall"),
        (F.col("delay") / F.nullif(F.col("detected_episodes").cast("double"), F.lit(0.0))).alias("mean_delay_seconds"),
    )

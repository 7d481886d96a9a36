"""The next key in ascending order, without a sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.session import materialize


def next_keys(keys: DataFrame, key: str) -> DataFrame:
    """key, next: distinct non-null keys, each with the next larger one; the last gets the first.

    A range-partitioned sort gives every key a place (partition and row); neighbours meet by place, and the
    last key of a partition goes on to the first key of the next one in use. Only those first keys, one for
    each partition of the sort, are ordered in a single task.
    """
    k = keys.select(F.col(key).alias("key")).filter("key IS NOT NULL").distinct()
    placed = materialize(k.orderBy("key").withColumn("at", F.monotonically_increasing_id()), "order")
    heads = placed.filter("at & 8589934591L = 0").select(F.shiftright("at", 33).alias("part"), F.col("key").alias("head"))
    in_order = Window.orderBy("part")
    heads = heads.select("part", F.lead("head").over(in_order).alias("after"), F.min("head").over(Window.partitionBy()).alias("first"))
    linked = placed.join(placed.select((F.col("at") - 1).alias("at"), F.col("key").alias("next")), "at", "left")
    out = linked.withColumn("part", F.shiftright("at", 33)).join(heads, "part", "left")
    return out.select(F.col("key").alias(key), F.coalesce("next", "after", "first").alias("next"))

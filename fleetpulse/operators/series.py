"""Per-host event series: numbering, and window frames over bounded chunks.

A host may hold a large share of all events, so nothing here puts a whole host in one
window partition. `number_events` counts events per host and short time cell, adds the counts
up to offsets in two levels, and ranks rows inside a cell. `over_chunks` cuts a numbered series
into chunks of a fixed number of events; each chunk also gets the last rows of the chunk before
it, as many as the widest frame reaches back, and those copies are dropped afterwards.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.config import LAYOUT, LayoutConfig

KEY = "host_id"
CHUNK_ORDER = f"PARTITION BY {KEY}, _chunk ORDER BY n"


_NUMBERED = {"fleetpulse.series": True}


def is_numbered(events: DataFrame) -> bool:
    """Whether the column n comes from number_events; any other column of that name doesn't count."""
    return any(f.name == "n" and f.metadata.get("fleetpulse.series") for f in events.schema.fields)


def cell_offsets(rows: DataFrame, keys: Sequence[str], layout: LayoutConfig = LAYOUT) -> DataFrame:
    """keys, _cell, _offset: how many rows of the keys stand in cells before each cell; rows need _cell.

    Counts are added up inside groups of `cells_per_group` cells, and the groups' counts per key.
    """
    by = ", ".join(keys)
    group = f"CAST(floor(_cell / {layout.cells_per_group}D) AS BIGINT) AS _group"
    before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    counts = rows.groupBy(*keys, "_cell").count().selectExpr("*", group)
    groups = counts.groupBy(*keys, "_group").agg(F.sum("count").alias("_events")).selectExpr(
        *keys, "_group", f"coalesce(sum(_events) OVER (PARTITION BY {by} ORDER BY _group {before}), 0) AS _base"
    )
    inside = counts.selectExpr(
        *keys, "_cell", "_group", f"coalesce(sum(count) OVER (PARTITION BY {by}, _group ORDER BY _cell {before}), 0) AS _before"
    )
    return inside.join(groups, [*keys, "_group"]).selectExpr(*keys, "_cell", "_base + _before AS _offset")


def number_events(events: DataFrame, layout: LayoutConfig = LAYOUT) -> DataFrame:
    """Add n = 1, 2, ... per host in (ts, event_id) order; an input column n is replaced.

    Rows are ranked in cells of `cell_micros`; the cells' counts are added up inside groups of
    `cells_per_group` cells, and the groups' counts per host, so no window holds more than the
    events of a cell, the cells of a group or the groups of a host.
    """
    if is_numbered(events):
        return events
    cell = f"CAST(floor(unix_micros(ts) / {layout.cell_micros}D) AS BIGINT) AS _cell"
    offsets = cell_offsets(events.selectExpr(KEY, cell), [KEY], layout)
    ranked = events.drop("n").selectExpr("*", cell).selectExpr(
        "*", f"row_number() OVER (PARTITION BY {KEY}, _cell ORDER BY ts, event_id) AS _rank"
    )
    numbered = ranked.join(offsets, [KEY, "_cell"]).selectExpr("* EXCEPT (_cell, _rank, _offset)", "_offset + _rank AS n")
    return numbered.withMetadata("n", _NUMBERED)


def last_rows(count: int) -> str:
    """Window of the current row and the count - 1 rows before it, in a chunk."""
    return f"OVER ({CHUNK_ORDER} ROWS BETWEEN {count - 1} PRECEDING AND CURRENT ROW)"


def previous_rows(count: int) -> str:
    """Window of the count rows before the current one, in a chunk."""
    return f"OVER ({CHUNK_ORDER} ROWS BETWEEN {count} PRECEDING AND 1 PRECEDING)"


def spread(df: DataFrame, layout: LayoutConfig, *keys: str) -> DataFrame:
    """Partition by keys for work that is heavy for its bytes.

    Merging small shuffle partitions by size would leave too few tasks, so the number is fixed:
    the configured shuffle partitions, but at least a few per core, which evens them out.
    """
    session = df.sparkSession
    configured = int(session.conf.get("spark.sql.shuffle.partitions"))
    per_core = layout.tasks_per_core * session.sparkContext.defaultParallelism
    return df.repartition(max(configured, per_core), *keys)


def over_chunks(
    events: DataFrame,
    lookback: int,
    build: Callable[[DataFrame], DataFrame],
    layout: LayoutConfig = LAYOUT,
) -> DataFrame:
    """Apply `build` so that every row sees its `lookback` previous rows.

    `build` may use any window of `last_rows` or `previous_rows` that reaches back at most
    `lookback` rows.
    """
    rows = max(layout.chunk_rows, lookback + 1)
    chunked = (
        number_events(events, layout)
        .selectExpr("*", f"(n - 1) div {rows} AS _own")
        .selectExpr(
            "*",
            f"""explode(CASE WHEN (n - 1) % {rows} >= {rows - lookback} THEN array(_own, _own + 1)
                ELSE array(_own) END) AS _chunk""",
        )
    )
    return build(spread(chunked, layout, KEY, "_chunk")).filter("_chunk = _own").drop("_chunk", "_own")

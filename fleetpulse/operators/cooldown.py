"""Per-key cooldown: keep a row only if no kept row of its key is closer than the limit.

Keeping a row depends on which row was kept before it, so this is a recurrence and no window
function expresses it. To keep a busy host out of a single task, a key's rows are cut into spans
of a number of rows, and the walk is composed like a prefix sum over functions:

1. rows of one time are one candidate, the first of them; counts per second give each its span;
2. per span: an exit table, the function from the clock at its start to the clock at its end. Only
   rows within one cooldown of the span start (and the next one) can be the first one kept, and
   rows that lead to the same end are merged;
3. upwards: the tables of FAN spans that follow each other are composed into one, level by level,
   until a key has FAN tables at most;
4. downwards: these are walked, then the tables below each of them, which gives the clock at the
   start of each span;
5. per span: with the clock known, walk its rows and emit the kept ones.

No step holds a key's rows: a group holds the rows of a span, or FAN tables, and a table has a row
at most for each different time within one cooldown. The kept rows get their other columns by a join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.config import DETECTOR, LAYOUT, LayoutConfig
from fleetpulse.operators.series import cell_offsets
from fleetpulse.session import materialize

FAN = 64  # exit tables composed in one group


def last_kept_from(times: np.ndarray, limit: int) -> np.ndarray:
    """For each start row, the time of the last row kept when the walk starts there."""
    rows = len(times)
    follow = np.searchsorted(times, times + limit)
    end = np.where(follow == rows, np.arange(rows), follow)
    while True:  # pointer jumping: doubles the steps covered each round
        further = end[end]
        if np.array_equal(further, end):
            return times[end]
        end = further


def kept_rows(times: np.ndarray, limit: int, clock: int | None) -> list[int]:
    """Indices kept in ascending times when the last kept time so far is `clock`."""
    kept = []
    at = 0 if clock is None else int(np.searchsorted(times, clock + limit))
    while at < len(times):
        kept.append(at)
        at = int(np.searchsorted(times, times[at] + limit))
    return kept


def exit_table(times: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(upto, leave) of a walk over ascending times, entered with a clock before the first of them.

    The clock at the end is leave[i] for the first i with upto[i] >= clock + limit, and the clock
    itself where there is none.
    """
    return _merged(times, last_kept_from(times, limit), int(times[0]), limit)


def compose(
    first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], start: int, limit: int
) -> tuple[np.ndarray, np.ndarray]:
    """Exit table of two walks, one after the other; start is the time of the first walk's first row."""
    upto, leave = first
    at = np.searchsorted(second[0], leave + limit)
    inside = at < len(second[0])
    through = np.where(inside, second[1][np.minimum(at, len(second[1]) - 1)], leave)
    beyond = second[0] > upto[-1]
    joined = np.append(upto, second[0][beyond]), np.append(through, second[1][beyond])
    return _merged(*joined, start, limit)


def _merged(upto: np.ndarray, leave: np.ndarray, start: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """A table without the entries that no clock before `start` reaches; equal exits are one entry."""
    entries = int(np.searchsorted(upto, start + limit)) + 1
    upto, leave = upto[:entries], leave[:entries]
    change = np.append(leave[1:] != leave[:-1], True)
    return upto[change], leave[change]


def _tables(rows: pa.Table) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(number, start, upto, leave) of each exit table, in order."""
    rows = rows.sort_by([("_no", "ascending"), ("_upto", "ascending")])
    numbers, starts, upto, leave = (rows[c].to_numpy() for c in ("_no", "_start", "_upto", "_exit"))
    first = np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1]))
    last = np.append(first[1:], len(numbers))
    return [(int(numbers[a]), int(starts[a]), upto[a:b], leave[a:b]) for a, b in zip(first, last)]


def apply_cooldown(
    candidates: DataFrame,
    keys: Sequence[str] = ("host_id",),
    time_col: str = "ts",
    order_col: str = "n",
    seconds: float = DETECTOR.cooldown_seconds,
    layout: LayoutConfig = LAYOUT,
    fan: int = FAN,
) -> DataFrame:
    """Rows of `candidates` that pass the cooldown; exactly at the limit passes.

    order_col must identify a row within its key; of rows with one time only the first in this order
    can pass. Rows without a time or with a null key don't pass. The input is read twice and its keys
    and times are stored, so pass a stored table or something cheap to recompute.
    """
    limit = int(seconds * 1_000_000)
    keys = list(keys)
    key_fields = [candidates.schema[k] for k in keys]

    def schema(*names: str) -> T.StructType:
        return T.StructType([*key_fields, *[T.StructField(name, T.LongType()) for name in names]])

    table_schema, clock_schema = schema("_no", "_start", "_upto", "_exit"), schema("_no", "_clock")

    def as_rows(key: tuple, number: int, start: int, upto: np.ndarray, leave: np.ndarray) -> pa.Table:
        constant = {"_no": np.full(len(upto), number), "_start": np.full(len(upto), start)}
        return _with_key(key, keys, {**constant, "_upto": upto, "_exit": leave})

    def exits(key: tuple, rows: pa.Table) -> pa.Table:
        times = np.sort(rows["_t"].to_numpy())
        return as_rows(key[:-1], key[-1].as_py(), int(times[0]), *exit_table(times, limit))

    def composed(key: tuple, rows: pa.Table) -> pa.Table:
        (_, start, *whole), *rest = _tables(rows)
        for _, _, *table in rest:
            whole = compose(tuple(whole), tuple(table), start, limit)
        return as_rows(key[:-1], key[-1].as_py(), start, *whole)

    def walk(key: tuple, rows: pa.Table, clock: int | None) -> pa.Table:
        numbers, found = [], []
        for number, _, upto, leave in _tables(rows):
            numbers.append(number)
            found.append(clock)
            at = 0 if clock is None else int(np.searchsorted(upto, clock + limit))
            if at < len(upto):
                clock = int(leave[at])
        return _with_key(key, keys, {"_no": pa.array(numbers, pa.int64()), "_clock": pa.array(found, pa.int64())})

    def from_start(key: tuple, rows: pa.Table) -> pa.Table:
        return walk(key, rows, None)

    def from_clock(key: tuple, rows: pa.Table, clock: pa.Table) -> pa.Table:
        return walk(key[:-1], rows, clock["_clock"][0].as_py())

    def keep(key: tuple, rows: pa.Table, clock: pa.Table) -> pa.Table:
        rows = rows.sort_by("_t")
        kept = kept_rows(rows["_t"].to_numpy(), limit, clock["_clock"][0].as_py())
        return rows.select([*keys, order_col]).take(pa.array(kept, pa.int64()))

    cell = F.floor(F.unix_micros(time_col) / F.lit(layout.cell_micros)).alias("_cell")
    times = candidates.groupBy(*keys, cell, F.unix_micros(time_col).alias("_t")).agg(F.min(order_col).alias(order_col))
    number = F.floor(F.col("_offset") / F.lit(layout.cooldown_span_rows)).alias("_no")
    spans = times.join(cell_offsets(times, keys, layout), [*keys, "_cell"]).select(*keys, order_col, "_t", number)
    spans = materialize(spans, "cooldown-spans")
    top = spans.agg(F.max("_no")).first()[0] or 0

    block = F.floor(F.col("_no") / F.lit(fan)).alias("_block")
    levels = [spans.groupBy(*keys, "_no").applyInArrow(exits, table_schema)]
    while top >= fan:
        levels[-1] = materialize(levels[-1], "cooldown-exits")
        levels.append(levels[-1].groupBy(*keys, block).applyInArrow(composed, table_schema))
        top //= fan
    clocks = levels.pop().groupBy(*keys).applyInArrow(from_start, clock_schema)
    for table in reversed(levels):
        clocks = table.groupBy(*keys, block).cogroup(clocks.groupBy(*keys, "_no")).applyInArrow(from_clock, clock_schema)

    kept_schema = T.StructType([*key_fields, candidates.schema[order_col]])
    kept = spans.groupBy(*keys, "_no").cogroup(clocks.groupBy(*keys, "_no")).applyInArrow(keep, kept_schema)
    passed = candidates.join(kept, [*keys, order_col], "left_semi")
    return passed.select(*candidates.columns)


def _with_key(key: tuple, names: Sequence[str], columns: dict) -> pa.Table:
    rows = len(next(iter(columns.values())))
    constant = {
        name: pa.array([value.as_py()] * rows, value.type) for name, value in zip(names, key)
    }
    return pa.table({**constant, **columns})

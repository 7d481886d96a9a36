"""Compare registered queries with their DuckDB SQL: python tests/check.py [sf] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as spark_entry  # noqa: E402
from fleetpulse.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if value is None or (not isinstance(value, (list, dict)) and pd.isna(value)):
        return None
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    if hasattr(value, "item"):
        value = value.item()
    return float(value) if isinstance(value, int) and not isinstance(value, bool) else value


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_plain(v) for v in row) for row in frame.itertuples(index=False, name=None)]
    return sorted(rows, key=repr)


def compare(left: pd.DataFrame, right: pd.DataFrame) -> str | None:
    """None if equal, else a description of the first difference."""
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = canonical(left), canonical(right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    differing = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(differing)} rows differ, first {differing[0]}" if differing else None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf_dir), spark_entry.queries(), spark_entry.oracle_sql()
    print("oracle without query:", sorted(set(oracles) - set(queries)))
    print("query without oracle:", sorted(set(queries) - set(oracles)))
    failed = 0
    for name in sys.argv[2:] or queries:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            spent, started = time.time() - started, time.time()
            if name not in oracles:
                print(f"{name:28} {spent:6.1f}s rows={len(got)}", flush=True)
                continue
            want = con.execute(oracles[name]).df()
            problem = compare(got, want)
        except Exception as error:  # keep going: report all queries
            problem, spent = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - started
            got = []
        failed += problem is not None
        print(f"{name:28} {spent:6.1f}s sql {time.time() - started:5.1f}s rows={len(got)} {problem or 'ok'}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""Run a registered query and its SQL side by side and compare whole results.

``python -m tests.oracle [folder] [query ...]`` prints one line per query.
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import pandas as pd

from cartulary.plans import QUERIES
from cartulary.plans.bindings import Bindings


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(value: object) -> object:
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value.item() if hasattr(value, "item") else value


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    rows = [tuple(_plain(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


def kinds_of(frame: pd.DataFrame) -> dict[str, set[str]]:
    return {c: {type(_plain(v)).__name__ for v in frame[c].astype(object)} - {"NoneType"} for c in frame.columns}


def problem(spark, con, folder: str, name: str) -> str | None:
    """What differs, or None."""
    q = QUERIES[name]
    got = q.build(Bindings(spark, folder)).toPandas()
    if q.sql is None:
        return None
    want = con.execute(q.sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if got.empty and want.empty:
        return "both sides are empty"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        only = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return f"{len(a)} rows != {len(b)} rows; only here {only[0]}; only there {only[1]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    if kinds_of(got) != kinds_of(want):
        return f"kinds {kinds_of(got)} != {kinds_of(want)}"
    return None


def main() -> int:
    from cartulary.session import local_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    bad = 0
    for name in args or QUERIES:
        start = time.time()
        try:
            said = problem(spark, con, folder, name)
        except Exception as error:  # report and go on with the next query
            said = "".join(traceback.format_exception_only(error))[:1500]
        bad += said is not None
        print(f"{'ok  ' if said is None else 'FAIL'} {time.time() - start:6.2f}s {name} {said or ''}", flush=True)
    print(f"{bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(min(main(), 1))

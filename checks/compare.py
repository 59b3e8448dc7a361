"""Run registered queries against their SQL and report mismatches.

    python -m checks.compare [folder] [name-part ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from checks.views import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for x in row:
            if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
                cells.append("null")
            elif isinstance(x, bool) or type(x).__name__ == "bool_":
                cells.append(str(bool(x)))
            elif isinstance(x, str):
                cells.append(x)
            else:
                try:
                    cells.append(f"{float(x):.6f}")
                except (TypeError, ValueError):
                    cells.append(str(x))
        rows.append(tuple(cells))
    return sorted(rows)


def mismatch(spark, con, name: str, folder: str) -> str | None:
    """None when query and SQL agree, else what differs."""
    got = QUERIES[name](spark, folder).toPandas()
    if name not in ORACLES:
        return None if len(got) else "no rows"
    want = con.execute(ORACLES[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} / {sorted(want.columns)}"
    left, right = _canonical(got), _canonical(want)
    if left == right:
        return None
    only_left = [x for x in left if x not in set(right)][:4]
    only_right = [x for x in right if x not in set(left)][:4]
    return f"rows {len(left)}/{len(right)}; Spark only {only_left}; SQL only {only_right}"


def main() -> None:
    from checks.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con, bad = local_session(), connect(folder), 0
    for name in QUERIES:
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = mismatch(spark, con, name, folder)
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        kind = "sql" if name in ORACLES else "rows"
        print(f"{name:32} {kind:5}{time.time() - start:6.1f}s  {problem or 'ok'}", flush=True)
    print(f"{bad} problems")


if __name__ == "__main__":
    main()

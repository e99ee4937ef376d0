"""Side-by-side comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else value + 0.0
    return value


def table(columns, rows):
    """Rows with columns in name order, as a sorted list of strings."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (
        [columns[i] for i in order],
        sorted(str(tuple(plain(r[i]) for i in order)) for r in rows),
    )


def differences(spark_df, con, sql: str) -> str | None:
    """What differs, or None."""
    got = table(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want = table([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {set(got[0]) ^ set(want[0])} differ"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return (
            f"{len(got[1])} rows here, {len(want[1])} there; only here "
            f"{sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
        )
    return None

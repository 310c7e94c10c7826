"""Run registered queries next to their SQL and compare whole results.

python tests/compare.py [sf] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    return v


def rows_of(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(
        (tuple(_norm(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False)), key=repr
    )


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    a_cols, a = rows_of(df.toPandas())
    want = con.execute(sql).fetch_df()
    b_cols, b = rows_of(want)
    if a_cols != b_cols:
        return f"columns {a_cols} != {b_cols}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    if diff:
        return f"{len(diff)} of {len(a)} rows differ, first: {diff[0][0]} != {diff[0][1]}"
    ta = {c: str(t) for c, t in zip(df.columns, [f.dataType.simpleString() for f in df.schema.fields])}
    tb = {c: str(t) for c, t in con.execute(f"SELECT column_name, column_type FROM (DESCRIBE {sql})").fetchall()}
    same = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}
    bad = {c: (ta[c], tb[c]) for c in ta if same.get(ta[c]) != tb[c]}
    return f"types differ: {bad}" if bad else None


def main() -> int:
    import __spark_entry__ as entry
    from clickloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    names = sys.argv[2:]
    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    queries, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, folder)
            if name in sqls:
                problem = compare(df, con, sqls[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as e:  # report and go on with the other queries
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        kind = "sql " if name in sqls else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:28s} {time.time() - t0:6.1f}s {problem or ''}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

"""Comparing a Spark result with DuckDB's, value by value."""

from __future__ import annotations

import datetime
import decimal
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 9)
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql: str, show: int = 4) -> str | None:
    got_cols, got = rows_of(spark_df.columns, spark_df.collect())
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if got == want:
        return None
    extra, lacking = got - want, want - got
    return (f"{sum(got.values())} rows, expected {sum(want.values())}; "
            f"extra {list(extra)[:show]} lacking {list(lacking)[:show]}")

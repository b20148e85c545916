"""Comparison of a Spark result with its DuckDB twin, order aside."""

from __future__ import annotations

import datetime
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def same_rows(spark_df, con, sql: str) -> None:
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    assert sorted(spark_df.columns) == sorted(names)
    order = sorted(names)
    at = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[i]) for i in at) for r in expected), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in spark_df.collect()), key=repr)
    assert len(got) == len(want), (len(got), len(want))
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w and not all(close(a, b) for a, b in zip(g, w, strict=True))]
    assert not wrong, (order, len(wrong), wrong[:3])


def close(a, b) -> bool:
    return a == b or isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-6 * max(1, abs(a))

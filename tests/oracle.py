"""Compare a registered query with its DuckDB twin, values rounded to 9 places, rows in any order."""

from __future__ import annotations

from collections import Counter
from pathlib import Path
from typing import Any

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value: Any) -> str:
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def same(spark: SparkSession, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = connect(sf_dir).execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert got == want, (list((got - want).items())[:2], list((want - got).items())[:2])

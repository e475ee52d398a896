"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import os
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if (p := Path(sf_dir, f"{t}.parquet")).exists():
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "-"
        v = v.item() if hasattr(v, "item") else v
        if v != v:
            return "-"
        return f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str = SF) -> None:
    left, right = spark_df.toPandas(), connection(sf_dir).sql(sql).df()
    assert sorted(left.columns) == sorted(right.columns)
    assert rows(left) == rows(right)

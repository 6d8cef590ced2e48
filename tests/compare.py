"""Compares a query's rows with those of its SQL, as sets with repeats, columns by name."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    out = pd.DataFrame({c: frame[c].map(cell) for c in frame.columns})
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(spark_frame, sql: str, con) -> None:
    got, wanted = canonical(spark_frame.toPandas()), canonical(con.execute(sql).df())
    assert list(got.columns) == list(wanted.columns)
    assert len(got) == len(wanted)
    pd.testing.assert_frame_equal(got, wanted)

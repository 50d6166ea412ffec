"""Rows of a Spark query and of its SQL in one comparable form."""

import glob
import math
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf=SF):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from '{path}'")
    return con


def plain(value):
    if value is None or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return "null"
    return repr(round(float(value), 9) + 0.0) if isinstance(value, float) else str(value)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False))

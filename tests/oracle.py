"""Compares registered queries with their SQL: python tests/oracle.py SF [NAME...]."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    """Columns and rows in order, lists as text, numbers as floats."""
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if len(df) and isinstance(next((x for x in df[c] if x is not None), None), list | np.ndarray):
            df[c] = [None if x is None else str([round(float(y), 6) if isinstance(y, float) else y for y in x]) for x in df[c]]
        elif pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable", na_position="first").reset_index(drop=True)


def difference(ours: pd.DataFrame, theirs: pd.DataFrame) -> str:
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    a, b = plain(ours), plain(theirs)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            return f"{c}: {int((~same).sum())} of {len(a)} differ, first {a[~same].iloc[0].to_dict()} and {b[~same].iloc[0].to_dict()}"
    return ""


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", "/tmp/warehouse").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sys.argv[1]), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]) or name not in sqls:
            continue
        try:
            began = time.time()
            ours = query(spark, sys.argv[1]).toPandas()
            took = time.time() - began
            found = difference(ours, con.sql(sqls[name]).df())
        except Exception as error:  # noqa: BLE001
            found, ours, took = f"{type(error).__name__}: {str(error)[:600]}", [], 0
        bad += bool(found)
        print(f"{name}: {len(ours)} rows, {took:.1f} s: {found or 'same'}", flush=True)
    sys.exit(bool(bad))

"""Run every query next to its SQL and report differences.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import numpy as np
import pandas as pd

from checks.oracle import ORACLE
from checks.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sweepframe")
        .config("spark.sql.shuffle.partitions", cpus.replace("*", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def ordered(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]) and not pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(float)
        else:
            df[c] = df[c].map(lambda x: None if pd.isna(x) else str(x))
    return df.sort_values(list(df.columns), ignore_index=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = ordered(got), ordered(want)
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            k = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{c}: {int((~same).sum())} differ, e.g. {a[k]!r} != {b[k]!r}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, bad = local_session(), connect(sf), 0
    for name in names:
        start = time.time()
        try:
            got = QUERIES[name](spark, sf).toPandas()
            note = f"{len(got)} rows"
            if name in ORACLE:
                problem = difference(got, con.execute(ORACLE[name]).df())
                note += " equal" if not problem else f" DIFF {problem}"
                bad += bool(problem)
        except Exception as e:  # report and go on with the next query
            note, bad = f"ERROR {str(e)[:600]}", bad + 1
        print(f"{name:24s} {time.time() - start:6.2f}s {note}", flush=True)
    print("problems:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())

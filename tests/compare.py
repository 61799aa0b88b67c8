"""Run registered queries on Spark and their SQL on DuckDB and report differences.

    python tests/compare.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    """None when both hold the same multiset of rows, else a short description."""
    cols = sorted(spark_df.columns)
    if cols != sorted(sql_df.columns):
        return f"columns differ: {cols} vs {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows differ: {len(spark_df)} vs {len(sql_df)}"
    text = [d[cols].astype(object).where(d[cols].notna(), None).map(
        lambda v: repr(float(v)) if isinstance(v, float) else str(v)) for d in (spark_df, sql_df)]
    a, b = (d.sort_values(cols).reset_index(drop=True) for d in text)
    bad = {c: int((a[c] != b[c]).sum()) for c in cols if (a[c] != b[c]).any()}
    if not bad:
        return None
    rows = (a != b).any(axis=1)
    return f"{int(rows.sum())} of {len(a)} rows differ; {bad}\n{a[rows].head(3).to_string()}\n{b[rows].head(3).to_string()}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    failed = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        t0 = time.time()
        try:
            got = fn(spark, sf).toPandas()
            t1 = time.time()
            msg = difference(got, con.execute(oracle[name]).df()) if name in oracle else "rows only"
            ok = msg in (None, "rows only")
        except Exception as e:  # report and go on with the next query
            t1, ok, msg, got = time.time(), False, f"{type(e).__name__}: {str(e)[:900]}", pd.DataFrame()
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} rows={len(got):7d} spark={t1 - t0:6.2f}s sql={time.time() - t1:6.2f}s"
              f"{'' if msg is None else ' ' + msg}", flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

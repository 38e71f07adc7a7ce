"""Run queries of the entry file and their SQL side by side: python -m tests.compare [SF_DIR] [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith("str"):
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or x != x else str(x))
        else:
            df[c] = df[c].astype("float64").round(9)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(run, sql: str, spark, sf_dir: str, con) -> str:
    """What differs between a query's rows and its SQL's; empty if nothing does."""
    ours, theirs = run(spark, sf_dir).toPandas(), con.sql(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} and {len(theirs)} rows"
    a, b = _sorted(ours), _sorted(theirs)
    for c in a.columns:
        unlike = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if unlike.any():
            return f"{c}: {int(unlike.sum())} rows, first {a[c][unlike].iloc[0]!r} and {b[c][unlike].iloc[0]!r}"
    return ""


def main() -> None:
    from pyspark.sql import SparkSession

    sys.path.insert(0, str(Path(__file__).parent.parent))
    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = duck(sf_dir), entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            if name in sql:
                said = difference(queries[name], sql[name], spark, sf_dir, con) or "same"
            else:
                said = f"{queries[name](spark, sf_dir).count()} rows, no SQL"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:300]}"
        print(f"{name:28} {time.time() - began:5.1f} s  {said}", flush=True)


if __name__ == "__main__":
    main()

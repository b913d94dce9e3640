"""Runs every query with SQL beside DuckDB and lists what differs: python tests/compare.py [folder] [name...]."""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def tables(folder):
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        db.sql(f"create view {name} as select * from '{path}'")
    return db


def rows(frame):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in frame), key=str)


def differs(spark, db, name, query, sql, folder):
    got = query(spark, folder)
    want = db.sql(sql)
    cols = sorted(got.columns)
    if cols != sorted(want.columns):
        return f"columns {cols} and {sorted(want.columns)}"
    a = rows(got.select(*cols).collect())
    b = rows(want.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    if a != b:
        return f"{len(a)} and {len(b)} rows; first difference {next(((x, y) for x, y in zip(a, b) if x != y), None)}"
    return ""


def main(folder="/root/testdata/sf0.001", *names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql, db = entry.queries(), entry.oracle_sql(), tables(folder)
    for name in names or sql:
        began = time.time()
        try:
            said = differs(spark, db, name, queries[name], sql[name], folder)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:400]}"
        if said:
            print(name, said, f"{time.time() - began:.1f} s", flush=True)
    print("compared", len(names or sql))


if __name__ == "__main__":
    main(*sys.argv[1:])

"""Holds registered queries against DuckDB: python -m tests.oracle [sf_dir] [name ...]"""

import math
import sys

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def plain(x):
        if isinstance(x, bool) or x is None or isinstance(x, str):
            return x
        if isinstance(x, float):
            return round(x, 5) if math.isfinite(x) else str(x)
        return round(float(x), 5) if hasattr(x, "as_tuple") else x

    return sorted((tuple(plain(r[k]) for k in order) for r in records), key=repr)


def compare(spark, sf_dir, name, query, sql):
    """None, or what differs."""
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    cols = [c[0] for c in res.description]
    want = rows(cols, res.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"{name}: columns {sorted(df.columns)} / {sorted(cols)}"
    if got != want:
        diff = next(((a, b) for a, b in zip(got, want) if a != b), ("lengths", (len(got), len(want))))
        return f"{name}: {len(got)} / {len(want)} rows, first difference {diff}"
    return None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    names = sys.argv[2:] or list(e.oracle_sql())
    for name in names:
        try:
            print(compare(s, sf, name, e.queries()[name], e.oracle_sql()[name]) or f"{name}: equal", flush=True)
        except Exception as x:
            print(f"{name}: {type(x).__name__} {str(x)[:400]}", flush=True)

"""Runs registered queries beside their SQL and compares all rows: python tests/oracle.py [sf_dir] [name ...]"""

import math
import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "isoformat"):
        return str(v)[:10]
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    return round(float(v), 6) if not math.isnan(float(v)) else None


def compare(spark, sf_dir, name, query, sql):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols, (sorted(names), cols)
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert len(got) == len(want), (len(got), len(want))
    key = lambda r: [(v is not None, str(v)) for v in r]
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert abs(x - y) <= 1e-6 * max(1.0, abs(x)), (cols, a, b)
            else:
                assert x == y, (cols, a, b)
    return len(got)


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[6]").config("spark.sql.shuffle.partitions", "6").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or [n for n in queries if not n.startswith(("op", "pipeline"))]:
        began = time.time()
        try:
            n = compare(spark, sf_dir, name, queries[name], oracles[name]) if name in oracles else f"{queries[name](spark, sf_dir).count()} (no SQL)"
            print(f"ok   {name} {n} {time.time() - began:.1f}s", flush=True)
        except Exception as e:
            print(f"FAIL {name}: {str(e)[:700]}", flush=True)

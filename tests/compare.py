"""Runs queries against their SQL: python tests/compare.py SF_DIR [NAME...]."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402


def rows(names, data):
    def plain(v):
        if hasattr(v, "item"):
            v = v.item()
        if v is None or v != v:
            return None
        return round(v, 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def views(d):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(d).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def compare(spark, d, name, con):
    t = time.time()
    df = entry.queries()[name](spark, d)
    a = rows(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    sql = entry.oracle_sql().get(name)
    if not sql:
        return f"{name}: {len(a[1])} rows, no SQL, {took:.1f} s", True
    t = time.time()
    cur = con.execute(sql)
    b = rows([c[0] for c in cur.description], cur.fetchall())
    if a == b:
        return f"{name}: {len(a[1])} rows equal, {took:.1f} s, SQL {time.time() - t:.1f} s", True
    extra, missing = [x for x in a[1] if x not in set(b[1])][:3], [x for x in b[1] if x not in set(a[1])][:3]
    return f"{name}: DIFFERS {a[0]} {b[0]} {len(a[1])} {len(b[1])}\n   only Spark {extra}\n   only SQL {missing}", False


if __name__ == "__main__":
    import tempfile

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = views(sys.argv[1])
    for n in sys.argv[2:] or entry.queries():
        try:
            print(compare(spark, sys.argv[1], n, con)[0][:1500], flush=True)
        except Exception as e:  # noqa: BLE001
            print(n, "FAILED", repr(e)[:1500], flush=True)

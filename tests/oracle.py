"""Compare registered queries with their SQL: ``python tests/oracle.py [sf_dir] [name ...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(frame, con, sql):
    """None if both give the same rows, else a message."""
    result = con.execute(sql)
    theirs = [d[0] for d in result.description]
    want = _rows(theirs, result.fetchall())
    kinds = {d[0]: str(d[1]) for d in result.description}
    mine = frame.columns
    if sorted(mine) != sorted(theirs):
        return f"columns differ: only ours {sorted(set(mine) - set(theirs))}, only SQL {sorted(set(theirs) - set(mine))}"
    got = _rows(mine, [tuple(r) for r in frame.collect()])
    if len(got) != len(want):
        return f"{len(got)} rows, SQL gives {len(want)}"
    same_kind = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE",
                 "boolean": "BOOLEAN"}
    odd = [(c, k, kinds[c]) for c, k in frame.dtypes if same_kind.get(k) != kinds[c]]
    if odd:
        return f"types differ: {odd}"
    for a, b in zip(got, want):
        if a != b:
            pairs = [(c, x, y) for c, x, y in zip(sorted(mine), a, b) if x != y]
            return f"values differ: {pairs[:4]} in {dict(zip(sorted(mine), a))}"
    return None


def main():
    from pyspark.sql import SparkSession

    from drawfield import plans
    from drawfield.session import configure
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = configure(SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                      .config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false")
                      .config("spark.sql.shuffle.partitions", "8")).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf_dir)
    bad = 0
    for name, function in plans.queries().items():
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        start = time.time()
        try:
            frame = function(spark, sf_dir)
            sql = plans.oracle_sql().get(name)
            message = compare(frame, con, sql) if sql else f"(no SQL, {frame.count()} rows)"
        except Exception as error:  # noqa: BLE001
            message = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(message) and not str(message).startswith("(no SQL")
        print(f"{'ok  ' if not message else 'FAIL' if not message.startswith('(no') else 'rows'} "
              f"{name} {time.time() - start:.1f}s {message or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()

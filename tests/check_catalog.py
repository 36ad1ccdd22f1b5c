"""Run catalog queries against their SQL: python tests/check_catalog.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(repr(r[i]) for i in order) for r in rows))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, entry, sf_dir):
    """(problem or None, rows)"""
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if entry.sql is None:
        return None, len(got), [f.dataType.simpleString() for f in df.schema]
    cur = con.execute(entry.sql)
    names = [c[0] for c in cur.description]
    types = {c[0]: str(c[1]) for c in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", len(got), types
    a, b = canonical(got, df.columns), canonical(want, names)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows vs {len(b)}; spark {only_a} sql {only_b}", len(got), types
    pairs = [(c, dict(df.dtypes)[c], types[c]) for c in df.columns]
    odd = [p for p in pairs if not same_type(p[1], p[2])]
    return (f"types {odd}" if odd else None), len(got), types


SAME = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "string": "VARCHAR", "double": "DOUBLE",
        "boolean": "BOOLEAN", "date": "DATE", "timestamp_ntz": "TIMESTAMP",
        "timestamp": "TIMESTAMP WITH TIME ZONE", "float": "FLOAT"}


def same_type(spark_type, sql_type):
    return SAME.get(spark_type) == sql_type or (spark_type.startswith("decimal")
                                                and spark_type.upper() == sql_type.replace(" ", ""))


def main():
    from __spark_entry__ import REGISTRY
    from eventlake.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                  "spark.ui.enabled": "false",
                                                  "spark.ui.showConsoleProgress": "false",
                                                  "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, entry in REGISTRY.items():
        if args[1:] and not any(a in name for a in args[1:]):
            continue
        begin = time.perf_counter()
        try:
            problem, rows, _ = compare(spark, con, entry, sf_dir)
        except Exception as err:
            problem, rows = f"{type(err).__name__}: {str(err)[:600]}", -1
        bad += problem is not None
        mark = "BAD " if problem else ("ok  " if entry.sql else "rows")
        print(f"{mark} {name:40s} {rows:7d} rows {time.perf_counter() - begin:6.2f}s {problem or ''}",
              flush=True)
    print(f"{bad} bad of {len(REGISTRY)}")
    spark.stop()


if __name__ == "__main__":
    main()

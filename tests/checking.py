"""Compare registered queries with their SQL checks, ignoring row order."""

import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return db


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in at) for row in rows), key=repr)


def compare(spark, db, sf_dir, query, sql):
    frame = query(spark, sf_dir)
    started = time.time()
    got = [tuple(r) for r in frame.collect()]
    spark_seconds = time.time() - started
    result = db.execute(sql)
    names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} != {sorted(names)}", 0
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    types = {d[0]: str(d[1]) for d in result.description}
    wrong = [(c, t, types[c]) for c, t in frame.dtypes if kinds.get(t) != types[c]]
    if wrong:
        return f"types {wrong}", 0
    a, b = rows_of(frame.columns, got), rows_of(names, want)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:3]
        only_b = [x for x in b if x not in set(a)][:3]
        return f"{len(a)} rows vs {len(b)}; first differences {str(only_a)[:900]} / {str(only_b)[:900]}", len(a)
    return None, len(a)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
               .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/{sf}"
    db = connect(folder)
    checks = entry.oracle_sql()
    for name, query in entry.queries().items():
        if wanted and name not in wanted:
            continue
        started = time.time()
        try:
            problem, count = compare(session, db, folder, query, checks[name])
        except Exception as e:  # noqa: BLE001
            problem, count = f"{type(e).__name__}: {str(e)[:1500]}", 0
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={count} {time.time() - started:.1f}s {problem or ''}", flush=True)

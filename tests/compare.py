"""Run the registered queries beside their SQL and compare whole results.

    python -m tests.compare [sf_dir] [query ...]
"""

import math
import pathlib
import sys
import time

import duckdb

import __spark_entry__ as contract

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    db = duckdb.connect()
    for table in TABLES:
        if pathlib.Path(f"{sf_dir}/{table}.parquet").exists():
            db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or (math.isnan(a) and math.isnan(b))
    return type(a) is type(b) and a == b


def differences(spark, db, sf_dir, name):
    """Differences between the two results of a query; empty when they agree."""
    frame = contract.queries()[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = [tuple(r) for r in frame.select(*columns).collect()]
    cursor = db.execute(contract.oracle_sql()[name])
    theirs_columns = [c[0] for c in cursor.description]
    if sorted(theirs_columns) != columns:
        return [f"columns {columns} and {sorted(theirs_columns)}"]
    order = [theirs_columns.index(c) for c in columns]
    theirs = [tuple(r[i] for i in order) for r in cursor.fetchall()]
    if len(ours) != len(theirs):
        return [f"{len(ours)} rows and {len(theirs)} rows"]
    pairs = zip(sorted(ours, key=_key), sorted(theirs, key=_key))
    return [f"{a} and {b}" for a, b in pairs if not all(map(_same, a, b))]


def main(sf_dir="/root/testdata/sf0.01", *names):
    from gridseries.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    bad = []
    for name in names or contract.queries():
        if name not in contract.oracle_sql():
            print(f"{name:28s} no SQL", flush=True)
            continue
        start = time.time()
        try:
            found = differences(spark, db, sf_dir, name)
        except Exception as error:  # show every failing query in one run
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{name:28s} {'ok' if not found else 'DIFFERS'} {time.time() - start:.1f}s", flush=True)
        for line in found[:3]:
            print("    ", line)
        if found:
            bad.append(name)
    print("differing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(*sys.argv[1:])))

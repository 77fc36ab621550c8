"""Run registered queries beside their oracle SQL and compare every value.

    python tests/oracle_compare.py [scale factor] [name prefix or exact names ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import duckdb

import __spark_entry__ as entrypoint
from tidegauge.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    elapsed = time.time() - started
    if sql is None:
        return f"rows-only {len(got[1])}", elapsed
    cursor = con.execute(sql)
    want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", elapsed
    if got[1] != want[1]:
        ours, theirs = set(got[1]), set(want[1])
        extra, lost = sorted(ours - theirs)[:3], sorted(theirs - ours)[:3]
        return f"VALUES spark={len(got[1])} oracle={len(want[1])}\n   only spark {extra}\n   only oracle {lost}", elapsed
    return f"ok {len(got[1])}", elapsed


def main(argv):
    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("oracle-compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    queries, oracle = entrypoint.queries(), entrypoint.oracle_sql()
    bad = 0
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            verdict, elapsed = compare(spark, con, name, query, oracle.get(name), sf_dir)
        except Exception as exc:  # report and go on with the next query
            verdict, elapsed = "FAILED " + str(exc)[:1500] + ("\n" + traceback.format_exc()[-600:]), 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:45s} {elapsed:6.2f}s {verdict}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

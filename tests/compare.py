"""Run registered queries beside their checking SQL and compare the rows.

Usage: python -m tests.compare [--sf sf0.01] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

import duckdb

TESTDATA = os.environ.get("TIDELINE_TESTDATA", "/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(
            f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{TESTDATA}/{sf}/{name}.parquet')"
        )
    return con


def _cell(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, bool):
        return value
    if isinstance(value, int):
        return value
    return str(value)


def _multiset(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf, name, fn, sql):
    df = fn(spark, f"{TESTDATA}/{sf}")
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return ("rows-only", len(rows), "")
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(columns) != sorted(df.columns):
        return ("COLUMNS", len(rows), f"spark {sorted(df.columns)} vs sql {sorted(columns)}")
    got_set, want_set = _multiset(df.columns, rows), _multiset(columns, want)
    if got_set == want_set:
        types = {type(c).__name__ for r in rows[:50] for c in r}
        want_types = {type(c).__name__ for r in want[:50] for c in r}
        note = "" if types == want_types else f"types {sorted(types)} vs {sorted(want_types)}"
        return ("ok", len(rows), note)
    extra = list((got_set - want_set).items())[:2]
    missing = list((want_set - got_set).items())[:2]
    return (
        "VALUES", len(rows),
        f"sql rows {len(want)}; {sorted(df.columns)}\n   spark only {extra}\n   sql only   {missing}",
    )


def main(argv):
    from tideline.plans import registry
    from tideline.session import local_session

    sf = "sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    registry.load_all()
    spark = local_session(8)
    con = connect(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if argv and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in argv):
            continue
        start = time.time()
        try:
            status, rows, note = compare(spark, con, sf, name, fn, registry.ORACLES.get(name))
        except Exception as err:  # report and go on to the next query
            status, rows, note = "ERROR", -1, str(err)[:1500]
        bad += status not in ("ok", "rows-only")
        print(f"{status:10} {name:28} rows={rows:<8} {time.time() - start:5.1f}s {note}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

"""Run registered queries next to their SQL and compare the rows.

    python tests/check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from granary.runtime import get_spark  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


STRICT = False  # compare doubles by their exact text


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return repr(value) if STRICT else round(value, 6) + 0.0
    return value


def compare(spark_df, con, sql: str) -> str:
    names = sorted(spark_df.columns)
    ours = [tuple(cell(r[n]) for n in names) for r in spark_df.collect()]
    cursor = con.execute(sql)
    found = [d[0] for d in cursor.description]
    if sorted(found) != names:
        return f"columns differ: {names} / {sorted(found)}"
    at = [found.index(n) for n in names]
    theirs = [tuple(cell(r[i]) for i in at) for r in cursor.fetchall()]
    kinds = [{type(v).__name__ for v in col if v is not None} for col in zip(*ours)]
    other = [{type(v).__name__ for v in col if v is not None} for col in zip(*theirs)]
    if ours and theirs and kinds != other:
        return f"types differ: {list(zip(names, kinds, other))}"
    if len(ours) != len(theirs):
        return f"row counts differ: {len(ours)} / {len(theirs)}"
    ours.sort(key=repr)
    theirs.sort(key=repr)
    for a, b in zip(ours, theirs):
        if a != b:
            return f"first difference:\n   ours   {str(a)[:600]}\n   theirs {str(b)[:600]}"
    if not ours:
        return "both sides are empty"
    return ""


def main() -> int:
    from __spark_entry__ import oracle_sql, queries

    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--strict", action="store_true", help="compare doubles exactly")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    global STRICT
    STRICT = args.strict
    spark = get_spark("check", 8, **{"spark.ui.showConsoleProgress": "false"})
    con = connect(args.sf)
    checks, bad = oracle_sql(), 0
    for name, build in queries().items():
        if args.names and name not in args.names:
            continue
        began = time.time()
        try:
            df = build(spark, args.sf)
            if name in checks:
                message = compare(df, con, checks[name])
            else:
                message = "" if df.count() else "no rows"
        except Exception as problem:
            message = f"{type(problem).__name__}: {str(problem)[:900]}"
        took = time.time() - began
        label = "ok  " if not message else "FAIL"
        kind = "sql " if name in checks else "rows"
        print(f"{label} {kind} {took:6.1f}s {name} {message}", flush=True)
        bad += bool(message)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

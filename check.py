"""Run registered queries in Spark and their SQL in DuckDB on the same tables and compare the rows.

    python check.py [--sf 0.01] [--only name,name] [--covers A1]
"""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from jobtide.bindings import QUERIES, check_sql, run
from jobtide.bindings.base import GIVEN
from jobtide.session import build_session


def kind(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"f{v!r}"
        return f"{kind(v)[0]}{v!r}"

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--only", default="")
    parser.add_argument("--covers", default="")
    args = parser.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = build_session(
        "check", "local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in GIVEN:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    wanted = [n for n in args.only.split(",") if n] or list(QUERIES)
    if args.covers:
        wanted = [n for n in wanted if args.covers in QUERIES[n].covers]
    bad = 0
    for name in wanted:
        start = time.time()
        try:
            df = run(name, spark, folder)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            text = check_sql(name)
            if text is None:
                print(f"rows  {name:34s} {len(rows):7d} {took:6.2f}s (no SQL)")
                bad += not rows
                continue
            cursor = con.execute(text)
            names = [d[0] for d in cursor.description]
            expected = cursor.fetchall()
            if sorted(names) != sorted(df.columns):
                bad += 1
                print(f"COLS  {name}: {sorted(df.columns)} / {sorted(names)}")
                continue
            left, right = normal(rows, df.columns), normal(expected, names)
            if left == right and rows:
                print(f"ok    {name:34s} {len(rows):7d} {took:6.2f}s")
            else:
                bad += 1
                print(f"DIFF  {name:34s} {len(rows)} / {len(expected)} rows {took:6.2f}s")
                for a, b in [(a, b) for a, b in zip(left, right) if a != b][:2]:
                    print("   spark ", a)
                    print("   duckdb", b)
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"FAIL  {name}: {str(error).splitlines()[0][:400]}")
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    raise SystemExit(1 if main() else 0)

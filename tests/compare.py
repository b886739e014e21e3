"""Run registered queries next to their SQL in DuckDB and compare all values.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
EXACT = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "smallint": "SMALLINT",
}


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (1, repr(value))
    return (1, value if isinstance(value, str) else repr(value))


def _canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf: str, name: str, function, sql: str | None) -> str | None:
    """None when equal, else what differs."""
    frame = function(spark, sf)
    rows = [tuple(r) for r in frame.collect()]
    if sql is None:
        return None if rows else "no rows"
    result = con.execute(sql)
    their_columns = [d[0] for d in result.description]
    their_types = dict(zip(their_columns, (str(d[1]) for d in result.description)))
    theirs = result.fetchall()
    if sorted(frame.columns) != sorted(their_columns):
        return f"columns {sorted(frame.columns)} / {sorted(their_columns)}"
    for column, kind in frame.dtypes:
        if EXACT.get(kind, kind) != their_types[column]:
            return f"type of {column}: {kind} / {their_types[column]}"
    if len(rows) != len(theirs):
        return f"{len(rows)} rows / {len(theirs)}"
    ours, expected = _canonical(frame.columns, rows), _canonical(their_columns, theirs)
    if ours != expected:
        pairs = [(a, b) for a, b in zip(ours, expected) if a != b][:3]
        return f"values differ, first: {pairs} columns {sorted(frame.columns)}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--zone", default="UTC", help="session time zone")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    from haulage.queries import ORACLE_SQL, QUERIES
    from haulage.session import get_session

    spark = get_session(
        "compare", master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g", spark__sql__session__timeZone=args.zone,
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(args.sf), 0
    for name, function in QUERIES.items():
        if args.names and name not in args.names:
            continue
        began = time.time()
        try:
            problem = compare(spark, con, args.sf, name, function, ORACLE_SQL.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        kind = "sql " if name in ORACLE_SQL else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind} {time.time() - began:6.2f}s {name}"
              + (f"\n     {problem}" if problem else ""), flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main())

"""Runs registered queries next to their SQL in DuckDB and compares whole results.

``python tests/oracle.py [sf] [name ..]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import pathlib
import sys
import time

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TESTDATA = pathlib.Path("/root/testdata")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir, files=""):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet{files}')")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, float):
        return value + 0.0
    return value


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=repr)


def compare(spark_df, connection, sql):
    """Empty text when equal, else what differs."""
    got = ordered(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    want = ordered(names, cursor.fetchall())
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    kinds = {tuple(type(v).__name__ for v in row) for row in got if None not in row}
    kinds_sql = {tuple(type(v).__name__ for v in row) for row in want if None not in row}
    if kinds != kinds_sql:
        return f"types {kinds} against {kinds_sql}"
    different = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(different)} of {len(got)} rows differ, first {different[0]}" if different else ""


def main(arguments):
    import __spark_entry__ as entry
    from costweave.session import local_session

    sf = arguments[0] if arguments else "0.01"
    sf_dir = str(TESTDATA / f"sf{sf}")
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in arguments[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                outcome = compare(df, connection, oracles[name])
            else:
                outcome = ""
                print("   rows only:", df.count())
        except Exception as error:  # noqa: BLE001
            outcome = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(outcome)
        print(f"{'FAIL' if outcome else 'ok':4} {time.time() - start:6.2f} {name} {outcome}", flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

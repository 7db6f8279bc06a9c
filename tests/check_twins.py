"""Run registered queries next to their SQL twins and compare every value.

Usage: python tests/check_twins.py [scale-folder] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(int(value)) if isinstance(value, bool) else str(value)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in rows), key=str)


SAME = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def type_difference(df, con, sql: str) -> str:
    described = dict(row[:2] for row in con.execute(f"describe {sql}").fetchall())
    wrong = {c: (t, described.get(c)) for c, t in df.dtypes if SAME.get(t, t) != described.get(c)}
    return f"types {wrong}" if wrong else ""


def compare(df, con, sql: str) -> str:
    """Empty when equal, else the first difference."""
    mine = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    names, theirs = [d[0] for d in result.description], result.fetchall()
    a, b = table_of(df.columns, mine), table_of(names, theirs)
    if a[0] != b[0]:
        return f"columns {a[0]} / {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"rows {len(a[1])} / {len(b[1])}"
    if problem := type_difference(df, con, sql):
        return problem
    different = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(different)} of {len(a[1])} rows differ, first {different[0]}" if different else ""


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, twins, failures = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.perf_counter()
        try:
            if name in twins:
                problem = compare(run(spark, folder), con, twins[name])
                note = "DIFF " + problem if problem else "ok"
            else:
                rows = run(spark, folder).collect()
                note = f"rows {len(rows)} {rows[0] if rows else ''}"[:200]
        except Exception as error:
            note = f"ERROR {type(error).__name__} {str(error)[:600]}"
        failures += note.startswith(("DIFF", "ERROR"))
        print(f"{time.perf_counter() - started:7.2f}s {name}: {note}", flush=True)
    print("failures", failures)
    return failures


if __name__ == "__main__":
    sys.exit(main() > 0)

"""Run registered queries beside their reference SQL: python tests/compare.py [sf] [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def spark_session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{files}'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        return normal(value.item())
    return value


def sort_key(row):
    return [(v is None, isinstance(v, str), str(v) if isinstance(v, (str, bool)) else v or 0) for v in row]


def differences(left_cols, left_rows, right_cols, right_rows) -> str | None:
    """None when both results hold the same rows under the same column names."""
    if sorted(left_cols) != sorted(right_cols):
        return f"columns {sorted(set(left_cols) ^ set(right_cols))}"
    if len(left_rows) != len(right_rows):
        return f"rows {len(left_rows)} vs {len(right_rows)}"
    order = sorted(left_cols)

    def arranged(cols, rows):
        pick = [list(cols).index(c) for c in order]
        return sorted([tuple(normal(r[i]) for i in pick) for r in rows], key=sort_key)

    a, b = arranged(left_cols, left_rows), arranged(right_cols, right_rows)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {order} {bad[0]}" if bad else None


TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN"}


def type_notes(df, con, sql: str) -> str:
    """Columns whose types differ between the two engines."""
    other = {r[0]: str(r[1]) for r in con.execute("DESCRIBE " + sql).fetchall()}
    return " ".join(
        f"{f.name}:{f.dataType.simpleString()}/{other.get(f.name)}" for f in df.schema
        if TYPES.get(f.dataType.simpleString()) != other.get(f.name)
    )


def main() -> int:
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    only = [a for a in sys.argv[2:] if not a.startswith("-")]
    skip = [a for a in sys.argv[2:] if a.startswith("-")]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = spark_session(), duck(sf_dir)
    sql = entry.oracle_sql()
    failed = 0
    for name, fn in entry.queries().items():
        if only and name not in only or f"-{name}" in skip:
            continue
        start, notes = time.time(), ""
        try:
            df = fn(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            took = time.time() - start
            if name in sql:
                res = con.execute(sql[name])
                cols = [c[0] for c in res.description]
                problem = differences(df.columns, rows, cols, res.fetchall())
                notes = type_notes(df, con, sql[name])
            else:
                problem = None if rows else "no rows"
        except Exception as e:  # noqa: BLE001
            problem, took, rows = f"{type(e).__name__}: {str(e)[:500]}", time.time() - start, []
        failed += bool(problem)
        kind = "sql " if name in sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:24s} {len(rows):7d} {took:6.2f}s {problem or ''} {notes}",
              flush=True)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Run registered queries against their SQL counterparts and report differences.

    python -m workloads.check [sf] [name-part ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value: object) -> object:
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    return value


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


TIMES: list[float] = []


def compare(spark_df, con, sql: str) -> str:
    start = time.time()
    got = spark_df.collect()
    TIMES[:] = [time.time() - start]
    cursor = con.execute(sql)
    sql_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(sql_columns):
        return f"columns differ: {sorted(spark_df.columns)} / {sorted(sql_columns)}"
    a, b = rows_of(spark_df.columns, [tuple(r) for r in got]), rows_of(sql_columns, want)
    if len(a) != len(b):
        only_a = [r for r in a if r not in set(b)][:2]
        only_b = [r for r in b if r not in set(a)][:2]
        return f"row counts differ: {len(a)} / {len(b)}; spark only {only_a}; sql only {only_b}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0]}" if bad else ""


def main() -> int:
    from scriptorium.session import local_session
    from workloads import registry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    parts = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check", cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = registry.queries(), registry.oracle_sql()
    failures = 0
    for name, query in queries.items():
        if parts and not any(p in name for p in parts):
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(query(spark, sf_dir), con, sql[name])
                note = problem or "ok"
            else:
                n = len(query(spark, sf_dir).collect())
                problem, note = ("" if n else "no rows"), f"rows only: {n}"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = note = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += bool(problem)
        spark_time = f"{TIMES.pop():.1f}" if TIMES else "-"
        print(f"{'FAIL' if problem else 'pass'}  {name}  {time.time() - start:.1f}s (collect {spark_time})  {note[:1500]}", flush=True)
    print(f"{failures} failures")
    return failures


if __name__ == "__main__":
    sys.exit(main())

"""Compare registered Spark queries with their SQL twins in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, dt.datetime) and value.tzinfo is not None:
        return value.replace(tzinfo=None)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(normal(row[i]) for i in order) for row in rows]
    out.sort(key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))
    return [columns[i] for i in order], out


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
         "boolean": "BOOLEAN", "timestamp": "TIMESTAMP"}


def check(spark, con, folder, run, sql):
    """None when equal, else a description of the first difference."""
    df = run(spark, folder)
    types = dict(df.dtypes)
    columns, ours = table(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    expected_columns, theirs = table(names, cursor.fetchall())
    if columns != expected_columns:
        return f"columns {columns} vs {expected_columns}", len(ours)
    odd = {c: (types[c], kinds[c]) for c in columns if KINDS.get(types[c], types[c]) != kinds[c]}
    if odd:
        return f"types {odd}", len(ours)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} vs {len(theirs)}", len(ours)
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    if bad:
        return f"{len(bad)}/{len(ours)} rows differ on {columns}, first:\n   {bad[0][0]}\n   {bad[0][1]}", len(ours)
    return None, len(ours)


def main() -> int:
    from kpisleuth.plans import all_queries
    from kpisleuth.plans.registry import compose
    from kpisleuth.session import get_spark

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_spark(master=f"local[{__import__('os').environ.get('COMPARE_CPUS', '8')}]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
                                             "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, entry in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if entry.sql is None:
                problem, rows = None, entry.run(spark, folder).count()
            else:
                problem, rows = check(spark, con, folder, entry.run, compose(entry.sql))
        except Exception as exc:  # noqa: BLE001
            problem, rows = f"{type(exc).__name__}: {str(exc)[:600]}", 0
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {rows:7d} rows {time.time() - began:6.2f}s"
              f"{' (rows only)' if entry.sql is None else ''} {problem or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)

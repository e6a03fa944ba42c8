"""Run registered queries and compare each with its check SQL.

Usage: python tools/check_queries.py <data folder> [name part ...]
"""

from __future__ import annotations

import hashlib
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgermesh.plans import catalog  # noqa: E402
from ledgermesh.plans.bindings import TABLES  # noqa: E402
from ledgermesh.session import get_spark  # noqa: E402


def cell(value) -> str:
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value)


def digest(columns: list[str], rows: list) -> tuple[str, list[str]]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    lines = sorted("\x1f".join(cell(row[k]) for k in order) for row in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def main() -> int:
    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = get_spark(cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    checks, bad = catalog.check_sql(), 0
    for name, build in catalog.queries().items():
        if wanted and not any(part in name for part in wanted):
            continue
        began = time.time()
        try:
            df = build(spark, folder)
            rows = df.collect()
            took = time.time() - began
            if name not in checks:
                print(f"rows  {name:40s} {len(rows):8d} rows {took:6.2f}s", flush=True)
                continue
            result = con.execute(checks[name])
            columns = [d[0] for d in result.description]
            expected = result.fetchall()
        except Exception as error:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            continue
        if sorted(df.columns) != sorted(columns):
            bad += 1
            print(f"BAD   {name}: columns {sorted(set(df.columns) ^ set(columns))}", flush=True)
            continue
        got, lines = digest(df.columns, rows)
        want, other = digest(columns, expected)
        verdict = "ok" if got == want else "BAD"
        print(f"{verdict:5s} {name:40s} {len(rows):8d} rows {took:6.2f}s", flush=True)
        if got != want:
            bad += 1
            ours, theirs = sorted(set(lines) - set(other)), sorted(set(other) - set(lines))
            print(f"   spark {len(lines)} rows, check {len(other)} rows; columns {sorted(columns)}")
            for side, sample in (("spark", ours[:3]), ("check", theirs[:3])):
                for line in sample:
                    print(f"   only {side}: {line[:400]!r}")
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())

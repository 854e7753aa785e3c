"""Compare registered queries with their oracle SQL: python tests/oracle_compare.py SF_DIR [NAME…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as entrypoint
from querylight.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def normal_rows(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(repr(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool | None, str]:
    """True when equal, None when the query has no oracle."""
    start = time.time()
    df = entrypoint.queries()[name](spark, sf_dir)
    got = [tuple(row) for row in df.collect()]
    took = time.time() - start
    sql = entrypoint.oracle_sql().get(name)
    if sql is None:
        return (None if got else False), f"{len(got)} rows, no oracle, {took:.1f}s"
    start = time.time()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    duck_took = time.time() - start
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = normal_rows(df.columns, got), normal_rows(names, want)
    if left != right or not left:
        only_left = [r for r in left if r not in set(right)][:3]
        only_right = [r for r in right if r not in set(left)][:3]
        return False, f"{len(left)} vs {len(right)} rows\n  spark  {str(only_left)[:700]}\n  duckdb {str(only_right)[:700]}"
    return True, f"{len(got)} rows, {took:.1f}s (duckdb {duck_took:.1f}s)"


def main() -> None:
    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    names = [n for n in entrypoint.queries() if not wanted or any(n.startswith(w) for w in wanted)]
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        if ok is False:
            bad.append(name)
        print({True: "ok  ", None: "rows", False: "BAD "}[ok], name, note, flush=True)
    print(f"{len(names) - len(bad)}/{len(names)} good; bad: {bad}")


if __name__ == "__main__":
    main()

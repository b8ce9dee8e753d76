"""Runs queries beside their SQL in DuckDB and compares names, types and values.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(arrow_type) -> str:
    text = str(arrow_type).replace("large_", "")
    if text.startswith("timestamp"):
        return "timestamp"
    return text


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        return str(value.replace(tzinfo=None))
    return str(value)


def rows_of(table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [[cell(v) for v in table[n].to_pylist()] for n in names]
    return sorted(zip(*columns))


def compare(spark: SparkSession, con, sf_dir: str, name: str, query, sql: str | None) -> tuple[bool, str]:
    got = query(spark, sf_dir).toArrow()
    if sql is None:
        return True, f"{got.num_rows} rows, no SQL"
    want = con.sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return False, f"columns {sorted(got.column_names)} against {sorted(want.column_names)}"
    types = {
        n: (kind(got.schema.field(n).type), kind(want.schema.field(n).type))
        for n in got.column_names
        if kind(got.schema.field(n).type) != kind(want.schema.field(n).type)
    }
    if types:
        return False, f"types {types}"
    a, b = rows_of(got), rows_of(want)
    if a == b:
        return True, f"{len(a)} rows"
    extra = [r for r in a if r not in set(b)][:3]
    missing = [r for r in b if r not in set(a)][:3]
    return False, f"{len(a)} rows against {len(b)}; only here {extra}; only in SQL {missing}"


def main(args: list[str]) -> int:
    from checks.oracles import oracle_sql
    from checks.queries import QUERIES
    from kveil.session import local_session

    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(QUERIES)
    spark, con, sql = local_session(cores="8"), duck(sf_dir), oracle_sql()
    print("SQL without query:", sorted(set(sql) - set(QUERIES)))
    print("query without SQL:", sorted(set(QUERIES) - set(sql)))
    bad = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, QUERIES[name], sql.get(name))
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:24s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

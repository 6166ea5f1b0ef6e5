"""Run queries on Spark and their counterparts on DuckDB and compare rows, column names and types.

    python tests/compare.py [folder of tables] [query ...]
"""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {
    "BIGINT": "bigint",
    "INTEGER": "int",
    "VARCHAR": "string",
    "DOUBLE": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def plain(value: object) -> object:
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    return value


def compare(db: duckdb.DuckDBPyConnection, df, sql: str) -> str | None:
    """None when both agree, else what differs."""
    cursor = db.execute(sql)
    described = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    if sorted(described) != sorted(df.columns):
        return f"columns {sorted(df.columns)} instead of {sorted(described)}"
    types = dict(df.dtypes)
    wrong = {c: (types[c], t) for c, t in described.items() if TYPES.get(t, t) != types[c]}
    names = sorted(described)
    spots = [list(described).index(n) for n in names]
    order = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(plain(r[i]) for i in spots) for r in expected), key=order)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=order)
    if wrong:
        return f"types {wrong}"
    if len(want) != len(got):
        return f"{len(got)} rows instead of {len(want)}"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{dict(zip(names, a, strict=True))} instead of {dict(zip(names, b, strict=True))}"
    return None if got else "no rows"


def main() -> None:
    from conftest import local_session

    import __spark_entry__ as entry

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, db = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        begun = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                result = compare(db, df, oracles[name]) or "ok"
            else:
                result = f"rows only: {df.count()}"
        except Exception as error:
            result = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        print(f"{name:28} {time.time() - begun:6.2f}s {result}", flush=True)


if __name__ == "__main__":
    main()

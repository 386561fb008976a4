"""Run a query and its SQL side by side and compare rows as multisets."""

from __future__ import annotations

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, (datetime, date)):
        return str(value)
    return value


def rows_of(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


# Types of both sides that hold the same values.
SAME_TYPES = {
    "int": "INTEGER",
    "bigint": "BIGINT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def spark_rows(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def sql_rows(con, sql: str) -> tuple[dict[str, str], Counter]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    return {d[0]: str(d[1]) for d in result.description}, rows_of(columns, result.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when both sides agree, else a short account of the difference."""
    got_columns, got = spark_rows(df)
    want_types, want = sql_rows(con, sql)
    if got_columns != sorted(want_types):
        return f"columns {got_columns} != {sorted(want_types)}"
    got_types = {name: SAME_TYPES.get(kind, kind) for name, kind in df.dtypes}
    if got_types != want_types:
        return f"types {got_types} != {want_types}"
    if got != want:
        extra, missing = got - want, want - got
        sample = lambda c: [str(r)[:400] for r in list(c)[:2]]
        return (
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {sum(extra.values())}: {sample(extra)}; "
            f"only sql {sum(missing.values())}: {sample(missing)}"
        )
    return None

"""Side-by-side run of a registered query and its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], records: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[int, str]:
    """(number of rows, '' if equal else what differs)."""
    df = query(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    want_columns = [c[0] for c in result.description]
    want = result.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return len(got), f"columns {sorted(got_columns)} != {sorted(want_columns)}"
    a, b = rows(got_columns, got), rows(want_columns, want)
    if len(a) != len(b):
        return len(got), f"{len(a)} rows != {len(b)} rows"
    for x, y in zip(a, b):
        if x != y:
            return len(got), f"{repr(x)[:600]} != {repr(y)[:600]}"
    return len(got), ""

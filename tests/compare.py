"""Runs a registered query and its SQL, and compares rows exactly."""

from __future__ import annotations

from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, [tuple(row[n] for n in names) for row in df.collect()]


def sql_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(row[i] for i in order) for row in cur.fetchall()]


def typed(value):
    """Types count: 1, 1.0 and True are different values."""
    return (type(value).__name__, value)


def difference(left, right) -> str | None:
    (names, a), (other, b) = left, right
    if names != other:
        return f"columns {names} vs {other}"
    count_a = Counter(tuple(map(typed, row)) for row in a)
    count_b = Counter(tuple(map(typed, row)) for row in b)
    if count_a == count_b:
        return None
    def plain(rows):
        return [tuple(v for _, v in row) for row in sorted(rows, key=repr)[:3]]

    return (f"{len(a)} vs {len(b)} rows; only Spark {sum((count_a - count_b).values())}: {plain(count_a - count_b)}; "
            f"only SQL {sum((count_b - count_a).values())}: {plain(count_b - count_a)}; columns {names}")

"""Compares a query with its SQL on the same tables."""

from __future__ import annotations

import zlib
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def plain(x):
    if hasattr(x, "asDict"):
        x = x.asDict()
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return None if isinstance(x, float) and x != x else x


def rows(df) -> Counter:
    return Counter(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())


def sql_rows(sql: str, data: str = DATA) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        db.execute("SET timezone = 'UTC'")
        for path in sorted(Path(data).glob("*.parquet")):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        cursor = db.execute(sql)
        names = [d[0] for d in cursor.description]
        order = [names.index(n) for n in sorted(names)]
        return sorted(names), Counter(repr(tuple(plain(r[i]) for i in order)) for r in cursor.fetchall())


def check(spark, query, sql: str) -> None:
    df = query(spark, DATA)
    names, expected = sql_rows(sql)
    assert sorted(df.columns) == names
    assert rows(df) == expected


def digest(df) -> tuple[int, int]:
    """Number of rows and a checksum that takes no notice of their order or of floats' last digits."""

    def short(x):
        if isinstance(x, tuple):
            return tuple(short(v) for v in x)
        return round(x, 4) + 0.0 if isinstance(x, float) else x

    lines = [repr(tuple(short(plain(r[c])) for c in sorted(df.columns))) for r in df.collect()]
    return len(lines), sum(zlib.crc32(line.encode()) for line in lines) % 2**32

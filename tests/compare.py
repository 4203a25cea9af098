"""A query and its SQL counterpart side by side."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in rows)


def from_spark(df) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def from_duckdb(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute("SET threads = 4")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = con.execute(sql)
    names = [c[0] for c in found.description]
    return sorted(names), rows_of(names, found.fetchall())


def assert_same(df, sql: str, sf_dir: str) -> None:
    (names, ours), (theirs_names, theirs) = from_spark(df), from_duckdb(sql, sf_dir)
    assert names == theirs_names
    missing, extra = theirs - ours, ours - theirs
    assert not missing and not extra, f"{sum(missing.values())} rows missing, {sum(extra.values())} extra: {list(missing)[:2]} {list(extra)[:2]}"
    assert sum(ours.values()) == sum(theirs.values())

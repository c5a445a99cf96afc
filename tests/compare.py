"""The driver's comparison: columns by name, rows in any order."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        at = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if at.is_dir() else ''}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def differences(df, con, sql: str):
    """None if the query and its check agree, else what differs first."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, wanted {sorted(names)}"
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    only, lack = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
    return f"{len(got)} rows, wanted {len(want)}; only here {str(only)[:700]}; lacking {str(lack)[:700]}"

"""Compare a query with its SQL on the same tables, as multisets of rows with columns by name."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb


def cell(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return x.isoformat()
    return x


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def difference(df, sql: str, con) -> str:
    """Empty if the rows agree."""
    rows = con.execute(sql)
    names = [c[0] for c in rows.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = sorted(names)
    want = Counter(tuple(cell(r[names.index(c)]) for c in order) for r in rows.fetchall())
    got = Counter(tuple(cell(r[c]) for c in order) for r in df.collect())
    more, less = got - want, want - got
    return "" if not more and not less else f"{sum(got.values())} rows against {sum(want.values())}; only here {list(more.items())[:3]}; only in SQL {list(less.items())[:3]}"

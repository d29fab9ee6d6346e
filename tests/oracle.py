"""Compare a query with its SQL on the same tables: columns, kinds, rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "isoformat"):
        return x.isoformat()[:26]
    return x


def difference(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or an empty text."""
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp", "DATE": "date"}
    own = {n: t.replace("timestamp_ntz", "timestamp") for n, t in df.dtypes}
    other = {d[0]: kinds.get(str(d[1]), str(d[1])) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}
    odd = {n: (own[n], other[n]) for n in names if own[n] != other[n]}
    order = sorted(names)
    a = Counter(tuple(plain(r[n]) for n in order) for r in df.collect())
    b = Counter(tuple(plain(v) for v in (r[names.index(n)] for n in order)) for r in con.execute(sql).fetchall())
    if a != b:
        return f"{sum(a.values())} and {sum(b.values())} rows; only here {list((a - b).items())[:2]}; only there {list((b - a).items())[:2]}; kinds {odd}"
    return f"kinds {odd}" if odd else ""

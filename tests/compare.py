"""Compares the queries with their DuckDB SQL, as the driver does: same columns, same rows in any order."""

from __future__ import annotations

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir, f"{name}.parquet")
        if path.exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def differences(spark, sf_dir: str, query, sql: str) -> list[str]:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    relation = duck(sf_dir).sql(sql)
    if sorted(relation.columns) != names:
        return [f"columns {names} against {sorted(relation.columns)}"]
    order = [relation.columns.index(c) for c in names]
    wanted = Counter(tuple(plain(r[i]) for i in order) for r in relation.fetchall())
    if got == wanted:
        return []
    more, less = got - wanted, wanted - got
    return [f"{sum(got.values())} rows, {sum(wanted.values())} wanted; only here {list(more)[:3]}; missing {list(less)[:3]}"]


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from conftest import make_session

    session, folder = make_session(), sys.argv[1]
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            if name in sqls:
                print(name, differences(session, folder, query, sqls[name]) or "equal", f"{time.time() - began:.1f} s", flush=True)
            else:
                print(name, query(session, folder).count(), "rows", f"{time.time() - began:.1f} s", flush=True)
        except Exception as error:
            print(name, "FAILED", str(error)[:1500], flush=True)

"""Compare registered queries with their SQL: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from unisource.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def ordered(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def difference(spark, con, name: str, sf_dir: str) -> str | None:
    """What differs between a query and its SQL, or None."""
    df = entry.queries()[name](spark, sf_dir)
    got_rows = df.collect()
    relation = con.sql(entry.oracle_sql()[name])
    want_rows = relation.fetchall()
    if sorted(df.columns) != sorted(relation.columns):
        return f"columns {sorted(df.columns)} != {sorted(relation.columns)}"
    got, want = ordered(got_rows, df.columns), ordered(want_rows, relation.columns)
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}; only here {list(set(map(str, got)) - set(map(str, want)))[:3]}; only there {list(set(map(str, want)) - set(map(str, got)))[:3]}"
    for g, w in zip(got, want):
        if g != w:
            return f"first difference\n  here  {g}\n  there {w}"
    types = dict(zip(relation.columns, map(str, relation.types)))
    alike = {
        "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
        "timestamp_ntz": "TIMESTAMP",
    }
    odd = [(c, t, types[c]) for c, t in df.dtypes if not types[c].startswith(alike.get(t, t)) and types[c] != '"NULL"']
    return f"types {odd}" if odd else None


if __name__ == "__main__":
    sf = sys.argv[1]
    session = build_session("compare", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                            spark__driver__memory="12g", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for name in sys.argv[2:] or entry.oracle_sql():
        start = time.time()
        try:
            found = difference(session, con, name, sf) if name in entry.oracle_sql() else "no SQL"
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += found is not None
        print(f"{name:24} {time.time() - start:6.2f}s  {'ok' if found is None else found}", flush=True)
    print("differing:", bad)

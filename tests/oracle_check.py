"""Run registered queries and compare them with their SQL in DuckDB: python -m tests.oracle_check [sf] [name part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(int(v)) if v == int(v) else v
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return str(v)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def spark_rows(df):
    return table_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return table_of([d[0] for d in cur.description], cur.fetchall())


def compare(spark, con, name, function, sql, folder):
    """None when equal, else what differs."""
    ours = spark_rows(function(spark, folder))
    if sql is None:
        return None if ours[1] else "no rows"
    theirs = duck_rows(con, sql)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} vs {theirs[0]}"
    if ours[1] != theirs[1]:
        bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b][:3]
        return f"rows {len(ours[1])} vs {len(theirs[1])}; {bad}"
    return None


def main():
    from centrum.queries import registry
    from centrum.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    registry.load_all()
    spark, con = local_session(8), connect(folder)
    bad = 0
    for name, function in registry.QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        begin = time.perf_counter()
        try:
            problem = compare(spark, con, name, function, registry.ORACLES.get(name), folder)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:900]}"
        bad += problem is not None
        kind = "sql" if name in registry.ORACLES else "inv"
        print(f"{'OK ' if problem is None else 'BAD'} {kind} {name} {time.perf_counter() - begin:.2f}s {problem or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()

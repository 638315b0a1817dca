"""Run queries next to their SQL on the same tables and compare the rows.

usage: python tests/check.py <sf_dir> [name or group prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, dt.date):
        return v
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - t0
    if sql is None:
        return "rows", len(got), spent, ""
    t0 = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_spent = time.time() - t0
    note = f"duck {duck_spent:.1f}s"
    types = {d[0]: str(d[1]) for d in cur.description}
    if "HUGEINT" in types.values() or any(t.startswith("DECIMAL") for t in types.values()):
        note += f" TYPES {types}"
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), spent, f"{sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        extra = [x for x in a if x not in set(b)][:2]
        lack = [x for x in b if x not in set(a)][:2]
        return "COUNT", len(a), spent, f"{len(a)} != {len(b)}\n   spark {extra}\n   duck  {lack}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", len(a), spent, f"{len(bad)} differ:\n   spark {bad[0][0][:600]}\n   duck  {bad[0][1][:600]}"
    return "ok", len(a), spent, note


def main():
    from shelfwise.session import build_session

    import __spark_entry__ as entry

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = build_session(
        "check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g", spark__driver__host="127.0.0.1",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted and not any(
            w == getattr(fn, "__module__", "").rsplit(".", 1)[-1] for w in wanted
        ):
            continue
        try:
            status, n, spent, note = compare(spark, con, sf_dir, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            text = str(e)
            status, n, spent, note = "ERROR", 0, 0.0, text[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:28} {n:8} rows {spent:6.2f}s  {note}", flush=True)
    print(f"{bad} bad of {len(queries)}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()

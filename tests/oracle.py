"""Run registered queries beside their SQL: ``python tests/oracle.py [sf_dir] [name part …]``."""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, Decimal):
        return ("dec", str(v.normalize()))
    if isinstance(v, float):
        return ("f", round(v, 9))
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def key(row):
    return tuple((x is not None, type(x).__name__, x) if not isinstance(x, tuple)
                 else (True, "tuple", str(x)) for x in row)


def compare(df, con, sql, took):
    cols = sorted(df.columns)
    mine = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
    took.append(time.time())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    pos = [names.index(c) for c in cols]
    theirs = [tuple(norm(r[i]) for i in pos) for r in cur.fetchall()]
    a, b = sorted(mine, key=key), sorted(theirs, key=key)
    if a == b:
        return None if a else "EMPTY"
    sa, sb = set(map(str, a)), set(map(str, b))
    return (
        f"rows {len(a)} vs {len(b)}; only spark {len(sa - sb)} {sorted(sa - sb)[:2]}; "
        f"only sql {len(sb - sa)} {sorted(sb - sa)[:2]} cols {cols}"
    )


def connect(sf):
    from wiretally.sources.derived import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def main(argv):
    from wiretally.session import build_session
    import __spark_entry__ as entry

    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in argv if not a.startswith("/")]
    spark = build_session(
        master="local[8]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8",
           "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(sf)
    sqls, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if parts and not any(p in name for p in parts):
            continue
        t, took = time.time(), []
        try:
            df = fn(spark, sf)
            if name in sqls:
                res = compare(df, con, sqls[name], took)
            else:
                n = df.count()
                res = None if n else "EMPTY"
        except Exception as e:  # noqa: BLE001
            res = "ERROR " + str(e)[:1500]
        bad += res is not None
        print(f"{'ok  ' if res is None else 'BAD '} {name:32s} {(took[0] if took else time.time()) - t:6.1f}s "
              f"{'' if name in sqls else '(rows only) '}{(res or '')[:1700]}", flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)

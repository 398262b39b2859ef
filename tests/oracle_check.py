"""Compare registered queries with their SQL oracles.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def norm(v):
        if isinstance(v, float):
            return repr(v + 0.0)
        return repr(v)

    return sorted(tuple(norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, sf, name, fn, sql, verbose=True):
    t0 = time.time()
    df = fn(spark, sf)
    got = df.collect()
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got)} spark={t1 - t0:.1f}s", True
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    try:
        rel = con.execute(sql)
    except Exception as ex:
        return f"SQL {type(ex).__name__}: {str(ex)[:600]} (spark {t1 - t0:.1f}s)", False
    cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    t2 = time.time()
    a, ca = rows_of(df.columns, got)
    b, cb = rows_of(cols, want)
    ok = a == b and ca == cb and len(a) > 0
    msg = f"{'OK ' if ok else 'BAD'} spark={len(a)} duck={len(b)} {t1 - t0:.1f}s/{t2 - t1:.1f}s"
    if not ok and verbose:
        sa, sb = set(a), set(b)
        msg += f"\n   cols {ca} {cb}\n   only spark {sorted(sa - sb)[:4]} ({len(sa - sb)})\n   only duck {sorted(sb - sa)[:4]} ({len(sb - sa)})"
    return msg, ok


def main():
    import __spark_entry__ as e
    from curbline.session import local_session

    spark = local_session("oracle-check")
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    bad = []
    for n in names:
        try:
            msg, ok = compare(spark, sf, n, e.queries()[n], e.oracle_sql().get(n))
        except Exception as ex:  # report and go on
            msg, ok = f"ERR {type(ex).__name__}: {str(ex)[:1500]}", False
        print(f"{n:28s} {msg}", flush=True)
        if not ok:
            bad.append(n)
    print("BAD:", bad)


if __name__ == "__main__":
    main()

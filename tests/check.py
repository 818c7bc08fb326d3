"""Compare queries with their oracles: python -m tests.check SF [name ...]"""

from __future__ import annotations

import decimal
import glob
import os
import sys
import time
import traceback


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6f}"
    if isinstance(v, int):
        return f"{float(v):.6f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(str(norm(x)) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(["\x1f".join(str(norm(r[i])) for i in order) for r in rows])


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def compare(spark, con, sf_dir, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}", True
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", False
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        show = lambda s: [x.replace("\x1f", " | ")[:300] for x in sorted(s)[:3]]
        return f"rows {len(got)} vs {len(want)}; spark only {show(a)}; oracle only {show(b)}", False
    return f"{len(got)} rows", True


def main():
    from codeloom.plans import catalog
    from codeloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    sf_dir = f"/root/testdata/{sf}"
    qs, oracles = catalog.all_queries(), catalog.all_oracles()
    picked = [n for n in qs if not names or any(n == x or (x.endswith("*") and n.startswith(x[:-1])) for x in names)]
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for n in picked:
        t = time.time()
        try:
            msg, ok = compare(spark, con, sf_dir, qs[n], oracles.get(n))
        except Exception as e:  # noqa: BLE001
            msg, ok = (type(e).__name__ + ": " + str(e)[:600] + ("" if os.environ.get("TB") is None else traceback.format_exc())), False
        bad += not ok
        print("ok  " if ok else "FAIL", n, f"{time.time() - t:.1f}s", msg, flush=True)
    print(len(picked), "checked,", bad, "bad")


if __name__ == "__main__":
    main()

"""Run a query in Spark and its SQL in DuckDB, and compare the row multisets."""

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows), sorted(names)


def compare(spark, con, q, sf_dir):
    start = time.time()
    df = q.build(spark, sf_dir)
    names = df.columns
    got, got_names = rows_of(names, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if q.sql is None:
        return {"rows": sum(got.values()), "sec": took, "ok": None}
    rel = con.execute(q.sql)
    want_names = [d[0] for d in rel.description]
    want, want_names = rows_of(want_names, rel.fetchall())
    out = {"rows": sum(got.values()), "sec": took, "ok": got == want and got_names == want_names}
    if not out["ok"]:
        out["detail"] = (got_names, want_names, sum(want.values()),
                         list((got - want).items())[:3], list((want - got).items())[:3])
    return out


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from noticegrid.plans.registry import load_all
    from noticegrid.session import local_session

    sf = sys.argv[1]
    only = sys.argv[2:]
    s = local_session(8, 8)
    c = database(sf)
    for name, q in load_all().items():
        if only and not any(name.startswith(o) for o in only):
            continue
        try:
            r = compare(s, c, q, sf)
            print(f"{name:28} ok={r['ok']} rows={r['rows']} {r['sec']:.2f}s", str(r.get("detail", ""))[:1200], flush=True)
        except Exception as e:  # noqa: BLE001
            print(f"{name:28} ERROR {type(e).__name__}: {str(e)[:900]}", flush=True)

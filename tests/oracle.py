"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return round(float(v), 6)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return datetime.datetime(v.year, v.month, v.day)
    return v


def compare(df, con, sql):
    """None when equal, else a short text."""
    cols = sorted(df.columns)
    left = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    right = sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"{len(bad)}/{len(left)} rows differ, first {cols}: {bad[0]}"
    return None if left else "both empty"


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry

    from orderlark.session import local_session

    wanted = sys.argv[1:]
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    skew = os.environ.get("SKEW")
    spark = local_session(**({"spark.orderlark.maxGroupRows": skew} if skew else {}))
    con = connect(sf)
    sqls = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                out = compare(df, con, sqls[name]) or "ok"
            else:
                out = f"rows {len(df.collect())}"
        except Exception as e:  # report and go on
            out = "ERROR " + str(e).split("JVM stacktrace")[0][:600]
        print(f"{name:40s} {time.time() - t:6.1f}s {out}", flush=True)

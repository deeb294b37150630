"""Spark-vs-DuckDB comparison of registered queries (mirrors the driver's correctness gate).

Usage: python -m tandem.plans.check [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

from tandem.sources.tables import TABLES

_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
          "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
          "date": "DATE", "timestamp": "TIMESTAMP"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def rows_of(names, records):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    out.sort(key=repr)
    return out


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from tandem.plans import ORACLE, QUERIES
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = QUERIES[key](spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    s_names = sdf.columns
    s_types = [_TYPES.get(t, f"{_TYPES.get(t[6:-1], t[6:-1])}[]" if t.startswith("array<") else t)
               for t in (f.dataType.simpleString() for f in sdf.schema.fields)]
    res = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if key not in ORACLE:
        res["oracle"] = "rows-only"
        return res
    rel = con.sql(ORACLE[key])
    d_names = list(rel.columns)
    d_types = [str(t) for t in rel.types]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    res["duck_sec"] = round(time.time() - t1, 2)
    res["names_ok"] = sorted(s_names) == sorted(d_names)
    st = dict(zip(s_names, s_types))
    dt = dict(zip(d_names, d_types))
    res["types_ok"] = res["names_ok"] and all(st[n] == dt[n] for n in s_names)
    if not res["types_ok"]:
        res["types"] = {n: (st.get(n), dt.get(n)) for n in sorted(set(s_names) | set(d_names))
                        if st.get(n) != dt.get(n)}
    if res["names_ok"]:
        a, b = rows_of(s_names, s_rows), rows_of(d_names, d_rows)
        res["values_ok"] = a == b
        if not res["values_ok"]:
            sa, sb = set(a), set(b)
            res["only_spark"] = [x for x in a if x not in sb][:3]
            res["only_duck"] = [x for x in b if x not in sa][:3]
    else:
        res["names"] = (sorted(s_names), sorted(d_names))
    res["ok"] = bool(res.get("values_ok")) and res["types_ok"] and res["spark_rows"] == res["duck_rows"]
    return res


def main(argv):
    from tandem.plans import QUERIES
    from tandem.session import get_session
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark = get_session()
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as e:  # report and continue
            r = {"key": k, "ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        if not r.get("ok") and r.get("oracle") != "rows-only":
            bad += 1
        print(r, flush=True)
    print(f"FAILED {bad} of {len(keys)}")


if __name__ == "__main__":
    main(sys.argv[1:])

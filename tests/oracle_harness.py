"""Run registered Spark queries next to their DuckDB oracle SQL and compare
(column names, row count, types, order-insensitive exact values).

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from tidemark.sources.tables import TABLES  # noqa: E402

_SPARK_TO_DUCK = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP WITH TIME ZONE",
    "timestamp_ntz": "TIMESTAMP", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
}


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return ("~null",)
    if isinstance(v, float):
        if math.isnan(v):
            return ("~null",)
        return ("f", v)
    if hasattr(v, "isoformat"):
        return ("t", v.isoformat())
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return (type(v).__name__, v)


def compare(spark, con, name: str, build, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    t1 = time.time()
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_types = {d[0]: str(d[1]) for d in rel.description}
    d_rows = [dict(zip(d_cols, r)) for r in rel.fetchall()]
    t2 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "spark_sec": round(t1 - t0, 2), "oracle_sec": round(t2 - t1, 2)}
    cols = sorted(s_types)
    if cols != sorted(d_cols):
        res["error"] = f"columns differ: spark={cols} oracle={sorted(d_cols)}"
        return res
    bad_types = {c: (s_types[c], d_types[c]) for c in cols
                 if _SPARK_TO_DUCK.get(s_types[c], s_types[c].upper()) != d_types[c].upper()}
    if bad_types:
        res["type_mismatch"] = bad_types
    s_set = sorted(tuple(_norm(r[c]) for c in cols) for r in s_rows)
    d_set = sorted(tuple(_norm(r[c]) for c in cols) for r in d_rows)
    if len(s_rows) != len(d_rows):
        res["error"] = "row count differs"
    elif s_set != d_set:
        diff = [(a, b) for a, b in zip(s_set, d_set) if a != b]
        res["error"] = f"{len(diff)} rows differ; first: {diff[:2]}"
    res["ok"] = "error" not in res and "type_mismatch" not in res
    return res


def main(argv):
    from tidemark.plans.catalog import CATALOG
    from tidemark.session import get_spark
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or [n for n, s in CATALOG.items() if s.sql]
    spark = get_spark("local[8]", 8)
    con = duck_connect(sf_dir)
    n_ok = 0
    for n in names:
        spec = CATALOG[n]
        if not spec.sql:
            print(f"{n}: no oracle")
            continue
        try:
            r = compare(spark, con, n, spec.build, spec.sql, sf_dir)
        except Exception as e:  # report and go on
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        n_ok += bool(r.get("ok"))
        print(r, flush=True)
    print(f"{n_ok}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv)

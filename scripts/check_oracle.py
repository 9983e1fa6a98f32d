"""Local correctness check: run each registered Spark query and its DuckDB oracle on the same
parquet tables and compare row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


SPARK2DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
              "smallint": "SMALLINT", "float": "FLOAT"}


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10] if len(v.isoformat()) >= 10 else v.isoformat()
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def main():
    sf = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")
    only = set(sys.argv[1:])
    from gridcast.session import local_session
    from gridcast.plans import queries, oracle_sql
    spark = local_session(8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(exc)[:600]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows-only {name}: {len(srows)} rows ({ts:.1f}s)")
            continue
        try:
            cur = con.execute(sqls[name])
            ocols = [d[0] for d in cur.description]
            orows = cur.fetchall()
        except Exception as exc:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(exc)[:600]}")
            bad += 1
            continue
        ok_cols = sorted(scols) == sorted(ocols)
        stypes = {f.name: SPARK2DUCK.get(f.dataType.simpleString(), f.dataType.simpleString())
                  for f in df.schema.fields}
        otypes = {d[0]: str(d[1]) for d in cur.description}
        tdiff = {c: (stypes.get(c), otypes.get(c)) for c in stypes if stypes.get(c) != otypes.get(c)}
        if tdiff:
            print(f"   type diff {name}: {tdiff}")
        hs, ls = digest(scols, srows)
        ho, lo = digest(ocols, orows)
        ok = ok_cols and len(srows) == len(orows) and hs == ho
        print(f"{'ok  ' if ok else 'FAIL'} {name}: spark {len(srows)} rows / oracle {len(orows)} "
              f"cols {'same' if ok_cols else (sorted(scols), sorted(ocols))} ({ts:.1f}s)")
        if not ok:
            bad += 1
            if ok_cols:
                sa, sb = set(ls), set(lo)
                for x in sorted(sa - sb)[:4]:
                    print("   spark-only :", x[:300])
                for x in sorted(sb - sa)[:4]:
                    print("   oracle-only:", x[:300])
    print("mismatches:", bad)


if __name__ == "__main__":
    main()

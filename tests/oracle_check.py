"""Run registered queries on Spark and their SQL twins on DuckDB and compare.

Usage: python -m tests.oracle_check [--sf DIR] [id ...]

Compares column names, row counts and the sorted rows (doubles within a
small tolerance, and exactly after the shared 6-decimal rounding).
"""

from __future__ import annotations

import argparse
import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _key(row):
    return tuple((0, "") if v is None else (1, v if not isinstance(v, float) else round(v, 4)) for v in row)


def compare(spark_rows, spark_cols, duck_rows, duck_cols, tol=1e-6):
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns differ: {spark_cols} vs {duck_cols}"
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(r[i] for i in si) for r in spark_rows), key=_key)
    b = sorted((tuple(r[i] for i in di) for r in duck_rows), key=_key)
    if len(a) != len(b):
        return f"row count {len(a)} vs {len(b)}"
    exact_mismatch = 0
    for ra, rb in zip(a, b):
        for c, x, y in zip(order, ra, rb):
            if x is None or y is None:
                if x is not y and not (x is None and y is None):
                    return f"null mismatch in {c}: {ra} vs {rb}"
                continue
            if isinstance(x, float) or isinstance(y, float):
                if not math.isclose(float(x), float(y), rel_tol=tol, abs_tol=tol):
                    return f"value mismatch in {c}: {x} vs {y}\n  {ra}\n  {rb}"
                if float(x) != float(y):
                    exact_mismatch += 1
            elif str(x) != str(y):
                return f"value mismatch in {c}: {x!r} vs {y!r}\n  {ra}\n  {rb}"
    return "ok" if exact_mismatch == 0 else f"ok (~{exact_mismatch} last-digit float diffs)"


def main(argv=None):
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("ids", nargs="*")
    args = ap.parse_args(argv)
    sys.path.insert(0, ".")
    from partnerlens.plans.registry import load_all
    from partnerlens.session import local_session
    reg = load_all()
    spark = local_session(8, 8)
    con = duck(args.sf)
    ids = args.ids or list(reg)
    bad = 0
    for qid in ids:
        q = reg[qid]
        t0 = time.time()
        try:
            df = q.fn(spark, args.sf)
            rows = [tuple(r) for r in df.collect()]
            cols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"{qid:32s} SPARK ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if q.sql is None:
            print(f"{qid:32s} rows={len(rows):7d} (no oracle) {ts:.1f}s")
            continue
        try:
            con.execute(f"CREATE OR REPLACE VIEW oracle_{qid} AS {q.sql}")      # as the driver does
            res = con.execute(f"SELECT * FROM oracle_{qid}")
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{qid:32s} DUCKDB ERROR {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        verdict = compare(rows, cols, drows, dcols)
        if not verdict.startswith("ok"):
            bad += 1
        print(f"{qid:32s} rows={len(rows):7d} {verdict} {ts:.1f}s")
    print(f"{len(ids) - bad}/{len(ids)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)

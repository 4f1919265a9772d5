"""Run registered queries next to their SQL in DuckDB and compare rows, types and values.

    python tools/check_queries.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidewatch.plans import ORACLES, QUERIES, load_all  # noqa: E402
from tidewatch.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def kind(v) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, int):
        return "int"
    return type(v).__name__


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def order_key(row):
    return tuple((v is None, str(type(v)), round(v, 4) if isinstance(v, float) else v) for v in row)


def compare(spark_rows, spark_cols, sql_rows, sql_cols, tol: float = 0.0) -> str | None:
    if sorted(spark_cols) != sorted(sql_cols):
        return f"columns differ: {sorted(spark_cols)} vs {sorted(sql_cols)}"
    if len(spark_rows) != len(sql_rows):
        return f"row counts differ: {len(spark_rows)} vs {len(sql_rows)}"
    pick = lambda rows, cols: sorted(
        (tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in rows), key=order_key)
    names = sorted(spark_cols)
    bad = []
    for a, b in zip(pick(spark_rows, spark_cols), pick(sql_rows, sql_cols)):
        for c, x, y in zip(names, a, b):
            if x == y:
                if x is not None and kind(x) != kind(y):
                    return f"types differ in {c}: {kind(x)} vs {kind(y)}"
                continue
            if isinstance(x, float) and isinstance(y, float) and tol and math.isclose(x, y, rel_tol=tol, abs_tol=tol):
                continue
            bad.append((c, x, y))
    if bad:
        return f"{len(bad)} values differ, e.g. {bad[:4]}"
    return None


def check(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if name not in ORACLES:
        return True, f"rows={len(rows)} spark={t1 - t0:.1f}s (no SQL)"
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    expected = cur.fetchall()
    problem = compare(rows, df.columns, expected, cols)
    nulls = sum(v is None for r in rows for v in r)
    stat = f"rows={len(rows)} nulls={nulls} spark={t1 - t0:.1f}s duck={time.time() - t1:.1f}s"
    return problem is None, f"{stat} {problem or ''}"


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--show", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    load_all()
    sf_dir = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(8), duck(sf_dir)
    failed = []
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            ok, text = check(spark, con, name, sf_dir)
            if args.show:
                QUERIES[name](spark, sf_dir).show(8, False)
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:700]}"
        print("ok  " if ok else "FAIL", name, text, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

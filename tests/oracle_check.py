"""Run registered queries beside their SQL twins and compare whole results.

Usage: python tests/oracle_check.py SF [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(d: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0 if v != int(v) or math.isinf(v) else int(v)
    if isinstance(v, int):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26]
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=lambda r: tuple((c is None, str(c)) for c in r))


def compare(spark, con, d: str, run, sql: str | None) -> tuple[bool, str]:
    df = run(spark, d)
    got = rows_of(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return len(got[1]) > 0, f"{len(got[1])} rows, no SQL twin"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return False, f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    if bad:
        return False, f"{len(bad)} of {len(got[1])} rows differ, first {bad[0]}"
    return True, f"{len(got[1])} rows"


def main() -> int:
    import __spark_entry__ as e
    from acervo.session import build_session

    d = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(e.queries())
    spark = build_session("oracle-check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = duck(d), []
    for name in names:
        t = time.time()
        try:
            ok, note = compare(spark, con, d, e.queries()[name], e.oracle_sql().get(name))
        except Exception as ex:  # report and go on with the next query
            ok, note = False, f"{type(ex).__name__}: {str(ex)[:2500]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())

"""Runs registered queries on Spark and their SQL twins on DuckDB and compares names, counts and values.

    python tests/compare.py 0.01 [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "~nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def kind(t: str) -> str:
    t = t.lower()
    return {"varchar": "string", "integer": "int"}.get(t, t)


def difference(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    want = rel.fetchall()
    types = {r[0]: kind(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    off = {n: (t, types[n]) for n, t in df.dtypes if t != types[n]}
    if off:
        return f"types {off}"
    got = rows_of(df.columns, df.collect())
    want = rows_of(names, want)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main() -> int:
    from meterline import registry
    from meterline.session import build_session
    from oracles import ORACLES

    folder = f"/root/testdata/sf{sys.argv[1]}"
    keys = sys.argv[2:] or registry.KEYS
    spark = build_session("local[8]", 8)
    con = duck(folder)
    failed = 0
    for k in keys:
        t0 = time.time()
        try:
            diff = difference(registry.run(k, spark, folder), con, ORACLES[k]) if k in ORACLES else "no SQL"
        except Exception as e:  # noqa: BLE001
            diff = f"error {str(e)[:500]}"
        failed += diff is not None
        print("ok  " if diff is None else "DIFF", k, round(time.time() - t0, 1), diff or "", flush=True)
    print(f"{len(keys) - failed} of {len(keys)} equal")
    return int(failed > 0)


if __name__ == "__main__":
    raise SystemExit(main())

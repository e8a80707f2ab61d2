"""Runs registered queries on Spark and their SQL on DuckDB and compares the results.

    python tests/compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    if isinstance(value, float):
        return (1, "nan") if math.isnan(value) else (2, round(value, 6) + 0.0)
    if isinstance(value, bool):
        return (3, str(value))
    if isinstance(value, int):
        return (2, float(value))
    return (4, str(value))


def _rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_key(r[i]) for i in order) for r in rows)


def _kind(text: str) -> str:
    text = text.lower().split("(")[0]
    return {"bigint": "int", "long": "int", "string": "varchar"}.get(text, text)


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None when equal, else what differs."""
    df = query(spark, sf_dir)
    got = df.collect()
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    want = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    mine = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    theirs = {n: _kind(k) for n, k in zip(names, kinds)}
    off = {n: (mine[n], theirs[n]) for n in names if mine[n] != theirs[n]}
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = _rows(df.columns, got), _rows(names, want)
    if a != b:
        wrong = [(x, y) for x, y in zip(a, b) if x != y]
        return f"{len(wrong)} rows differ, first: {wrong[0]}"
    return f"types {off}" if off else None


def main() -> None:
    import __spark_entry__ as entry
    from tests.session import local_session

    sf_dir, chosen = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), connect(sf_dir)
    sqls, failed = entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.perf_counter()
        try:
            if name in sqls:
                problem = compare(spark, con, name, query, sqls[name], sf_dir)
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {len(query(spark, sf_dir).collect())}"
        except Exception as error:
            note = f"FAIL {type(error).__name__}: {str(error)[:600]}"
        failed += note.startswith(("DIFF", "FAIL"))
        print(f"{name:28s} {time.perf_counter() - start:6.2f}s  {note}", flush=True)
    print(f"failed: {failed}")


if __name__ == "__main__":
    main()

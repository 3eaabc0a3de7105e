"""Runs a registered query and its check SQL side by side and compares rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.sql(sql)
    return list(rel.columns), rel.fetchall()


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(_plain(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return float(v)
    return str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(name: str, query, sql: str | None, spark, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"rows={len(got)} unchecked {took:.1f}s"
    columns, expected = oracle_rows(sql, sf_dir)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = normal(df.columns, got), normal(columns, expected)
    if a == b:
        return True, f"rows={len(a)} {took:.1f}s"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"rows {len(a)} vs {len(b)}; " + "\n".join(f"  spark {x}\n  duck  {y}" for x, y in diff)


def main(argv: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    from lureline.shared import local_session

    sf_dir = f"/root/testdata/sf{argv[0]}"
    prefixes = argv[1:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    oracles = oracle_sql()
    for name, query in queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(name, query, oracles.get(name), spark, sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    sys.exit(main(sys.argv[1:]))

"""Run catalogue queries in Spark and in DuckDB and compare columns, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
KINDS = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _key(row):
    return tuple((v is not None, str(type(v)), v) if not isinstance(v, float) else (True, "f", v) for v in row)


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def compare(df, con, sql) -> list[str]:
    spark_types = dict(df.dtypes)
    cols = sorted(df.columns)
    left = [tuple(_plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    rows = cur.fetchall()
    types = {r[0]: r[1] for r in con.execute(f"describe {sql}").fetchall()}
    problems = []
    if sorted(names) != cols:
        return [f"columns: spark {cols} oracle {sorted(names)}"]
    for c in cols:
        if KINDS.get(types[c], types[c]) != spark_types[c]:
            problems.append(f"type of {c}: spark {spark_types[c]} oracle {types[c]}")
    order = [names.index(c) for c in cols]
    right = [tuple(_plain(r[i]) for i in order) for r in rows]
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)} oracle {len(right)}")
    left.sort(key=_key)
    right.sort(key=_key)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        diff = {c: (x, y) for c, x, y in zip(cols, a, b) if x != y}
        problems.append(f"{len(bad)} of {len(left)} rows differ, first: {diff}")
    return problems


def main() -> None:
    import __spark_entry__ as entry
    from loanloom.session import local_session

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark = local_session()
    con = connect(sf_dir)
    failures = 0
    oracle = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            if name in oracle:
                problems = compare(fn(spark, sf_dir), con, oracle[name])
            else:
                problems = [] if fn(spark, sf_dir).count() >= 0 else ["no rows"]
        except Exception as exc:  # noqa: BLE001
            problems = [f"{type(exc).__name__}: {str(exc)[:1500]}"]
        failures += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - t:.2f}s {'' if name in oracle else '(rows only)'}", flush=True)
        for p in problems:
            print("     ", p)
    print("failures:", failures)


if __name__ == "__main__":
    main()

"""Compare registered queries with their SQL: python tests/check.py [sf] [name prefix ...]"""

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, sf_dir, run, sql):
    """None when equal, else a short description of the first difference."""
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got[1] else "no rows"
    cur = con.execute(sql)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


def main():
    from tests.session import make_session

    import __spark_entry__ as e

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = tuple(sys.argv[2:])
    spark, sf_dir = make_session(), f"/root/testdata/sf{sf}"
    con, sql = duck(sf_dir), e.oracle_sql()
    failed = []
    for name, run in e.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, sf_dir, run, sql.get(name))
        except Exception as exc:  # noqa: BLE001
            diff = f"{type(exc).__name__}: {str(exc)[:1500]}"
        kind = "rows" if name not in sql else "sql"
        print(f"{'FAIL' if diff else 'ok':5}{kind:5}{time.time() - t:6.1f}s {name} {diff or ''}", flush=True)
        failed += [name] if diff else []
    print("failed:", failed)


if __name__ == "__main__":
    main()

"""Compare registered queries with their SQL on DuckDB: ``python tests/oracle.py sf name...``."""

import hashlib
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
DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        path = Path(sf_dir) / f"{table}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.6g}"
    if isinstance(value, bool) or value is None:
        return str(value)
    return str(value)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x01".join(_norm(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def compare(spark, con, name, query, sql, sf_dir):
    started = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return True, f"{name}: rows={len(rows)} {took:.1f}s (no sql)", df
    started = time.time()
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    expected = cur.fetchall()
    sql_took = time.time() - started
    note = f"{name}: rows={len(rows)}/{len(expected)} {took:.1f}s sql {sql_took:.1f}s"
    if sorted(df.columns) != sorted(columns):
        return False, f"{note} COLUMNS {sorted(df.columns)} vs {sorted(columns)}", df
    a, la = digest(df.columns, rows)
    b, lb = digest(columns, expected)
    if a != b:
        only_a = sorted(set(la) - set(lb))[:3]
        only_b = sorted(set(lb) - set(la))[:3]
        return False, f"{note} DIFF\n   spark {only_a}\n   sql   {only_b}", df
    return True, note + " ok", df


def main():
    import __spark_entry__ as entry
    from conftest import make_session

    sf_dir = f"{DATA}/{sys.argv[1]}"
    spark = make_session()
    con = connect(sf_dir)
    wanted = sys.argv[2:]
    sqls = entry.oracle_sql()
    bad = []
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            good, note, _ = compare(spark, con, name, query, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            good, note = False, f"{name}: {type(e).__name__} {str(e)[:900]}"
        if not good:
            bad.append(name)
        print(note, flush=True)
    print("FAILED:", bad)


if __name__ == "__main__":
    main()

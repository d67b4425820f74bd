"""Compare registered queries with their oracle SQL: python tests/compare.py <sf_dir> [names…]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def check(spark, con, name, job, sql, folder):
    start = time.time()
    df = job(spark, folder)
    names = df.columns
    got = [tuple(r) for r in df.collect()]
    spark_time = time.time() - start
    if sql is None:
        return f"ROWS  {name:24s} {len(got):7d} rows  spark {spark_time:.1f}s"
    start = time.time()
    res = con.execute(sql)
    want_names = [d[0] for d in res.description]
    want = res.fetchall()
    duck_time = time.time() - start
    tail = f"{len(got):7d} rows  spark {spark_time:.1f}s duck {duck_time:.1f}s"
    if sorted(names) != sorted(want_names):
        return f"FAIL  {name:24s} columns {sorted(names)} vs {sorted(want_names)}"
    a, b = normal(got, names), normal(want, want_names)
    if a != b:
        extra, missing = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
        return (
            f"FAIL  {name:24s} {len(a)} vs {len(b)} {tail}\n   spark only: {str(extra)[:600]}"
            f"\n   duck only:  {str(missing)[:600]}\n   {sorted(names)}"
        )
    duck_types = {d[0]: str(d[1]) for d in con.execute(f"DESCRIBE {sql}").fetchall()}
    odd = {
        c: (t, duck_types[c]) for c, t in df.dtypes if TYPES.get(t, t) != duck_types[c]
    }
    note = f"  types {odd}" if odd else ""
    empty = "  EMPTY" if not got else ""
    return f"OK    {name:24s} {tail}{note}{empty}"


def main(folder: str, wanted: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from passages.session import build_session

    spark = build_session(
        "compare", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "16g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    jobs, oracles = queries(), oracle_sql()
    for name in wanted or jobs:
        try:
            line = check(spark, con, name, jobs[name], oracles.get(name), folder)
        except Exception as e:  # noqa: BLE001 - report and go on with the next query
            line = f"ERROR {name:24s} {type(e).__name__} {str(e)[:700]}"
        print(line, flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])

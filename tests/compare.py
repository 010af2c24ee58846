"""Run registered queries next to their SQL checks and compare the values.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(df, con, sql: str, timing: list[float]) -> str:
    """Empty text when both results agree, else a short description."""
    rows = [tuple(r) for r in df.collect()]
    timing.append(time.time())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    check = rel.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}"
    if len(rows) != len(check):
        return f"rows differ: {len(rows)} / {len(check)}"
    mine, theirs = canon(df.columns, rows), canon(names, check)
    if mine != theirs or repr(mine) != repr(theirs):
        bad = [(a, b) for a, b in zip(mine, theirs) if repr(a) != repr(b)]
        head = "\n".join(f"    {a}\n    {b}" for a, b in bad[:3])
        return f"{len(bad)} of {len(mine)} rows differ {sorted(names)}\n{head}"
    return ""


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("pricelens-compare")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
       .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(argv: list[str]) -> int:
    sf_dir = "/root/testdata/sf0.01"
    if argv and argv[0] == "--sf":
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    spark, con = session(), connect(sf_dir)
    queries, checks = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in argv or queries:
        start = time.time()
        timing: list[float] = []
        try:
            if name in checks:
                df = queries[name](spark, sf_dir)
                problem = compare(df, con, checks[name], timing)
            else:
                n = len(queries[name](spark, sf_dir).collect())
                problem = "" if n else "no rows"
                name += f" (rows only: {n})"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {(timing or [time.time()])[0] - start:6.1f}s spark {time.time() - start:6.1f}s all {name} {problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

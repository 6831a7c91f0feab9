"""Runs a query and its SQL on the same tables and compares columns and rows.

python tests/oracle.py [--sf DIR] [PREFIX ...] prints what differs.
"""

from __future__ import annotations

import datetime
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KIND = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT"}


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[8]")).config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v == v else "nan"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def difference(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    """Empty if columns, types and rows agree."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    mine = Counter(tuple(plain(r[c]) for c in names) for r in df.select(*[df[f"`{c}`"] for c in names]).collect())
    rel = con.sql(sql)
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    if sorted(kinds) != names:
        return f"columns {names}, SQL {sorted(kinds)}"
    types = {c: (k, kinds[c]) for c, k in df.dtypes if KIND.get(k, k) != kinds[c]}
    at = [rel.columns.index(c) for c in names]
    theirs = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    if mine != theirs:
        a, b = mine - theirs, theirs - mine
        return f"{sum(mine.values())} rows, SQL {sum(theirs.values())}; only here {sum(a.values())}: {list(a)[:2]}; only there: {list(b)[:2]}"[:1500]
    if not mine:
        return "no rows at all"
    return f"types {types}" if types else ""


def main(args: list[str]) -> int:
    import __spark_entry__ as entry

    sf_dir = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark, con = session(), database(sf_dir)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name, q in queries.items():
        if args and not any(name.startswith(a) for a in args):
            continue
        began = time.time()
        try:
            what = difference(spark, con, name, q, sql[name], sf_dir) if name in sql else f"no SQL; {q(spark, sf_dir).count()} rows"
        except Exception as e:
            what = f"{type(e).__name__}: {str(e)[:700]}"
        if what:
            bad += not what.startswith("no SQL")
            print(f"{name}: {what} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1:])))

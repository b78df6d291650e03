"""Run registered queries and their SQL side by side and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


TIMES = {"spark": 0.0}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if hasattr(value, "normalize"):
        return float(value)
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    table = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [names[i] for i in order], sorted(table, key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """None if both agree exactly, otherwise what differs."""
    start = time.time()
    df = query(spark, sf_dir)
    names, mine = _rows(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    result = con.execute(sql)
    other_names, theirs = _rows([d[0] for d in result.description], result.fetchall())
    if names != other_names:
        return f"columns {names} / {other_names}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} / {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"first difference {a} / {b}"
    for i, name in enumerate(names):
        types = {type(r[i]) for r in mine + theirs if r[i] is not None}
        if len(types) > 1:
            return f"column {name} has types {types}"
    return None


def main() -> int:
    from pyspark.sql import SparkSession

    from catalog import ORACLES, QUERIES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failures = 0
    for name in wanted:
        start = time.time()
        try:
            if name in ORACLES:
                problem = compare(spark, con, QUERIES[name], ORACLES[name], sf_dir)
            else:
                rows = len(QUERIES[name](spark, sf_dir).collect())
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        failures += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        kind = "" if name in ORACLES else " (rows only)"
        spent = TIMES["spark"] if name in ORACLES else time.time() - start
        print(f"{mark} {spent:6.2f}s {name}{kind} {problem or ''}", flush=True)
    print(f"{len(wanted)} queries, {failures} failures")
    return 1 if failures else 0


if __name__ == "__main__":
    sys.exit(main())

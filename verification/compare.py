"""Run queries next to their SQL: ``python -m verification.compare SF_DIR [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from verification.hashed import ORACLE
from verification.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


TYPES = {"string": "varchar", "int": "integer"}


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", os.environ.get("CHECKPOINT_DIR", "spark-warehouse/checkpoints"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    table = [tuple(canonical(row[at]) for at in order) for row in rows]
    return [columns[at] for at in order], sorted(table, key=lambda row: tuple((v is None, str(v)) for v in row))


def compare(spark, connection, sf_dir, name) -> str:
    started = time.time()
    frame = QUERIES[name](spark, sf_dir)
    found = frame.collect()
    took = time.time() - started
    if name not in ORACLE:
        return f"rows  {name}: {len(found)} rows, {took:.1f}s"
    started = time.time()
    cursor = connection.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    expected = cursor.fetchall()
    sql_took = time.time() - started
    left, right = rows_of(frame.columns, found), rows_of(columns, expected)
    if left == right:
        kinds = {d[0]: str(d[1]).lower() for d in cursor.description}
        odd = [f"{n} {t}/{kinds[n]}" for n, t in frame.dtypes if TYPES.get(t, t) != kinds[n]]
        note = f" types differ: {odd}" if odd else ""
        return f"OK    {name}: {len(found)} rows, {took:.1f}s (sql {sql_took:.1f}s){note}"
    lines = [f"DIFF  {name}: {len(found)} against {len(expected)} rows, {left[0]} {right[0]}"]
    a, b = set(map(str, left[1])), set(map(str, right[1]))
    lines += ["  spark " + row[:300] for row in sorted(a - b)[:3]]
    lines += ["  sql   " + row[:300] for row in sorted(b - a)[:3]]
    return "\n".join(lines)


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, connection = session(os.environ.get("CORES", "8")), database(sf_dir)
    for name in names:
        try:
            print(compare(spark, connection, sf_dir, name), flush=True)
        except Exception as error:
            print(f"FAIL  {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            if os.environ.get("TRACE"):
                traceback.print_exc()


if __name__ == "__main__":
    main()

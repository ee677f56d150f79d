"""Run registered queries and their SQL twins side by side: ``check_queries.py FOLDER [NAME ...]``."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from vacantia.plans import registered  # noqa: E402


def session(cpus: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("vacantia-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(value):
    """A value in a form both engines agree on."""
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def compare(spark_df, sql: str, con) -> str:
    """Empty when both results agree, else the first difference."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    got = [tuple(row) for row in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(names)}"
    order = sorted(names)

    def rows(data, columns):
        index = [columns.index(c) for c in order]
        return sorted((tuple(plain(r[i]) for i in index) for r in data), key=repr)

    left, right = rows(got, list(spark_df.columns)), rows(expected, names)
    if left == right:
        return ""
    only_left, only_right = list(set(left) - set(right))[:2], list(set(right) - set(left))[:2]
    return f"{len(left)} rows vs {len(right)}; {order}\n   spark {only_left}\n   sql   {only_right}"


def connect(folder: str):
    con = duckdb.connect()
    for name in registered().TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def main(folder: str, only: list[str]) -> int:
    spark, con, catalog = session(), connect(folder), registered()
    bad = 0
    for name, fn in catalog.QUERIES.items():
        if only and name not in only:
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            if name in catalog.ORACLES:
                problem = compare(df, catalog.ORACLES[name], con)
                note = "ok" if not problem else "DIFF " + problem[:1500]
            else:
                note = f"rows {df.count()}"
                problem = ""
        except Exception as error:  # noqa: BLE001
            problem = "error"
            note = "ERROR " + "".join(traceback.format_exception_only(error))[:900]
        bad += bool(problem)
        print(f"{name:24s} {time.time() - start:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)

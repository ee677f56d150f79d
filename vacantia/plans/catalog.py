"""Registered queries and the SQL that gives the same result, by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, GroupedData, SparkSession, types as T

from vacantia.schemas import JOB_SCHEMA
from vacantia.sources.tables import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Tables whose rows are costly to work on (text, pages) or come in one row group.
HEAVY_TABLES = ("documents", "pages", "orders", "part")
#: Input views as SQL that Spark and the checking engine read alike; ``{name}`` is a table or a view.
VIEWS: dict[str, str] = {}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_REFERENCE = re.compile(r"\{([a-z]\w*)\}")


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(VIEWS[name])
        table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return spread(table) if name in HEAVY_TABLES else table

    def pages_of(self, rows: DataFrame, *keys: str) -> GroupedData:
        """Rows grouped to pages. The shuffle is the one the grouping needs anyway, but its partitions are
        not merged afterwards, because the pages they hold are costly to parse."""
        count = max(self.spark.sparkContext.defaultParallelism, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return rows.repartition(count, *keys).groupBy(*keys)

    def sql(self, text: str) -> DataFrame:
        names = dict.fromkeys(_REFERENCE.findall(text))
        return self.spark.sql(text, **{n: self[n] for n in names})


def oracle_text(sql: str) -> str:
    """``sql`` with every view it needs as a common table expression."""
    ordered: dict[str, str] = {}

    def need(text: str) -> None:
        for name in _REFERENCE.findall(text):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                ordered[name] = _REFERENCE.sub(r"\1", VIEWS[name])

    need(sql)
    body = _REFERENCE.sub(r"\1", sql)
    if not ordered:
        return body
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in ordered.items())
    if body.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes},\n{body.lstrip()[len('WITH RECURSIVE'):]}"
    if body.lstrip().upper().startswith("WITH"):
        return f"WITH {ctes},\n{body.lstrip()[len('WITH'):]}"
    return f"WITH {ctes}\n{body}"


def query(name: str, oracle: str | None = None):
    """Register ``fn(inputs) -> DataFrame`` under ``name``."""
    def keep(fn: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return fn

    return keep


def job_columns(**given: str) -> str:
    """SELECT list of a JOB_SCHEMA row; columns that are not given are empty."""
    parts = []
    for field in JOB_SCHEMA.fields:
        if field.name == "capture_seq":
            continue
        if field.name in given:
            sql = given[field.name]
        elif field.name in ("published_at", "updated_at"):
            sql = "CAST(NULL AS VARCHAR)"
        elif isinstance(field.dataType, T.DoubleType):
            sql = "CAST(NULL AS DOUBLE)"
        else:
            sql = "''"
        parts.append(f"{sql} AS {field.name}")
    return ", ".join(parts)

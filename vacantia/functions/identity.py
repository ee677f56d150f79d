"""Posting identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import first_non_empty


def stable_key(company="company", source="source", source_id="source_id", url="url") -> Column:
    """24 hex digits over company, source and the board's id (the URL when there is no id)."""
    basis = F.concat_ws(
        "|",
        F.coalesce(F.col(company), F.lit("")),
        F.coalesce(F.col(source), F.lit("")),
        first_non_empty(F.col(source_id), F.col(url)),
    )
    return F.substring(F.sha2(F.lower(basis).cast("binary"), 256), 1, 24)


def with_stable_key(df: DataFrame) -> DataFrame:
    return df.withColumn("stable_key", stable_key())

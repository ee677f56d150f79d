"""Company registry: load, route, and find companies without a normalizer."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.schemas import COMPANY_SCHEMA

_TYPED = {"name", "platform", "enabled", "target_profile"}


def registry_from_records(spark: SparkSession, records: Iterable[Mapping[str, object]]) -> DataFrame:
    """Registry table from configuration entries; keys without a typed column go to ``options``."""
    rows = []
    for record in records:
        options = {
            k: v if isinstance(v, str) else json.dumps(v) for k, v in record.items() if k not in _TYPED and v is not None
        }
        rows.append((record.get("name"), record.get("platform"), record.get("enabled"), record.get("target_profile"), options))
    return spark.createDataFrame(rows, COMPANY_SCHEMA)


def load_registry(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """Registry table and active target profile of a JSON or YAML file."""
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            config = json.load(handle)
        else:
            try:
                import yaml
            except ImportError as error:
                raise RuntimeError("YAML registries need the yaml package; use JSON instead") from error
            config = yaml.safe_load(handle)
    return registry_from_records(spark, config.get("companies", [])), config.get("active_target_profile")


def route_companies(companies: DataFrame, active_profile: str | None = None) -> DataFrame:
    """Enabled companies (the default); with an active profile only those that carry it."""
    enabled = companies.filter(F.coalesce("enabled", F.lit(True)))
    return enabled.filter(F.col("target_profile") == active_profile) if active_profile else enabled

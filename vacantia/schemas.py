"""Table schemas shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXT_FIELDS = [
    "company", "title", "location", "url", "source", "source_id", "description",
    "department", "team", "workplace_type", "employment_type",
]
DATE_FIELDS = ["published_at", "updated_at"]
PAY_FIELDS = [
    "compensation", "compensation_min", "compensation_max",
    "compensation_currency", "compensation_period",
]
JOB_FIELDS = TEXT_FIELDS + DATE_FIELDS + PAY_FIELDS

_NUMERIC_PAY = {"compensation_min", "compensation_max"}


def _field(name: str) -> T.StructField:
    kind = T.DoubleType() if name in _NUMERIC_PAY else T.StringType()
    return T.StructField(name, kind)


#: One posting. ``capture_seq`` is the listing order that decides first-wins and last-wins rules.
JOB_SCHEMA = T.StructType(
    [_field(name) for name in JOB_FIELDS] + [T.StructField("capture_seq", T.LongType())]
)

HISTORY_EXTRA = [
    T.StructField("first_seen", T.TimestampType()),
    T.StructField("last_seen", T.TimestampType()),
    T.StructField("active", T.IntegerType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("band", T.StringType()),
    T.StructField("score_json", T.StringType()),
]
JOB_HISTORY = T.StructType(
    [T.StructField("stable_key", T.StringType())] + [_field(name) for name in JOB_FIELDS] + HISTORY_EXTRA
)

RUN_LOG = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("completed_at", T.StringType()),
    T.StructField("companies_attempted", T.IntegerType()),
    T.StructField("jobs_retrieved", T.LongType()),
    T.StructField("new_jobs", T.LongType()),
    T.StructField("errors_json", T.StringType()),
])

COMPANY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("enabled", T.BooleanType()),
    T.StructField("target_profile", T.StringType()),
    T.StructField("options", T.MapType(T.StringType(), T.StringType())),
])

RULE_SCHEMA = T.StructType([
    T.StructField("section", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("slot", T.StringType()),
    T.StructField("pattern", T.StringType()),
])

RATING_SCHEMA = T.StructType([
    T.StructField("stable_key", T.StringType()),
    T.StructField("overall_interest", T.IntegerType()),
    T.StructField("would_apply", T.StringType()),
    T.StructField("application_status", T.StringType()),
    T.StructField("calibration_source", T.StringType()),
])


def text_or_empty(col: Column | str) -> Column:
    """Absent text is the empty string everywhere in the posting table."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def as_jobs(df: DataFrame, **columns: Column) -> DataFrame:
    """Project ``df`` to JOB_SCHEMA; columns that are not given take their empty value."""
    out = []
    for field in JOB_SCHEMA.fields:
        value = columns.get(field.name)
        if value is None:
            default = "" if field.name in TEXT_FIELDS or field.name in PAY_FIELDS and field.name not in _NUMERIC_PAY else None
            value = F.lit(default)
        elif field.name in TEXT_FIELDS or field.name == "compensation":
            value = F.coalesce(value, F.lit(""))
        out.append(value.cast(field.dataType).alias(field.name))
    return df.select(*out)

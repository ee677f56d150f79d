"""Board health: unverified zero results, errors, collapses, and registry checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

# The platforms, and the configuration keys that each cannot work without.
PLATFORMS: Mapping[str, tuple[str, ...]] = {
    "greenhouse": ("board",), "lever": ("board",), "ashby": ("board",), "gem": ("board",),
    "recruitee": ("board",), "smartrecruiters": ("board",), "kula": ("board",),
    "workday": ("host", "tenant", "board"),
    "career_page": ("url",), "browser_career": ("url",), "oracle": ("url",), "jazzhr": ("url",),
    "ultipro": ("url",), "hologic": ("url",), "jobvite": ("url",), "adp": ("url",),
    "icims": ("url",), "promega": ("url",), "eligo": ("url",), "successfactors": ("url",),
    # Their sites have default addresses; an empty board needs nothing.
    "foundation": (), "adaptive": (), "indigo_ag": (), "empty": (),
    # Named in registries, but every site needs an own reader: its board is an error.
    "custom": (),
}
ZERO_RESULT = "ZERO_RESULT_UNVERIFIED"
UNKNOWN_PLATFORM = "Unknown platform"


def zero_result_warnings(companies: DataFrame, counts: DataFrame, page_evidence: DataFrame | None = None) -> DataFrame:
    """Companies without a posting whose emptiness neither configuration nor page confirms.

    ``companies`` (company, platform, zero_jobs_verified, zero_result_verified) are those captured
    without error; ``counts`` (company, n); ``page_evidence`` (company, verified_empty).
    """
    df = companies.join(counts.select("company", "n"), "company", "left")
    verified = F.coalesce("zero_jobs_verified", F.lit(False)) | F.coalesce("zero_result_verified", F.lit(False))
    if page_evidence is not None:
        df = df.join(page_evidence.select("company", "verified_empty"), "company", "left")
        verified = verified | F.coalesce("verified_empty", F.lit(False))
    empty = F.coalesce("n", F.lit(0)) == 0
    return df.filter(empty & ~verified).select("company", "platform", F.lit(ZERO_RESULT).alias("warning"))


def unknown_platforms(companies: DataFrame, known: Iterable[str] = PLATFORMS) -> DataFrame:
    """Error rows for companies whose platform is none of ``known``; a missing platform is unknown too."""
    return companies.filter(~F.coalesce("platform", F.lit("")).isin(list(known))).select(
        F.col("name").alias("company"), "platform", F.lit(UNKNOWN_PLATFORM).alias("error"))


def board_errors(captures: DataFrame) -> DataFrame:
    """One error row per failed capture."""
    return captures.filter(F.col("error").isNotNull()).select("run", "company", "platform", "error")


def errors_json() -> Column:
    """Aggregate: the failed companies of a run (company, error) as a JSON list in order of their names. A run has one
    row per configured company."""
    failed = F.collect_list(F.when(F.col("error").isNotNull(), F.struct("company", "error")))
    return F.to_json(F.sort_array(failed)).alias("errors_json")


def board_collapse(counts: DataFrame, runs_back: int = 5, max_ratio: float = 0.5) -> DataFrame:
    """Runs whose count falls below ``max_ratio`` of the average over the ``runs_back`` runs before."""
    trail = Window.partitionBy("company").orderBy("run").rowsBetween(-runs_back, -1)
    earlier_sum, earlier_n = F.sum("n").over(trail), F.count("n").over(trail)
    df = counts.withColumns({"earlier_sum": earlier_sum, "earlier_n": earlier_n})
    fell = F.col("n") * F.col("earlier_n") < F.col("earlier_sum") * F.lit(max_ratio)
    return df.filter((F.col("earlier_n") > 0) & fell)


def repeat_errors(status: DataFrame, last_runs: int = 7, min_errors: int = 2) -> DataFrame:
    """Companies with at least ``min_errors`` failures among their ``last_runs`` latest runs."""
    rank = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("run")))
    recent = status.withColumn("_rank", rank).filter(F.col("_rank") <= last_runs)
    failed = recent.groupBy("company").agg(
        F.count_if(~F.col("ok")).alias("errors"), F.count("*").alias("runs"))
    return failed.filter(F.col("errors") >= min_errors)


def registry_problems(companies: DataFrame) -> DataFrame:
    """Problems of a registry: names used twice and options a platform needs but does not have."""
    doubled = (
        companies.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1")
        .select("name", F.lit("duplicate name").alias("problem"), F.col("n").cast("string").alias("detail"))
    )
    missing = F.lit("")
    for platform, needed in PLATFORMS.items():
        absent = F.array_join(F.array_compact(F.array(*[
            F.when(F.coalesce(F.try_element_at("options", F.lit(key)), F.lit("")) == "", F.lit(key)) for key in needed
        ])), ", ")
        missing = F.when(F.col("platform") == platform, absent).otherwise(missing)
    lacking = companies.withColumn("detail", missing).filter(F.col("detail") != "").select(
        "name", F.lit("missing config").alias("problem"), "detail")
    return doubled.unionByName(lacking)


def registry_counts(companies: DataFrame) -> DataFrame:
    """Companies per platform: all, enabled, and routed to a target profile."""
    return companies.groupBy("platform").agg(
        F.count("*").alias("companies"),
        F.count_if(F.coalesce("enabled", F.lit(True))).alias("enabled"),
        F.count("target_profile").alias("targeted"),
    )


def verified_empty(platform: Column, page_text: Column) -> Column:
    """A board that is known to be empty: by its platform or by what its page says."""
    return (platform == "empty") | F.coalesce(page_text, F.lit("")).rlike(EMPTY_PAGE)


# Fixed value: how a page says that there is no opening.
EMPTY_PAGE = (
    r"(?iuUd)(no jobs found|no open positions|no current openings|there are no jobs|current openings \(0 of 0\))"
)

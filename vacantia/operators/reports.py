"""Thresholded, deduplicated and ranked reports, board counters, and run summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.functions.text import squash_ws, strip

SAMPLE_TITLES = 5


def _all_columns(df: DataFrame) -> Column:
    return F.struct(*[F.col(name) for name in df.columns])


def report_filter(rows: DataFrame, min_score: int = 0, new_only: bool = False) -> DataFrame:
    """Rows at or above the threshold that pass the gate (a missing gate passes), optionally new ones only."""
    eligible = F.coalesce(F.col("alert_eligible"), F.lit(True)) if "alert_eligible" in rows.columns else F.lit(True)
    kept = rows.filter((F.coalesce(F.col("total"), F.lit(0)) >= min_score) & eligible)
    return kept.filter(F.coalesce(F.col("is_new"), F.lit(False))) if new_only else kept


def alert_dedupe(rows: DataFrame) -> DataFrame:
    """Best row per (company, title), compared case-blind with white space squashed; the first wins ties.

    Aggregated with a map-side combine, so a title that fills a third of the input costs one
    partial result per task. Keep long texts out of ``rows``: everything in it is shuffled.
    """
    best = F.max_by(_all_columns(rows), F.struct(F.col("total"), -F.col("capture_seq")))
    keys = [squash_ws(F.lower(F.col(name))).alias(f"_{name}") for name in ("company", "title")]
    return rows.groupBy(*keys).agg(best.alias("_best")).select("_best.*")


def ranked_report(rows: DataFrame, min_score: int = 0, new_only: bool = False) -> DataFrame:
    """Filter, dedupe, and order by total, company and title, all descending."""
    best = alert_dedupe(report_filter(rows, min_score, new_only))
    return best.orderBy(F.desc("total"), F.desc("company"), F.desc("title"))


def board_stats(companies: DataFrame, rows: DataFrame, min_score: int) -> DataFrame:
    """Per attempted company: retrieved, matching (threshold and gate) and first-seen postings."""
    matching = (F.col("total") >= min_score) & F.col("alert_eligible")
    counts = rows.groupBy("company").agg(
        F.count("*").alias("retrieved"),
        F.count_if(matching).alias("matching"),
        F.count_if(F.col("is_new")).alias("first_seen"),
    )
    joined = companies.select(F.col("name").alias("company"), "platform").join(counts, "company", "left")
    return joined.fillna(0, ["retrieved", "matching", "first_seen"])


RUN_COUNTS = ("companies_attempted", "jobs_retrieved", "new_jobs", "company_errors", "exported", "exported_new")


def _counted(df: DataFrame, **counts: Column) -> DataFrame:
    """Rows of ``df`` as addends of the run counts."""
    return df.select(*[counts.get(name, F.lit(0)).cast("bigint").alias(name) for name in RUN_COUNTS])


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _sums(names: tuple[str, ...]) -> list[Column]:
    return [F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(name) for name in names]


def _total_parts(stats: DataFrame, errors: DataFrame) -> list[DataFrame]:
    return [
        _counted(stats, companies_attempted=F.lit(1), jobs_retrieved=F.col("retrieved"), new_jobs=F.col("first_seen")),
        _counted(errors, company_errors=F.lit(1)),
    ]


def run_totals(stats: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: companies attempted, jobs retrieved, new jobs, company errors."""
    return _union(_total_parts(stats, errors)).agg(*_sums(RUN_COUNTS[:4]))


def run_summary(stats: DataFrame, errors: DataFrame, warnings: DataFrame, run_id: str, started_at: str, completed_at: str,
                exported: DataFrame, exported_new: DataFrame) -> DataFrame:
    """One row with the run's totals, its export counts and its warnings as JSON.

    ``warnings`` has at most one row per registered company.
    """
    entry = F.struct("company", "platform", "warning")
    parts = [
        *_total_parts(stats, errors), _counted(exported, exported=F.lit(1)), _counted(exported_new, exported_new=F.lit(1)),
    ]
    rows = _union(parts).unionByName(warnings.select(entry.alias("warning")), allowMissingColumns=True)
    listed = F.to_json(F.sort_array(F.collect_list("warning"))).alias("warnings_json")
    return rows.agg(*_sums(RUN_COUNTS), listed).withColumns({
        "run_id": F.lit(run_id), "started_at": F.lit(started_at), "completed_at": F.lit(completed_at),
        "elapsed_seconds": F.lit(completed_at).cast("timestamp").cast("double")
        - F.lit(started_at).cast("timestamp").cast("double"),
    })


def sample_titles(rows: DataFrame, limit: int = SAMPLE_TITLES) -> DataFrame:
    """First ``limit`` distinct non-empty titles per company, in listing order."""
    titled = rows.select("company", strip(F.col("title")).alias("title"), "capture_seq").filter(F.col("title") != "")
    distinct = titled.groupBy("company", "title").agg(F.min("capture_seq").alias("seq"))
    rank = F.row_number().over(Window.partitionBy("company").orderBy("seq"))
    top = distinct.withColumn("rank", rank).filter(F.col("rank") <= limit)
    # At most `limit` rows per company reach the list.
    return top.groupBy("company").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("rank", "title"))), lambda e: e["title"]), " | "
        ).alias("sample_titles"))

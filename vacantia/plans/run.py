"""One search run: captured postings to history, results, health tables and reports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from vacantia.functions.identity import with_stable_key
from vacantia.functions.pay import apply_pay
from vacantia.operators.capture import page_gaps
from vacantia.operators.health import board_errors, errors_json, unknown_platforms, zero_result_warnings
from vacantia.operators.history import merge_history, result_rows, touched_keys
from vacantia.operators.reports import board_stats, ranked_report, run_summary
from vacantia.operators.scoring import SCORE_FIELDS, Profile, with_gate, with_score
from vacantia.schemas import JOB_HISTORY
from vacantia.sources.tables import HistoryTable, append_run


@dataclass(frozen=True)
class RunTables:
    """What a run leaves behind; every member is a plan over tables already written."""

    results: DataFrame
    stats: DataFrame
    errors: DataFrame
    warnings: DataFrame
    ranked: DataFrame
    new_matches: DataFrame
    summary: DataFrame
    gaps: DataFrame | None = None


def scored_postings(jobs: DataFrame, profile: Profile) -> DataFrame:
    """Normalized postings with pay, key, score and gate."""
    keyed = jobs if "stable_key" in jobs.columns else with_stable_key(jobs)
    return with_gate(with_score(apply_pay(keyed), profile), profile)


def history_rows(scored: DataFrame) -> DataFrame:
    """Scored postings with the columns the history keeps, and ``run_at`` if there is one."""
    kept = ["run_at"] if "run_at" in scored.columns else []
    kept += [c for c in JOB_HISTORY.fieldNames() if c in scored.columns and c not in ("score", "band", "score_json")]
    return scored.select(
        *kept, "capture_seq", F.col("total").alias("score"), "band",
        F.to_json(F.struct(*SCORE_FIELDS)).alias("score_json"))


def run_search(jobs: DataFrame, companies: DataFrame, status: DataFrame, profile: Profile, table: HistoryTable,
               results_path: str, run_id: str, started_at: str, completed_at: str, min_score: int = 65,
               errors: DataFrame | None = None, evidence: DataFrame | None = None, run_log_path: str | None = None,
               pages: DataFrame | None = None) -> RunTables:
    """Score ``jobs``, move the history on by one version, and describe the run.

    ``companies``: routed registry (name, platform, options). ``status``: one row per attempted company
    (company, error; null when the capture went well). ``errors`` (company, error): what could not be read, see
    ``boards.payload_errors`` and ``dom.page_errors``; such a company failed and closes no posting, and so did one whose
    platform is unknown. ``evidence`` (company, verified_empty): boards whose page says that there is nothing. ``pages`` (company,
    page_no, n_rows): all captured pages; a board with a hole among them may have listed more, so it closes no posting either, see
    ``capture.page_gaps``.

    What is new is found by key before anything is scored; the scored postings are written to ``results_path`` once, so the
    patterns run once however many tables are read from them, and a lost executor costs a re-read only.
    Reports leave the descriptions behind. A run that is tried again starts from the history it started from before.
    """
    spark = jobs.sparkSession
    before = table.read_before(run_id)
    flagged = result_rows(before, with_stable_key(jobs), run_id, started_at)
    scored_postings(flagged, profile).write.mode("overwrite").parquet(results_path)
    results = spark.read.parquet(results_path)

    platforms = companies.select(F.col("name").alias("company"), "platform", "options")
    reported = status.select("company", "error").unionByName(unknown_platforms(companies).select("company", "error"))
    if errors is not None:
        reported = reported.unionByName(errors.select("company", "error"))
    # One row per company; a company has no error only if nothing reports one.
    outcome = reported.groupBy("company").agg(F.min("error").alias("error"))
    ok = outcome.filter(F.col("error").isNull()).select("company")
    gaps = None if pages is None else page_gaps(pages)
    whole = ok if gaps is None else ok.join(gaps, "company", "left_anti")
    current, moment = history_rows(results), F.lit(started_at).cast("timestamp")
    # Only the buckets that hold a listed or a closing key are written.
    table.update(run_id, touched_keys(before, current, whole), lambda rows: merge_history(rows, current, moment, whole))

    narrow = results.drop("description")
    stats = board_stats(companies, narrow, min_score)
    failed = board_errors(outcome.join(platforms.drop("options"), "company").withColumn("run", F.lit(run_id)))

    def flag(name: str):
        return (F.try_element_at("options", F.lit(name)) == "true").alias(name)

    attempted = platforms.join(ok, "company", "left_semi").select(
        "company", "platform", flag("zero_jobs_verified"), flag("zero_result_verified"))
    known = platforms.select("company", (F.col("platform") == "empty").alias("verified_empty"))
    if evidence is not None:
        known = known.unionByName(evidence.select("company", "verified_empty"))
        known = known.groupBy("company").agg(F.bool_or("verified_empty").alias("verified_empty"))
    counts = stats.select("company", F.col("retrieved").alias("n"))
    warnings = zero_result_warnings(attempted, counts, known)
    ranked, fresh = ranked_report(narrow, min_score), ranked_report(narrow, min_score, new_only=True)
    if run_log_path is not None:
        totals = stats.agg(
            F.count("*").alias("companies_attempted"), F.coalesce(F.sum("retrieved"), F.lit(0)).alias("jobs_retrieved"),
            F.coalesce(F.sum("first_seen"), F.lit(0)).alias("new_jobs"))
        # Two tables of one row.
        logged = totals.withColumn("_one", F.lit(1)).join(outcome.agg(errors_json()).withColumn("_one", F.lit(1)), "_one")
        append_run(logged.select(
            F.lit(run_id).alias("run_id"), F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"),
            "companies_attempted", "jobs_retrieved", "new_jobs", "errors_json"), run_log_path)
    return RunTables(
        results=results, stats=stats, errors=failed, warnings=warnings, ranked=ranked, new_matches=fresh,
        summary=run_summary(stats, failed, warnings, run_id, started_at, completed_at, ranked, fresh), gaps=gaps)

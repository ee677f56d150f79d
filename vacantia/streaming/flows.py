"""The same flow on arriving captures, with Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from vacantia.operators.boards import normalize
from vacantia.operators.history import merge_batch, touched_by_batch
from vacantia.operators.scoring import Profile
from vacantia.plans.run import history_rows, scored_postings
from vacantia.session import scratch_path
from vacantia.sources.tables import HistoryTable


def capture_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """Files of captures as they arrive."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def new_postings_stream(postings: DataFrame, delay: str | None = None, time: str = "capture_ts") -> DataFrame:
    """First row of every stable key, once. With ``delay``, keys are forgotten when the watermark passes
    them, which bounds the state; without it every key is remembered."""
    if delay is None:
        return postings.dropDuplicates(["stable_key"])
    return postings.withWatermark(time, delay).dropDuplicatesWithinWatermark(["stable_key"])


def board_counts_stream(postings: DataFrame, delay: str = "1 day", width: str = "1 day", time: str = "capture_ts") -> DataFrame:
    """Postings per company and time window; rows later than ``delay`` are dropped."""
    return (
        postings.withWatermark(time, delay).groupBy(F.window(time, width), "company").agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), "company", "n")
    )


def history_batch_writer(table: HistoryTable, prepare: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                         query: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that merges each batch into the history.

    ``prepare`` maps a batch to (scored postings with ``run_at``, completed captures (company, run_at)); see
    ``merge_batch`` and ``scored_batches``. A batch need not be a whole run, and it rewrites only the buckets whose rows it
    changes. Versions are named by query and batch id: a batch that runs again after a failure starts from what it started
    from before, and replaces its own buckets.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        name = f"{query}-{batch_id:012d}"
        batch.persist()
        try:
            postings, completed = prepare(batch)
            if not batch.isEmpty():
                # Captures that were complete before close postings of older runs that arrive only now.
                completed = table.record_completed(name, completed)
                touched = touched_by_batch(table.read_before(name), postings, completed)
                table.update(name, touched, lambda rows: merge_batch(rows, postings, completed))
        finally:
            batch.unpersist()

    return merge


class _Completion(StatefulProcessor):
    """Counts the different pages of a run's capture that have arrived, against the number that it should have."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._pages = handle.getMapState("pages", "page_no long", "seen boolean")
        self._counts = handle.getValueState("counts", "seen long, expected long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, expected = self._counts.get() if self._counts.exists() else (0, 0)
        changed = False
        for frame in rows:
            for page in frame["page_no"].dropna().astype("int64").unique().tolist():
                if not self._pages.containsKey((page,)):
                    self._pages.updateValue((page,), (True,))
                    seen, changed = seen + 1, True
            known = frame["n_pages"].dropna()
            if len(known) and int(known.max()) > expected:
                expected, changed = int(known.max()), True
        self._counts.update((seen, expected))
        # A page that comes after the run was complete is listed by it too, so the run is complete anew.
        done = changed and 0 < expected <= seen
        yield pd.DataFrame({"company": [key[0]] * done, "run_at": [pd.Timestamp(key[1])] * done}).astype({"company": str, "run_at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def with_completion(captures: DataFrame) -> DataFrame:
    """The captures (company, run_at, page_no, n_pages, ...) with ``complete`` (false), and a row with ``complete`` (true) per run
    and company once all its pages have arrived, in whatever files and order.

    ``n_pages``: how many pages the capture has; one row that tells it is enough. The state is one row per page number, not the
    bodies, and is kept by run and company.
    """
    narrow = captures.select("company", "run_at", "page_no", "n_pages")
    done = narrow.groupBy("company", "run_at").transformWithStateInPandas(
        statefulProcessor=_Completion(), outputStructType="company string, run_at timestamp", outputMode="Append", timeMode="None")
    return captures.withColumn("complete", F.lit(False)).unionByName(done.withColumn("complete", F.lit(True)), allowMissingColumns=True)


def scored_batches(profile: Profile, platforms: list[str] | None = None) -> Callable[[DataFrame], tuple[DataFrame, DataFrame]]:
    """``prepare`` for ``history_batch_writer``: batches of ``with_completion`` over raw captures are normalised and scored."""
    def prepare(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        # While it is normalised, a run of a company is a board of its own: a batch may hold several.
        mark = F.concat(F.unix_micros("run_at").cast("string"), F.lit("|"), F.col("company"))
        jobs = normalize(batch.filter("not complete").withColumn("company", mark).drop("complete", "n_pages"), platforms)
        run_at = F.timestamp_micros(F.substring_index("company", "|", 1).cast("long"))
        company = F.regexp_extract("company", r"(?s)^-?\d+\|(.*)$", 1)
        own = jobs.select(run_at.alias("run_at"), company.alias("company"), *[c for c in jobs.columns if c != "company"])
        return history_rows(scored_postings(own, profile)), batch.filter("complete").select("company", "run_at")

    return prepare


def expiry_stream(postings: DataFrame, absence_ms: int, delay: str = "1 day", time: str = "capture_ts",
                  history: DataFrame | None = None) -> DataFrame:
    """Keys not listed for ``absence_ms``, with the time they were listed last, once per such absence.

    Sightings of a key that lie ``absence_ms`` apart at most are one session. It is reported when the watermark has passed its last
    sighting by ``absence_ms``, so the result does not depend on the order in which rows arrive within the watermark's delay,
    or on how they are split into batches. The state is one row per open session; no Python runs per key. A row that is later than
    the delay counts while the session that it belongs to is still open.

    ``history`` (stable_key, last_seen) is what the stream starts from: the open postings of a batch history; they expire
    also if the stream never lists them. It arrives with the first batch; read once more after a restart, it changes nothing.
    """
    rows = postings.select("stable_key", F.col(time).alias("seen"))
    if history is not None:
        spark = postings.sparkSession
        past, path = history.select("stable_key", F.col("last_seen").alias("seen")), scratch_path(spark, "expiry-history")
        past.write.parquet(path)
        rows = spark.readStream.schema(past.schema).parquet(path).unionByName(rows)
    timed = rows.withColumn("seen", F.timestamp_millis(F.unix_millis("seen"))).withWatermark("seen", delay)
    sessions = timed.groupBy("stable_key", F.session_window("seen", f"{absence_ms} milliseconds"))
    return sessions.agg(F.max(F.unix_millis("seen")).alias("last_seen_ms")).select("stable_key", "last_seen_ms")

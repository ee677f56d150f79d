"""Durable tables: captures, versioned history snapshots, run log, and CSV reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from vacantia.operators.history import latest_runs
from vacantia.schemas import JOB_HISTORY, RUN_LOG

_COMMIT = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("version", T.StringType()), T.StructField("folder", T.StringType()),
    T.StructField("bucket", T.IntegerType()), T.StructField("buckets", T.IntegerType())])


def read_captures(spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """Captured payloads or pages (company, platform, page_no, body or html, ...) in parquet, JSON or ORC."""
    reader = spark.read.format(file_format)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def spread(df: DataFrame) -> DataFrame:
    """Split a scan that has fewer partitions than there are cores, for work that is heavy per row.

    A file with one huge row group is one task. A scan that already has a partition per core, as any large
    table does, is left alone: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class HistoryTable:
    """History in hash buckets of the stable key, and a small commit log that names each bucket's folder.

    A commit writes the buckets it changes, as one partitioned write to a fresh folder, and becomes visible by its commit rows; the
    other buckets' files stay where they are. So a run that touches few buckets writes little, a failed or half-written
    commit is never read, and nothing that is being read is overwritten. Commits are numbered; a bucket's newest one counts. A
    version that is written again (a retried run or batch) replaces itself, and what it starts from is the table as it was
    before its first commit.

    ``buckets`` is fixed when the table is first written: later sessions take the number from the log.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = 16):
        self.spark, self.root = spark, root.rstrip("/")
        self._buckets = buckets

    def _commits(self) -> DataFrame:
        return _read_or_empty(self.spark, f"{self.root}/_commits_log", _COMMIT)

    def versions(self) -> list[str]:
        """Committed versions in the order of their newest commits."""
        rows = self._commits().groupBy("version").agg(F.max("seq").alias("seq")).orderBy("seq").collect()
        return [r["version"] for r in rows]

    def _state(self, version: str | None = None) -> dict:
        """What the log says, in one aggregate: buckets of the table, newest commit, first and last commit of ``version``, and the
        buckets it wrote so far."""
        own = F.col("version") == F.lit(version)
        row = self._commits().agg(
            F.max("buckets").alias("n"), F.max(F.struct("seq", "version")).alias("newest"), F.min(F.when(own, F.col("seq"))).alias("first"),
            F.max(F.when(own, F.col("seq"))).alias("last"), F.collect_set(F.when(own, F.col("bucket"))).alias("own")).first()
        return {**row.asDict(), "n": row["n"] or self._buckets}

    def _snapshot(self, until: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The newest folders of all buckets, or of some, after commit number ``until``. What is collected is one row per bucket."""
        commits = self._commits()
        newest = (commits if until is None else commits.filter(F.col("seq") <= until)).groupBy("bucket").agg(
            F.max(F.struct("seq", "folder")).alias("c")).select("bucket", "c.folder")
        paths = [
            f"{self.root}/{r['folder']}/bucket={r['bucket']}" for r in newest.where("folder IS NOT NULL").orderBy("bucket").collect()
            if only is None or r["bucket"] in only]
        # Columns that an older commit does not have are null.
        return self.spark.read.schema(JOB_HISTORY).parquet(*paths) if paths else self.read_empty()

    def read(self, version: str | None = None) -> DataFrame:
        """The table after a version, the newest by default; an empty table before the first commit."""
        return self._snapshot() if version is None else self._snapshot(self._state(version)["last"] or 0)

    def read_before(self, version: str) -> DataFrame:
        """What ``version`` starts from, on its first and on every later attempt."""
        return self._snapshot(self._until(self._state(version)))

    @staticmethod
    def _until(state: dict) -> int | None:
        return None if state["first"] is None else state["first"] - 1

    def read_empty(self) -> DataFrame:
        return self.spark.createDataFrame([], JOB_HISTORY)

    def write(self, snapshot: DataFrame, version: str) -> None:
        """Commit ``snapshot``, the whole table, as ``version``. A version that others follow cannot be written again."""
        state = self._state(version)
        self._commit(snapshot, version, list(range(state["n"])), state)

    def update(self, version: str, touched: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> None:
        """Commit as ``version`` what ``merge`` makes of the buckets that hold a key of ``touched`` (stable_key).

        ``merge`` gets the rows of these buckets as they were before the version and returns them with its changes; a row
        whose key is not among ``touched`` must stay as it is.
        """
        state = self._state(version)
        buckets = {r[0] for r in touched.select(bucket_of(F.col("stable_key"), state["n"]).alias("b")).distinct().collect()}
        # What an earlier attempt of this version wrote is written anew.
        changed = sorted(buckets.union(state["own"]))
        if changed:
            self._commit(merge(self._snapshot(self._until(state), changed)), version, changed, state)

    def record_completed(self, version: str, completed: DataFrame) -> DataFrame:
        """Keep the captures (company, run_at) that were complete with ``version``, and return the latest per company of all versions so far. A
        version that is recorded again replaces its own."""
        path = f"{self.root}/_completed"
        completed.select("company", "run_at").distinct().write.mode("overwrite").parquet(f"{path}/v={version}")
        every = self.spark.read.schema("company string, run_at timestamp, v string").parquet(path)
        return every.groupBy("company").agg(F.max("run_at").alias("run_at"))

    def _commit(self, rows: DataFrame, version: str, buckets: list[int], state: dict) -> None:
        newest, n = state["newest"], state["n"]
        if newest is not None and newest["version"] != version and state["first"] is not None:
            raise ValueError(f"version {version} is older than {newest['version']}")
        folder = f"v={version}/{uuid.uuid4().hex}"
        # Dealt by bucket first, so that a bucket is one file and not one per task.
        placed = rows.withColumn("bucket", bucket_of(F.col("stable_key"), n)).repartition("bucket")
        placed.write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
        filled = {r[0] for r in self.spark.read.schema("bucket int").parquet(f"{self.root}/{folder}").distinct().collect()}
        seq = newest["seq"] + 1 if newest is not None else 1
        log = [(seq, version, folder if b in filled else None, b, n) for b in buckets]
        self.spark.createDataFrame(log, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits_log")


def bucket_of(key: Column, n: int) -> Column:
    """The bucket of a stable key."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def append_run(run: DataFrame, path: str) -> None:
    """Add one run-log row; a run recorded again wins when the log is read."""
    run.select(*[F.col(f.name).cast(f.dataType) for f in RUN_LOG.fields]).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return latest_runs(_read_or_empty(spark, path, RUN_LOG))


def write_report(report: DataFrame, path: str) -> None:
    """CSV files with a header each, one per partition: the files of a sorted report follow its order by name, and no task
    gets the whole of it."""
    report.write.mode("overwrite").csv(
        path, header=True, escape='"', emptyValue="", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_report(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV report as text columns; a missing or empty report has no rows."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        return spark.read.csv(path, header=True, schema=schema, escape='"', multiLine=True).fillna("")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)

"""History, run log, board health and streams over events as repeated runs, and the supplier registry."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from vacantia.operators import health, history
from vacantia.plans.catalog import Inputs, query, view
from vacantia.plans.views import registry
from vacantia.schemas import JOB_HISTORY
from vacantia.session import scratch_path
from vacantia.sources.registry import route_companies
from vacantia.sources.tables import HistoryTable, append_run, read_run_log
from vacantia.streaming import flows

_DAY = "CAST(CAST({} AS DATE) AS VARCHAR)"


def as_history(rows: DataFrame, *more: str) -> DataFrame:
    """Sightings or a replay as JOB_HISTORY rows: the event's value is title, score and pay."""
    named = rows.withColumns({
        "title": F.concat(F.lit("event "), F.col("capture_seq").cast("string")),
        "source": F.lit("events"), "source_id": F.col("stable_key"),
        "score": F.floor("value").cast("int"), "compensation_min": F.col("value"),
    })
    for field in JOB_HISTORY.fields:
        if field.name not in named.columns:
            named = named.withColumn(field.name, F.lit(None).cast(field.dataType))
    extra = [c for c in ("capture_seq", *more) if c in rows.columns]
    return named.select(*[F.col(f.name).cast(f.dataType) for f in JOB_HISTORY.fields], *extra)


def _past(inputs: Inputs) -> DataFrame:
    replay = history.replay_history(inputs["past"], inputs["past_status"], ["capture_seq", "value"])
    return as_history(replay).drop("capture_seq")


def _now(inputs: Inputs) -> DataFrame:
    return as_history(inputs["now"])


def _shown(df: DataFrame) -> DataFrame:
    return df.select(
        "stable_key", "company", "title", "score", F.to_date("first_seen").cast("string").alias("first_seen"),
        F.to_date("last_seen").cast("string").alias("last_seen"), "active")


_RUN_TIME = "2024-01-30 06:00:00"

view("past_last", """
    SELECT stable_key, company, min(run) AS first_seen, max(run) AS last_seen, max(capture_seq) AS capture_seq
    FROM {past} GROUP BY stable_key, company""")
view("past_history", """
    SELECT l.stable_key, l.company, l.first_seen, l.last_seen, l.capture_seq, p.value,
           CASE WHEN l.last_seen >= g.last_good THEN 1 ELSE 0 END AS active
    FROM {past_last} l JOIN {past} p ON p.stable_key = l.stable_key AND p.capture_seq = l.capture_seq
    JOIN (SELECT company, max(run) AS last_good FROM {past_status} WHERE ok GROUP BY company) g ON g.company = l.company""")
view("now_last", """
    SELECT n.stable_key, n.company, n.capture_seq, n.value FROM {now} n
    JOIN (SELECT stable_key, max(capture_seq) AS m FROM {now} GROUP BY stable_key) x ON x.stable_key = n.stable_key AND x.m = n.capture_seq""")
view("good_last", """
    SELECT n.stable_key, n.company, n.capture_seq, n.value FROM {now_good} n
    JOIN (SELECT stable_key, max(capture_seq) AS m FROM {now_good} GROUP BY stable_key) x ON x.stable_key = n.stable_key AND x.m = n.capture_seq""")


@query("history_upsert", """
    SELECT coalesce(n.stable_key, h.stable_key) AS stable_key, coalesce(h.company, n.company) AS company,
           concat('event ', CAST(coalesce(n.capture_seq, h.capture_seq) AS VARCHAR)) AS title,
           CAST(floor(coalesce(n.value, h.value)) AS INTEGER) AS score,
           CAST(coalesce(h.first_seen, DATE '2024-01-30') AS VARCHAR) AS first_seen,
           CAST(CASE WHEN n.stable_key IS NULL THEN h.last_seen ELSE DATE '2024-01-30' END AS VARCHAR) AS last_seen,
           CASE WHEN n.stable_key IS NOT NULL THEN 1 ELSE h.active END AS active
    FROM {past_history} h FULL OUTER JOIN {now_last} n ON n.stable_key = h.stable_key""")
def _history_upsert(inputs: Inputs) -> DataFrame:
    merged = history.merge_history(_past(inputs), _now(inputs), F.lit(_RUN_TIME).cast("timestamp"))
    return _shown(merged)


@query("history_deactivate", """
    SELECT coalesce(n.stable_key, h.stable_key) AS stable_key, coalesce(h.company, n.company) AS company,
           concat('event ', CAST(coalesce(n.capture_seq, h.capture_seq) AS VARCHAR)) AS title,
           CAST(floor(coalesce(n.value, h.value)) AS INTEGER) AS score,
           CAST(coalesce(h.first_seen, DATE '2024-01-30') AS VARCHAR) AS first_seen,
           CAST(CASE WHEN n.stable_key IS NULL THEN h.last_seen ELSE DATE '2024-01-30' END AS VARCHAR) AS last_seen,
           CASE WHEN n.stable_key IS NOT NULL THEN 1 WHEN h.company IN (SELECT company FROM {now_ok}) THEN 0 ELSE h.active END AS active
    FROM {past_history} h FULL OUTER JOIN {good_last} n ON n.stable_key = h.stable_key""")
def _history_deactivate(inputs: Inputs) -> DataFrame:
    merged = history.merge_history(
        _past(inputs), as_history(inputs["now_good"]), F.lit(_RUN_TIME).cast("timestamp"), inputs["now_ok"])
    return _shown(merged)


@query("new_postings", """
    SELECT n.stable_key, min(n.capture_seq) AS capture_seq FROM {now} n
    WHERE n.stable_key NOT IN (SELECT stable_key FROM {past_history}) GROUP BY n.stable_key""")
def _new_postings(inputs: Inputs) -> DataFrame:
    return history.new_postings(_past(inputs), _now(inputs)).select("stable_key", "capture_seq")


@query("result_rows", """
    SELECT n.stable_key, n.capture_seq, f.first IS NOT NULL AS is_new, 'run-30' AS run_id,
           CASE WHEN f.first IS NOT NULL THEN '2024-01-30 06:00:00' ELSE '' END AS first_seen_this_run
    FROM {now} n LEFT JOIN (SELECT stable_key, min(capture_seq) AS first FROM {now}
                            WHERE stable_key NOT IN (SELECT stable_key FROM {past_history}) GROUP BY stable_key) f
      ON f.stable_key = n.stable_key AND f.first = n.capture_seq""")
def _result_rows(inputs: Inputs) -> DataFrame:
    rows = history.result_rows(_past(inputs), _now(inputs), "run-30", _RUN_TIME)
    return rows.select("stable_key", "capture_seq", "is_new", "run_id", "first_seen_this_run")


_REPLAY = """
    SELECT l.stable_key, l.company, CAST(l.first_seen AS VARCHAR) AS first_seen, CAST(l.last_seen AS VARCHAR) AS last_seen,
           l.capture_seq, CASE WHEN l.last_seen >= g.last_good THEN 1 ELSE 0 END AS active
    FROM (SELECT stable_key, company, min(run) AS first_seen, max(run) AS last_seen, max(capture_seq) AS capture_seq
          FROM {sightings} GROUP BY stable_key, company) l
    JOIN (SELECT company, max(run) AS last_good FROM {run_status} WHERE ok GROUP BY company) g ON g.company = l.company"""


@query("history_replay", _REPLAY)
def _history_replay(inputs: Inputs) -> DataFrame:
    last_of_day = inputs["sightings"].groupBy("company", "stable_key", "run").agg(F.max("capture_seq").alias("capture_seq"))
    out = history.replay_history(last_of_day, inputs["run_status"], ["capture_seq"])
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query("history_evolve", """
    SELECT stable_key, company, CAST(NULL AS DOUBLE) AS compensation_min, CAST(NULL AS VARCHAR) AS compensation_currency,
           active, CAST(floor(value) AS INTEGER) AS score FROM {past_history}""")
def _history_evolve(inputs: Inputs) -> DataFrame:
    """A snapshot written before the pay columns existed, read with today's schema."""
    table = HistoryTable(inputs.spark, scratch_path(inputs.spark, "history"))
    old = _past(inputs).drop("compensation_min", "compensation_max", "compensation_currency", "compensation_period")
    table.write(old, "20240124")
    return table.read().select("stable_key", "company", "compensation_min", "compensation_currency", "active", "score")


@query("run_log", """
    SELECT concat('run-', CAST(c.run AS VARCHAR)) AS run_id, CAST(c.run AS VARCHAR) AS started_at,
           concat(CAST(c.run AS VARCHAR), 'T02') AS completed_at, CAST(count(*) AS INTEGER) AS companies_attempted,
           CAST(sum(n) AS BIGINT) AS jobs_retrieved, CAST(coalesce(max(f.n_new), 0) AS BIGINT) AS new_jobs,
           concat('[', coalesce(string_agg(CASE WHEN NOT ok THEN concat('{"company":"', company, '","error":"HTTPError"}') END, ',' ORDER BY company), ''), ']') AS errors_json
    FROM {run_counts} c LEFT JOIN (SELECT run, count(*) AS n_new FROM (SELECT stable_key, min(run) AS run FROM {sightings} GROUP BY stable_key) k
                                   GROUP BY run) f ON f.run = c.run
    GROUP BY c.run""")
def _run_log(inputs: Inputs) -> DataFrame:
    """Every run recorded twice; the later record counts."""
    path = scratch_path(inputs.spark, "runlog")
    firsts = inputs["sightings"].groupBy("stable_key").agg(F.min("run").alias("run")).groupBy("run").agg(F.count("*").alias("new_jobs"))
    status = inputs["run_counts"].withColumn("error", F.when(~F.col("ok"), F.lit("HTTPError")))
    runs = status.groupBy("run").agg(
        F.count("*").cast("int").alias("companies_attempted"), F.sum("n").alias("jobs_retrieved"), health.errors_json())
    day = F.col("run").cast("string")
    runs = runs.join(firsts, "run", "left").select(
        F.concat(F.lit("run-"), day).alias("run_id"), day.alias("started_at"), "companies_attempted", "jobs_retrieved",
        F.coalesce("new_jobs", F.lit(0)).alias("new_jobs"), "errors_json")
    early = runs.withColumns({"completed_at": F.concat("started_at", F.lit("T01")), "jobs_retrieved": F.lit(0)})
    append_run(early, path)
    append_run(runs.withColumn("completed_at", F.concat("started_at", F.lit("T02"))), path)
    return read_run_log(inputs.spark, path)


# ---- registry and health ----------------------------------------------------------------------------------

@query("route_companies", """
    SELECT name, platform FROM {registry} WHERE coalesce(enabled, true) AND target_profile = 'user1'""")
def _route_companies(inputs: Inputs) -> DataFrame:
    return route_companies(registry(inputs), "user1").select("name", "platform")


@query("unknown_platform", """
    SELECT name AS company, platform, 'Unknown platform' AS error FROM {registry} WHERE platform = 'mystery'""")
def _unknown_platform(inputs: Inputs) -> DataFrame:
    return health.unknown_platforms(registry(inputs))


@query("registry_checks", """
    SELECT name, 'duplicate name' AS problem, CAST(count(*) AS VARCHAR) AS detail FROM {registry} GROUP BY name HAVING count(*) > 1
    UNION ALL SELECT name, 'missing config', detail FROM (
        SELECT name, CASE WHEN platform IN ('greenhouse', 'lever', 'kula') AND board = '' THEN 'board'
                          WHEN platform = 'career_page' AND url = '' THEN 'url'
                          WHEN platform = 'workday' THEN concat_ws(', ', CASE WHEN host IS NULL THEN 'host' END,
                               CASE WHEN tenant = '' THEN 'tenant' END, CASE WHEN board = '' THEN 'board' END)
                          ELSE '' END AS detail FROM {registry}) m WHERE detail <> ''
    UNION ALL SELECT platform, 'counts', concat(CAST(count(*) AS VARCHAR), '/', CAST(count(CASE WHEN coalesce(enabled, true) THEN 1 END) AS VARCHAR),
                     '/', CAST(count(target_profile) AS VARCHAR)) FROM {registry} GROUP BY platform""")
def _registry_checks(inputs: Inputs) -> DataFrame:
    companies = registry(inputs)
    counts = health.registry_counts(companies).select(
        F.col("platform").alias("name"), F.lit("counts").alias("problem"),
        F.concat_ws("/", *[F.col(c).cast("string") for c in ("companies", "enabled", "targeted")]).alias("detail"))
    return health.registry_problems(companies).unionByName(counts)


view("board_sizes", """
    SELECT s_name AS company, count(l_orderkey) AS n FROM {supplier} JOIN {lineitem} ON l_suppkey * 3 = s_suppkey
    GROUP BY s_name""")


@query("zero_result_boards", """
    SELECT s_name AS company, 'career_page' AS platform, 'ZERO_RESULT_UNVERIFIED' AS warning
    FROM {supplier} LEFT JOIN {board_sizes} ON company = s_name
    WHERE coalesce(n, 0) = 0 AND s_suppkey % 6 <> 0 AND s_suppkey % 7 <> 0 AND s_suppkey % 5 <> 0""")
def _zero_result_boards(inputs: Inputs) -> DataFrame:
    key = F.col("s_suppkey")
    companies = inputs["supplier"].select(
        F.col("s_name").alias("company"), F.lit("career_page").alias("platform"),
        F.when(key % 6 == 0, F.lit(True)).alias("zero_jobs_verified"), (key % 7 == 0).alias("zero_result_verified"))
    evidence = inputs["supplier"].filter(key % 5 == 0).select(
        F.col("s_name").alias("company"), health.verified_empty(F.lit("adp"), F.concat(F.lit("We have NO open positions "), "s_name")).alias("verified_empty"))
    return health.zero_result_warnings(companies, inputs["board_sizes"], evidence)


@query("board_errors", """
    SELECT CAST(run AS VARCHAR) AS run, company, 'events' AS platform, concat('HTTPError: ', CAST(day(run) AS VARCHAR)) AS error
    FROM {run_status} WHERE NOT ok""")
def _board_errors(inputs: Inputs) -> DataFrame:
    captures = inputs["run_status"].select(
        F.col("run").cast("string").alias("run"), "company", F.lit("events").alias("platform"),
        F.when(~F.col("ok"), F.concat(F.lit("HTTPError: "), F.dayofmonth("run").cast("string"))).alias("error"))
    return health.board_errors(captures)


@query("board_collapse", """
    SELECT company, CAST(run AS VARCHAR) AS run, n, CAST(earlier_sum AS BIGINT) AS earlier_sum, earlier_n FROM (
        SELECT company, run, n, sum(n) OVER w AS earlier_sum, count(n) OVER w AS earlier_n FROM {run_counts} WHERE ok
        WINDOW w AS (PARTITION BY company ORDER BY run ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) t
    WHERE earlier_n > 0 AND n * earlier_n < earlier_sum * 0.95""")
def _board_collapse(inputs: Inputs) -> DataFrame:
    counts = inputs["run_counts"].filter("ok").select("company", "run", "n")
    return health.board_collapse(counts, 5, 0.95).withColumn("run", F.col("run").cast("string"))


@query("repeat_errors", """
    SELECT company, count(CASE WHEN NOT ok THEN 1 END) AS errors, count(*) AS runs FROM (
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY run DESC) AS rn FROM {run_status}) t
    WHERE rn <= 14 GROUP BY company HAVING count(CASE WHEN NOT ok THEN 1 END) >= 1""")
def _repeat_errors(inputs: Inputs) -> DataFrame:
    return health.repeat_errors(inputs["run_status"], 14, 1)


# ---- streams --------------------------------------------------------------------------------------------

def _capture_rows(inputs: Inputs) -> DataFrame:
    """Successful sightings with a capture time (the event's), in blocks of five days; a block is a run."""
    rows = inputs["sightings"].join(
        inputs["events"].select(F.col("event_id").alias("capture_seq"), F.col("ts").cast("timestamp").alias("capture_ts")),
        "capture_seq")
    block = F.floor((F.dayofmonth("run") - 1) / 5).cast("int")
    return rows.withColumns({"block": block, "run_at": F.date_add(F.lit("2024-01-01").cast("date"), block * 5).cast("timestamp")})


def _arrive(inputs: Inputs, rows: DataFrame, late: DataFrame | None = None, ends: bool = False) -> tuple[str, DataFrame]:
    """Files that arrive block by block in a fresh folder, several for a block; ``late`` rows come last.

    With ``ends`` a block is followed by a row without a key per company: its capture is complete.
    """
    folder = scratch_path(inputs.spark, "arrivals")
    rows = written(rows, inputs.spark)
    plain = rows.drop("block")
    for block in sorted(r["block"] for r in rows.select("block").distinct().collect()):
        of_block = rows.filter(F.col("block") == block).drop("block")
        of_block.repartition(2).write.mode("append").parquet(folder)
        if ends:
            marks = of_block.groupBy("company", "run_at").agg(F.max("capture_ts").alias("capture_ts"))
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in plain.schema if f.name not in marks.columns]
            marks.select("*", *nothing).select(*plain.columns).write.mode("append").parquet(folder)
    if late is not None:
        late.drop("block").write.mode("append").parquet(folder)
    return folder, plain


def written(df: DataFrame, spark: SparkSession) -> DataFrame:
    path = scratch_path(spark, "rows")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _run_to_files(inputs: Inputs, stream: DataFrame) -> DataFrame:
    """Process everything that has arrived and read the sink back."""
    out = scratch_path(inputs.spark, "sink")
    handle = (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", scratch_path(inputs.spark, "stream")).trigger(availableNow=True).start()
    )
    handle.awaitTermination()
    return inputs.spark.read.schema(stream.schema).parquet(out)


@query("stream_history", """
    WITH blocks AS (SELECT stable_key, company, CAST(floor((day(run) - 1) / 5) AS INTEGER) AS block, capture_seq FROM {sightings}),
         good AS (SELECT company, max(block) AS last_good FROM blocks GROUP BY company),
         spans AS (SELECT stable_key, company, min(block) AS f, max(block) AS l FROM blocks GROUP BY stable_key, company)
    SELECT s.stable_key, s.company, concat('run ', CAST(DATE '2024-01-01' + l * 5 AS VARCHAR)) AS title, CAST(DATE '2024-01-01' + f * 5 AS VARCHAR) AS first_seen,
           CAST(DATE '2024-01-01' + l * 5 AS VARCHAR) AS last_seen, CASE WHEN l >= last_good THEN 1 ELSE 0 END AS active
    FROM spans s JOIN good g ON g.company = s.company""")
def _stream_history(inputs: Inputs) -> DataFrame:
    """Runs that arrive in several files and micro-batches each, and end with a row that says so."""
    folder, rows = _arrive(inputs, _capture_rows(inputs), ends=True)
    table = HistoryTable(inputs.spark, scratch_path(inputs.spark, "history"))

    def prepare(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        is_end = F.col("stable_key").isNull()
        postings = batch.filter(~is_end)
        # Files of one run come in any order, so the title names the run and not the event.
        rows = as_history(postings, "run_at").withColumn("title", F.concat(F.lit("run "), F.to_date("run_at").cast("string")))
        return rows, batch.filter(is_end).select("company", "run_at")

    handle = (
        flows.capture_stream(inputs.spark, folder, rows.schema, files_per_batch=2).writeStream
        .foreachBatch(flows.history_batch_writer(table, prepare))
        .option("checkpointLocation", scratch_path(inputs.spark, "stream")).trigger(availableNow=True).start()
    )
    handle.awaitTermination()
    return _shown(table.read()).drop("score")


@query("stream_new", "SELECT DISTINCT stable_key FROM {sightings}")
def _stream_new(inputs: Inputs) -> DataFrame:
    folder, rows = _arrive(inputs, _capture_rows(inputs))
    stream = flows.capture_stream(inputs.spark, folder, rows.schema, files_per_batch=2)
    return _run_to_files(inputs, flows.new_postings_stream(stream, "60 days").select("stable_key"))


@query("stream_board_counts", """
    SELECT CAST(run AS VARCHAR) AS day, company, count(*) AS n FROM {sightings}
    WHERE run < (SELECT CAST(max(ts) - INTERVAL 6 DAY AS DATE) FROM {events} JOIN {sightings} ON capture_seq = event_id)
    GROUP BY run, company""")
def _stream_board_counts(inputs: Inputs) -> DataFrame:
    """Daily counts; the first block arrives a second time at the end and is too late to count."""
    rows = _capture_rows(inputs)
    folder, plain = _arrive(inputs, rows, late=rows.filter(F.col("block") == 0))
    stream = flows.capture_stream(inputs.spark, folder, plain.schema, files_per_batch=1)
    counts = _run_to_files(inputs, flows.board_counts_stream(stream, "6 days"))
    return counts.select(F.to_date("window_start").cast("string").alias("day"), "company", "n")


view("expiry_times", """
    SELECT stable_key, run, epoch_us(CAST(e.ts AS TIMESTAMP)) // 1000 AS ms FROM {sightings} JOIN {events} e ON capture_seq = e.event_id""")


@query("stream_expiry", """
    WITH known AS (SELECT stable_key, max(ms) AS ms FROM {expiry_times} WHERE day(run) <= 10 GROUP BY stable_key
                   UNION ALL SELECT stable_key, ms FROM {expiry_times} WHERE day(run) > 10),
         following AS (SELECT stable_key, ms, lead(ms) OVER (PARTITION BY stable_key ORDER BY ms) AS later FROM known)
    SELECT stable_key, ms AS last_seen_ms FROM following
    WHERE (later IS NULL OR later - ms > 259200000) AND ms + 259200000 <= (SELECT max(ms) - 518400000 FROM {expiry_times} WHERE day(run) > 10)""")
def _stream_expiry(inputs: Inputs) -> DataFrame:
    """Three days of absence; the first two blocks are the history that the stream starts from."""
    rows = _capture_rows(inputs)
    past = rows.filter(F.col("block") < 2).groupBy("stable_key").agg(F.max("capture_ts").alias("last_seen"))
    folder, plain = _arrive(inputs, rows.filter(F.col("block") >= 2))
    stream = flows.capture_stream(inputs.spark, folder, plain.schema, files_per_batch=3)
    with _rocks(inputs.spark):
        return _run_to_files(inputs, flows.expiry_stream(stream, absence_ms=3 * 86_400_000, delay="6 days", history=past))


@contextmanager
def _rocks(spark: SparkSession):
    """The state store that operators with state of their own need."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(provider, before)


_STREAM_PROFILE = {
    "role_rules": [{"name": "event", "score": 30, "patterns": ["sighting"]}],
    "location": {"enabled": False},
}


@query("stream_raw_captures", """
    WITH blocks AS (SELECT stable_key, company, CAST(floor((day(run) - 1) / 5) AS INTEGER) AS block FROM {sightings}),
         good AS (SELECT company, max(block) AS last_good FROM blocks GROUP BY company),
         spans AS (SELECT stable_key, company, min(block) AS f, max(block) AS l FROM blocks GROUP BY stable_key, company)
    SELECT s.company, s.stable_key AS source_id, concat('Sighting in run ', CAST(l AS VARCHAR)) AS title, 30 AS score,
           CAST(DATE '2024-01-01' + f * 5 AS VARCHAR) AS first_seen, CAST(DATE '2024-01-01' + l * 5 AS VARCHAR) AS last_seen,
           CASE WHEN l >= last_good THEN 1 ELSE 0 END AS active
    FROM spans s JOIN good g ON g.company = s.company""")
def _stream_raw_captures(inputs: Inputs) -> DataFrame:
    """Raw payloads of many pages that arrive shuffled, several files to a batch and runs out of order within it: normalised,
    scored and merged in one stream. A run closes postings once all its pages are there."""
    rows = _capture_rows(inputs).withColumn("page_no", F.pmod(F.xxhash64("stable_key"), F.lit(6)))
    item = F.struct(
        F.col("stable_key").alias("id"), F.concat(F.lit("Sighting in run "), F.col("block").cast("string")).alias("text"),
        F.concat(F.lit("https://example.com/"), "stable_key").alias("hostedUrl"))
    pages = rows.dropDuplicates(["company", "run_at", "stable_key"]).groupBy("company", "run_at", "page_no").agg(
        F.to_json(F.collect_list(item)).alias("body"))
    counted = pages.groupBy("company", "run_at").agg(F.count("*").alias("n_pages"))
    captures = pages.join(counted, ["company", "run_at"]).withColumn("platform", F.lit("lever"))
    folder = scratch_path(inputs.spark, "arrivals")
    captures = written(captures, inputs.spark)
    captures.repartition(5, F.xxhash64("run_at", "company", "page_no")).write.parquet(folder)
    table = HistoryTable(inputs.spark, scratch_path(inputs.spark, "history"), buckets=4)
    stream = flows.with_completion(flows.capture_stream(inputs.spark, folder, captures.schema, files_per_batch=2))
    with _rocks(inputs.spark):
        handle = (
            stream.writeStream.foreachBatch(flows.history_batch_writer(table, flows.scored_batches(_STREAM_PROFILE, ["lever"])))
            .option("checkpointLocation", scratch_path(inputs.spark, "stream")).trigger(availableNow=True).start()
        )
        handle.awaitTermination()
    return table.read().select(
        "company", "source_id", "title", "score", F.to_date("first_seen").cast("string").alias("first_seen"),
        F.to_date("last_seen").cast("string").alias("last_seen"), "active")

import datetime
import random

import pandas as pd
from pyspark.sql import functions as F

from vacantia.operators import health, history
from vacantia.schemas import JOB_HISTORY
from vacantia.sources.tables import HistoryTable, append_run, read_run_log
from vacantia.streaming import flows

CURRENT = "capture_seq long, stable_key string, company string, source string, source_id string, title string, score int"


def at(day):
    return F.lit(f"2024-01-{day:02d} 06:00:00").cast("timestamp")


def current(spark, rows):
    return spark.createDataFrame([(i, k, c, "s", k, t, 1) for i, (k, c, t) in enumerate(rows)], CURRENT)


def companies(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "company string")


def state(df):
    return {r["stable_key"]: (r["company"], r["title"], r["first_seen"].day, r["last_seen"].day, r["active"]) for r in df.collect()}


def test_upsert_rules(spark):
    empty = spark.createDataFrame([], JOB_HISTORY)
    one = history.merge_history(empty, current(spark, [("k1", "a", "old"), ("k2", "a", "x"), ("k3", "b", "y"), ("k1", "a", "last wins")]), at(1), companies(spark, "a", "b"))
    assert state(one) == {"k1": ("a", "last wins", 1, 1, 1), "k2": ("a", "x", 1, 1, 1), "k3": ("b", "y", 1, 1, 1)}
    # k1 is renamed and claims another company: the company of a known key stays. b failed, so k3 is untouched.
    two = history.merge_history(one, current(spark, [("k1", "z", "new")]), at(2), companies(spark, "a"))
    assert state(two) == {"k1": ("a", "new", 1, 2, 1), "k2": ("a", "x", 1, 1, 0), "k3": ("b", "y", 1, 1, 1)}
    # A successful company without any posting is closed as a whole.
    three = history.merge_history(two, current(spark, []), at(3), companies(spark, "b"))
    assert state(three)["k3"] == ("b", "y", 1, 1, 0) and state(three)["k1"][4] == 1


def test_upsert_twice_is_upsert_once(spark):
    rows, ok = current(spark, [("k1", "a", "t"), ("k2", "a", "u")]), companies(spark, "a")
    once = history.merge_history(spark.createDataFrame([], JOB_HISTORY), rows, at(1), ok)
    assert state(history.merge_history(once, rows, at(1), ok)) == state(once)


def test_new_once_per_run(spark):
    empty = spark.createDataFrame([], JOB_HISTORY)
    rows = current(spark, [("k1", "a", "t"), ("k1", "a", "t"), ("k2", "a", "u")])
    flags = [r["is_new"] for r in history.result_rows(empty, rows, "r", "now").orderBy("capture_seq").collect()]
    assert flags == [True, False, True]
    known = history.merge_history(empty, rows, at(1))
    assert history.new_postings(known, rows).count() == 0
    assert {r["first_seen_this_run"] for r in history.result_rows(known, rows, "r", "now").collect()} == {""}


def test_replay_equals_folding_run_by_run(spark):
    rng = random.Random(5)
    sightings, status = [], []
    for day in range(1, 9):
        for name in "ab":
            ok = rng.random() < 0.7
            status.append((name, day, ok))
            if ok:
                sightings += [(name, f"{name}{i}", day, day * 100 + i) for i in range(6) if rng.random() < 0.5]
    folded = spark.createDataFrame([], JOB_HISTORY)
    for day in range(1, 9):
        rows = spark.createDataFrame([(s, k, c, "s", k, "t", s) for c, k, d, s in sightings if d == day], CURRENT)
        ok = companies(spark, *[n for n, d, good in status if d == day and good])
        folded = spark.createDataFrame(history.merge_history(folded, rows, at(day), ok).collect(), JOB_HISTORY)
    replay = history.replay_history(
        spark.createDataFrame(sightings, "company string, stable_key string, run int, score int"),
        spark.createDataFrame(status, "company string, run int, ok boolean"), ["score"])
    left = {r["stable_key"]: (r["company"], r["first_seen"].day, r["last_seen"].day, r["active"], r["score"]) for r in folded.collect()}
    right = {r["stable_key"]: (r["company"], r["first_seen"], r["last_seen"], r["active"], r["score"]) for r in replay.collect()}
    assert left == right and len(left) > 5


def test_deactivate(spark):
    base = history.merge_history(spark.createDataFrame([], JOB_HISTORY), current(spark, [("k1", "a", "t"), ("k2", "a", "t"), ("k3", "b", "t")]), at(1))
    closed = history.deactivate_missing(base, current(spark, [("k1", "a", "t")]), companies(spark, "a"))
    assert {r["stable_key"]: r["active"] for r in closed.collect()} == {"k1": 1, "k2": 0, "k3": 1}


def test_history_table_versions_and_old_schema(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "h"))
    assert table.versions() == [] and table.read().count() == 0
    old = history.merge_history(table.read(), current(spark, [("k1", "a", "t")]), at(1)).drop("compensation_min")
    table.write(old, "1")
    # A snapshot whose commit row is missing is not read.
    old.withColumn("title", F.lit("half")).write.parquet(str(tmp_path / "h" / "v=2"))
    assert table.versions() == ["1"]
    row = table.read().collect()[0]
    assert (row["title"], row["compensation_min"]) == ("t", None)
    table.write(history.merge_history(table.read(), current(spark, [("k1", "a", "u")]), at(2)), "2")
    assert table.versions() == ["1", "2"] and table.read().collect()[0]["title"] == "u" and table.read("1").collect()[0]["title"] == "t"


def test_run_log_keeps_the_last_record(spark, tmp_path):
    path = str(tmp_path / "runs")
    for end, jobs in (("T1", 1), ("T2", 2)):
        append_run(spark.createDataFrame([("r", "s", end, 1, jobs, 0, "[]")], "run_id string, started_at string, completed_at string, "
                                         "companies_attempted int, jobs_retrieved int, new_jobs int, errors_json string"), path)
    assert [(r["run_id"], r["jobs_retrieved"]) for r in read_run_log(spark, path).collect()] == [("r", 2)]


def test_collapse_and_repeat_errors(spark):
    counts = spark.createDataFrame([("a", i, n) for i, n in enumerate([10, 10, 4, 10, 10])] + [("b", 0, 0), ("b", 1, 5)], "company string, run int, n long")
    assert [(r["company"], r["run"]) for r in health.board_collapse(counts, 3, 0.5).collect()] == [("a", 2)]
    status = spark.createDataFrame([("a", i, i < 3) for i in range(5)] + [("b", i, i > 0) for i in range(5)], "company string, run int, ok boolean")
    assert [(r["company"], r["errors"]) for r in health.repeat_errors(status, 4, 2).collect()] == [("a", 2)]


# ---- streams ----

STREAM = "capture_seq long, stable_key string, company string, source string, source_id string, title string, score int, capture_ts timestamp"


def arrivals(spark, folder, batches):
    for batch in batches:
        rows = [(i, k, c, "s", k, "t", 1, datetime.datetime(2024, 1, day, 12)) for i, (k, c, day) in enumerate(batch)]
        spark.createDataFrame(rows, STREAM).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema


def drain(stream, tmp_path, name):
    handle = (stream.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / name))
              .option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start())
    handle.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(str(tmp_path / name))


def test_new_postings_stream_reports_each_key_once(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = arrivals(spark, folder, [[("k1", "a", 1), ("k1", "a", 1)], [("k1", "a", 2), ("k2", "b", 2)]])
    for delay in (None, "30 days"):
        stream = flows.new_postings_stream(flows.capture_stream(spark, folder, schema, 1), delay)
        assert sorted(r["stable_key"] for r in drain(stream, tmp_path, f"new{delay is None}").collect()) == ["k1", "k2"]


def test_history_stream_equals_batch_and_retries_are_harmless(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = arrivals(spark, folder, [[("k1", "a", 1), ("k2", "a", 1), ("k3", "b", 1)], [("k2", "a", 2)]])
    table = HistoryTable(spark, str(tmp_path / "h"))
    day = F.date_trunc("day", "capture_ts").alias("run_at")
    writer = flows.history_batch_writer(table, lambda df: (df.select("*", day), df.select("company", day).distinct()))
    handle = (flows.capture_stream(spark, folder, schema, 1).writeStream.foreachBatch(writer)
              .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
    handle.awaitTermination()
    expected = {"k1": ("a", "t", 1, 1, 0), "k2": ("a", "t", 1, 2, 1), "k3": ("b", "t", 1, 1, 1)}
    assert state(table.read()) == expected
    rows = spark.read.parquet(folder).filter("day(capture_ts) = 2")
    writer(rows, 1)  # the last batch runs again after a lost acknowledgement
    assert state(table.read()) == expected and len(table.versions()) == 2


def test_expiry_stream(spark, tmp_path):
    folder = str(tmp_path / "in")
    schema = arrivals(spark, folder, [[("gone", "a", 1), ("stays", "a", 1)], [("stays", "a", 12)], [("stays", "a", 20)]])
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = flows.expiry_stream(flows.capture_stream(spark, folder, schema, 1), absence_ms=12 * 86_400_000)
        rows = drain(stream, tmp_path, "expired").collect()
    finally:
        spark.conf.set(provider, before)
    assert [(r["stable_key"], pd.Timestamp(r["last_seen_ms"], unit="ms").day) for r in rows] == [("gone", 1)]


def test_a_run_may_be_split_over_batches(spark, tmp_path):
    """Two batches of one run, then its end; a batch-run history before it; the next run closes what it does not list."""
    table = HistoryTable(spark, str(tmp_path / "h"))
    table.write(history.merge_history(table.read(), current(spark, [("k0", "a", "t"), ("k9", "b", "t")]), at(1)), "20240101T060000")
    columns = CURRENT + ", run_at timestamp, complete boolean"

    def batch(day, keys, complete=()):
        moment = datetime.datetime(2024, 1, day, 6)
        rows = [(i, k, "a", "s", k, "t", 1, moment, False) for i, k in enumerate(keys)] + [(None, None, c, None, None, None, None, moment, True) for c in complete]
        return spark.createDataFrame(rows, columns)

    writer = flows.history_batch_writer(table, lambda df: (df.filter("not complete"), df.filter("complete").select("company", "run_at")), "q")
    writer(batch(2, ["k1", "k2"]), 0)
    writer(batch(2, ["k3", "k0"]), 1)
    assert {k: v[4] for k, v in state(table.read()).items()} == {"k0": 1, "k1": 1, "k2": 1, "k3": 1, "k9": 1}
    writer(batch(2, [], ["a"]), 2)
    assert {k: v[2:] for k, v in state(table.read()).items()} == {
        "k0": (1, 2, 1), "k1": (2, 2, 1), "k2": (2, 2, 1), "k3": (2, 2, 1), "k9": (1, 1, 1)}
    writer(batch(3, ["k2"]), 3)
    writer(batch(3, ["k2"]), 3)
    writer(batch(3, [], ["a"]), 4)
    assert {k: v[2:] for k, v in state(table.read()).items()} == {
        "k0": (1, 2, 0), "k1": (2, 2, 0), "k2": (2, 3, 1), "k3": (2, 2, 0), "k9": (1, 1, 1)}


def test_equal_sequence_numbers_leave_one_row_per_key(spark):
    rows = spark.createDataFrame([(5, "k", "a", "s", "k", t, 1) for t in ("x", "y", "x")] + [(4, "k", "a", "s", "k", "old", 1)], CURRENT)
    kept = history.last_per_key(rows).collect()
    assert len(kept) == 1 and kept[0]["capture_seq"] == 5 and history.last_per_key(rows.repartition(3)).collect() == kept


def test_a_retried_version_starts_from_what_it_started_from(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "h"))
    table.write(history.merge_history(table.read(), current(spark, [("k1", "a", "t")]), at(1)), "r1")
    for _ in range(2):
        before = table.read_before("r2")
        assert history.new_postings(before, current(spark, [("k1", "a", "t"), ("k2", "a", "t")])).count() == 1
        table.write(history.merge_history(before, current(spark, [("k1", "a", "t"), ("k2", "a", "t")]), at(2)), "r2")
    assert table.versions() == ["r1", "r2"] and table.read().count() == 2
    import pytest
    with pytest.raises(ValueError):
        table.write(table.read(), "r1")


def bucket_files(root):
    return {str(p.relative_to(root)) for p in root.rglob("part-*.parquet") if "_commits_log" not in str(p)}


def test_an_update_leaves_the_files_of_other_buckets_alone(spark, tmp_path):
    from vacantia.sources.tables import bucket_of

    table = HistoryTable(spark, str(tmp_path / "h"), buckets=8)
    keys = [f"k{i}" for i in range(60)]
    first = current(spark, [(k, "a", "t") for k in keys])
    table.update("r1", first, lambda rows: history.merge_history(rows, first, at(1)))
    before = bucket_files(tmp_path / "h")
    assert table.read().count() == 60 and len(before) == 8
    one = current(spark, [("k7", "a", "new")])
    ok = companies(spark)

    def step(version, day, rows):
        touched = history.touched_keys(table.read_before(version), rows, ok)
        table.update(version, touched, lambda part: history.merge_history(part, rows, at(day), ok))

    step("r2", 2, one)
    assert len(bucket_files(tmp_path / "h") - before) == 1
    got = {r["stable_key"]: r["title"] for r in table.read().collect()}
    assert got == {k: "new" if k == "k7" else "t" for k in keys} and table.versions() == ["r1", "r2"]
    # The run again with another key: what it changed before goes back, the number of buckets is the table's own.
    table = HistoryTable(spark, str(tmp_path / "h"), buckets=3)
    other = next(k for k in keys if spark.range(1).select(bucket_of(F.lit(k), 8) != bucket_of(F.lit("k7"), 8)).first()[0])
    step("r2", 2, current(spark, [(other, "a", "newer")]))
    assert {r["stable_key"]: r["title"] for r in table.read().collect()} == {k: "newer" if k == other else "t" for k in keys}
    assert {r["title"] for r in table.read("r1").collect()} == {"t"}


def test_a_closing_key_touches_its_bucket(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "h"), buckets=50)
    rows = current(spark, [("k1", "a", "t"), ("k2", "a", "t"), ("k3", "b", "t")])
    table.write(history.merge_history(table.read(), rows, at(1)), "r1")
    now, ok = current(spark, [("k1", "a", "t")]), companies(spark, "a")
    touched = history.touched_keys(table.read(), now, ok)
    assert sorted(r[0] for r in touched.collect()) == ["k1", "k2"]
    table.update("r2", touched, lambda part: history.merge_history(part, now, at(2), ok))
    assert {r["stable_key"]: r["active"] for r in table.read().collect()} == {"k1": 1, "k2": 0, "k3": 1}
    table.update("r3", touched.limit(0), lambda part: part)
    assert table.versions() == ["r1", "r2"]


def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def test_expiry_starts_from_the_history_and_survives_a_restart(spark, tmp_path):
    folder, day_ms = str(tmp_path / "in"), 86_400_000
    past = spark.createDataFrame([("old", datetime.datetime(2024, 1, 1)), ("back", datetime.datetime(2024, 1, 2))], "stable_key string, last_seen timestamp")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rocks(spark)
    try:
        schema = arrivals(spark, folder, [[("back", "a", 4), ("hole", "a", 5)], [("back", "a", 6), ("hole", "a", 11)]])
        make = lambda: flows.expiry_stream(flows.capture_stream(spark, folder, schema, 1), 4 * day_ms, "3 days", history=past)
        seen = lambda rows: sorted((r["stable_key"], pd.Timestamp(r["last_seen_ms"], unit="ms").day) for r in rows.collect())
        # The watermark ends at day 8: 'old' was away for four days, 'back' came back in time, 'hole' is not settled yet.
        assert seen(drain(make(), tmp_path, "out")) == [("old", 1)]
        arrivals(spark, folder, [[("late", "a", 20)], [("late", "a", 20)]])
        # The query goes on from its checkpoint: 'hole' was away from day 5 to 11 and from 11 on.
        assert seen(drain(make(), tmp_path, "out")) == [("back", 6), ("hole", 5), ("hole", 11), ("old", 1)]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)


def test_expiry_runs_no_python_per_key_and_counts_an_absence_to_the_millisecond(spark, tmp_path):
    folder, hour = str(tmp_path / "in"), datetime.timedelta(hours=1)
    start = datetime.datetime(2024, 1, 1, 0, 0, 0, 900)
    times = {"edge": [start, start + 4 * hour], "over": [start, start + 4 * hour + datetime.timedelta(milliseconds=1)], "part": [start, start + 4 * hour + datetime.timedelta(microseconds=50)]}
    rows = [(key, seen) for key, seens in times.items() for seen in seens]
    for part in (rows[1:4], rows[:1] + rows[4:], [("end", start + 30 * hour)], [("end", start + 30 * hour)]):
        spark.createDataFrame(part, "stable_key string, capture_ts timestamp").coalesce(1).write.mode("append").parquet(folder)
    schema = spark.createDataFrame([], "stable_key string, capture_ts timestamp").schema
    past = spark.createDataFrame([("over", start - 3 * hour), ("past", start)], "stable_key string, last_seen timestamp")
    stream = flows.expiry_stream(flows.capture_stream(spark, folder, schema, 1), 4 * 3_600_000, "6 hours", history=past)
    assert "InPandas" not in stream._jdf.queryExecution().logical().toString()
    ms = lambda t: int(t.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000)
    got = sorted((r["stable_key"], r["last_seen_ms"]) for r in drain(stream, tmp_path, "out").collect())
    assert got == sorted([("edge", ms(times["edge"][1])), ("over", ms(start)), ("over", ms(times["over"][1])), ("part", ms(times["part"][1])), ("past", ms(start))])


def test_raw_captures_split_at_will_equal_the_batch_and_late_pages_reopen_a_run(spark, tmp_path):
    import json

    columns = "company string, run_at timestamp, page_no long, n_pages long, platform string, body string"

    def page(day, page_no, ids, n_pages=2):
        body = json.dumps([{"id": i, "text": f"Scientist {day}", "hostedUrl": f"u/{i}"} for i in ids])
        return ("A", datetime.datetime(2024, 1, day), page_no, n_pages, "lever", body)

    folder = str(tmp_path / "in")
    profile = {"role_rules": [{"name": "s", "score": 30, "patterns": ["scientist"]}], "location": {"enabled": False}}
    table = HistoryTable(spark, str(tmp_path / "h"), buckets=4)

    def arrive(*files):
        for rows in files:
            spark.createDataFrame(rows, columns).coalesce(1).write.mode("append").parquet(folder)
        schema = spark.createDataFrame([], columns).schema
        stream = flows.with_completion(flows.capture_stream(spark, folder, schema, 1))
        handle = (stream.writeStream.foreachBatch(flows.history_batch_writer(table, flows.scored_batches(profile, ["lever"])))
                  .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start())
        handle.awaitTermination()
        return {r["source_id"]: (r["first_seen"].day, r["last_seen"].day, r["active"], r["score"]) for r in table.read().collect()}

    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    rocks(spark)
    try:
        # Run 1 is whole, of run 2 a page is missing: it closes nothing.
        assert arrive([page(1, 0, ["a", "b"]), page(2, 0, ["a"])], [page(1, 1, ["c"])]) == {
            "a": (1, 2, 1, 30), "b": (1, 1, 1, 30), "c": (1, 1, 1, 30)}
        # The missing page: now run 2 closes what it does not list.
        assert arrive([page(2, 1, ["c"])]) == {"a": (1, 2, 1, 30), "b": (1, 1, 0, 30), "c": (1, 2, 1, 30)}
        # The run has one page more than it said: its posting opens again.
        assert arrive([page(2, 2, ["b"], 3)]) == {"a": (1, 2, 1, 30), "b": (1, 2, 1, 30), "c": (1, 2, 1, 30)}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)

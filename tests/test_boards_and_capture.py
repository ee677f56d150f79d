import json
import random

import pytest
from pyspark.sql import functions as F

from vacantia.operators import boards, capture, jsonld
from vacantia.sources.registry import registry_from_records, route_companies
from vacantia.operators.health import registry_problems, unknown_platforms, zero_result_warnings

CAPTURE = "company string, board string, page_no long, platform string, public_base string, body string"


def captures(spark, platform, *bodies):
    return spark.createDataFrame(
        [("Acme", "acme", i, platform, "https://h/en-US/b", json.dumps(b)) for i, b in enumerate(bodies)], CAPTURE)


def first(df):
    return df.orderBy("capture_seq").collect()[0]


def test_greenhouse(spark):
    body = {"jobs": [{"id": 7, "title": "T", "content": "<p>a</p><div class='pay-range'>$1 - $2</div>", "departments": [{"name": "X"}, {"name": "Y"}],
                      "location": None, "absolute_url": "u", "updated_at": "d"}]}
    row = first(boards.greenhouse(captures(spark, "greenhouse", body)))
    assert (row["source_id"], row["description"], row["department"], row["location"], row["compensation"]) == ("7", "a $1 - $2", "X, Y", "", "$1 - $2")


def test_lever_pay_only_when_given(spark):
    body = [{"id": "a", "text": "T", "salaryRange": {}, "descriptionPlain": "", "additionalPlain": "x"},
            {"id": "b", "text": "T", "salaryRange": {"currency": "USD", "min": 1, "max": 2, "interval": "per-year"}}]
    rows = boards.lever(captures(spark, "lever", body)).orderBy("capture_seq").collect()
    assert [r["compensation"] for r in rows] == ["", "USD 1-2 per-year"]
    assert rows[0]["description"] == "x"


def test_ashby_hides_only_explicit_false(spark):
    body = {"jobs": [{"id": "1", "isListed": False}, {"id": None, "isListed": None, "jobUrl": "u"}, {"id": "3"}]}
    rows = boards.ashby(captures(spark, "ashby", body)).orderBy("capture_seq").collect()
    assert [r["source_id"] for r in rows] == ["u", "3"]


@pytest.mark.parametrize("location, expected", [
    ({"locations": [{"name": "Remote - US"}, "Oslo"]}, "Remote - US; Oslo"), ({"location": {"display_name": "D"}}, "D"),
    ({"location": "", "locations": [{"name": "L"}]}, "L"), ({"location": "S"}, "S"), ({}, ""),
])
def test_gem_location_shapes(spark, location, expected):
    for body in ({"job_posts": [{"id": 1, "title": "T", **location}]}, [{"id": 1, "title": "T", **location}]):
        assert first(boards.gem(captures(spark, "gem", body)))["location"] == expected


def test_recruitee(spark):
    body = {"offers": [{"id": 1, "status": "draft"}, {"status": "published", "slug": "s", "locations": [{"name": "A"}, "B"], "description": "<b>metagenomics</b>"}]}
    row = first(boards.recruitee(captures(spark, "recruitee", body)))
    assert (row["url"], row["source_id"], row["location"], row["description"]) == ("https://acme.recruitee.com/o/s", "s", "A; B", "metagenomics")


def test_smartrecruiters_detail_wins_and_keeps_section_order(spark):
    listing = captures(spark, "smartrecruiters", {"content": [
        {"uuid": "u", "name": "N", "location": {"city": "San Diego", "region": "CA", "country": "us"}, "ref": "r"}], "totalFound": 1})
    detail = json.dumps({"name": "N2", "jobAd": {"sections": {"z": {"text": "<p>one</p>"}, "a": [{"text": "two"}, "three"], "m": {"title": "four"}}}})
    details = spark.createDataFrame([("Acme", "u", detail)], "company string, pid string, body string")
    row = first(boards.smartrecruiters(listing, details))
    assert (row["title"], row["location"], row["url"], row["description"]) == ("N2", "San Diego, CA, us", "r", "one two\nthree\nfour")
    alone = first(boards.smartrecruiters(listing))
    assert (alone["title"], alone["source_id"], alone["description"]) == ("N", "u", "")


def test_workday_listing_and_detail(spark):
    def posting(i, **more):
        return {"title": f"T{i}", "externalPath": f"/job/Oslo/{i}", "locationsText": "Oslo", "postedOn": "Posted 2 Days Ago", "bulletFields": [f"R{i}"], **more}

    listing = captures(spark, "workday", {"total": 2, "jobPostings": [posting(1), posting(2, locationsText="5", externalPath="/job/US---CA---San-Diego/2")]},
                       {"total": 2, "jobPostings": [posting(1, title="copy")]})
    detail = {"jobPostingInfo": {"title": "Full", "jobReqId": "43098-JOB-1", "location": "", "jobDescription": "<p>Hi <b>you</b></p>", "timeType": "Full time",
                                 "salary": {"currency": "USD", "min": 1, "max": 2}}}
    details = spark.createDataFrame([("Acme", "/job/Oslo/1", json.dumps(detail)), ("Acme", "", "{}")], "company string, external_path string, body string")
    rows = boards.workday(listing, details).orderBy("capture_seq").collect()
    assert [(r["title"], r["source_id"], r["location"], r["description"], r["published_at"], r["compensation"]) for r in rows] == [
        ("Full", "43098-JOB-1", "Oslo", "Hi you", "Posted 2 Days Ago", "USD 1 2"), ("T2", "R2", "US - CA - San Diego", "", "Posted 2 Days Ago", "")]
    assert rows[0]["url"] == "https://h/en-US/b/job/Oslo/1"


def test_normalize_unions_platforms_and_takes_new_ones(spark):
    boards.register_normalizer("echo", lambda df: boards.lever(df).withColumn("source", F.lit("echo")))
    try:
        both = captures(spark, "lever", [{"id": "a"}]).unionByName(captures(spark, "echo", [{"id": "b"}]))
        assert {r["source"] for r in boards.normalize(both, ["lever", "echo"]).collect()} == {"lever", "echo"}
    finally:
        del boards.NORMALIZERS["echo"]


def test_candidates(spark):
    rows = [("c", t, i, own) for i, (t, own) in enumerate([
        ("Bioinformatics Lead", None), ("Chef", None), ("Data Scientist", None), ("GENOMICS", None), ("Chef", ["chef"]), ("Genomics", ["chef"])])]
    df = spark.createDataFrame(rows, "company string, title string, capture_seq long, terms array<string>")
    got = capture.enrich_candidates(df, own_terms="terms").orderBy("capture_seq").collect()
    assert [r["capture_seq"] for r in got] == [0, 2, 3, 4]


@pytest.mark.parametrize("seed", range(2))
def test_first_copies_and_page_gaps(spark, seed):
    rng = random.Random(seed)
    first, gaps, listings, pages = set(), set(), [], []
    for company in range(12):
        board = {no: [rng.randrange(25) for _ in range(rng.choice([3, 3, 3, 2, 0]))] for no in range(8) if rng.random() < 0.8}
        seen = set()
        for no, keys in sorted(board.items()):
            pages.append((company, no, len(keys)))
            listings += [(company, str(k), no, pos) for pos, k in enumerate(keys)]
            first |= {(company, no, str(k)) for k in keys if k not in seen}
            seen |= set(keys)
        numbers = sorted(board)
        missing = set(range(numbers[0], numbers[-1])) - set(numbers)
        empty = [no for no in numbers[:-1] if not board[no]]
        if missing or empty:
            gaps.add((company, len(missing), len(empty)))
    got = capture.first_copies(spark.createDataFrame(listings, "company int, listing_key string, page_no long, pos int"))
    assert {(r["company"], r["page_no"], r["listing_key"]) for r in got.collect()} == first
    holes = capture.page_gaps(spark.createDataFrame(pages, "company int, page_no long, n_rows long"))
    assert {(r["company"], r["missing_pages"], r["empty_pages"]) for r in holes.collect()} == gaps


def test_link_closure_reaches_the_end_of_a_chain(spark):
    chain = [("c", f"p{i}", f"p{i + 1}") for i in range(59)] + [("c", "p59", "p0"), ("c", "lone", "p3"), ("d", "p0", "x")]
    links = spark.createDataFrame(chain, "company string, from_url string, to_url string").coalesce(1)
    seeds = spark.createDataFrame([("c", "p0"), ("c", "p0")], "company string, url string").coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = capture.link_closure(seeds, links).collect()
        with pytest.raises(RuntimeError):
            capture.link_closure(seeds, links, max_rounds=5)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {(r["url"], r["round"]) for r in got} == {(f"p{i}", i) for i in range(60)} and len(got) == 60


def test_same_host_job_links(spark):
    rows = [("c", "https://x.org/a", 1, "https://x.org/job/1"), ("c", "https://x.org/a", 2, "https://y.org/job/1"), ("c", "https://x.org/a", 3, "https://x.org/news")]
    got = capture.same_host_job_links(spark.createDataFrame(rows, "company string, page_url string, seq int, link string")).collect()
    assert [(r["from_url"], r["to_url"]) for r in got] == [("https://x.org/a", "https://x.org/job/1")]


def test_discover_boards(spark):
    html = '<a href="/wday/cxs/hidden/RealBoard/jobs">x</a> "wday/cxs/hidden/RealBoard" /wday/cxs/t2/B?x'
    df = spark.createDataFrame([("c", 1, html)], "company string, page_id int, html string")
    assert {(r["tenant"], r["board"]) for r in capture.discover_boards(df).collect()} == {("hidden", "RealBoard"), ("t2", "B")}


def test_registry(spark):
    records = [
        {"name": "A", "platform": "workday", "target_profile": "user1", "host": "h", "tenant": "t", "max_pages": 3},
        {"name": "B", "platform": "lever", "enabled": False, "target_profile": "user1", "board": "b"},
        {"name": "B", "platform": "nope"},
    ]
    table = registry_from_records(spark, records)
    assert [r["name"] for r in route_companies(table, "user1").collect()] == ["A"]
    assert sorted(r["name"] for r in route_companies(table).collect()) == ["A", "B"]
    assert {tuple(r) for r in registry_problems(table).collect()} == {("B", "duplicate name", "2"), ("A", "missing config", "board")}
    assert [tuple(r) for r in unknown_platforms(table, ["workday", "lever"]).collect()] == [("B", "nope", "Unknown platform")]


def test_zero_results(spark):
    companies = spark.createDataFrame(
        [("a", "x", None, None), ("b", "x", True, None), ("c", "x", None, None), ("d", "empty", None, None), ("e", "x", False, True)],
        "company string, platform string, zero_jobs_verified boolean, zero_result_verified boolean")
    counts = spark.createDataFrame([("c", 4)], "company string, n long")
    evidence = spark.createDataFrame([("d", True)], "company string, verified_empty boolean")
    assert [r["company"] for r in zero_result_warnings(companies, counts, evidence).collect()] == ["a"]


def test_jsonld_shapes(spark):
    def posting(**more):
        return json.dumps({"@type": "JobPosting", "title": "T", **more})

    bodies = [
        posting(jobLocation={"address": {"addressLocality": "Seattle", "addressRegion": "WA", "addressCountry": "US"}}, identifier={"value": 1234}),
        posting(jobLocation=[{"address": {"addressLocality": "A"}}, {"name": "B"}, "C"], identifier="x"),
        posting(jobLocation={"addressLocality": "Own"}, baseSalary={"currency": "USD", "value": {"minValue": 1, "maxValue": 2.5, "unitText": "HOUR"}}),
        posting(applicantLocationRequirements={"@type": "Country", "name": "US"}, baseSalary={"currency": "USD", "value": {"maxValue": 2}}),
        posting(jobLocation={"address": "Main St", "name": "HQ"}, employmentType=["A", "B"]),
    ]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, body string")
    rows = df.select("i", jsonld.posting_struct(F.try_parse_json("body")).alias("p")).select("i", "p.*").orderBy("i").collect()
    assert [r["location"] for r in rows] == ["Seattle, WA, US", "A", "Own", "", ""]
    assert [r["all_locations"] for r in rows] == ["Seattle, WA, US", "A; C", "Own", "", "HQ"]
    assert [r["identifier"] for r in rows] == ["1234", "x", "", "", ""]
    assert [r["salary"] for r in rows] == ["", "", "USD 1-2.5 / HOUR", "USD 2 /", ""]
    assert rows[4]["employment_type"] == "A, B"


def test_last_capture_ranks_narrow(spark):
    from vacantia.operators.capture import last_capture

    rows = [("c", "1", "old", 1), ("c", "1", "new", 2), ("c", "1", "new", 2), ("c", "2", None, None), ("c", "2", "timed", 5), (None, "3", "x", 1)]
    df = spark.createDataFrame(rows, "company string, pid string, body string, captured_at int")
    last = last_capture(df, "company", "pid")
    assert sorted(last.collect(), key=lambda r: r["pid"]) == [("c", "1", "new", 2), ("c", "2", "timed", 5), (None, "3", "x", 1)]
    assert "SortAggregate" not in last._jdf.queryExecution().executedPlan().toString()
    # Without times the choice depends on the content alone, not on the order of rows.
    untimed = df.drop("captured_at")
    assert sorted(map(str, last_capture(untimed, "company", "pid").collect())) == sorted(
        map(str, last_capture(untimed.orderBy(F.desc("body")), "company", "pid").collect()))


def test_normalize_takes_the_first_variant_that_lists_something(spark):
    def page(*ids, key="jobs"):
        return json.dumps({key: [{"id": i, "title": f"T{i}"} for i in ids]})

    rows = [
        ("a", "greenhouse", 1, 0, page()), ("a", "greenhouse", 2, 0, page()), ("a", "greenhouse", 2, 1, page(1)), ("a", "greenhouse", 3, 0, page(2)),
        ("b", "greenhouse", 1, 0, page(3)), ("b", "greenhouse", 2, 0, page(3)), ("c", "greenhouse", 1, 0, "{broken"), ("c", "greenhouse", 2, 0, None),
        ("d", "lever", 1, 0, "[]"), ("d", "lever", 2, 0, json.dumps([{"id": 4, "text": "T4"}])),
        ("e", "workday", 1, 0, page(key="jobPostings")),
        ("e", "workday", 2, 0, json.dumps({"jobPostings": [{"title": "T5", "externalPath": "/job/5"}]})),
        ("f", "ashby", 5, 0, json.dumps([{"id": 6, "title": "T6"}])),
    ]
    df = spark.createDataFrame(rows, "company string, platform string, variant_rank int, page_no int, body string")
    got = sorted((r["company"], r["title"]) for r in boards.normalize(df).collect())
    assert got[:3] == [("a", "T1"), ("b", "T3"), ("d", "T4")] and ("e", "T5") in got and len([g for g in got if g[0] in "abcde"]) == 4
    # Without ranks every capture counts.
    assert boards.normalize(df.drop("variant_rank"), ["greenhouse"]).count() == 4
    # A platform of one's own without a key: a payload that is not blank counts.
    boards.register_normalizer("own", boards.lever)
    try:
        own = [("g", "own", 1, 0, " "), ("g", "own", 2, 0, json.dumps([{"id": 7, "text": "T7"}])), ("g", "own", 3, 0, json.dumps([{"id": 8, "text": "T8"}]))]
        assert [r["title"] for r in boards.normalize(spark.createDataFrame(own, df.schema), ["own"]).collect()] == ["T7"]
    finally:
        del boards.NORMALIZERS["own"], boards.LIST_KEYS["own"]

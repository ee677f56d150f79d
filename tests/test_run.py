import json

from vacantia.operators.boards import normalize
from vacantia.plans.run import run_search
from vacantia.sources.registry import registry_from_records, route_companies
from vacantia.sources.tables import HistoryTable

PROFILE = {
    "role_rules": [{"name": "s", "score": 30, "patterns": ["scientist"]}],
    "domain_rules": [{"name": "g", "weight": 25, "patterns": ["genom"]}],
    "technical_rules": [{"name": "p", "weight": 20, "patterns": ["python"]}],
    "location": {"enabled": True, "allow_ambiguous": False, "allowed_patterns": ["oslo"], "excluded_patterns": []},
}
CAPTURE = "company string, board string, page_no long, platform string, body string"


def run(spark, tmp_path, table, run_id, day, boards, failed=(), **more):
    companies = route_companies(registry_from_records(spark, [
        {"name": "A", "platform": "lever", "board": "a"}, {"name": "B", "platform": "ashby", "board": "b"},
        {"name": "C", "platform": "lever", "board": "c"}, {"name": "D", "platform": "empty"}, {"name": "E", "platform": "lever", "enabled": False}]))
    captures = spark.createDataFrame([(c, c.lower(), 0, p, json.dumps(b)) for c, p, b in boards], CAPTURE)
    status = spark.createDataFrame([(c, "TimeoutError: slow" if c in failed else None) for c in "ABCD"], "company string, error string")
    return run_search(normalize(captures, ["lever", "ashby"]), companies, status, PROFILE, table, str(tmp_path / run_id), run_id,
                      f"2024-01-0{day} 06:00:00", f"2024-01-0{day} 06:00:30", **more)


def test_two_runs(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))

    def posting(i, text="Genomics with Python, $100,000 - $120,000", place="Oslo"):
        return {"id": str(i), "text": f"Scientist {i}", "descriptionPlain": text, "categories": {"location": place}, "hostedUrl": f"u{i}"}

    lever = ("A", "lever", [posting(1), posting(2, place="Mars"), posting(3, "none")])
    ashby = ("B", "ashby", {"jobs": [{"id": "9", "title": "Scientist", "location": "Oslo", "descriptionPlain": "genom python", "jobUrl": "v"}]})
    one = run(spark, tmp_path, table, "r1", 1, [lever, ashby])
    assert [(r["company"], r["title"], r["total"], r["compensation"]) for r in one.ranked.collect()] == [
        ("B", "Scientist", 75, "Not listed"), ("A", "Scientist 1", 75, "$100,000–$120,000/yr")]
    assert {r["company"]: (r["retrieved"], r["matching"], r["first_seen"]) for r in one.stats.collect()} == {
        "A": (3, 1, 3), "B": (1, 1, 1), "C": (0, 0, 0), "D": (0, 0, 0)}
    assert [r["company"] for r in one.warnings.collect()] == ["C"]
    summary = one.summary.collect()[0]
    assert (summary["companies_attempted"], summary["jobs_retrieved"], summary["new_jobs"], summary["exported"], summary["elapsed_seconds"]) == (4, 4, 4, 2, 30.0)

    two = run(spark, tmp_path, table, "r2", 2, [("A", "lever", [posting(1), posting(4)])], failed=("B",))
    assert [(r["company"], r["title"]) for r in two.new_matches.collect()] == [("A", "Scientist 4")]
    assert [(r["company"], r["platform"], r["error"]) for r in two.errors.collect()] == [("B", "ashby", "TimeoutError: slow")]
    history = {(r["company"], r["source_id"]): (r["first_seen"].day, r["last_seen"].day, r["active"], r["score"]) for r in table.read().collect()}
    assert history == {("A", "1"): (1, 2, 1, 75), ("A", "2"): (1, 1, 0, 75), ("A", "3"): (1, 1, 0, 30), ("A", "4"): (2, 2, 1, 75), ("B", "9"): (1, 1, 1, 75)}
    assert json.loads(table.read().filter("source_id = '4'").collect()[0]["score_json"])["domain_fit"] == 25


def test_errors_unknown_platforms_evidence_and_log(spark, tmp_path):
    from vacantia.operators.boards import payload_errors
    from vacantia.sources.tables import read_run_log

    table = HistoryTable(spark, str(tmp_path / "history"))
    posting = {"id": "1", "text": "Scientist", "descriptionPlain": "genom python", "categories": {"location": "Oslo"}, "hostedUrl": "u"}
    run(spark, tmp_path, table, "r1", 1, [("A", "lever", [posting])])
    # The next capture of A is cut off: an error, and A's posting stays open.
    broken = spark.createDataFrame([("A", json.dumps([posting])[:-3])], "company string, body string")
    evidence = spark.createDataFrame([("C", True)], "company string, verified_empty boolean")
    log = str(tmp_path / "log")
    for _ in range(2):
        two = run(spark, tmp_path, table, "r2", 2, [("B", "ashby", {"jobs": [{"id": "9", "title": "Scientist", "location": "Oslo", "descriptionPlain": "genom python"}]})],
                  errors=payload_errors(broken), evidence=evidence, run_log_path=log)
        assert [r["company"] for r in two.errors.collect()] == ["A"] and two.warnings.count() == 0
        assert [r["company"] for r in two.new_matches.collect()] == ["B"]
    assert {(r["company"], r["active"]) for r in table.read().collect()} == {("A", 1), ("B", 1)}
    logged = read_run_log(spark, log).collect()
    assert [(r["run_id"], r["companies_attempted"], r["jobs_retrieved"], r["new_jobs"]) for r in logged] == [("r2", 4, 1, 1)]
    assert json.loads(logged[0]["errors_json"]) == [{"company": "A", "error": "ValueError: unreadable payload"}]


def test_a_board_with_missing_pages_closes_nothing(spark, tmp_path):
    table = HistoryTable(spark, str(tmp_path / "history"))
    posting = lambda i: {"id": str(i), "text": "Scientist", "categories": {"location": "Oslo"}, "hostedUrl": f"u{i}"}
    run(spark, tmp_path, table, "r1", 1, [("A", "lever", [posting(1), posting(2)]), ("C", "lever", [posting(3), posting(4)])])
    # Of A page 9 is missing; C is whole.
    pages = spark.createDataFrame([("A", n, 100) for n in range(12) if n != 9] + [("C", 0, 1)], "company string, page_no long, n_rows long")
    two = run(spark, tmp_path, table, "r2", 2, [("A", "lever", [posting(1)]), ("C", "lever", [posting(3)])], pages=pages)
    assert [(r["company"], r["missing_pages"]) for r in two.gaps.collect()] == [("A", 1)]
    assert {r["source_id"]: r["active"] for r in table.read().collect()} == {"1": 1, "2": 1, "3": 1, "4": 0}


def test_scoring_stands_in_the_plan_once(spark, tmp_path):
    from vacantia.plans.catalog import Inputs
    from vacantia.plans.scoring_queries import flagged
    from vacantia.operators.reports import board_stats

    rows = spark.createDataFrame([(1, "Scientist\ngenom", "en", "src0", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    inputs = Inputs(spark, str(tmp_path))
    plan = board_stats(inputs["attempted"], flagged(inputs), 65)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1

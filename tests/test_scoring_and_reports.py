import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from vacantia.operators import calibration, digest, reports, scoring
from vacantia.schemas import as_jobs
from vacantia.sources.tables import read_report, write_report

PROFILE = {
    "profile_status": "personalized_ready",
    "role_rules": [
        {"name": "postdoc", "score": 30, "patterns": ["postdoc.*", "fellow.*"]},
        {"name": "scientist", "score": 28, "patterns": ["research.*", "scientist.*"]},
        {"name": "default", "score": 2, "patterns": [".*"]},
    ],
    "domain_rules": [{"name": "gut", "weight": 15, "patterns": ["gut", "host"]}, {"name": "genom", "weight": 15, "patterns": ["genom"]}],
    "technical_rules": [{"name": "code", "weight": 5, "patterns": ["python", r"\br\b"]}],
    "seniority_rules": [{"name": "vp", "adjustment": -50, "patterns": [r"\bvp\b"]}, {"name": "director", "adjustment": -30, "patterns": [r"\bdirector\b"]}],
    "penalty_rules": [{"name": "eng", "adjustment": -20, "title_patterns": ["software engineer"], "unless_text_patterns": ["genom"]}],
    "location": {"enabled": True, "allow_ambiguous": True, "allowed_patterns": ["remote", "boston"], "excluded_patterns": ["india"]},
}


def jobs(spark, rows):
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)], "capture_seq long, company string, title string, location string, url string, description string")
    return as_jobs(df, **{c: F.col(c) for c in df.columns})


def brute_score(title, text):
    """The same rules in plain Python."""
    def hit(patterns, s):
        return any(re.search(p, s, re.I) for p in patterns)

    role = next((r["score"] for r in PROFILE["role_rules"] if hit(r["patterns"], title)), 0)
    domain = min(25, sum(r["weight"] for r in PROFILE["domain_rules"] if hit(r["patterns"], text)))
    tech = min(20, sum(r["weight"] for r in PROFILE["technical_rules"] if hit(r["patterns"], text)))
    senior = next((r["adjustment"] for r in PROFILE["seniority_rules"] if hit(r["patterns"], title)), 0)
    other = -20 if hit(["software engineer"], title) and not hit(["genom"], text) else 0
    return max(0, min(100, role + domain + tech + senior + other))


def test_score_matches_brute_force(spark):
    titles = ["Postdoc", "VP Research", "Director, Scientist", "Software Engineer", "", "Chef (R)"]
    texts = ["", "gut HOST genomics", "Python in Göteborg", "R & D", "the hosts' r."]
    rows = [("c", t, "", "", d) for t in titles for d in texts]
    got = scoring.with_score(jobs(spark, rows), PROFILE).orderBy("capture_seq").collect()
    assert [r["total"] for r in got] == [brute_score(t, f"{t} {d}  ") for _, t, _, _, d in rows]
    assert all(r["penalty"] == r["seniority_adjustment"] + r["other_penalty"] and r["location_fit"] == 0 for r in got)


def test_threshold_filter_does_not_repeat_patterns(spark):
    plan = scoring.with_score(jobs(spark, [("c", "t", "", "", "d")]), PROFILE).filter("total >= 65")
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("postdoc") == 1


def test_bands_and_empty_title(spark):
    values = spark.createDataFrame([(i, v) for i, v in enumerate([85, 84, 75, 65, 64])], "i int, v int")
    got = [r[0] for r in values.orderBy("i").select(scoring.band(F.col("v"), {})).collect()]
    assert got == ["Exceptional", "Strong", "Strong", "Review", "Lower Fit"]


def test_location_gate_order(spark):
    rows = [("c", "t", "Remote, India", "", ""), ("c", "t", "Pune, India", "https://x/boston", ""), ("c", "t", "", "", ""),
            ("c", "t", "Mars", "https://x/india", ""), ("c", "t", "Mars", "https://x/BOSTON", ""), ("c", "t", "Mars", "", "")]
    strict = {"location": {**PROFILE["location"], "allow_ambiguous": False}}
    got = scoring.with_gate(jobs(spark, rows), strict).orderBy("capture_seq").collect()
    assert [r["alert_eligible"] for r in got] == [True, False, False, False, True, False]
    off = scoring.with_gate(jobs(spark, rows), {"location": {"enabled": False}}).collect()
    assert all(r["alert_eligible"] for r in off)


def test_rule_with_no_groups_always_applies(spark):
    title, text = scoring.rule_texts()
    df = scoring.with_rule_text(jobs(spark, [("c", "b", "", "", "a")]))
    rules = [{"bonus": 3}, {"bonus": 5, "all_text_pattern_groups": [["a"], ["b"]]}, {"bonus": 7, "all_title_pattern_groups": [["a"]]}]
    assert df.select(scoring.interaction_bonus(title, text, rules)).collect()[0][0] == 8
    assert df.select(scoring.penalties(title, text, [{"adjustment": -4}])).collect()[0][0] == -4


def test_lint(spark):
    bad = {"role_rules": [{"name": "r", "patterns": ["(", "ok"]}], "interaction_rules": [{"name": "i", "all_text_pattern_groups": [["["]]}]}
    problems = {(r["section"], r["pattern"]) for r in scoring.lint_profile(spark, bad).collect()}
    assert problems == {("domain_rules", ""), ("profile_status", ""), ("role_rules", "("), ("interaction_rules", "[")}
    assert scoring.lint_profile(spark, PROFILE).count() == 0


REPORT = [  # seq, company, title, total, location, is_new, eligible
    (0, "Acme", "Scientist", 82, "A", True, True), (1, " acme ", "SCIENTIST ", 87, "B", True, True),
    (2, "Acme", "scientist", 87, "C", False, True), (3, "Beta", "Chef", 60, "D", True, True),
    (4, "Beta", "Cook", 90, "E", True, False), (5, "Beta", "Baker", 71, "F", False, None),
]
SCHEMA = "capture_seq long, company string, title string, total int, location string, is_new boolean, alert_eligible boolean"


@pytest.mark.parametrize("order", list(permutations(range(6)))[::103])
def test_dedupe_is_independent_of_row_order(spark, order):
    df = spark.createDataFrame([REPORT[i] for i in order], SCHEMA)
    assert {r["location"] for r in reports.alert_dedupe(df).collect()} == {"B", "D", "E", "F"}


def test_report_filters_and_rank(spark):
    df = spark.createDataFrame(REPORT, SCHEMA)
    assert [r["location"] for r in reports.ranked_report(df, 70).collect()] == ["B", "F"]
    assert [r["location"] for r in reports.ranked_report(df, 70, new_only=True).collect()] == ["B"]


def test_report_roundtrip_and_missing_file(spark, tmp_path):
    columns = ["company", "title", "total"]
    rows = [("A", 'say "hi", you', 90), ("B", " blanks ", 80), ("C", "two\nlines", 70), ("D", "", 60)]
    path = str(tmp_path / "report")
    write_report(spark.createDataFrame(rows, "company string, title string, total int"), path)
    back = read_report(spark, path, columns).collect()
    assert sorted(tuple(r) for r in back) == sorted((a, b, str(c)) for a, b, c in rows)
    assert read_report(spark, str(tmp_path / "none"), columns).count() == 0
    write_report(spark.createDataFrame([], "company string, title string, total int"), path)
    assert read_report(spark, path, columns).count() == 0


DIGEST = [
    (0, "A", "Low", "72", "", "", "u<1>", "30", "", "", "", ""),
    (1, "B", "Top", "94", "Oslo", "$1", "", "30", "25", "13", "0", "7"),
    (2, "C", None, "junk", "", "", "", "x", "", "", "", ""),
    (3, "D", "Mid & Co", "75.9", "", "", "", "0", "0", "0", "0", "0"),
]
DIGEST_SCHEMA = ("capture_seq long, company string, title string, total string, location string, compensation string, url string, "
                 "role_fit string, domain_fit string, technical_fit string, operating_model_fit string, leadership_fit string")


def test_digest(spark):
    df = spark.createDataFrame(DIGEST, DIGEST_SCHEMA)
    blocks = [r["block"] for r in digest.digest_lines(df).collect()]
    assert blocks[0] == ("94 — B — Top\n   Oslo · Compensation: $1\n   Why: Target computational biology / bioinformatics role · "
                         "Strong scientific-domain match · Technical / project / people leadership\n")
    assert [b.split(" ")[0] for b in blocks] == ["94", "75", "72", "0"]
    assert blocks[3].startswith("0 — C — Untitled role\n   Location not listed · Compensation: Not listed")
    cards = [r["card"] for r in digest.digest_cards(df).collect()]
    assert "Mid &amp; Co" in cards[1] and 'href="u&lt;1&gt;"' in cards[2] and "<strong>Why:" not in cards[1]
    tiers = [(r["tier"], r["roles"]) for r in digest.digest_tiers(df).collect()]
    assert tiers == [("Exceptional", 1), ("Strong", 1), ("Review", 2)]
    lines = [r["line"] for r in digest.plain_digest(df).collect()]
    assert lines[0].startswith("4 new") and lines[1].startswith("EXCEPTIONAL FIT\n---------------") and len(lines) == 8


def test_backtest(spark):
    rows = spark.createDataFrame([(90, True, "a"), (80, False, "a"), (70, True, "b"), (10, False, "b")], "new_score int, wanted boolean, d string")
    table = {r["threshold"]: (r["selected"], r["precision"], r["recall"]) for r in calibration.threshold_table(rows).collect()}
    assert table == {90: (1, 1.0, 0.5), 80: (2, 0.5, 0.5), 70: (3, 0.666667, 1.0), 10: (4, 0.5, 1.0)}
    confusion = {r["d"]: tuple(r)[1:] for r in calibration.confusion(rows, ["d"], 75).collect()}
    assert confusion == {"a": (2, 1, 1, 0, 0), "b": (2, 0, 0, 1, 1)}
    coverage = calibration.rating_coverage(rows.select("wanted")).collect()[0]
    assert (coverage["enough_rated"], coverage["enough_positives"]) == (False, True)

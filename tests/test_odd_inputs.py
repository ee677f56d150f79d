"""Inputs that must not end a job or change what a board says."""

import html
import json

import pytest
from pyspark.sql import functions as F

from vacantia.functions.pay import pay_currency
from vacantia.functions.regex import any_match, java_pattern
from vacantia.functions.text import html_unescape
from vacantia.operators import boards, dom, health
from vacantia.sources.registry import registry_from_records


def test_character_references_read_as_in_python(spark):
    texts = [
        "&#9999999;", "&#xFFFFFF;", "&#99999999999999999999;", "&#0;", "&#xD800;", "&#128;&#x9f;&#129;", "&#1;x&#11;&#xFDD0;&#x1FFFF;&#65535;", "&#13;",
        "a &#38;lt; b &lt; c", "&amp;lt; &amp;amp;", "&ampx &ltb &copy2 &notit; &nosuch; &", "&NotEqualTilde; &acE; &hellip; &apos; &quot", "&#65 &#x41g &#;", "&#x1F4A5;",
        "plain", "", "&eacute;&Eacute&nbsp;x", "&&amp;&", "&lt;p&gt;",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r["i"]: r["u"] for r in df.select("i", html_unescape(F.col("t")).alias("u")).collect()}
    assert {texts[i]: u for i, u in got.items()} == {t: html.unescape(t) for t in texts}


def test_a_page_that_cannot_be_read_is_an_error_not_a_failure(spark):
    rows = [("a", "u", "<p>one</p>"), ("b", "u", "<p>half<![foo[ x ]]>"), ("c", "u", None), ("d", "u", "<p>two</p>")]
    parsed = dom.parse_pages(spark.createDataFrame(rows, "company string, page_url string, html string"))
    assert {r["company"]: r["texts"] for r in parsed.collect()} == {"a": ["one"], "b": [], "c": [], "d": ["two"]}
    assert [(r["company"], r["error"].split(":")[0]) for r in dom.page_errors(parsed).collect()] == [("b", "AssertionError")]


def test_an_unreadable_payload_is_an_error(spark):
    rows = [("a", '{"jobs":[{"id":1}'), ("b", '{"jobs":[]}'), ("c", None), ("d", "<html>"), ("e", "[]")]
    captures = spark.createDataFrame(rows, "company string, body string")
    assert {r["company"] for r in boards.payload_errors(captures).collect()} == {"a", "d"}


@pytest.mark.parametrize("pattern, text, found", [
    ("ba{,3}c", "baac", True), ("ba{,3}c", "baaaac", False), ("x{", "x{", True), ("x{", "x", False), ("x{}", "x{}", True), ("x{a}", "x{a}", True),
    ("x{2}y", "xxy", True), ("x{2,}y", "xxxy", True), ("[{]", "{", True), (r"\{1", "{1", True), ("b{,}", "", True),
])
def test_braces_of_rule_patterns(spark, pattern, text, found):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(any_match([pattern], F.col("t"))).collect()[0][0] is found
    spark._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))


def test_currency_in_any_case(spark):
    df = spark.createDataFrame([("usd 150000",), ("Usd",), ("eur 5",), ("none",)], "t string")
    assert [r[0] for r in df.select(pay_currency(F.col("t"))).collect()] == ["USD", "USD", "EUR", ""]


def test_known_platforms(spark):
    records = [{"name": p, "platform": p} for p in (*health.PLATFORMS, "mystery", None)]
    got = health.unknown_platforms(registry_from_records(spark, records)).collect()
    assert [r["platform"] for r in got] == ["mystery", None]
    lacking = {r["name"] for r in health.registry_problems(registry_from_records(spark, records)).collect()}
    assert lacking == {p for p, needed in health.PLATFORMS.items() if needed}


def test_a_detail_captured_twice_gives_one_posting(spark):
    listing = json.dumps({"content": [{"uuid": "1", "name": "Chef"}]})
    captures = spark.createDataFrame([("c", "b", 0, "smartrecruiters", listing)], "company string, board string, page_no long, platform string, body string")
    details = spark.createDataFrame(
        [("c", "1", json.dumps({"name": n}), t) for n, t in (("New", 2), ("Old", 1), ("New", 2))], "company string, pid string, body string, captured_at int")
    assert [r["title"] for r in boards.smartrecruiters(captures, details).collect()] == ["New"]
    paths = json.dumps({"total": 1, "jobPostings": [{"title": "Chef", "externalPath": "/job/x"}]})
    pages = spark.createDataFrame([("c", "b", 0, "workday", paths, "https://h")], "company string, board string, page_no long, platform string, body string, public_base string")
    details = spark.createDataFrame(
        [("c", "/job/x", json.dumps({"jobPostingInfo": {"title": n}})) for n in ("A", "B", "B")], "company string, external_path string, body string")
    assert [r["title"] for r in boards.workday(pages, details).collect()] == ["B"]


def test_errors_of_a_run_as_json(spark):
    status = spark.createDataFrame([("b", "x"), ("a", "y"), ("c", None)], "company string, error string")
    assert status.agg(health.errors_json()).collect()[0][0] == '[{"company":"a","error":"y"},{"company":"b","error":"x"}]'
    assert status.filter("company = 'c'").agg(health.errors_json()).collect()[0][0] == "[]"


def test_lint_finds_what_the_engine_cannot_run(spark):
    from vacantia.operators.scoring import lint_profile

    patterns = ["a{,3}", "x{", "(x)?(?(1)y|z)", "(", "(?P<n>a)b", "[[]"]
    profile = {"profile_status": "personalized_ready", "role_rules": [{"name": "r", "score": 1, "patterns": patterns}], "domain_rules": [{"name": "d", "weight": 1, "patterns": ["d"]}]}
    assert {r["pattern"] for r in lint_profile(spark, profile).collect()} == {"(x)?(?(1)y|z)", "("}

import hashlib

import pytest
from pyspark.sql import functions as F

from vacantia.functions import location, pay
from vacantia.functions.identity import stable_key
from vacantia.functions.regex import PatternError, any_match, folded, java_pattern
from vacantia.functions.text import fragment_text, html_unescape, squash_ws, synthetic_id


def evaluate(spark, rows, schema, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r["v"] for r in df.select("i", expression.alias("v")).orderBy("i").collect()]


PAY_CASES = [
    # pay text, description, expected text, low, high, currency, period
    ("", '<div class="content-pay-transparency"><div class="pay-range"><span>$166,600</span><span>—</span><span>$202,000 USD</span></div></div>',
     "$166,600–$202,000/yr", 166600.0, 202000.0, "USD", "year"),
    ("$130,900 — $163,600 USD", "", "$130,900–$163,600/yr", 130900.0, 163600.0, "USD", "year"),
    ("", "Pay Range: 100,000 - 140,000 USD depending on experience", "$100,000–$140,000/yr", 100000.0, 140000.0, "USD", "year"),
    ("USD 150000-220000 year", "", "$150,000–$220,000/yr", 150000.0, 220000.0, "USD", "year"),
    ("Competitive", "", "Not listed", None, None, "", ""),
    ("Competitive", "Salary: $50 - $60 per hour", "$50–$60/hr", 50.0, 60.0, "USD", "hour"),
    ("Competitive salary", "$100,000 - $120,000", "Competitive salary", None, None, "", ""),
    ("C$ 90000 - 110000", "", "$90,000–$110,000/yr", 90000.0, 110000.0, "USD", "year"),
    ("", "salary range 50,000 - 60,000 EUR", "EUR 50,000–60,000/yr", 50000.0, 60000.0, "EUR", "year"),
    ("", "from €50,000 to €60,000", "EUR 50,000–EUR 60,000/yr", 50000.0, 60000.0, "EUR", "year"),
    ("120-150k", "", "120–150,000/yr", 120.0, 150000.0, "", "year"),
    ("$90k to $70K", "", "$70,000–$90,000/yr", 70000.0, 90000.0, "USD", "year"),
    ("$25.50-$30.75 hourly", "", "$25.5–$30.75/hr", 25.5, 30.75, "USD", "hour"),
    ("$50 - $60 / MONTH", "", "$50–$60/hr", 50.0, 60.0, "USD", "hour"),
    ("", "Win $5 - $9 today", "Not listed", None, None, "", ""),
    ("", "We raised $20,000 - $30,000 yearly. " + "x" * 200 + " base salary $100,000 - $120,000", "$100,000–$120,000/yr", 100000.0, 120000.0, "USD", "year"),
    ("", "<p>Salary</p><p>$80,000</p><p>-</p><p>$90,000</p>", "$80,000–$90,000/yr", 80000.0, 90000.0, "USD", "year"),
    ("N/A", "", "Not listed", None, None, "", ""),
    (None, None, "Not listed", None, None, "", ""),
]


def test_pay_cases(spark):
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(PAY_CASES)], "i int, compensation string, description string")
    got = pay.parse_pay(df).select("i", "pay.*").orderBy("i").collect()
    for case, row in zip(PAY_CASES, got):
        assert tuple(row)[1:] == case[2:], case


def test_small_thousands_group_is_not_one_number(spark):
    assert evaluate(spark, [("pay $5,000 - $8,000",)], "t string", pay.prose_pay(F.col("t"))) == [None]


def test_prose_positions_with_repeated_range(spark):
    text = "$10 - $20 then $10 - $20 and $30 - $40"
    got = evaluate(spark, [(text,)], "t string", F.transform(pay.prose_candidates(F.col("t")), lambda c: c["start"]))
    assert got == [[1, 16, 30]]


@pytest.mark.parametrize("value, path, description, expected", [
    ("5", "/job/US---CA---San-Diego/Scientist_R1", "", "US - CA - San Diego"),
    ("Boston, MA", "/job/US---CA---San-Diego/x", "", "Boston, MA"),
    ("", "/job/Berlin/x", "The role is located in US - CA - San Diego, CA.", "US - CA - San Diego"),
    ("12", "/x", "This is a US -  Remote role", "US - Remote"),
    ("", "/job/Casablanca/x", "", "Casablanca"),
    ("7", "", "nothing", ""),
])
def test_location_repair(spark, value, path, description, expected):
    got = evaluate(spark, [(value, path, description)], "a string, b string, c string",
                   location.normalize_location(F.col("a"), F.col("b"), F.col("c")))
    assert got == [expected]


def test_slug_title(spark):
    urls = [("https://h/job/San-Diego/Lead-Data_Scientist_R26-13249?x=1",), ("https://h/job/a/Staff_JR77/",), ("https://h",)]
    assert evaluate(spark, urls, "u string", location.slug_title(F.col("u"))) == ["Lead Data Scientist", "Staff", ""]


def test_stable_key_matches_sha256_and_ignores_other_fields(spark):
    df = spark.createDataFrame([("Acme", "lever", "X1", "u1"), ("Acme", "lever", "X1", "u2"), ("Acme", "lever", "", "U3")],
                               "company string, source string, source_id string, url string")
    keys = [r[0] for r in df.select(stable_key()).collect()]
    expected = [hashlib.sha256(b.encode()).hexdigest()[:24] for b in ("acme|lever|x1", "acme|lever|x1", "acme|lever|u3")]
    assert keys == expected


def test_synthetic_id_is_sha1(spark):
    url = "https://example.org/é"
    assert evaluate(spark, [(url,)], "u string", synthetic_id(F.col("u"), 16)) == [hashlib.sha1(url.encode()).hexdigest()[:16]]


def test_fragment_text(spark):
    cases = [
        ("<p>a<p> b <br>c", "a b c"),
        ("x<!-- no -->y", "x y"),
        ("<script>if (a<b) {}</script>t<style>p{}</style>", "t"),
        ("a &amp;lt; b &nbsp; &#8211; &#x2014; &eacute; &unknown; &", "a &lt; b   – — é &unknown; &"),
        ('<a title="1 > 0">k</a>', "k"),
        ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"),
        (None, ""),
    ]
    got = evaluate(spark, [(c[0],) for c in cases], "t string", fragment_text(F.col("t")))
    assert got == [c[1] for c in cases]


def test_unescape_once(spark):
    assert evaluate(spark, [("&amp;amp; &lt;b&gt; &apos;",)], "t string", html_unescape(F.col("t"))) == ["&amp; <b> '"]


def test_squash_ws_knows_unicode_blanks(spark):
    assert evaluate(spark, [("  a\t\n b ",)], "t string", squash_ws(F.col("t"))) == ["a b"]


def test_pattern_dialect(spark):
    assert java_pattern(r"(?P<n>a)[[&&]\Z") == r"(a)[\[\&\&]\z"
    with pytest.raises(PatternError):
        java_pattern("(?i)a")
    df = spark.createDataFrame([("MALMÖ office",), ("a b",), ("x\rqu",), ("ſcientist ıntern K",), ("",)], "t string")
    text = F.col("t")
    rows = df.select(
        any_match(["malmö"], text), any_match([r"a\sb"], text), any_match([r"x.qu"], text),
        any_match(["scientist", "zz"], text, folded(text)), any_match(["intern k"], text, folded(text)),
        any_match([".*"], text), any_match([r"(q)\1|x", "zz"], text)).collect()
    assert [list(r) for r in zip(*rows)] == [
        [True, False, False, False, False], [False, True, False, False, False], [False, False, True, False, False],
        [False, False, False, True, False], [False, False, False, True, False], [True] * 5,
        [False, False, True, False, False]]

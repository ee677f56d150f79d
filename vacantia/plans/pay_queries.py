"""Pay extraction over orders as postings, and location repair over customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions import location, pay
from vacantia.functions.text import fragment_text
from vacantia.plans.catalog import Inputs, query, view

# What each shape of `pay_text` means, worked out from the whole amounts instead of the text.
view("pay_expected", """
    SELECT o_orderkey, shape, b_text,
        CASE WHEN shape IN (0, 1, 5, 8) OR shape = 2 AND o_orderkey % 3 <> 1 THEN 'USD'
             WHEN shape = 2 OR shape = 7 THEN 'EUR' WHEN shape = 4 THEN 'GBP' ELSE '' END AS currency,
        CASE WHEN shape = 6 THEN CAST(NULL AS DOUBLE) WHEN shape = 3 THEN CAST(a_k AS DOUBLE) ELSE CAST(a AS DOUBLE) END AS minimum,
        CASE WHEN shape = 6 THEN CAST(NULL AS DOUBLE) WHEN shape = 3 THEN b_k * 1000.0 ELSE CAST(b AS DOUBLE) END AS maximum,
        CASE WHEN shape = 6 THEN '' ELSE 'year' END AS period,
        CASE WHEN shape IN (0, 1, 5, 8) OR shape = 2 AND o_orderkey % 3 <> 1 THEN concat('$', a_text, '–$', b_text, '/yr')
             WHEN shape = 2 THEN concat('EUR ', a_text, '–', b_text, '/yr')
             WHEN shape = 3 THEN concat(CAST(a_k AS STRING), '–', CAST(b_k AS STRING), ',000/yr')
             WHEN shape = 4 THEN concat('GBP ', a_text, '–GBP ', b_text, '/yr')
             WHEN shape = 7 THEN concat('EUR ', a_text, '–EUR ', b_text, '/yr') ELSE 'Not listed' END AS text
    FROM {pay_text}""")
_FIELDS = ("text", "minimum", "maximum", "currency", "period")


def _spread(df: DataFrame, value: Column) -> DataFrame:
    out = df.withColumn("_p", value)
    return out.select("o_orderkey", *[F.col(f"_p.{f}").alias(f) for f in _FIELDS])


@query("pay_parse", "SELECT o_orderkey, text, minimum, maximum, currency, period FROM {pay_expected}")
def _pay_parse(inputs: Inputs) -> DataFrame:
    return pay.parse_pay(inputs["pay_text"]).select("o_orderkey", *[F.col(f"pay.{f}").alias(f) for f in _FIELDS])


@query("pay_apply", """
    SELECT o_orderkey, text AS compensation, minimum AS compensation_min, maximum AS compensation_max,
           currency AS compensation_currency, period AS compensation_period FROM {pay_expected}""")
def _pay_apply(inputs: Inputs) -> DataFrame:
    return pay.apply_pay(inputs["pay_text"].select("o_orderkey", "compensation", "description")).drop("description")


@query("pay_node", """
    SELECT o_orderkey, CASE WHEN shape = 8 THEN concat('$', a_text, ' — $', b_text, ' USD') ELSE '' END AS node FROM {pay_text}""")
def _pay_node(inputs: Inputs) -> DataFrame:
    return inputs["pay_text"].select("o_orderkey", pay.pay_node_text(F.col("description")).alias("node"))


def _only(shapes: str) -> str:
    """Expected pay for the given shapes, nulls for all others."""
    picked = ", ".join(f"CASE WHEN shape IN ({shapes}) THEN {f} END AS {f}" for f in _FIELDS)
    return f"SELECT o_orderkey, {picked} FROM {{pay_expected}}"


@query("pay_structured", _only("0, 3, 7"))
def _pay_structured(inputs: Inputs) -> DataFrame:
    return _spread(inputs["pay_text"], pay.structured_pay(F.col("compensation")))


@query("pay_labeled", _only("2"))
def _pay_labeled(inputs: Inputs) -> DataFrame:
    return _spread(inputs["pay_text"], pay.labeled_pay(F.col("description")))


@query("pay_prose", _only("1, 4, 5"))
def _pay_prose(inputs: Inputs) -> DataFrame:
    df = inputs["pay_text"].withColumn("_text", pay.description_text(F.col("description")))
    return _spread(df, F.when(F.col("shape") != 8, pay.prose_pay(F.col("_text"))))


@query("pay_number", """
    SELECT o_orderkey, CAST(a AS DOUBLE) AS grouped, CAST(a_k * 1000 AS DOUBLE) AS thousands, o_totalprice AS plain FROM {pay_text}
    JOIN (SELECT o_orderkey AS k, o_totalprice FROM {orders}) o ON k = o_orderkey""")
def _pay_number(inputs: Inputs) -> DataFrame:
    df = inputs["pay_text"].join(inputs["orders"].select(F.col("o_orderkey"), "o_totalprice"), "o_orderkey")
    return df.select(
        "o_orderkey", pay.pay_number(F.concat(F.lit(" "), "a_text")).alias("grouped"),
        pay.pay_number(F.concat(F.col("a_k").cast("string"), F.lit("K"))).alias("thousands"),
        pay.pay_number(F.format_string("%.2f", "o_totalprice")).alias("plain"))


@query("pay_currency", """
    SELECT o_orderkey, CASE WHEN shape IN (1, 5, 6, 8) THEN 'USD' WHEN shape = 4 THEN 'GBP'
           WHEN shape = 2 AND o_orderkey % 3 = 0 THEN 'USD' WHEN shape = 2 AND o_orderkey % 3 = 1 THEN 'EUR' ELSE '' END AS in_description,
           CASE shape WHEN 0 THEN 'USD' WHEN 7 THEN 'EUR' ELSE '' END AS in_text
    FROM {pay_text}""")
def _pay_currency(inputs: Inputs) -> DataFrame:
    return inputs["pay_text"].select(
        "o_orderkey", pay.pay_currency(F.col("description")).alias("in_description"),
        pay.pay_currency(F.col("compensation")).alias("in_text"))


@query("pay_period", """
    SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'hour' WHEN '2-HIGH' THEN 'year' WHEN '3-MEDIUM' THEN 'month'
                            ELSE CASE WHEN o_totalprice >= 100000 THEN 'year' ELSE 'hour' END END AS period
    FROM {orders}""")
def _pay_period(inputs: Inputs) -> DataFrame:
    words = F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "/hr", "2-HIGH", "per annum", "3-MEDIUM", "monthly", "4-NOT SPECIFIED", "/ MONEY", "5-LOW", "")])
    high = F.col("o_totalprice") / 100
    return inputs["orders"].select(
        "o_orderkey", pay.pay_period(words[F.col("o_orderpriority")], high / 2, high).alias("period"))


@query("pay_display", r"""
    SELECT o_orderkey, concat('$', lo, '–$', hi, '/yr') AS usd, concat('EUR ', lo, '–EUR ', hi, '/mo') AS eur, concat(lo, '–', hi) AS bare
    FROM (SELECT o_orderkey, regexp_replace(regexp_replace(format('{:,.2f}', o_totalprice), '0+$', ''), '\.$', '') AS lo,
                 format('{:,}', CAST(floor(o_totalprice) AS BIGINT) + 1) AS hi FROM {orders}) t""")
def _pay_display(inputs: Inputs) -> DataFrame:
    low, high = F.col("o_totalprice"), F.floor("o_totalprice").cast("double") + 1
    return inputs["orders"].select(
        "o_orderkey", pay.pay_display(low, high, F.lit("USD"), F.lit("year")).alias("usd"),
        pay.pay_display(low, high, F.lit("EUR"), F.lit("month")).alias("eur"),
        pay.pay_display(low, high, F.lit(""), F.lit("")).alias("bare"))


# ---- locations ------------------------------------------------------------------------------------------

@query("loc_malformed", r"""
    SELECT c_custkey, trim(value) = '' OR regexp_full_match(trim(value), '[\d.,;:+_-]+')
           OR length(trim(value)) <= 2 AND NOT regexp_matches(value, '[A-Za-z]{2}') AS malformed
    FROM {locations}""")
def _loc_malformed(inputs: Inputs) -> DataFrame:
    return inputs["locations"].select("c_custkey", location.is_malformed(F.col("value")).alias("malformed"))


view("path_places", r"""
    SELECT *, CASE WHEN regexp_matches(segment, 'US|United[- ]States|Remote|CA|California', 'i')
        THEN trim(replace(replace(replace(replace(replace(replace(segment, '---', ' - '), '--', ' - '), '_', ' '), ' - ', '~'), '-', ' '), '~', ' - '), ' -')
        ELSE '' END AS from_path
    FROM (SELECT *, regexp_extract(path, '/job/([^/]+)/[^/]+$', 1) AS segment FROM {locations}) x""")


@query("loc_from_path", "SELECT c_custkey, from_path FROM {path_places}")
def _loc_from_path(inputs: Inputs) -> DataFrame:
    return inputs["locations"].select("c_custkey", location.from_path(F.col("path")).alias("from_path"))


@query("loc_normalize", """
    SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN value WHEN from_path <> '' THEN from_path
        WHEN c_custkey % 5 = 1 THEN 'US - CA - San Diego' WHEN n_nationkey % 2 = 0 THEN 'US - Remote' ELSE '' END AS location
    FROM {path_places}""")
def _loc_normalize(inputs: Inputs) -> DataFrame:
    return inputs["locations"].select("c_custkey", location.normalize_location(
        F.col("value"), F.col("path"), F.col("description")).alias("location"))


@query("slug_title", r"""
    SELECT c_custkey, trim(regexp_replace(concat(lower(c_mktsegment), '-', CAST(c_nationkey AS VARCHAR), ' lead'), '[-_]+', ' ', 'g')) AS title
    FROM {customer}""")
def _slug_title(inputs: Inputs) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    suffix = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("_R"), key, F.lit("-1"))).otherwise(F.concat(F.lit("_jr"), key))
    url = F.concat(F.lit("https://x.example.com/job/Oslo/"), F.lower("c_mktsegment"), F.lit("-"),
                   F.col("c_nationkey").cast("string"), F.lit("__lead"), suffix, F.lit("/?q=1"))
    return inputs["customer"].select("c_custkey", location.slug_title(url).alias("title"))


# ---- fragments ------------------------------------------------------------------------------------------

_UNESCAPED = ("replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&')")


@query("html_text", r"""
    SELECT page_id, array_to_string(list_filter(list_transform(string_split_regex(
        regexp_replace(regexp_replace(html, '<!--.*?-->', '<br>', 'gs'), '<script.*?</script>|<style.*?</style>', '<br>', 'gs'),
        '<[^>]*>'), lambda p: trim(%s, concat(' ', chr(9), chr(10), chr(13)))), lambda p: p <> ''), ' ') AS text
    FROM {pages}""" % _UNESCAPED.format("p"))
def _html_text(inputs: Inputs) -> DataFrame:
    return inputs["pages"].select("page_id", fragment_text(F.col("html")).alias("text"))

"""Published pay: find a range in structured text, markup or prose and put it in one form.

Every function maps Columns to a Column; nothing is estimated. Long texts are searched once for
the whole range; its parts are then read from that short match, all in one pass.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import element_html, fragment_or_plain, fragment_text, let, strip

# Range shapes, their groups, and the words that give context.
# Groups of STRUCTURED_RANGE and PROSE_RANGE: 1 currency, 2 minimum, 3 maximum, 4 period.
STRUCTURED_RANGE = (
    r"(?iuUd)(USD|CAD|GBP|EUR|US\$|C\$|\$|£|€)?\s*"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)\s*"
    r"(?:-|–|—|to)\s*"
    r"(?:(?:USD|CAD|GBP|EUR|US\$|C\$|\$|£|€)\s*)?"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)"
    r"(?:\s*(?:USD|CAD|GBP|EUR))?"
    r"(?:\s*(per\s+(?:year|hour|month)|/\s*(?:yr|year|hr|hour)|annual(?:ly)?|year(?:ly)?|hour(?:ly)?|month(?:ly)?))?"
)
# Groups of LABELED_RANGE: 1 minimum, 2 maximum, 3 currency, 4 period.
LABELED_RANGE = (
    r"(?iuUd)(?:pay\s*range|salary\s*range|base\s*(?:pay|salary)|compensation(?:\s*range)?)\s*[:\-]?\s*"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)\s*"
    r"(?:-|–|—|to)\s*"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)"
    r"(?:\s*(USD|CAD|GBP|EUR))?"
    r"(?:\s*(per\s+(?:year|hour|month)|/\s*(?:yr|year|hr|hour)|annual(?:ly)?|year(?:ly)?|hour(?:ly)?|month(?:ly)?))?"
)
PROSE_RANGE = (
    r"(?iuUd)(USD|CAD|GBP|EUR|US\$|C\$|\$|£|€)\s*"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)\s*"
    r"(?:-|–|—|to)\s*"
    r"(?:(?:USD|CAD|GBP|EUR|US\$|C\$|\$|£|€)\s*)?"
    r"(\d{2,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?[kK]?)"
    r"(?:\s*(?:USD|CAD|GBP|EUR))?"
    r"(?:\s*(per\s+(?:year|hour|month)|/\s*(?:yr|year|hr|hour)|annual(?:ly)?|year(?:ly)?|hour(?:ly)?|month(?:ly)?))?"
)
PAY_WORDS = r"(?iuUd)salary|compensation|pay|wage|\$|USD|CAD|GBP|EUR|£|€"
CONTEXT_WORDS = r"(?iuUd)salary|compensation|pay range|wage|base pay|base salary|anticipated"
NO_PAY_TEXT = ("not listed", "n/a", "na", "none")
NOT_LISTED = "Not listed"
CONTEXT_CHARS = 180
LABEL_TAIL_CHARS = 12
MIN_YEARLY, MIN_HOURLY = 10_000, 10

#: Stands between the groups of a matched range.
GROUP_MARK = "\u0001"
PAY_TYPE = "struct<text:string,minimum:double,maximum:double,currency:string,period:string>"


def pay_number(value: Column) -> Column:
    """``166,600`` or ``120k`` as a double."""
    def read(text: Column) -> Column:
        digits = F.regexp_replace(text, "(?i)k$", "").try_cast("double")
        return digits * F.when(F.lower(text).endswith("k"), F.lit(1000.0)).otherwise(F.lit(1.0))

    return let(F.replace(strip(value), F.lit(","), F.lit("")), read)


def pay_currency(value: Column) -> Column:
    """Currency named in the text. A dollar sign wins, so ``C$`` reads as USD."""
    upper = F.upper(value)
    return (
        F.when(value.contains("$") | upper.contains("USD"), F.lit("USD"))
        .when(upper.contains("CAD"), F.lit("CAD"))
        .when(upper.contains("GBP") | value.contains("£"), F.lit("GBP"))
        .when(upper.contains("EUR") | value.contains("€"), F.lit("EUR"))
        .otherwise(F.lit(""))
    )


def pay_period(value: Column, minimum: Column, maximum: Column) -> Column:
    """Period from its wording, else from the size of the amount."""
    text = F.lower(F.coalesce(value, F.lit("")))
    high = F.coalesce(maximum, minimum)
    return (
        F.when(text.contains("hour") | text.contains("/hr") | text.contains("per hr"), F.lit("hour"))
        .when(text.contains("year") | text.contains("annual") | text.contains("annum") | text.contains("/yr"), F.lit("year"))
        .when(text.contains("month"), F.lit("month"))
        .when(high >= 1000, F.lit("year"))
        .when(high <= 1000, F.lit("hour"))
        .otherwise(F.lit(""))
    )


def format_amount(value: Column) -> Column:
    return F.coalesce(F.call_function("format_number", value, F.lit("#,##0.##")), F.lit(""))


def _per(period: Column) -> Column:
    return (
        F.when(period == "", F.lit(""))
        .when(period == "year", F.lit("/yr"))
        .when(period == "hour", F.lit("/hr"))
        .otherwise(F.lit("/mo"))
    )


def pay_display(minimum: Column, maximum: Column, currency: Column, period: Column) -> Column:
    """``$a–b/yr`` style text; other currencies are named before both amounts."""
    symbol = F.when(currency == "USD", F.lit("$")).when(currency != "", F.concat(currency, F.lit(" "))).otherwise(F.lit(""))
    return F.concat(symbol, format_amount(minimum), F.lit("–"), symbol, format_amount(maximum), _per(period))


def _labeled_display(minimum: Column, maximum: Column, currency: Column, period: Column) -> Column:
    """As ``pay_display``, but a currency other than USD is named once only."""
    second = F.when(currency == "USD", F.lit("$")).otherwise(F.lit(""))
    first = F.when(currency == "USD", F.lit("$")).otherwise(F.concat(currency, F.lit(" ")))
    return F.concat(first, format_amount(minimum), F.lit("–"), second, format_amount(maximum), _per(period))


def _pay(text, minimum, maximum, currency, period) -> Column:
    return F.struct(
        text.alias("text"), minimum.alias("minimum"), maximum.alias("maximum"),
        currency.alias("currency"), period.alias("period"),
    )


def _candidate(found: Column, pattern: str, groups: tuple[int, int, int, int], source: Column, labeled: bool = False,
               priority: Column | None = None, start: Column | None = None) -> Column:
    """A matched range: all its groups (minimum, maximum, currency, period) from one pass of the pattern, and the text
    that names the currency if the range does not. Only prose has a priority; other ranges count however small."""
    replacement = GROUP_MARK.join(f"${g}" for g in groups)
    return F.struct(
        (F.lit(0) if priority is None else priority).alias("priority"), (F.lit(1) if start is None else start).alias("start"),
        F.split(F.regexp_replace(found, pattern, replacement), GROUP_MARK).alias("words"), source.alias("source"),
        F.lit(labeled).alias("labeled"), F.lit(priority is not None).alias("checked"))


def _structured(found: Column, text: Column) -> Column:
    return F.array(_candidate(found, STRUCTURED_RANGE, (2, 3, 1, 4), text))


def _labeled(found: Column, text: Column) -> Column:
    after = F.substr(text, F.instr(text, found), F.length(found) + F.lit(LABEL_TAIL_CHARS))
    return F.array(_candidate(found, LABELED_RANGE, (1, 2, 3, 4), after, labeled=True))


def _prose(text: Column) -> Column:
    """All ranges with a currency, with their places; ranges near pay language go first."""
    matches = F.regexp_extract_all(text, F.lit(PROSE_RANGE), F.lit(0))
    start = F.struct(
        F.lit(1).alias("at"),
        F.array().cast("array<struct<start:int,found:string>>").alias("out"),
    )

    def place(acc: Column, found: Column) -> Column:
        # The pattern looks neither ahead nor behind, so the next literal copy is the next match.
        here = F.position(found, text, acc["at"]).cast("int")
        return F.struct(
            (here + F.length(found)).cast("int").alias("at"),
            F.array_append(acc["out"], F.struct(here.alias("start"), found.alias("found"))).alias("out"),
        )

    def read(m: Column) -> Column:
        left = F.greatest(m["start"] - F.lit(CONTEXT_CHARS), F.lit(1))
        context = F.substr(text, left, m["start"] + F.length(m["found"]) + F.lit(CONTEXT_CHARS) - left)
        near = F.when(context.rlike(CONTEXT_WORDS), F.lit(0)).otherwise(F.lit(1))
        return _candidate(m["found"], PROSE_RANGE, (2, 3, 1, 4), m["found"], priority=near, start=m["start"])

    return F.transform(F.aggregate(matches, start, place)["out"], read)


def _amount(word: Column) -> Column:
    """As ``pay_number`` for a matched amount, which holds no white space."""
    digits = F.replace(word, F.lit(","), F.lit(""))
    return F.rtrim(digits, F.lit("kK")).try_cast("double") * F.when(
        F.lower(word).endswith("k"), F.lit(1000.0)).otherwise(F.lit(1.0))


def _read(candidates: Column) -> Column:
    """Candidates as (priority, start, minimum, maximum, currency, period, labeled), implausible prose dropped. Each step is
    one pass over the array, so no part is worked out twice."""
    with_amounts = F.transform(candidates, lambda c: F.struct(
        c["priority"].alias("priority"), c["start"].alias("start"), c["labeled"].alias("labeled"), c["checked"].alias("checked"),
        F.sort_array(F.transform(F.slice(c["words"], 1, 2), _amount)).alias("amounts"),
        F.when(c["words"][2] != "", c["words"][2]).otherwise(c["source"]).alias("named"), c["words"][3].alias("wording")))

    def describe(c: Column) -> Column:
        low, high = c["amounts"][0], c["amounts"][1]
        return F.struct(
            c["priority"].alias("priority"), c["start"].alias("start"), low.alias("minimum"), high.alias("maximum"),
            pay_currency(c["named"]).alias("currency"), pay_period(c["wording"], low, high).alias("period"),
            c["labeled"].alias("labeled"), c["checked"].alias("checked"))

    too_small = lambda c: (
        ((c["period"] == "year") & (c["maximum"] < MIN_YEARLY)) | ((c["period"] == "hour") & (c["maximum"] < MIN_HOURLY)))
    return F.filter(F.transform(with_amounts, describe), lambda c: ~(c["checked"] & too_small(c)))


def _shown(best: Column) -> Column:
    """The pay of a read candidate; a labeled range without a currency is in USD."""
    currency = F.when(best["labeled"] & (best["currency"] == ""), F.lit("USD")).otherwise(best["currency"])
    values = (best["minimum"], best["maximum"], currency, best["period"])
    text = F.when(best["labeled"], _labeled_display(*values)).otherwise(pay_display(*values))
    return F.when(best.isNotNull(), _pay(text, *values))


def _first_range(text: Column, pattern: str, candidates: Callable[[Column, Column], Column]) -> Column:
    """Pay of the pattern's first match in ``text``; null when there is none."""
    found = F.regexp_extract(text, pattern, 0)
    return let(found, lambda f: F.when(f != "", let(F.array_min(_read(candidates(f, text))), _shown)))


def structured_pay(text: Column) -> Column:
    """First range in a board's own pay text; null when there is none."""
    return _first_range(text, STRUCTURED_RANGE, _structured)


def labeled_pay(text: Column) -> Column:
    """First range introduced by a pay label; the currency may follow shortly after, USD otherwise."""
    return _first_range(text, LABELED_RANGE, _labeled)


def prose_candidates(text: Column) -> Column:
    """All ranges with a currency as structs (priority, start, minimum, maximum, currency, period), implausible ones dropped."""
    return _read(_prose(text))


def prose_pay(text: Column) -> Column:
    """The plausible range nearest to pay language, then the earliest; null when there is none."""
    return let(F.array_min(prose_candidates(text)), _shown)


def pay_node_text(html: Column) -> Column:
    """Text of a board's dedicated pay-range element, or empty."""
    html = F.coalesce(html, F.lit(""))
    node = let(element_html(html, "content-pay-transparency"), lambda box: F.coalesce(
        element_html(box, "pay-range"), element_html(html, "pay-range")))
    return F.when(html.contains("pay-range"), F.coalesce(fragment_text(node), F.lit(""))).otherwise(F.lit(""))


def description_text(description: Column) -> Column:
    """Plain text of a description that may be an HTML fragment."""
    return fragment_or_plain(description)


def parse_pay(df: DataFrame, raw: str = "compensation", description: str = "description",
              into: str = "pay") -> DataFrame:
    """Add the struct column ``into`` (text, minimum, maximum, currency, period).

    Order of trust: the board's pay text, explicit pay wording kept as is, the pay-range element,
    a labeled range, the best prose range, and "Not listed".
    """
    none = F.lit(None).cast("double")
    c = lambda name: F.col(f"_pay_{name}")
    # Each step is its own column and every range is read by the same three array passes, so a pattern runs once a text
    # and a long description is cleaned once and searched only if needed.
    staged = df.withColumn("_pay_raw", strip(F.col(raw)))
    usable = (c("raw") != "") & ~F.lower(c("raw")).isin(*NO_PAY_TEXT)
    staged = staged.withColumn("_pay_hit", F.when(usable, F.regexp_extract(c("raw"), STRUCTURED_RANGE, 0)).otherwise(F.lit("")))
    staged = staged.withColumn("_pay_worded", usable & (c("hit") == "") & c("raw").rlike(PAY_WORDS))
    staged = staged.withColumn("_pay_html", F.when(
        (c("hit") == "") & ~c("worded"), pay_node_text(F.col(description))).otherwise(F.lit("")))
    staged = staged.withColumn("_pay_node", F.regexp_extract(c("html"), STRUCTURED_RANGE, 0))
    open_case = (c("hit") == "") & ~c("worded") & (c("node") == "")
    staged = staged.withColumn("_pay_text", F.when(open_case, description_text(F.col(description))).otherwise(F.lit("")))
    staged = staged.withColumn("_pay_label", F.regexp_extract(c("text"), LABELED_RANGE, 0))
    staged = staged.withColumn("_pay_found", F.when(c("hit") != "", _structured(c("hit"), c("raw")))
                               .when(c("node") != "", _structured(c("node"), c("html")))
                               .when(c("label") != "", _labeled(c("label"), c("text"))).otherwise(_prose(c("text"))))
    staged = staged.withColumn("_pay_best", F.array_min(_read(c("found"))))
    kept = F.when(c("worded"), _pay(c("raw"), none, none, pay_currency(c("raw")), F.lit("")))
    unlisted = _pay(F.lit(NOT_LISTED), none, none, F.lit(""), F.lit(""))
    merged = F.coalesce(*[x.cast(PAY_TYPE) for x in (kept, _shown(c("best")), unlisted)])
    return staged.withColumn(into, merged).drop(
        *[f"_pay_{x}" for x in ("raw", "hit", "worded", "html", "node", "text", "label", "found", "best")])


def apply_pay(df: DataFrame) -> DataFrame:
    """Replace the five pay columns of a posting table by the parsed values."""
    parsed = parse_pay(df, into="_pay")
    return parsed.withColumns({
        "compensation": F.col("_pay.text"),
        "compensation_min": F.col("_pay.minimum"),
        "compensation_max": F.col("_pay.maximum"),
        "compensation_currency": F.col("_pay.currency"),
        "compensation_period": F.col("_pay.period"),
    }).drop("_pay")

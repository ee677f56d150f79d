"""schema.org JobPosting data embedded in pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import first_non_empty, fragment_text, let, non_empty, squash_ws
from vacantia.operators.dom import JSON_LD, attr
from vacantia.schemas import as_jobs


def _variant(source: Column, path: str) -> Column:
    return F.try_variant_get(source, path, "variant")


def _string(source: Column, path: str) -> Column:
    return F.try_variant_get(source, path, "string")


def _object(source: Column, path: str) -> Column:
    return F.try_variant_get(source, path, "map<string,variant>")


def _list(source: Column, path: str) -> Column:
    return F.try_variant_get(source, path, "array<variant>")


def script_postings(body: Column, graph: bool = True) -> Column:
    """JobPosting objects of one JSON-LD script: an object, a list, or (``graph``) nodes of ``@graph``."""
    data = F.try_parse_json(body)
    listed = F.coalesce(_list(data, "$"), F.array(data))
    if graph:
        empty = F.array().cast("array<variant>")
        listed = F.flatten(F.transform(
            listed, lambda item: F.concat(F.array(item), F.coalesce(_list(item, "$['@graph']"), empty))))
    return F.filter(listed, lambda item: _string(item, "$['@type']") == "JobPosting")


def page_postings(graph: bool = True) -> Column:
    """All JobPosting objects of a parsed page, in document order; unreadable scripts are skipped."""
    scripts = F.filter("elements", lambda e: (e["tag"] == "script") & (attr(e, "type") == JSON_LD))
    found = F.transform(scripts, lambda e: script_postings(e["own"], graph))
    return F.flatten(F.filter(found, lambda postings: postings.isNotNull()))


def jsonld_jobs(parsed: DataFrame, keys: list[str], graph: bool = True) -> DataFrame:
    """One row per embedded posting: ``pos`` and ``item`` (VARIANT)."""
    return parsed.select(*keys, F.posexplode(page_postings(graph)).alias("pos", "item"))


def _address(source: Column, path: str) -> Column:
    parts = [non_empty(_string(source, f"{path}.{part}"))
             for part in ("addressLocality", "addressRegion", "addressCountry")]
    return F.concat_ws(", ", *parts)


def first_location(item: Column) -> Column:
    """Address of the first job location; a location without an address may hold the parts itself."""
    place = F.when(_list(item, "$.jobLocation").isNotNull(), _variant(item, "$.jobLocation[0]")).otherwise(
        _variant(item, "$.jobLocation"))
    return let(place, lambda p: F.when(
        _variant(p, "$.address").isNull(), _address(p, "$")).otherwise(_address(p, "$.address")))


def all_locations(item: Column) -> Column:
    """All job locations (else the applicant locations), joined by ``"; "``."""
    def filled(path: str) -> Column:
        is_list, is_object = _list(item, path), _object(item, path)
        empty = (F.size(is_list) == 0) | (F.size(is_object) == 0) | (_string(item, path) == "")
        return F.when(~F.coalesce(empty, F.lit(False)), _variant(item, path))

    chosen = F.coalesce(filled("$.jobLocation"), filled("$.applicantLocationRequirements"))
    places = let(chosen, lambda c: F.coalesce(_list(c, "$"), F.array(c)))

    def show(place: Column) -> Column:
        address = _object(place, "$.address")
        own = F.when(F.size(address) > 0, _address(place, "$.address")).when(
            F.coalesce(_string(place, "$.address"), F.lit("")).isin("", "{}", "[]"), _address(place, "$"))
        return F.when(_object(place, "$").isNotNull(), F.coalesce(own, _string(place, "$.name"), F.lit(""))).otherwise(
            F.coalesce(_string(place, "$"), F.lit("")))

    return F.array_join(F.filter(F.transform(places, show), lambda p: p != ""), "; ")


def salary_text(item: Column) -> Column:
    """``"CUR lo-hi / UNIT"``; one bound alone is shown alone, none gives empty text."""
    value = "$.baseSalary.value"
    low, high = _string(item, f"{value}.minValue"), _string(item, f"{value}.maxValue")
    amount = F.when(low.isNotNull() & high.isNotNull(), F.concat(low, F.lit("-"), high)).otherwise(F.coalesce(low, high))
    currency = F.coalesce(_string(item, "$.baseSalary.currency"), F.lit(""))
    unit = F.coalesce(_string(item, f"{value}.unitText"), F.lit(""))
    text = squash_ws(F.concat(currency, F.lit(" "), amount, F.lit(" / "), unit))
    return F.when(_object(item, value).isNotNull() & amount.isNotNull(), text).otherwise(F.lit(""))


def identifier(item: Column) -> Column:
    value = F.when(_object(item, "$.identifier").isNotNull(), _string(item, "$.identifier.value")).otherwise(
        _string(item, "$.identifier"))
    return F.coalesce(value, F.lit(""))


def employment_type(item: Column) -> Column:
    listed = F.try_variant_get(item, "$.employmentType", "array<string>")
    return F.coalesce(F.when(listed.isNotNull(), F.array_join(listed, ", ")).otherwise(
        _string(item, "$.employmentType")), F.lit(""))


def posting_struct(item: Column) -> Column:
    """The fields of a posting as a plain struct; null when there is no posting."""
    return let(item, lambda posting: F.when(posting.isNotNull(), _fields(posting)))


def _fields(item: Column) -> Column:
    return F.struct(
        F.coalesce(_string(item, "$.title"), F.lit("")).alias("title"),
        F.coalesce(_string(item, "$.url"), F.lit("")).alias("url"),
        identifier(item).alias("identifier"),
        F.coalesce(_string(item, "$.description"), F.lit("")).alias("description"),
        employment_type(item).alias("employment_type"),
        _string(item, "$.datePosted").alias("date_posted"),
        _string(item, "$.validThrough").alias("valid_through"),
        first_location(item).alias("location"),
        all_locations(item).alias("all_locations"),
        salary_text(item).alias("salary"),
    )


def first_posting(graph: bool = True) -> Column:
    """The first posting of a parsed page as a struct."""
    return posting_struct(F.try_element_at(page_postings(graph), F.lit(1)))


def posting_to_job(rows: DataFrame, posting: str, source: str, fallback_url: str, dated: bool = False,
                   **fixed: Column) -> DataFrame:
    """JOB_SCHEMA rows from a posting struct: the page's URL, also as id, when the posting has none.

    ``dated`` adds employment type, dates and salary; ``fixed`` replaces single columns.
    """
    p = F.col(posting)
    url = first_non_empty(p["url"], F.col(fallback_url))
    columns = dict(
        company=F.col("company"), title=p["title"], location=p["location"], url=url, source=F.lit(source),
        source_id=first_non_empty(p["identifier"], url), description=fragment_text(p["description"]),
    )
    if dated:
        columns.update(
            employment_type=squash_ws(p["employment_type"]), published_at=p["date_posted"],
            updated_at=p["valid_through"], compensation=p["salary"])
    columns.update(fixed)
    return as_jobs(rows, **columns)

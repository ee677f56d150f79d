"""Normalizers: captured board payloads (JSON) to the posting table, one function per platform.

A capture row is one payload page: ``company``, ``board``, ``page_no``, ``body``. Payloads are read
as VARIANT, because boards deliver the same field as a string, an object or a list. Store captures
partitioned by ``platform``: ``normalize`` filters on it, so every partition is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.location import normalize_location
from vacantia.functions.pay import pay_node_text
from vacantia.functions.text import first_non_empty, fragment_text, non_empty, strip
from vacantia.operators.capture import first_nonempty_variant, last_capture
from vacantia.schemas import as_jobs

#: Room for this many postings per payload page in ``capture_seq``.
PAGE_SPAN = 1_000_000

Normalizer = Callable[[DataFrame], DataFrame]
NORMALIZERS: dict[str, Normalizer] = {}
#: Name of the list of postings in a platform's payload; null for a bare list, empty if it is not known.
LIST_KEYS: dict[str, str | None] = {}


def register_normalizer(platform: str, fn: Normalizer, key: str | None = "") -> None:
    """Add or replace the normalizer of a platform (captures in, JOB_SCHEMA out). ``key`` names the list of postings in its
    payload (null: the payload is the list); without it every payload that is not blank counts as listing something."""
    NORMALIZERS[platform], LIST_KEYS[platform] = fn, key


def _normalizer(platform: str, key: str | None = None):
    def keep(fn: Normalizer) -> Normalizer:
        register_normalizer(platform, fn, key)
        return fn

    return keep


def normalize(captures: DataFrame, platforms: list[str] | None = None) -> DataFrame:
    """Union of all platforms' postings.

    Captures of several addresses of one board carry ``variant_rank``: each company's first variant that lists anything
    counts, and the others are left out.
    """
    for name in ("board", "public_base"):
        if name not in captures.columns:
            captures = captures.withColumn(name, F.lit(""))
    out = None
    for platform in platforms or sorted(NORMALIZERS):
        rows = captures.filter(F.col("platform") == platform)
        if "variant_rank" in captures.columns:
            rows = first_listing_variant(rows, LIST_KEYS.get(platform, ""))
        jobs = NORMALIZERS[platform](rows)
        out = jobs if out is None else out.unionByName(jobs)
    if out is None:
        raise ValueError("no platform given")
    return out


def listed_count(key: str | None) -> Column:
    """How many postings a payload lists; 0 if it cannot be read. Postings are counted as text, none is parsed."""
    if key == "":
        return F.when(F.trim("body") != "", F.lit(1)).otherwise(F.lit(0))
    bare = F.coalesce(F.size(F.from_json("body", "array<string>")), F.lit(0))
    if key is None:
        return F.greatest(bare, F.lit(0))
    nested = F.size(F.from_json("body", f"struct<`{key}`:array<string>>")[key])
    return F.greatest(F.when(F.ltrim("body").startswith("["), bare).otherwise(F.coalesce(nested, F.lit(0))), F.lit(0))


def first_listing_variant(captures: DataFrame, key: str | None) -> DataFrame:
    """Captures of each company's first variant (lowest ``variant_rank``) with a posting on any of its pages. Only company and
    rank are aggregated; bodies meet the result in a join."""
    return first_nonempty_variant(captures, listed_count(key) > 0)


def payload_items(captures: DataFrame, key: str | None) -> DataFrame:
    """One row per posting: capture columns without the body, ``item`` (VARIANT) and ``capture_seq``.

    The payload is an object holding the list under ``key``, or a bare list.
    """
    items = F.from_json("body", "array<variant>")
    if key is not None:
        nested = F.from_json("body", f"struct<`{key}`:array<variant>>")[key]
        items = F.when(F.ltrim("body").startswith("["), items).otherwise(nested)
    kept = [c for c in captures.columns if c != "body"]
    rows = captures.select(*kept, F.posexplode(items).alias("pos", "item"))
    return rows.withColumn("capture_seq", F.col("page_no") * F.lit(PAGE_SPAN) + F.col("pos"))


def payload_errors(captures: DataFrame) -> DataFrame:
    """(company, error) of captures whose body is there but is no JSON. Such a board failed; it is not empty."""
    broken = F.col("body").isNotNull() & F.try_parse_json("body").isNull()
    return captures.filter(broken).select("company", F.lit("ValueError: unreadable payload").alias("error"))


def _last_details(details: DataFrame, key: str) -> DataFrame:
    """One captured detail per posting."""
    kept = [c for c in ("company", key, "body", "captured_at") if c in details.columns]
    return last_capture(details.select(*kept).filter(F.col(key) != ""), "company", key)


def _text(path: str, source: str | Column = "item") -> Column:
    return F.try_variant_get(source, path, "string")


def _is_object(path: str, source: str | Column = "item") -> Column:
    return F.try_variant_get(source, path, "map<string,variant>").isNotNull()


def _is_list(path: str, source: str | Column = "item") -> Column:
    return F.try_variant_get(source, path, "array<variant>").isNotNull()


def _names(path: str, keys: tuple[str, ...] = ("name",), separator: str = "; ") -> Column:
    """Names of a list of objects or strings, joined."""
    elements = F.try_variant_get("item", path, "array<variant>")

    def name(element: Column) -> Column:
        is_object = F.try_variant_get(element, "$", "map<string,variant>").isNotNull()
        named = F.coalesce(*[F.try_variant_get(element, f"$.{k}", "string") for k in keys], F.lit(""))
        return F.when(is_object, named).otherwise(F.try_variant_get(element, "$", "string"))

    return F.array_join(F.transform(elements, name), separator)


def _name_or_text(path: str) -> Column:
    """``{"name": x}`` or a scalar as text."""
    return F.when(_is_object(path), _text(f"{path}.name")).otherwise(_text(path))


@_normalizer("greenhouse", "jobs")
def greenhouse(captures: DataFrame) -> DataFrame:
    rows = payload_items(captures, "jobs").withColumn("content", F.coalesce(_text("$.content"), F.lit("")))
    return as_jobs(
        rows,
        company=F.col("company"), title=_text("$.title"), location=_text("$.location.name"),
        url=_text("$.absolute_url"), source=F.lit("greenhouse"), source_id=_text("$.id"),
        description=fragment_text(F.col("content")), department=_names("$.departments", separator=", "),
        updated_at=_text("$.updated_at"), compensation=pay_node_text(F.col("content")),
        capture_seq=F.col("capture_seq"),
    )


@_normalizer("lever")
def lever(captures: DataFrame) -> DataFrame:
    rows = payload_items(captures, None)
    salary = F.try_variant_get("item", "$.salaryRange", "map<string,variant>")
    part = {k: F.coalesce(_text(f"$.salaryRange.{k}"), F.lit("")) for k in ("currency", "min", "max", "interval")}
    pay = strip(F.concat(part["currency"], F.lit(" "), part["min"], F.lit("-"), part["max"], F.lit(" "), part["interval"]))
    return as_jobs(
        rows,
        company=F.col("company"), title=_text("$.text"), location=_text("$.categories.location"),
        url=_text("$.hostedUrl"), source=F.lit("lever"), source_id=_text("$.id"),
        description=F.concat_ws("\n", non_empty(_text("$.descriptionPlain")), non_empty(_text("$.additionalPlain"))),
        department=_text("$.categories.department"), team=_text("$.categories.team"),
        workplace_type=_text("$.workplaceType"), employment_type=_text("$.categories.commitment"),
        compensation=F.when(F.size(salary) > 0, pay), capture_seq=F.col("capture_seq"),
    )


@_normalizer("ashby", "jobs")
def ashby(captures: DataFrame) -> DataFrame:
    rows = payload_items(captures, "jobs")
    # Only an explicit false hides a posting; null and absent flags do not.
    listed = rows.filter(F.coalesce(F.try_variant_get("item", "$.isListed", "boolean"), F.lit(True)))
    return as_jobs(
        listed,
        company=F.col("company"), title=_text("$.title"), location=_text("$.location"), url=_text("$.jobUrl"),
        source=F.lit("ashby"), source_id=first_non_empty(_text("$.id"), _text("$.jobUrl")),
        description=_text("$.descriptionPlain"), department=_text("$.department"), team=_text("$.team"),
        workplace_type=_text("$.workplaceType"), employment_type=_text("$.employmentType"),
        published_at=_text("$.publishedAt"), compensation=_text("$.compensation.compensationTierSummary"),
        capture_seq=F.col("capture_seq"),
    )


def _place(path: str) -> Column:
    """A place given as a list, an object or text; empty values are null."""
    listed = F.when(F.size(F.try_variant_get("item", path, "array<variant>")) > 0, _names(path))
    named = first_non_empty(_text(f"{path}.name"), _text(f"{path}.display_name"))
    is_filled = F.size(F.try_variant_get("item", path, "map<string,variant>")) > 0
    return (
        F.when(_is_list(path), listed)
        .when(_is_object(path), F.when(is_filled, named))
        .otherwise(non_empty(_text(path)))
    )


@_normalizer("gem", "job_posts")
def gem(captures: DataFrame) -> DataFrame:
    rows = payload_items(captures, "job_posts")
    return as_jobs(
        rows,
        company=F.col("company"), title=_text("$.title"),
        location=F.coalesce(_place("$.location"), _place("$.locations"), F.lit("")),
        url=first_non_empty(_text("$.job_post_url"), _text("$.url"), _text("$.apply_url")),
        source=F.lit("gem"), source_id=first_non_empty(_text("$.id"), _text("$.job_post_id")),
        description=first_non_empty(_text("$.description"), _text("$.description_plain")),
        department=_name_or_text("$.department"),
        workplace_type=first_non_empty(_text("$.workplace_type"), _text("$.location_type")),
        employment_type=_text("$.employment_type"), capture_seq=F.col("capture_seq"),
    )


@_normalizer("recruitee", "offers")
def recruitee(captures: DataFrame) -> DataFrame:
    rows = payload_items(captures, "offers")
    shown = rows.filter(F.coalesce(_text("$.status"), F.lit("published")) == "published")
    by_slug = F.concat(F.lit("https://"), F.col("board"), F.lit(".recruitee.com/o/"), F.coalesce(_text("$.slug"), F.lit("")))
    many = F.coalesce(_names("$.locations"), F.lit(""))
    no_locations = first_non_empty(_text("$.locations"), F.lit(""))
    return as_jobs(
        shown,
        company=F.col("company"), title=_text("$.title"),
        location=F.when(_is_list("$.locations") | (no_locations == ""), many).otherwise(no_locations),
        url=F.coalesce(non_empty(_text("$.careers_url")), non_empty(_text("$.url")), by_slug),
        source=F.lit("recruitee"), source_id=first_non_empty(_text("$.id"), _text("$.slug")),
        description=fragment_text(first_non_empty(_text("$.description"), _text("$.description_html"))),
        department=_name_or_text("$.department"), employment_type=_text("$.employment_type"),
        capture_seq=F.col("capture_seq"),
    )


def _label(path: str, source: str) -> Column:
    """``{"label": x}`` / ``{"name": x}`` or a scalar; empty values are null."""
    named = first_non_empty(_text(f"{path}.label", source), _text(f"{path}.name", source))
    return non_empty(F.when(_is_object(path, source), named).otherwise(_text(path, source)))


def _section_text(sections: Column) -> Column:
    """Text of all sections of an advert, in document order."""
    def read(value: Column) -> Column:
        as_list = F.from_json(value, "array<string>")
        one = first_non_empty(F.get_json_object(value, "$.text"), F.get_json_object(value, "$.title"))
        # A list element is an object with a text, or the text itself.
        each = F.transform(as_list, lambda e: F.when(
            e.startswith("{"), F.coalesce(F.get_json_object(e, "$.text"), F.lit(""))).otherwise(e))
        return F.when(F.ltrim(value).startswith("["), each).when(
            F.ltrim(value).startswith("{"), F.array(one)).otherwise(F.array(F.lit("")))

    parts = F.flatten(F.transform(F.map_values(sections), read))
    return F.array_join(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), "\n")


def smartrecruiters(captures: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Listing joined with the captured details (company, pid, body); a detail wins field by field."""
    kept = [c for c in captures.columns if c != "body"]
    # Items stay JSON text here: VARIANT sorts object keys, and section order matters.
    listed = captures.select(
        *kept, F.posexplode(F.from_json("body", "struct<content:array<string>>")["content"]).alias("pos", "raw"))
    rows = listed.withColumns({
        "capture_seq": F.col("page_no") * F.lit(PAGE_SPAN) + F.col("pos"), "item": F.try_parse_json("raw"),
    }).withColumn("pid", first_non_empty(_text("$.uuid"), _text("$.id")))
    if details is not None:
        found = _last_details(details, "pid").select("company", "pid", F.col("body").alias("_detail"))
        rows = rows.join(found, ["company", "pid"], "left")
        rows = rows.withColumn("_detail", F.coalesce("_detail", "raw"))
    else:
        rows = rows.withColumn("_detail", F.col("raw"))
    rows = rows.withColumn("detail", F.try_parse_json("_detail"))

    def either(path: str) -> Column:
        return F.coalesce(non_empty(_text(path, "detail")), non_empty(_text(path)), F.lit(""))

    from_detail = F.size(F.try_variant_get("detail", "$.location", "map<string,variant>")) > 0

    def place(part: str) -> Column:
        return non_empty(F.when(from_detail, _text(f"$.location.{part}", "detail")).otherwise(_text(f"$.location.{part}")))

    is_object = from_detail | _is_object("$.location")
    plain = F.coalesce(_label("$.location", "detail"), _label("$.location", "item"))
    sections = F.from_json("_detail", "struct<jobAd:struct<sections:map<string,string>>>")["jobAd"]["sections"]
    return as_jobs(
        rows,
        company=F.col("company"), title=either("$.name"),
        location=F.when(is_object, F.concat_ws(", ", place("city"), place("region"), place("country"))).otherwise(plain),
        url=F.coalesce(non_empty(_text("$.applyUrl", "detail")), non_empty(_text("$.ref", "detail")), _text("$.ref")),
        source=F.lit("smartrecruiters"), source_id=F.col("pid"),
        description=fragment_text(_section_text(sections)),
        department=F.coalesce(_label("$.department", "detail"), _label("$.department", "item")),
        workplace_type=F.initcap(F.when(
            from_detail, _text("$.location.remote", "detail")).otherwise(_text("$.location.remote"))),
        employment_type=F.coalesce(_label("$.typeOfEmployment", "detail"), _label("$.typeOfEmployment", "item")),
        published_at=F.coalesce(non_empty(_text("$.releasedDate", "detail")), _text("$.releasedDate")),
        capture_seq=F.col("capture_seq"),
    )


register_normalizer("smartrecruiters", smartrecruiters, "content")


def workday_listing(captures: DataFrame) -> DataFrame:
    """Listing rows of board pages with ``external_path`` and the key that tells copies apart."""
    rows = payload_items(captures, "jobPostings")
    path = F.coalesce(_text("$.externalPath"), F.lit(""))
    by_title = F.concat(F.coalesce(_text("$.title"), F.lit("")), F.lit("|"), F.coalesce(_text("$.locationsText"), F.lit("")))
    return rows.withColumns({
        "external_path": path,
        "listing_key": F.when(path != "", path).otherwise(by_title),
        "listing_title": F.coalesce(_text("$.title"), F.lit("")),
    })


def first_listings(rows: DataFrame) -> DataFrame:
    """First listed row per (company, listing_key). Listings are short, so the rows themselves are aggregated
    and the payloads are read once."""
    first = F.min_by(F.struct(*rows.columns), F.col("capture_seq")).alias("_first")
    return rows.groupBy("company", "listing_key").agg(first).select("_first.*")


def workday_pay_text(info: str = "info") -> Column:
    """Pay wording of a detail: the first field that is text, or an object's parts joined by blanks."""
    options = []
    for key in ("compensation", "salary", "salaryRange", "payRange"):
        parts = [non_empty(strip(_text(f"$.{key}.{part}", info))) for part in ("currency", "min", "max", "interval")]
        is_text = ~_is_object(f"$.{key}", info) & ~_is_list(f"$.{key}", info) & F.try_variant_get(
            info, f"$.{key}", "double").isNull()
        scalar = F.when(is_text, non_empty(strip(_text(f"$.{key}", info))))
        options.append(F.when(_is_object(f"$.{key}", info), non_empty(F.concat_ws(" ", *parts))).otherwise(scalar))
    return F.coalesce(*options, F.lit(""))


def workday_detail_info(body: Column) -> Column:
    """The posting object inside a captured detail."""
    detail = F.try_parse_json(body)

    def filled(path: str) -> Column:
        return F.when(F.size(F.try_variant_get(detail, path, "map<string,variant>")) > 0,
                      F.try_variant_get(detail, path, "variant"))

    return F.coalesce(filled("$.jobPostingInfo"), filled("$.jobPosting"), detail)


def workday(captures: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """Board pages, first copy of each listing, joined with captured details (company, external_path, body).

    A listing without a detail is kept. ``public_base`` in the captures is the public site's address.
    """
    rows = first_listings(workday_listing(captures))
    if details is not None:
        found = _last_details(details, "external_path").select("company", "external_path", F.col("body").alias("_body"))
        rows = rows.join(found, ["company", "external_path"], "left")
    else:
        rows = rows.withColumn("_body", F.lit(None).cast("string"))
    rows = rows.withColumn("info", workday_detail_info(F.col("_body")))

    def info(path: str) -> Column:
        return non_empty(_text(path, "info"))

    description = fragment_text(F.coalesce(info("$.jobDescription"), info("$.description"), _text("$.jobDescription")))
    rows = rows.withColumn("description", description)
    place = F.coalesce(info("$.location"), info("$.locationsText"),
                       non_empty(_text("$.locationsText")), non_empty(_text("$.location")), F.lit(""))
    return as_jobs(
        rows,
        company=F.col("company"), title=F.coalesce(info("$.title"), F.col("listing_title")),
        location=normalize_location(place, F.col("external_path"), F.col("description")),
        url=F.concat(F.col("public_base"), F.col("external_path")), source=F.lit("workday"),
        source_id=F.coalesce(info("$.jobReqId"), info("$.jobRequisitionId"),
                             non_empty(_text("$.bulletFields[0]")), F.col("external_path")),
        description=F.col("description"), department=info("$.department"), team=info("$.team"),
        workplace_type=info("$.workplaceType"),
        employment_type=F.coalesce(info("$.timeType"), info("$.employmentType")),
        published_at=F.coalesce(info("$.startDate"), info("$.postedOn"), _text("$.postedOn")),
        updated_at=_text("$.updatedAt", "info"), compensation=workday_pay_text(),
        capture_seq=F.col("capture_seq"),
    )


register_normalizer("workday", workday, "jobPostings")

"""Postings and facts read from page text and layout instead of job links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import compute_once, heading_url, let, squash_ws, strip, synthetic_id
from vacantia.operators import dom
from vacantia.operators.links import ADP_ROLE, first_by_url
from vacantia.schemas import as_jobs
from vacantia.session import scratch_path

# Section markers, headings that are no jobs, and the shape of rendered cards.
JOBS_MARKER = (
    r"(?iuUd)open positions?|current openings?|career opportunities|job opportunities|"
    r"openings|vacancies|join us|we seek"
)
NOT_A_JOB = ("open positions", "view more", "nothing found")
OTHER_SECTIONS = ("benefits", "culture", "values", "about us", "locations")
CARD_SECTION = r"(?iuUd)Current Openings\s*\(\d+\s+of\s+\d+\)\s*(.*?)(?:Copyright|Privacy\s*\||$)"
CARD_LOCATION = r"(?Ud)([A-Z][A-Za-z .'-]+,\s*[A-Z]{2},\s*US)"
CARD_AGE = r"(?iuUd)^(?:\d+\s+(?:day|days|hour|hours|month|months)\s+ago)?(?:Full Time|Part Time|Temporary|Contract)?\s*"
CARD_LATE_AGE = r"(?iuUd)^\d+\s+(?:day|days|hour|hours|month|months)\s+ago\s*"
CARD_MIN_TITLE = 4
CARD_EMPLOYMENT = r"(?iuUd)^(?:Full Time|Part Time|Temporary|Contract)\s+"


def heading_jobs(parsed: DataFrame, already_listed: DataFrame | None = None) -> DataFrame:
    """Headings after the first "open positions"-like heading, up to an unrelated section.

    The unrelated section ends the list only once a job was listed; ``already_listed`` (company) names
    boards that gave a job in another way before.
    """
    columns = ["company", "page_url", "page_no"]
    if already_listed is not None:
        known = already_listed.select("company").distinct().withColumn("_listed", F.lit(True))
        parsed = parsed.join(known, "company", "left").withColumn("_listed", F.coalesce("_listed", F.lit(False)))
    else:
        parsed = parsed.withColumn("_listed", F.lit(False))
    marker = dom.first_of(F.filter(
        dom.find_all("h1", "h2", "h3", "h4", "h5"), lambda h: dom.element_text(h).rlike(JOBS_MARKER)))

    def describe(h: Column, lists: Column) -> Column:
        def with_sibling(sibling: Column) -> Column:
            beside = dom.element_text(sibling)
            usable = ~sibling["tag"].isin("h4", "h5") & (beside != "")
            section = dom.element_text(dom.heading_before(h, "h1", "h2", "h3"))
            return F.struct(
                h["seq"].alias("seq"), dom.element_text(h).alias("title"),
                F.coalesce(section, F.lit("")).alias("section"), F.when(usable, beside).otherwise(F.lit("")).alias("location"))

        return let(dom.next_sibling(h), with_sibling)

    listed = let(marker, lambda m: F.filter(dom.find_all("h2", "h3", "h4", "h5", "h6"), lambda h: h["seq"] > m["seq"]))
    heads = dom.describe_each(listed, {}, describe)
    jobs = F.filter(heads, lambda h: (h["title"] != "") & ~F.lower(h["title"]).isin(*NOT_A_JOB))
    def ends(h: Column, i: Column) -> Column:
        other = F.lit(False)
        for word in OTHER_SECTIONS:
            other = other | F.lower(h["section"]).contains(word)
        begun = (i > 0) | F.col("_listed")
        return begun & (h["section"] != "") & ~h["section"].rlike(JOBS_MARKER) & other

    # Pages are parsed once: what counts is written, headings and page text apart, and the text joins after the dedupe, once per
    # posting that stays.
    found = compute_once(parsed.select(*columns, "_listed", "elements", "texts"), {"_jobs": jobs, "page_text": dom.page_text()})
    path = scratch_path(parsed.sparkSession, "headings")
    found.filter(F.size("_jobs") > 0).select(*columns, "_listed", "_jobs", "page_text").write.parquet(path)
    pages = parsed.sparkSession.read.parquet(path)
    stop = dom.first_of(F.filter("_jobs", ends))["seq"]
    rows = pages.withColumn("_stop", stop).select(*columns, "_stop", F.explode("_jobs").alias("h")).select(
        *columns, "_stop", "h.*")
    kept = rows.filter(F.col("_stop").isNull() | (F.col("seq") < F.col("_stop"))).withColumn(
        "url", heading_url(F.col("page_url"), F.col("title")))
    texts = pages.select(*columns, "page_text").dropDuplicates(columns)
    first = first_by_url(kept).join(texts, columns)
    text = F.concat_ws(" ", "title", "location", "page_text")
    return as_jobs(
        first, company=F.col("company"), title=F.col("title"), location=F.col("location"), url=F.col("page_url"),
        source=F.lit("career_page"), description=strip(text),
        source_id=synthetic_id(F.concat("page_url", "title", "location"), 16),
        capture_seq=F.col("page_no").cast("bigint") * 1_000_000 + F.col("seq"))


def seed_title_jobs(pages_text: DataFrame, seeds: DataFrame) -> DataFrame:
    """Configured titles that occur, case-blind, in the company's page text.

    ``pages_text`` (company, page_url, text); ``seeds`` (company, title, default_location, seq), a configuration table: a
    company's seeds travel as one list to its pages, so a page's text is not repeated per seed.
    """
    named = seeds.filter(F.col("title") != "").groupBy("company").agg(
        F.collect_list(F.struct("title", "default_location", "seq")).alias("_seeds"))
    low = pages_text.join(named, "company").withColumn("_low", F.lower("text"))
    hits = F.filter("_seeds", lambda s: F.col("_low").contains(F.lower(s["title"])))
    rows = low.select("company", "page_url", "text", F.explode(hits).alias("s")).select("company", "page_url", "text", "s.*")
    return as_jobs(
        rows, company=F.col("company"), title=F.col("title"), location=F.col("default_location"), url=F.col("page_url"),
        source=F.lit("career_page"), source_id=synthetic_id(F.concat("page_url", "title"), 16),
        description=F.col("text"), capture_seq=F.col("seq"))


def _card_title(chunk: Column) -> Column:
    text = F.regexp_replace(strip(chunk), r"(?iuUd)^Search\s+", "")
    text = strip(F.regexp_replace(text, CARD_AGE, ""))
    text = F.regexp_replace(F.regexp_replace(text, CARD_LATE_AGE, ""), CARD_EMPLOYMENT, "")
    return F.btrim(text, F.lit(" -|"))


def card_segments(pages_text: DataFrame, min_title: int = CARD_MIN_TITLE) -> DataFrame:
    """Cards of a rendered job list: each location ends a card, the words before it are the title.

    ``pages_text`` (company, page_url, text) holds white-space-squashed page text. The section after
    "Current Openings (n of m)" is used if there is one. Of a chunk shorter than ``min_title`` only scraps of other fields are
    left, so it is no title; 0 keeps all.
    """
    text = squash_ws(F.col("text"))
    in_section = strip(F.regexp_extract(text, CARD_SECTION, 1))
    section = F.when(text.rlike(CARD_SECTION), in_section).otherwise(text)
    rows = pages_text.select("company", "page_url", section.alias("section"))
    places = F.regexp_extract_all("section", F.lit(CARD_LOCATION), F.lit(1))
    # Splitting at the locations leaves one chunk more than there are locations: what follows the last card.
    chunks = F.slice(F.split("section", CARD_LOCATION), F.lit(1), F.size(places))
    cards = F.transform(F.arrays_zip(chunks.alias("chunk"), places.alias("place")), lambda c: F.struct(
        _card_title(c["chunk"]).alias("title"), strip(c["place"]).alias("location")))
    flat = rows.select("company", "page_url", F.posexplode(cards).alias("pos", "card")).select(
        "company", "page_url", "pos", "card.*")
    kept = flat.filter(F.col("title").rlike(ADP_ROLE) & (F.length("title") >= min_title))
    digest = F.substring(F.sha1(F.concat_ws("|", "title", "location").cast("binary")), 1, 12)
    kept = kept.withColumns({
        "url": F.concat("page_url", F.lit("#job-"), digest), "page_no": F.lit(0), "seq": F.col("pos")})
    first = first_by_url(kept)
    return as_jobs(
        first, company=F.col("company"), title=F.col("title"), location=F.col("location"), url=F.col("url"),
        source=F.lit("adp"), source_id=synthetic_id(F.col("url")), capture_seq=F.col("seq"))


def label_value(text: Column, pattern: str) -> Column:
    """Value after a label such as ``Location:``; empty if the label is missing."""
    return strip(F.regexp_extract(text, pattern, 1))


def card_fields(parsed: DataFrame, card_class: str, title_class: str | None = None, link_tag: str = "a",
                description_class: str | None = None, location_attribute: str | None = None) -> DataFrame:
    """Configured cards: title, link, description and location attribute of each element with ``card_class``."""
    def with_class(class_name: str | None) -> Column:
        return F.filter("elements", lambda e: dom.has_class(e, class_name) if class_name else F.lit(False))

    lists = {
        "titles": with_class(title_class), "descriptions": with_class(description_class),
        "links": F.filter("elements", lambda e: (e["tag"] == link_tag) & dom.attr(e, "href").isNotNull()),
    }

    def describe(card: Column, lists: Column) -> Column:
        title = dom.first_of(dom.inside(card, lists["titles"])) if title_class else card
        text = dom.element_text(dom.first_of(dom.inside(card, lists["descriptions"]))) if description_class else F.lit("")
        place = dom.attr(card, location_attribute) if location_attribute else F.lit("")
        return F.struct(
            card["seq"].alias("seq"), squash_ws(dom.element_text(title)).alias("label"),
            dom.first_of(dom.inside(card, lists["links"]))["link"].alias("url"),
            squash_ws(text).alias("description"), strip(place).alias("location"))

    cards = dom.describe_each(with_class(card_class), lists, describe)
    rows = parsed.select("company", "page_url", "page_no", F.explode(cards).alias("c")).select(
        "company", "page_url", "page_no", "c.*")
    return first_by_url(rows.filter((F.col("label") != "") & (F.coalesce("url", F.lit("")) != ""))).withColumn(
        "title", F.col("label"))

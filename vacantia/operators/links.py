"""Page anchors to postings: one policy per platform, and the join with captured detail pages.

Anchors come from ``dom.page_links`` (company, page_url, page_no, seq, href, link, label). A policy is a
predicate and a few Column rules; ``first_by_url`` keeps the first anchor of each URL per company with an
aggregate that combines on the map side, so a URL repeated on every page is no hot spot.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.functions.regex import FLAGS, folded, plain_words
from vacantia.functions.text import (
    compute_once, first_non_empty, fragment_text, heading_url, last_path_part, let, non_empty, squash_ws, strip, synthetic_id,
    url_host, url_path,
)
from vacantia.operators import dom, jsonld
from vacantia.operators.capture import last_capture
from vacantia.schemas import as_jobs

# Link shapes, hosts, words and labels per platform.
ICIMS_JOB = r"(?iuUd)/jobs/\d+/.+?/job"
PROMEGA_JOB = r"(?iuUd)/jobs/\d+(?:\?|$)"
SUCCESSFACTORS_JOB = r"(?iuUd)/job/.+?/\d+/?(?:\?|$)"
ORACLE_JOB = r"(?iuUd)/job/(?:[^/]+/)?\d+/?|/jobs/[^?#]+"
ULTIPRO_JOB = r"(?iuUd)(JobDetails|JobBoard|Opportunity|job[-_/]?detail|/Job/)"
INDIGO_JOB = r"(?iuUd)job-application|product-mgmt-intern"
BROWSER_JOB = (
    r"(?iuUd)(/job/|/jobs/|/position/|/positions/|/opening/|/openings/|jobid=|gh_jid=|jobId=|requisition|careersection)"
)
BROWSER_TITLE = (
    r"(?iuUd)bioinform|computational|scientist|data science|data scientist|genomic|microbiom|"
    r"metagenom|informatics|algorithm|research|director|manager|engineer|application|"
    r"developer|analyst|microbiolog|ferment|bioprocess|food techn|food sci|probiotic|"
    r"protein|laboratory|lab technician|strain|cultivation|brew"
)
CAREER_TITLE = (
    r"(?iuUd)bioinform|computational|scientist|data science|data scientist|genomic|microbiom|"
    r"metagenom|informatics|algorithm|research|director|manager|engineer|developer|"
    r"software|application|analyst|microbiolog|ferment|bioprocess|food techn|food sci|"
    r"probiotic|protein|laboratory|lab technician|strain|cultivation|brew"
)
BROWSER_HEADING = (
    r"(?iuUd)scientist|research|microbiolog|ferment|bioprocess|protein|laboratory|"
    r"technician|operator|engineer|food|strain|cultivation|brew"
)
ENTRY_TEXT = (
    r"(?iuUd)(search jobs|view all jobs|current opportunities|current openings|explore job opportunities|"
    r"explore open positions|view openings|job openings|open roles|see current opportunities|view our open roles|"
    r"find job openings|view and apply to open positions|career center)"
)
ADP_ROLE = (
    r"(?iuUd)\b(scientist|research associate|senior research associate|director|manager|engineer|"
    r"associate director|specialist|technician|analyst|developer|coordinator|clinical|"
    r"regulatory|quality|manufacturing|operations|finance|legal)\b"
)
GENERIC_LABELS = (
    "applications", "applicant tracking system by teamtailor", "apply here", "apply here →",
    "careers", "embedded job board", "employee login", "explore all open positions",
    "job opening", "job openings", "log in as employee", "open positions", "open roles",
    "read more and apply", "social menu", "skip to main content",
    "submit your open application (opens in a new window)",
)
BROWSER_HOSTS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "gem.com", "myworkdayjobs.com",
    "oraclecloud.com", "smartrecruiters.com", "successfactors.com", "phenompeople.com",
    "icims.com", "jibecdn.com", "workforcenow.adp.com", "jobvite.com", "breezy.hr",
    "recright.com", "personio.de", "teamtailor.com", "bamboohr.com",
)
CAREER_HOSTS = (
    "greenhouse.io", "lever.co", "ashbyhq.com", "recruitee.com", "gem.com",
    "oraclecloud.com", "smartrecruiters.com", "myworkdayjobs.com", "jobvite.com",
    "icims.com", "workable.com", "isolvedhire.com", "jibecdn.com", "recright.com",
    "personio.de", "teamtailor.com", "bamboohr.com",
)
CAREER_WORDS = ("/job", "/career", "/position", "/opening", "apply")
SMARTRECRUITERS_WORDS = ("/job", "/position", "apply")
JAZZHR_NAV = ("powered by", "privacy", "login", "sign in")
ULTIPRO_MIN_LABEL = 3
ULTIPRO_NAV = ("privacy", "home", "login", "company")
ADP_NAV = ("privacy", "support", "login", "home", "search jobs", "view all", "career center")
BROWSER_NAV = ("privacy", "terms", "talent community", "join our talent", "career home")
ADAPTIVE_HREF = ("career", "job", "apply")
ADAPTIVE_MIN_CARD, ADAPTIVE_CHROME_CARD = 10, 80
ADAPTIVE_CHROME = ("careers", "career listings", "view all career listings", "apply now")
ADAPTIVE_NOT_TITLE = ("apply now", "learn more", "view job")
INDIGO_NOT_TITLE = ("apply here", "apply", "learn more")
ELIGO_SECTIONS = (
    "research & development", "operations & general administration",
    "discovery and automation", "genetic engineering", "preclinical development",
    "production and scale-up", "clinical dev and regulatory", "intellectual property and business",
)
JAZZHR_LOCATION = r"(?iuUd)(?:Location|Job Location)\s*[:\-]?\s*([A-Za-z][A-Za-z .,'/\-]{2,100})"
ULTIPRO_LOCATION = r"(?iuUd)(?:Location|Job Location)\s*[:\-]?\s*([A-Za-z0-9 .,'/&()\-]{2,120})"
BROWSER_LOCATION = r"(?iuUd)(?:Location|Locations?)\s*[:\-]?\s*([A-Za-z][A-Za-z .,';/\-]{2,100})"
LINE_LOCATION = r"(?iuUd)Location:\s*([^\n]+)"
LINE_DATE = r"(?iuUd)Date:\s*([^\n]+)"
LOCATION_TRIPLE = (
    r"(?Ud)(?:Work type:\s*[^·]+·?\s*)?([A-Za-z][A-Za-z .'-]+,\s*[A-Za-z .'-]+,\s*[A-Za-z .'-]+)"
)
ENTRY_LIMIT, EXTERNAL_LIMIT, INDIGO_LEVELS = 3, 8, 6


def _c(name: str) -> Column:
    return F.col(name)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """True when the text holds one of the words; each is searched as it stands, which costs less than an alternation."""
    return let(text, lambda t: reduce(or_, [t.contains(word) for word in words]))


def has_word(text: Column, pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern of plain words in any case, without a regular expression."""
    words = plain_words(pattern.removeprefix(FLAGS).removeprefix("(").removesuffix(")"))
    # A word that holds another one adds nothing.
    least = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    return F.when(text.isNotNull(), contains_any(folded(text), tuple(least)))


def _low() -> Column:
    return F.lower(F.concat(_c("label"), F.lit(" "), _c("link")))


def is_generic(label: Column) -> Column:
    return squash_ws(F.lower(label)).isin(*GENERIC_LABELS)


def likely_job_link(link: Column, label: Column, page_url: Column) -> Column:
    """A link to a posting: by its shape, a known board host, or a fitting title on the same host."""
    usable = (link != "") & ~(link.startswith("mailto:") | link.startswith("tel:") | link.startswith("javascript:"))
    return usable & (has_word(link, BROWSER_JOB) | let(url_host(link), lambda host: (
        contains_any(host, BROWSER_HOSTS) | ((host == url_host(page_url)) & has_word(label, BROWSER_TITLE)))))


@dataclass(frozen=True)
class LinkPolicy:
    """How a platform's anchors become postings."""

    source: str
    keep: Callable[[], Column]
    url: Callable[[], Column] = lambda: _c("link")
    title: Callable[[], Column] = lambda: _c("label")
    id_length: int = 20
    source_id: Callable[[], Column] | None = None


def _labelled(condition: Column) -> Column:
    return condition & (_c("label") != "")


def _not_root() -> Column:
    return F.rtrim(_c("link"), F.lit("/")) != F.rtrim(_c("page_url"), F.lit("/"))


def _plain_url() -> Column:
    return F.substring_index(_c("link"), "?", 1)


def _digits_or_hash() -> Column:
    tail = last_path_part(_c("url"))
    return F.when(tail.rlike("^[0-9]+$"), tail).otherwise(synthetic_id(_c("url")))


def _kula_path() -> Column:
    href = F.rtrim(F.substring_index(_c("href"), "?", 1), F.lit("/"))
    return F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), url_path(href)).otherwise(href)


def _kula_base() -> Column:
    return F.regexp_extract(_c("page_url"), r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)


def _career_keep() -> Column:
    link = _c("link")
    known = let(url_host(link), lambda host: (
        (host == url_host(_c("page_url"))) | contains_any(host, CAREER_HOSTS) | contains_any(link, CAREER_HOSTS)))
    return _labelled(_not_root() & has_word(_c("label"), CAREER_TITLE) & known & contains_any(F.lower(link), CAREER_WORDS))


def _ultipro_keep(min_label: int = ULTIPRO_MIN_LABEL) -> Column:
    on_board = _c("link").contains("recruiting.ultipro.com") & (_c("label") != "") & ~contains_any(_low(), ULTIPRO_NAV)
    return (_c("href") != "") & (_c("link").rlike(ULTIPRO_JOB) | on_board) & (F.length("label") >= min_label)


def _browser_keep() -> Column:
    link, label = _c("link"), _c("label")
    front_page = F.rtrim(url_path(link), F.lit("/")).isin("", "/careers")
    unlabelled_navigation = (squash_ws(label) == "") & ~has_word(link, BROWSER_JOB) & front_page
    # What costs little and decides most comes first.
    return (
        (_c("href") != "") & likely_job_link(link, label, _c("page_url")) & ~contains_any(_low(), BROWSER_NAV)
        & ~is_generic(label) & ~unlabelled_navigation
    )


POLICIES: dict[str, LinkPolicy] = {
    "jobvite": LinkPolicy("jobvite", lambda: _labelled(_c("link").contains("/job/"))),
    "icims": LinkPolicy("icims", lambda: _labelled(_c("link").rlike(ICIMS_JOB))),
    "promega": LinkPolicy("promega", lambda: _labelled(_c("link").rlike(PROMEGA_JOB))),
    "smartrecruiters": LinkPolicy(
        "smartrecruiters",
        lambda: _labelled(_c("link").contains("smartrecruiters.com")
                          & contains_any(F.lower(_c("link")), SMARTRECRUITERS_WORDS)),
        id_length=16),
    "jazzhr": LinkPolicy(
        "jazzhr",
        lambda: _labelled(_not_root() & _c("link").contains("applytojob.com")
                          & ~contains_any(_low(), JAZZHR_NAV))),
    "ultipro": LinkPolicy("ultipro", _ultipro_keep),
    "successfactors": LinkPolicy(
        "successfactors", lambda: url_path(_c("link")).rlike(SUCCESSFACTORS_JOB), url=_plain_url,
        source_id=_digits_or_hash),
    "kula": LinkPolicy(
        "kula",
        lambda: _kula_path().rlike(r"^/[^/]+/[0-9]+$")
        & (F.split_part(_kula_path(), F.lit("/"), F.lit(2)) == _c("board")),
        url=lambda: F.concat(_kula_base(), _kula_path()), source_id=lambda: last_path_part(_c("url"))),
    "oracle": LinkPolicy("oracle", lambda: _labelled(_c("href").rlike(ORACLE_JOB))),
    "foundation": LinkPolicy(
        "foundation", lambda: _labelled(_c("href").contains("/jobs/") & ~_c("href").contains("/jobs/search")),
        source_id=lambda: last_path_part(_c("url"))),
    "career_page": LinkPolicy("career_page", _career_keep, id_length=16),
    "browser_career": LinkPolicy(
        "browser_career", _browser_keep,
        title=lambda: F.coalesce(non_empty(_c("label")), F.lit("Job opening"))),
    "adp": LinkPolicy(
        "adp", lambda: _c("link").contains("workforcenow.adp.com") & _c("label").rlike(ADP_ROLE)
        & ~contains_any(_low(), ADP_NAV)),
}


def first_by_url(rows: DataFrame, *keys: str) -> DataFrame:
    """First row per company and URL (or ``keys``), by page and position; ``rows`` should be narrow."""
    keys = keys or ("company", "url")
    order = F.struct("page_no", "seq")
    best = F.min_by(F.struct(*[_c(c) for c in rows.columns]), order)
    return rows.groupBy(*keys).agg(best.alias("_first")).select("_first.*")


def policy_links(anchors: DataFrame, policy: LinkPolicy) -> DataFrame:
    """Kept anchors, one per URL, with url, title, source_id and capture_seq."""
    kept = anchors.filter(policy.keep()).withColumns({"url": policy.url(), "title": policy.title()})
    first = first_by_url(kept)
    new_id = policy.source_id() if policy.source_id else synthetic_id(_c("url"), policy.id_length)
    return first.withColumns({
        "source_id": new_id, "source": F.lit(policy.source),
        "capture_seq": _c("page_no").cast("bigint") * 1_000_000 + _c("seq"),
    })


def links_to_jobs(anchors: DataFrame, platform: str) -> DataFrame:
    """Postings of a platform that lists title and link only."""
    rows = policy_links(anchors, POLICIES[platform])
    return as_jobs(rows, **{c: _c(c) for c in ("company", "title", "url", "source", "source_id", "capture_seq")})


# ---- detail pages ---------------------------------------------------------------------------------------

def detail_facts(details: DataFrame, graph: bool | None = None) -> DataFrame:
    """What postings need from captured detail pages (company, url, html), one row per page.

    ``graph`` asks for the first JSON-LD posting too: False without, True with the nodes of ``@graph``.
    """
    kept = [c for c in ("company", "url", "html", "captured_at") if c in details.columns]
    parsed = dom.parse_pages(last_capture(details.select(*kept), "company", "url").drop("captured_at"), url="url")
    if graph is not None:
        parsed = compute_once(parsed, {"posting": jsonld.first_posting(graph)})
    heading = lambda *tags: dom.element_text(dom.find_first(*tags))
    main = F.coalesce(dom.find_first("main"), dom.find_first("body"))
    facts = parsed.withColumns({
        "captured": F.lit(True),
        "h1": heading("h1"), "heading": heading("h1", "h2"), "h1_or_h2": F.coalesce(heading("h1"), heading("h2")),
        "text": dom.page_text(), "lines": dom.page_text("\n"), "main_text": dom.element_text(main),
    })
    return facts.drop("elements", "texts", "parse_error")


def _with_details(links: DataFrame, facts: DataFrame, how: str = "left") -> DataFrame:
    return links.join(facts, ["company", "url"], how)


def _base(rows: DataFrame, **columns: Column) -> DataFrame:
    common = {c: _c(c) for c in ("company", "title", "url", "source", "source_id", "capture_seq")}
    return as_jobs(rows, **{**common, **columns})


def jazzhr_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    rows = _with_details(policy_links(anchors, POLICIES["jazzhr"]), facts)
    return _base(
        rows, title=first_non_empty(_c("heading"), _c("title")), description=_c("text"),
        location=strip(F.regexp_extract("text", JAZZHR_LOCATION, 1)))


def ultipro_jobs(anchors: DataFrame, facts: DataFrame, min_label: int = ULTIPRO_MIN_LABEL) -> DataFrame:
    """``min_label``: a link with a shorter label (an icon, an arrow) is no posting; 0 keeps all."""
    policy = replace(POLICIES["ultipro"], keep=lambda: _ultipro_keep(min_label))
    rows = _with_details(policy_links(anchors, policy), facts)
    return _base(rows, title=first_non_empty(_c("heading"), _c("title")), description=_c("text"),
                 location=strip(F.regexp_extract("text", ULTIPRO_LOCATION, 1)))


def successfactors_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    rows = _with_details(policy_links(anchors, POLICIES["successfactors"]), facts)
    by_slug = F.replace(F.try_element_at(F.split(F.rtrim(_c("url"), F.lit("/")), "/"), F.lit(-2)), F.lit("-"), F.lit(" "))
    title = F.coalesce(non_empty(_c("h1")), non_empty(_c("title")), by_slug)
    return _base(
        rows, title=title, description=_c("text"),
        location=strip(F.regexp_extract(_c("lines"), LINE_LOCATION, 1)),
        published_at=non_empty(strip(F.regexp_extract(_c("lines"), LINE_DATE, 1))))


def location_triple(text: Column) -> Column:
    """``City, Region, Country`` in free text, after an optional work type."""
    return squash_ws(F.regexp_extract(text, LOCATION_TRIPLE, 1))


def kula_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """JSON-LD of the detail page, else its heading and text; without a detail or a title there is no posting."""
    rows = _with_details(policy_links(anchors, POLICIES["kula"]), facts, "inner")
    p = _c("posting")
    own, text = p.isNotNull(), squash_ws(_c("text"))
    title = F.when(own, first_non_empty(squash_ws(p["title"]), squash_ws(_c("h1_or_h2")))).otherwise(squash_ws(_c("h1_or_h2")))
    rows = rows.withColumn("title", title).filter(_c("title") != "")
    return _base(
        rows,
        description=F.when(own, squash_ws(fragment_text(p["description"]))).otherwise(text),
        location=F.when(own, p["location"]).otherwise(location_triple(text)),
        employment_type=F.when(own, squash_ws(p["employment_type"])),
        published_at=p["date_posted"], updated_at=p["valid_through"], compensation=p["salary"])


def oracle_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """JSON-LD, else heading and text; a posting whose detail failed stays with its URL as id."""
    rows = _with_details(policy_links(anchors, POLICIES["oracle"]), facts)
    p = _c("posting")
    own, captured = p.isNotNull(), F.coalesce("captured", F.lit(False))
    return _base(
        rows,
        title=F.when(own, first_non_empty(p["title"], _c("title")))
        .when(captured, first_non_empty(_c("heading"), _c("title"))).otherwise(_c("title")),
        location=F.when(own, p["location"]),
        source_id=F.when(own, first_non_empty(p["identifier"], _c("url"))).when(captured, _c("source_id")).otherwise(_c("url")),
        description=F.when(own, fragment_text(p["description"])).otherwise(_c("text")))


def foundation_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """JSON-LD, else the main text; a detail that disappeared drops the posting."""
    rows = _with_details(policy_links(anchors, POLICIES["foundation"]), facts, "inner")
    p = _c("posting")
    own = p.isNotNull()
    by_slug = F.replace(last_path_part(_c("url")), F.lit("-"), F.lit(" "))
    return _base(
        rows,
        title=F.when(own, first_non_empty(p["title"], squash_ws(_c("h1")))).otherwise(
            F.coalesce(non_empty(squash_ws(_c("h1"))), by_slug)),
        location=F.when(own, p["location"]),
        source_id=F.when(own, first_non_empty(p["identifier"], _c("source_id"))).otherwise(_c("source_id")),
        description=F.when(own, fragment_text(p["description"])).otherwise(squash_ws(_c("main_text"))))


def first_page_errors(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Boards whose first page has no job link: an error, not an empty board."""
    boards = pages.filter(_c("page_no") == 1).select("company", "page_url").distinct()
    return boards.join(jobs.select("company").distinct(), "company", "left_anti").select(
        "company", F.concat(F.lit("No job links found at "), _c("page_url")).alias("error"))


def career_page_jobs(anchors: DataFrame, facts: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Relevant links, enriched from every captured detail page.

    ``listed`` (company, url): postings that the listing page already gave as JSON-LD.
    """
    links = policy_links(anchors, POLICIES["career_page"])
    if listed is not None:
        links = links.join(listed.select("company", "url"), ["company", "url"], "left_anti")
    rows = _with_details(links, facts)
    p, captured = _c("posting"), F.coalesce("captured", F.lit(False))
    own = p.isNotNull()
    url = F.when(own, first_non_empty(p["url"], _c("url"))).otherwise(_c("url"))
    heading = F.when(captured & has_word(_c("heading"), CAREER_TITLE), _c("heading"))
    return _base(
        rows, url=url,
        title=F.when(own, p["title"]).otherwise(F.coalesce(heading, _c("title"))),
        location=F.when(own, p["location"]),
        source_id=F.when(own, first_non_empty(p["identifier"], url)).otherwise(_c("source_id")),
        description=F.when(own, fragment_text(p["description"])).when(captured, _c("text")))


def browser_jobs(anchors: DataFrame, facts: DataFrame) -> DataFrame:
    """Rendered-page links, enriched from every captured detail page; links without one stay for board health."""
    rows = _with_details(policy_links(anchors, POLICIES["browser_career"]), facts)
    captured = F.coalesce("captured", F.lit(False))
    title = F.when(captured & (_c("heading") != ""), _c("heading")).otherwise(_c("title"))
    rows = rows.withColumns({"title": title, "_description": F.when(captured, _c("text")).otherwise(F.lit(""))})
    place = strip(F.regexp_extract(_c("_description"), BROWSER_LOCATION, 1))
    return _base(rows.filter(~is_generic(_c("title"))), location=place, description=_c("_description"))


def browser_heading_jobs(parsed: DataFrame) -> DataFrame:
    """Headings that read like job titles, for boards that list openings without links."""
    heads = F.transform(dom.find_all("h2", "h3", "h4", "h5", "h6"),
                        lambda h: F.struct(h["seq"].alias("seq"), dom.element_text(h).alias("title")))
    rows = parsed.select("company", "page_url", "page_no", F.explode(heads).alias("h")).select(
        "company", "page_url", "page_no", "h.*")
    kept = rows.filter(
        (_c("title") != "") & has_word(_c("title"), BROWSER_HEADING) & ~is_generic(_c("title")))
    first = first_by_url(kept.withColumn("url", heading_url(_c("page_url"), _c("title"))))
    return as_jobs(
        first, company=_c("company"), title=_c("title"), url=_c("url"), source=F.lit("browser_career"),
        source_id=synthetic_id(_c("url")), capture_seq=_c("page_no").cast("bigint") * 1_000_000 + _c("seq"))


def entry_links(anchors: DataFrame, own_terms: tuple[str, ...] = (), limit: int = ENTRY_LIMIT) -> DataFrame:
    """First ``limit`` distinct links whose label leads to a job list, for companies without any job link."""
    label = _c("label")
    match = has_word(label, ENTRY_TEXT)
    for term in own_terms:
        match = match | F.lower(label).contains(term.lower())
    # Null flags (a link that could not be resolved) count as no.
    flagged = compute_once(anchors.select("company", "page_url", "href", "link", "label", "page_no", "seq"), {
        "is_job": F.coalesce(_browser_keep(), F.lit(False)),
        "is_entry": F.coalesce((_c("href") != "") & match & ~is_generic(label), F.lit(False))})
    # One pass: job links sort first, so a company that has any shows it among its first rows. One of them says it all.
    entry = lambda name: F.when(~_c("is_job"), _c(name))
    first = first_by_url(flagged.filter(_c("is_job") | _c("is_entry")).select(
        "company", entry("link").alias("url"), entry("label").alias("label"), "page_no", "seq", "is_job"), "company", "url", "is_job")
    by_company = Window.partitionBy("company")
    rank = F.row_number().over(by_company.orderBy(F.desc("is_job"), "page_no", "seq"))
    top = first.withColumn("rank", rank).filter(_c("rank") <= limit)
    return top.withColumn("_jobs", F.max("is_job").over(by_company)).filter(~_c("_jobs")).drop("_jobs", "is_job")


def external_links(anchors: DataFrame, limit: int = EXTERNAL_LIMIT) -> DataFrame:
    """Per company, the first ``limit`` labelled links to other hosts as ``label -> url``."""
    host = url_host(_c("link"))
    outside = anchors.filter(
        (host != "") & (host != url_host(_c("page_url"))) & (_c("label") != ""))
    rank = F.row_number().over(Window.partitionBy("company").orderBy("page_no", "seq"))
    top = outside.select("company", "page_no", "seq", "label", "link").withColumn("rank", rank).filter(_c("rank") <= limit)
    entry = F.struct("rank", F.concat(_c("label"), F.lit(" -> "), _c("link")).alias("text"))
    # At most `limit` entries per company reach the list.
    return top.groupBy("company").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), " || ").alias("external_links"))


def embedded_boards(parsed: DataFrame) -> DataFrame:
    """Job links and embedded boards (anchors and frames) of a server page."""
    targets = F.filter("elements", lambda e: e["tag"].isin("a", "iframe") & (F.coalesce(
        non_empty(F.coalesce(dom.attr(e, "href"), F.lit(""))), dom.attr(e, "src"), F.lit("")) != ""))
    rows = parsed.select("company", "page_url", "page_no", F.explode(F.transform(targets, lambda e: F.struct(
        e["seq"].alias("seq"), e["tag"].alias("tag"), e["link"].alias("link"),
        F.when(e["tag"] == "a", dom.element_text(e)).otherwise(F.lit("Embedded job board")).alias("label"))
    )).alias("t")).select("company", "page_url", "page_no", "t.*")
    # A frame's stand-in label is generic itself, so frames are judged by host alone.
    job = likely_job_link(_c("link"), _c("label"), _c("page_url")) | contains_any(url_host(_c("link")), BROWSER_HOSTS)
    kept = rows.filter(job & ~is_generic(_c("label")))
    first = first_by_url(kept.withColumn("url", _c("link")))
    return first.withColumn("title", F.coalesce(non_empty(_c("label")), F.lit("Job opening")))


# ---- platforms that read the surroundings of a link ----------------------------------------------------------

def hologic_jobs(parsed: DataFrame) -> DataFrame:
    """"View details" links: title from the enclosing box or the heading before, location from the box's rest.

    A page without such a link falls back to headings followed by a details link.
    """
    def without(text: Column, part: Column) -> Column:
        at = F.instr(text, part)
        rest = F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(part)))
        return F.when((at > 0) & (part != ""), rest).otherwise(text)

    def boxed(a: Column, lists: Column) -> Column:
        box = dom.element(a["box"])
        facts = F.struct(
            dom.element_text(a).alias("label"), F.coalesce(dom.element_text(box), F.lit("")).alias("text"),
            F.coalesce(let(box, lambda x: dom.element_text(dom.first_of(dom.inside(x, lists["heads"])))), F.lit("")).alias("inner"),
            F.coalesce(dom.element_text(dom.heading_before(a, "h2", "h3", "h4", "h5")), F.lit("")).alias("before"))
        return let(facts, lambda f: F.struct(
            a["seq"].alias("seq"), a["link"].alias("url"), first_non_empty(f["inner"], f["before"]).alias("title"),
            F.when(f["inner"] != "", strip(without(without(f["text"], f["inner"]), f["label"])))
            .otherwise(F.lit("")).alias("location")))

    def loose(h: Column, lists: Column) -> Column:
        after = let(dom.link_after(h), lambda a: F.struct(
            a["link"].alias("link"), F.lower(dom.element_text(a)).contains("detail").alias("leads")))
        return let(after, lambda a: F.struct(
            h["seq"].alias("seq"), F.when(a["leads"], a["link"]).alias("url"), dom.element_text(h).alias("title"),
            F.lit("").alias("location")))

    details = F.filter(dom.anchor_elements(), lambda a: F.lower(dom.element_text(a)).contains("view detail"))
    primary = F.filter(
        dom.describe_each(details, {"heads": dom.find_all("h2", "h3", "h4", "h5")}, boxed), lambda j: j["title"] != "")
    second = F.filter(
        dom.describe_each(dom.find_all("h3", "h4"), {}, loose),
        lambda j: (j["title"] != "") & j["url"].isNotNull())
    jobs = let(primary, lambda found: F.when(F.size(found) > 0, found).otherwise(second))
    rows = parsed.select("company", "page_no", F.explode(jobs).alias("j")).select("company", "page_no", "j.*")
    first = first_by_url(rows)
    return as_jobs(
        first, company=_c("company"), title=_c("title"), location=_c("location"), url=_c("url"), source=F.lit("hologic"),
        source_id=synthetic_id(_c("url")), capture_seq=_c("page_no").cast("bigint") * 1_000_000 + _c("seq"))


def indigo_jobs(parsed: DataFrame, facts: DataFrame) -> DataFrame:
    """Application links; an empty or generic label takes the first heading inside the nearest of six ancestors."""
    def around(e: Column, lists: Column) -> Column:
        start = F.struct(e["parent"].alias("seq"), F.lit("").alias("title"))

        def climb(state: Column, _: Column) -> Column:
            return let(dom.element(state["seq"]), lambda outer: F.struct(
                F.coalesce(outer["parent"], F.lit(0)).alias("seq"),
                F.when(state["title"] != "", state["title"]).otherwise(F.coalesce(
                    dom.element_text(dom.first_of(dom.inside(outer, lists["heads"]))), F.lit(""))).alias("title")))

        return F.aggregate(F.sequence(F.lit(1), F.lit(INDIGO_LEVELS)), start, climb)["title"]

    anchors = dom.page_links(
        parsed, ["company", "page_url", "page_no"], {"heads": dom.find_all("h2", "h3", "h4", "h5", "h6")}, around=around)
    kept = anchors.filter(_c("link").rlike(INDIGO_JOB)).withColumn("url", _c("link"))
    generic = (_c("label") == "") | F.lower("label").isin(*INDIGO_NOT_TITLE)
    kept = kept.withColumn("title", F.when(generic, first_non_empty(_c("around"), _c("label"))).otherwise(_c("label")))
    # The detail's heading is the same for all copies of a link, so copies collapse before the one join:
    # the first copy counts when the detail has a heading, else the first copy with a title of its own.
    order = F.struct("page_no", "seq")
    titled = F.when(_c("title") != "", order)
    links = kept.groupBy("company", "url").agg(
        F.min(order).alias("first"), F.min(titled).alias("first_titled"), F.min_by("title", titled).alias("title"))
    rows = _with_details(links, facts)
    headed = F.coalesce("heading", F.lit("")) != ""
    rows = rows.withColumns({
        "title": first_non_empty(_c("heading"), F.coalesce("title", F.lit(""))),
        "at": F.when(headed, _c("first")).otherwise(_c("first_titled"))}).filter(_c("title") != "")
    return as_jobs(
        rows, company=_c("company"), title=_c("title"), url=_c("url"), source=F.lit("indigo_ag"),
        source_id=synthetic_id(_c("url")), description=_c("text"),
        capture_seq=_c("at.page_no").cast("bigint") * 1_000_000 + _c("at.seq"))


def adaptive_jobs(parsed: DataFrame, site: str, min_card: int = ADAPTIVE_MIN_CARD,
                  chrome_card: int = ADAPTIVE_CHROME_CARD) -> DataFrame:
    """JSON-LD postings of a rendered page; a page without any falls back to the cards around job links.

    ``min_card``: a card with a shorter text is empty and no posting (0 keeps all). ``chrome_card``: a link with a navigation
    label is navigation if its card is shorter than this, and a posting's own link otherwise (0 keeps all).
    """
    def structured(p: Column, pos: Column) -> Column:
        return F.struct(
            pos.alias("seq"), pos.alias("copy"), squash_ws(p["title"]).alias("title"), p["url"].alias("url"),
            p["location"].alias("location"), squash_ws(fragment_text(p["description"])).alias("description"),
            first_non_empty(p["identifier"], last_path_part(p["url"])).alias("source_id"),
            squash_ws(p["employment_type"]).alias("employment_type"), F.lit(False).alias("chrome"))

    def absolute(href: Column) -> Column:
        return F.when(href.startswith("http"), href).when(href.startswith("/"), F.concat(F.lit(site), href)).otherwise(
            F.concat(F.lit(site + "/"), href))

    def card(a: Column, lists: Column) -> Column:
        box = F.coalesce(dom.element(a["box"]), a)
        facts = F.struct(
            absolute(dom.attr(a, "href")).alias("url"), squash_ws(dom.element_text(a)).alias("label"),
            squash_ws(dom.element_text(box)).alias("text"),
            let(box, lambda x: dom.element_text(dom.first_of(dom.inside(x, lists["heads"])))).alias("head"))
        return let(facts, lambda f: F.struct(
            a["seq"].alias("seq"), F.lit(-1).alias("copy"),
            F.when(f["head"].isNotNull(), squash_ws(f["head"])).otherwise(f["label"]).alias("title"), f["url"].alias("url"),
            F.lit("").alias("location"), f["text"].alias("description"),
            first_non_empty(last_path_part(f["url"]), f["head"]).alias("source_id"), F.lit("").alias("employment_type"),
            (F.lower(f["label"]).isin(*ADAPTIVE_CHROME) & (F.length(f["text"]) < chrome_card)).alias("chrome")))

    anchors = F.filter(dom.anchor_elements(), lambda a: contains_any(dom.attr(a, "href"), ADAPTIVE_HREF))
    cards = F.filter(
        dom.describe_each(anchors, {"heads": dom.find_all("h1", "h2", "h3", "h4")}, card),
        lambda j: (F.length(j["description"]) >= min_card) & ~j["chrome"] & (j["title"] != "")
        & ~F.lower(j["title"]).isin(*ADAPTIVE_NOT_TITLE))
    postings = F.filter(
        F.transform(F.transform(jsonld.page_postings(True), jsonld.posting_struct), structured),
        lambda j: (j["title"] != "") & (j["url"] != ""))
    jobs = let(postings, lambda found: F.when(F.size(found) > 0, found).otherwise(cards))
    rows = parsed.select("company", "page_no", F.explode(jobs).alias("j")).select("company", "page_no", "j.*")
    # Cards with the same title and URL are one posting; postings given as data are kept as they are.
    first = first_by_url(rows.withColumn("copy", F.when(_c("copy") >= 0, F.struct("page_no", "seq"))),
                         "company", "title", "url", "copy")
    return as_jobs(
        first, company=_c("company"), title=_c("title"), location=_c("location"), url=_c("url"), source=F.lit("adaptive"),
        source_id=_c("source_id"), description=_c("description"), employment_type=_c("employment_type"),
        capture_seq=_c("page_no").cast("bigint") * 1_000_000 + _c("seq"))


def eligo_jobs(parsed: DataFrame) -> DataFrame:
    """Headings after "Current job openings" with a details link or a full-time line, then board links."""
    def describe(h: Column, lists: Column) -> Column:
        """A heading with the text and the details link up to the next heading beside it."""
        stop = dom.first_of(F.filter(
            lists["heads"], lambda x: (x["parent"] == h["parent"]) & (x["seq"] > h["last"])))
        return let(F.struct(stop.alias("stop"), dom.element(h["parent"]).alias("parent"),
                            dom.link_after(h).alias("after")), lambda s: section(h, s, lists))

    def section(h: Column, s: Column, lists: Column) -> Column:
        end = F.coalesce(s["stop"]["seq"] - 1, s["parent"]["last"], F.size("elements"))
        text_end = F.coalesce(s["stop"]["text_from"], s["parent"]["text_to"], F.size("texts"))
        siblings = F.filter(F.slice("elements", h["last"] + 1, F.greatest(end - h["last"], F.lit(0))),
                            lambda x: x["parent"] == h["parent"])
        found = F.transform(siblings, lambda x: dom.first_of(dom.inside(x, lists["anchors"])))
        details = F.filter(found, lambda a: F.lower(dom.element_text(a)).contains("detail"))
        after = F.when(F.lower(dom.element_text(s["after"])).contains("detail"), s["after"]["link"])
        nearby = F.slice(F.col("texts"), h["text_to"] + 1, F.greatest(text_end - h["text_to"], F.lit(0)))
        return F.struct(
            h["seq"].alias("seq"), dom.element_text(h).alias("title"), F.array_join(nearby, " ").alias("nearby"),
            F.coalesce(dom.last_of(details)["link"], after).alias("detail"))

    marker = dom.first_of(F.filter(
        dom.find_all("h1", "h2", "h3"), lambda h: F.lower(dom.element_text(h)).contains("current job openings")))
    heads = dom.find_all("h2", "h3")
    listed = let(marker, lambda m: F.filter(heads, lambda h: h["seq"] > m["seq"]))
    found = dom.describe_each(listed, {"heads": heads, "anchors": dom.anchor_elements()}, describe)
    named = F.transform(
        F.filter(found, lambda h: (h["title"] != "") & ~F.lower(h["title"]).isin(*ELIGO_SECTIONS)
                 & (h["detail"].isNotNull() | F.lower(h["nearby"]).contains("full time"))),
        lambda h: F.struct(
            h["seq"].alias("seq"), h["title"].alias("title"),
            F.coalesce(h["detail"], heading_url(_c("page_url"), h["title"])).alias("url"),
            F.when(F.lower(h["nearby"]).contains("paris"), F.lit("Paris")).otherwise(F.lit("")).alias("location")))

    def on_board(a: Column, lists: Column) -> Column:
        before = dom.heading_before(a, "h2", "h3")
        title = F.when(before.isNotNull(), dom.element_text(before)).otherwise(dom.element_text(a))
        # Links of the job board come after all headings.
        return F.struct((a["seq"] + 1_000_000).alias("seq"), title.alias("title"), a["link"].alias("url"), F.lit("Paris").alias("location"))

    board = F.filter(
        dom.describe_each(F.filter(dom.anchor_elements(), lambda a: a["link"].contains("breezy.hr")), {}, on_board),
        lambda j: (j["title"] != "") & ~F.lower(j["title"]).isin(*ELIGO_SECTIONS))
    none = F.array().cast("array<struct<seq:int,title:string,url:string,location:string>>")
    jobs = F.concat(F.coalesce(named, none), board)
    rows = parsed.select("company", "page_no", F.explode(jobs).alias("j")).select("company", "page_no", "j.*")
    first = first_by_url(rows)
    return as_jobs(
        first, company=_c("company"), title=_c("title"), location=_c("location"), url=_c("url"), source=F.lit("eligo"),
        source_id=synthetic_id(_c("url")), capture_seq=_c("page_no").cast("bigint") * 10_000_000 + _c("seq"))

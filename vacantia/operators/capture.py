"""Which captures count: first copies, page gaps, variants, detail candidates, board identities, seeds, link closure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from vacantia.functions.location import normalize_location, slug_title
from vacantia.functions.text import first_non_empty, fragment_text, non_empty, url_host, url_path
from vacantia.session import cut_lineage

# Titles worth a detail capture unless a company names its own terms.
DETAIL_TITLE_TERMS = (
    "bioinform", "computational", "genom", "genetic", "omics", "biomarker",
    "data scientist", "data science", "informatics", "algorithm", "machine learning",
    "applications scientist", "application scientist", "product owner", "scientific software",
    "systems biology", "biostat", "quantitative biology", "precision medicine",
)
ROUNDS_PER_FOLD = 10
SEED_ID = r"(?i)_((?:R|JR)\d+[A-Za-z0-9-]*)"
BOARD_IDENTITY = r"""wday/cxs/([^/"']+)/([^/"'?]+)"""


def last_capture(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key: the one captured last where captures have a time (``captured_at``), else the greatest.

    Bodies are wide, so they are not aggregated: rows are ranked, each task passes on its best row per key, and only those are
    shuffled. A key that fills a third of the input costs one row a task. Bodies are compared where times are equal only.
    """
    order = [c for c in ("captured_at",) if c in rows.columns] + [c for c in rows.columns if c not in ("captured_at", *keys)]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order]))
    return rows.withColumn("_place", place).filter(F.col("_place") == 1).drop("_place")


def title_is_candidate(title: Column, own_terms: Column | None = None,
                       terms: Sequence[str] = DETAIL_TITLE_TERMS) -> Column:
    """The lower-cased title contains one of the terms; a company's own list replaces the default."""
    default = F.array(*[F.lit(t) for t in terms])
    wanted = default if own_terms is None else F.when(F.size(own_terms) > 0, own_terms).otherwise(default)
    return F.exists(wanted, lambda term: F.lower(title).contains(F.lower(term)))


def enrich_candidates(listings: DataFrame, own_terms: str | None = None,
                      terms: Sequence[str] = DETAIL_TITLE_TERMS) -> DataFrame:
    """All listings whose title is worth a detail capture."""
    return listings.filter(title_is_candidate(F.col("title"), F.col(own_terms) if own_terms else None, terms))


def first_nonempty_variant(captures: DataFrame, filled: Column | None = None) -> DataFrame:
    """Rows of each company's first variant (lowest ``variant_rank``) that has any row, or any row that is ``filled``."""
    best = (captures if filled is None else captures.filter(filled)).groupBy("company").agg(F.min("variant_rank").alias("variant_rank"))
    return captures.join(best, ["company", "variant_rank"], "left_semi")


def discover_boards(pages: DataFrame) -> DataFrame:
    """(tenant, board) pairs named in each company's pages, at the position of their first mention."""
    text = F.col("html")
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, F.lit(BOARD_IDENTITY), F.lit(1)).alias("tenant"),
        F.regexp_extract_all(text, F.lit(BOARD_IDENTITY), F.lit(2)).alias("board"),
    )
    named = pages.select("company", "page_id", F.posexplode(pairs).alias("pos", "pair"))
    return named.groupBy("company", F.col("pair.tenant").alias("tenant"), F.col("pair.board").alias("board")).agg(
        F.min(F.struct("page_id", "pos")).alias("_first")
    ).select("company", "tenant", "board", F.col("_first.page_id").alias("page_id"), F.col("_first.pos").alias("pos"))


def first_copies(listings: DataFrame) -> DataFrame:
    """First copy of each listing over all captured pages of its board.

    ``listings`` has company, page_no, pos, listing_key and no long texts. They are shuffled once, by their own key,
    after a map-side combine, so one huge board is no hot spot.
    """
    first = F.min_by(F.struct(*listings.columns), F.struct("page_no", "pos")).alias("_first")
    return listings.groupBy("company", "listing_key").agg(first).select("_first.*")


def page_gaps(pages: DataFrame) -> DataFrame:
    """Boards whose captured pages have a hole: a missing number, or an empty page before the last one.

    ``pages`` (company, page_no, n_rows) lists every captured page, empty ones too. The result counts the
    missing and the empty pages between a board's first and last page.
    """
    per_page = pages.groupBy("company", "page_no").agg(F.max("n_rows").alias("n_rows"))
    per_board = per_page.groupBy("company").agg(
        F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"), F.count("*").alias("captured"),
        F.count_if(F.col("n_rows") == 0).alias("_empty"), F.max_by("n_rows", "page_no").alias("_last_rows"))
    holes = per_board.select(
        "company", "first_page", "last_page",
        (F.col("last_page") - F.col("first_page") + 1 - F.col("captured")).alias("missing_pages"),
        # An empty last page is how a board ends.
        (F.col("_empty") - F.when(F.col("_last_rows") == 0, F.lit(1)).otherwise(F.lit(0))).alias("empty_pages"))
    return holes.filter((F.col("missing_pages") > 0) | (F.col("empty_pages") > 0))


def seed_rows(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Postings from configured job URLs whose page was captured.

    ``seeds``: company, seq, url, title, location, description. ``pages``: url, heading and the first
    JSON-LD posting as ``posting`` (see ``operators.jsonld``), null without one. The page wins over
    the seed; the id comes from the page, else from the URL; the first seed of an id wins.
    """
    df = seeds.join(pages.select("url", "heading", "posting"), "url")
    title = first_non_empty(
        F.trim(first_non_empty(F.col("posting.title"), F.col("title"))), F.coalesce("heading", slug_title(F.col("url"))))
    description = fragment_text(first_non_empty(F.col("posting.description"), F.col("description")))
    df = df.withColumns({"_title": title, "_description": description})
    place = first_non_empty(F.col("posting.location"), F.col("location"))
    from_url = F.regexp_extract(F.col("url"), SEED_ID, 1)
    df = df.withColumns({
        "_location": normalize_location(place, url_path(F.col("url")), F.col("_description")),
        "source_id": F.coalesce(non_empty(F.col("posting.identifier")), non_empty(from_url), F.col("url")),
    })
    rows = df.filter((F.col("_title") != "") & F.col("url").contains("/job/")).select(
        "company", "seq", "url", "source_id", F.lit("workday-public").alias("source"),
        F.col("_title").alias("title"), F.col("_location").alias("location"), F.col("_description").alias("description"))
    first = rows.groupBy("company", "source_id").agg(F.min_by(F.struct(*rows.columns), F.col("seq")).alias("_first"))
    return first.select("_first.*")


def link_closure(seeds: DataFrame, links: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """All captured pages that the seeds reach over links, with the ``round`` (number of links) that reaches them first.

    ``seeds`` (company, url) and ``links`` (company, from_url, to_url) are tables of captured pages; links are already
    restricted to the same host and to job pages. Each round is one join of the new frontier with the links and one anti
    join; it is checkpointed, so neither the plan nor a lost executor makes the work grow. The search ends when a round
    reaches nothing new; with ``max_rounds`` it raises if there is more to reach.
    """
    links = links.select("company", F.col("from_url").alias("url"), "to_url").distinct()
    frontier = cut_lineage(seeds.select("company", "url").distinct().withColumn("round", F.lit(0)))
    visited, round_no = frontier, 0
    while not frontier.isEmpty():
        round_no += 1
        reached = frontier.join(links, ["company", "url"]).select("company", F.col("to_url").alias("url")).distinct()
        frontier = cut_lineage(reached.join(visited, ["company", "url"], "left_anti").withColumn("round", F.lit(round_no)))
        if max_rounds is not None and round_no > max_rounds and not frontier.isEmpty():
            raise RuntimeError(f"pages are left to reach after {max_rounds} rounds")
        # A union of checkpointed rounds, folded into one table now and then so that the plan stays small.
        visited = visited.unionByName(frontier)
        if round_no % ROUNDS_PER_FOLD == 0:
            visited = cut_lineage(visited)
    return visited


def same_host_job_links(anchors: DataFrame) -> DataFrame:
    """Links between job pages of one host, from page anchors (company, page_url, seq, link)."""
    same = url_host(F.col("page_url")) == url_host(F.col("link"))
    return anchors.filter(same & F.col("link").contains("/job/")).select(
        "company", F.col("page_url").alias("from_url"), F.col("link").alias("to_url"), "seq")

"""Board payloads: parts (and line items) as captured JSON of each platform, normalized to postings.

The payload is built from the flat table, at most 500 postings a page, then parsed by the normalizer; the
SQL twin computes the postings from the flat table without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


from vacantia.operators import boards, capture, dom, jsonld
from vacantia.plans.catalog import Inputs, job_columns, query, view
from vacantia.schemas import JOB_FIELDS

PAGE_KEYS = 500

view("items", """
    SELECT p_partkey AS k, p_brand AS company, lower(replace(p_brand, '#', '')) AS board, CAST(floor(p_partkey / 500) AS BIGINT) AS page_no,
           concat(p_name, CASE p_partkey % 5 WHEN 0 THEN ' Scientist' WHEN 1 THEN ' Data Scientist' WHEN 2 THEN ' Accountant'
                               WHEN 3 THEN ' Genomics Manager' ELSE ' Clerk' END) AS title,
           p_name AS name, p_type AS kind, p_size AS size, concat(p_type, ' City') AS city, CAST(p_partkey AS STRING) AS id,
           concat('https://jobs.example.com/', CAST(p_partkey AS STRING)) AS url,
           concat('2024-01-', lpad(CAST(p_size % 28 + 1 AS STRING), 2, '0')) AS day,
           CAST(floor(p_retailprice) AS BIGINT) * 100 AS low, CAST(floor(p_retailprice) AS BIGINT) * 130 AS high
    FROM {part}""")
view("item_text", """
    SELECT *, concat('<div><p>', kind, ' work &amp; ', name, '</p><script>x()</script><p> size ', CAST(size AS STRING), ' </p></div>') AS html,
           concat(kind, ' work & ', name, ' size ', CAST(size AS STRING)) AS plain FROM {items}""")


def _captures(inputs: Inputs, platform: str, item: Column, key: str | None, bare: Column | None = None) -> DataFrame:
    """Captured pages of a platform; pages for which ``bare`` holds are lists without an enclosing object."""
    rows = inputs["item_text"].select("company", "board", "page_no", "k", F.to_json(item).alias("json"))
    pages = rows.groupBy("company", "board", "page_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "json"))), lambda r: r["json"]), ",").alias("list"))
    listed = F.concat(F.lit("["), "list", F.lit("]"))
    body = listed if key is None else F.concat(F.lit(f'{{"{key}":'), listed, F.lit(',"total":0}'))
    if bare is not None:
        body = F.when(bare, listed).otherwise(body)
    return pages.select("company", "board", "page_no", F.lit(platform).alias("platform"), body.alias("body"))


def _jobs(df: DataFrame) -> DataFrame:
    return df.select(*JOB_FIELDS)


def _k() -> Column:
    return F.col("k")


def greenhouse_captures(inputs: Inputs) -> DataFrame:
    pay = F.concat(F.lit("<div class='content-pay-transparency'><div class='pay-range'><span>$"), F.col("low").cast("string"),
                   F.lit("</span><span>&mdash;</span><span>$"), F.col("high").cast("string"), F.lit("</span></div></div>"))
    content = F.concat("html", F.when(_k() % 4 == 0, pay).otherwise(F.lit("")))
    departments = F.array(
        F.struct(F.col("kind").alias("name")), F.struct(F.concat(F.lit("Unit "), F.col("size").cast("string")).alias("name")))
    return _captures(inputs, "greenhouse", F.struct(
        _k().alias("id"), "title", content.alias("content"), departments.alias("departments"),
        F.when(_k() % 3 != 0, F.struct(F.col("city").alias("name"))).alias("location"),
        F.col("url").alias("absolute_url"), F.col("day").alias("updated_at")), "jobs")


_GREENHOUSE = job_columns(
    company="company", title="title", location="CASE WHEN k % 3 <> 0 THEN city ELSE '' END", url="url", source="'greenhouse'",
    source_id="id", updated_at="day",
    description="concat(plain, CASE WHEN k % 4 = 0 THEN concat(' $', low, ' — $', high) ELSE '' END)",
    department="concat(kind, ', Unit ', size)", compensation="CASE WHEN k % 4 = 0 THEN concat('$', low, ' — $', high) ELSE '' END")


@query("norm_greenhouse", f"SELECT {_GREENHOUSE} FROM {{item_text}}")
def _norm_greenhouse(inputs: Inputs) -> DataFrame:
    return _jobs(boards.greenhouse(greenhouse_captures(inputs)))


def lever_captures(inputs: Inputs) -> DataFrame:
    salary = F.when(_k() % 3 != 0, F.struct(
        F.lit("USD").alias("currency"), F.col("low").alias("min"), F.col("high").alias("max"),
        F.when(_k() % 3 == 1, F.lit("per-year-salary")).alias("interval")))
    return _captures(inputs, "lever", F.struct(
        F.col("id"), F.col("title").alias("text"), F.col("url").alias("hostedUrl"),
        F.struct(F.col("city").alias("location"), F.col("kind").alias("department"), F.col("name").alias("team"),
                 F.when(_k() % 2 == 0, F.lit("Full-time")).alias("commitment")).alias("categories"),
        F.col("plain").alias("descriptionPlain"), F.when(_k() % 2 == 0, F.lit("")).otherwise(F.lit("More")).alias("additionalPlain"),
        F.lit("remote").alias("workplaceType"), salary.alias("salaryRange")), None)


_LEVER = job_columns(
    company="company", title="title", location="city", url="url", source="'lever'", source_id="id",
    description="CASE WHEN k % 2 = 0 THEN plain ELSE concat(plain, chr(10), 'More') END", department="kind", team="name",
    workplace_type="'remote'", employment_type="CASE WHEN k % 2 = 0 THEN 'Full-time' ELSE '' END",
    compensation="CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN concat('USD ', low, '-', high, ' per-year-salary') ELSE concat('USD ', low, '-', high) END")


@query("norm_lever", f"SELECT {_LEVER} FROM {{item_text}}")
def _norm_lever(inputs: Inputs) -> DataFrame:
    return _jobs(boards.lever(lever_captures(inputs)))


def ashby_captures(inputs: Inputs) -> DataFrame:
    return _captures(inputs, "ashby", F.struct(
        F.when(_k() % 4 != 0, F.col("id")).otherwise(F.lit("")).alias("id"), "title", F.col("city").alias("location"),
        F.col("url").alias("jobUrl"), F.when(_k() % 3 == 0, F.lit(False)).when(_k() % 3 == 1, F.lit(True)).alias("isListed"),
        F.col("plain").alias("descriptionPlain"), F.col("kind").alias("department"), F.col("name").alias("team"),
        F.when(_k() % 2 == 0, F.lit("FullTime")).alias("employmentType"), F.col("day").alias("publishedAt"),
        F.struct(F.concat(F.lit("$"), F.col("low").cast("string"), F.lit(" - $"), F.col("high").cast("string")).alias(
            "compensationTierSummary")).alias("compensation")), "jobs")


_ASHBY = job_columns(
    company="company", title="title", location="city", url="url", source="'ashby'", source_id="CASE WHEN k % 4 <> 0 THEN id ELSE url END",
    description="plain", department="kind", team="name", employment_type="CASE WHEN k % 2 = 0 THEN 'FullTime' ELSE '' END",
    published_at="day", compensation="concat('$', low, ' - $', high)")


@query("norm_ashby", f"SELECT {_ASHBY} FROM {{item_text}} WHERE k % 3 <> 0")
def _norm_ashby(inputs: Inputs) -> DataFrame:
    return _jobs(boards.ashby(ashby_captures(inputs)))


def _mixed_place(as_json: bool = True) -> Column:
    """Location as text, object or list, by key."""
    return F.when(_k() % 3 == 0, F.to_json(F.array(
        F.struct(F.col("city").alias("name")), F.struct(F.lit("Remote - US").alias("name"))))).when(
        _k() % 3 == 1, F.to_json(F.struct(F.col("city").alias("display_name")))).otherwise(
        F.concat(F.lit('"'), F.col("city"), F.lit('"')))


def _with_raw(item: Column, **raw: Column) -> Column:
    """A VARIANT object from a struct and JSON fragments."""
    text = F.to_json(item)
    for name, fragment in raw.items():
        text = F.concat(F.substr(text, F.lit(1), F.length(text) - 1), F.lit(f',"{name}":'), fragment, F.lit("}"))
    return F.parse_json(text)


def gem_captures(inputs: Inputs) -> DataFrame:
    item = F.struct(
        F.when(_k() % 2 == 0, _k()).alias("id"), F.when(_k() % 2 == 1, _k()).alias("job_post_id"), "title",
        F.when(_k() % 4 == 0, F.col("url")).alias("job_post_url"), F.when(_k() % 4 != 0, F.col("url")).alias("apply_url"),
        F.lit("").alias("description"), F.col("plain").alias("description_plain"),
        F.when(_k() % 5 == 0, F.lit("hybrid")).alias("location_type"), F.lit("full_time").alias("employment_type"))
    department = F.when(_k() % 2 == 0, F.to_json(F.struct(F.col("kind").alias("name")))).otherwise(
        F.concat(F.lit('"'), F.col("kind"), F.lit('"')))
    return _captures(inputs, "gem", _with_raw(item, locations=_mixed_place(), department=department), "job_posts", F.col("page_no") % 2 == 1)


_GEM = job_columns(
    company="company", title="title", location="CASE WHEN k % 3 = 0 THEN concat(city, '; Remote - US') ELSE city END", url="url",
    source="'gem'", source_id="id", description="plain", department="kind",
    workplace_type="CASE WHEN k % 5 = 0 THEN 'hybrid' ELSE '' END", employment_type="'full_time'")


@query("norm_gem", f"SELECT {_GEM} FROM {{item_text}}")
def _norm_gem(inputs: Inputs) -> DataFrame:
    return _jobs(boards.gem(gem_captures(inputs)))


def recruitee_captures(inputs: Inputs) -> DataFrame:
    return _captures(inputs, "recruitee", F.struct(
        F.when(_k() % 2 == 0, _k()).alias("id"), F.concat(F.lit("slug-"), F.col("id")).alias("slug"), "title",
        F.when(_k() % 4 == 0, F.lit("draft")).when(_k() % 4 == 1, F.lit("published")).alias("status"),
        F.array(F.struct(F.col("city").alias("name")), F.struct(F.lit("Helsinki").alias("name"))).alias("locations"),
        F.when(_k() % 3 == 0, F.col("url")).alias("careers_url"), F.col("html").alias("description"),
        F.col("kind").alias("department"), F.lit("fulltime").alias("employment_type")), "offers", F.col("page_no") % 2 == 1)


_RECRUITEE = job_columns(
    company="company", title="title", location="concat(city, '; Helsinki')",
    url="CASE WHEN k % 3 = 0 THEN url ELSE concat('https://', board, '.recruitee.com/o/slug-', id) END", source="'recruitee'",
    source_id="CASE WHEN k % 2 = 0 THEN id ELSE concat('slug-', id) END", description="plain", department="kind",
    employment_type="'fulltime'")


@query("norm_recruitee", f"SELECT {_RECRUITEE} FROM {{item_text}} WHERE k % 4 <> 0")
def _norm_recruitee(inputs: Inputs) -> DataFrame:
    return _jobs(boards.recruitee(recruitee_captures(inputs)))


def smartrecruiters_captures(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    """Listing pages and the details of two thirds of the postings."""
    place = F.struct(F.col("city").alias("city"), F.lit("").alias("region"), F.lit("us").alias("country"))
    listing = _captures(inputs, "smartrecruiters", F.struct(
        F.concat(F.lit("u-"), F.col("id")).alias("uuid"), F.col("title").alias("name"), place.alias("location"),
        F.concat(F.lit("https://api.example.com/"), F.col("id")).alias("ref"), F.col("day").alias("releasedDate"),
        F.struct(F.col("kind").alias("label")).alias("department")), "content")
    section = F.struct
    detail = F.struct(
        F.concat(F.col("title"), F.lit(" II")).alias("name"), F.col("url").alias("applyUrl"),
        F.struct(F.lit("Oslo").alias("city"), F.col("kind").alias("region"), F.lit("no").alias("country")).alias("location"),
        F.struct(F.lit("Permanent").alias("label")).alias("typeOfEmployment"),
        F.struct(F.struct(
            section(F.col("html").alias("text")).alias("jobDescription"),
            section(F.lit("About us").alias("title")).alias("companyDescription")).alias("sections")).alias("jobAd"))
    details = inputs["item_text"].filter(_k() % 3 != 0).select(
        "company", F.concat(F.lit("u-"), F.col("id")).alias("pid"), F.to_json(detail).alias("body"))
    return listing, details


_SMART = job_columns(
    company="company", title="CASE WHEN k % 3 <> 0 THEN concat(title, ' II') ELSE title END",
    location="CASE WHEN k % 3 <> 0 THEN concat('Oslo, ', kind, ', no') ELSE concat(city, ', us') END",
    url="CASE WHEN k % 3 <> 0 THEN url ELSE concat('https://api.example.com/', id) END", source="'smartrecruiters'",
    source_id="concat('u-', id)", description="CASE WHEN k % 3 <> 0 THEN concat(plain, ' About us') ELSE '' END", department="kind",
    employment_type="CASE WHEN k % 3 <> 0 THEN 'Permanent' ELSE '' END", published_at="day")


@query("norm_smartrecruiters", f"SELECT {_SMART} FROM {{item_text}}")
def _norm_smartrecruiters(inputs: Inputs) -> DataFrame:
    return _jobs(boards.smartrecruiters(*smartrecruiters_captures(inputs)))


# Workday: every fifth posting is listed twice, the copy on a later page.
view("workday_items", """
    SELECT *, page_no AS at_page, 0 AS copy FROM {item_text}
    UNION ALL SELECT *, page_no + 1000, 1 FROM {item_text} WHERE k % 5 = 0""")


def workday_captures(inputs: Inputs) -> tuple[DataFrame, DataFrame]:
    path = F.concat(F.lit("/job/US---CA---"), F.col("kind"), F.lit("/"), F.col("id"))
    item = F.struct(
        "title", F.when(_k() % 7 != 6, path).alias("externalPath"),
        F.when(_k() % 4 == 0, F.lit("5")).otherwise(F.col("city")).alias("locationsText"),
        F.lit("Posted 2 Days Ago").alias("postedOn"),
        F.when(_k() % 2 == 0, F.array(F.concat(F.lit("R-"), F.col("id")))).alias("bulletFields"))
    rows = inputs["workday_items"].select("company", "at_page", "k", F.to_json(item).alias("json"))
    pages = rows.groupBy("company", "at_page").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "json"))), lambda r: r["json"]), ",").alias("list"))
    listing = pages.select(
        "company", F.col("at_page").alias("page_no"), F.lit("workday").alias("platform"),
        F.lit("https://wd.example.com/en-US/board").alias("public_base"),
        F.concat(F.lit('{"total":40,"jobPostings":['), "list", F.lit("]}")).alias("body"))
    info = F.struct(
        F.concat(F.lit("JR"), F.col("id")).alias("jobReqId"), F.col("html").alias("jobDescription"),
        F.when(_k() % 2 == 0, F.lit("Full time")).alias("timeType"), F.col("day").alias("startDate"),
        F.struct(F.lit("USD").alias("currency"), F.col("low").alias("min"), F.col("high").alias("max")).alias("salary"))
    body = F.when(_k() % 2 == 0, F.to_json(F.struct(info.alias("jobPostingInfo")))).otherwise(F.to_json(info))
    details = inputs["item_text"].filter(_k() % 3 == 0).select("company", path.alias("external_path"), body.alias("body"))
    return listing, details


# A posting without a path is told apart by title and location, so equal ones of a board collapse.
view("workday_kept", """
    SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY company, CASE WHEN k % 7 <> 6 THEN id ELSE concat(title, '|', place) END ORDER BY k) AS rn
        FROM (SELECT *, CASE WHEN k % 4 = 0 THEN '5' ELSE city END AS place,
                     CASE WHEN k % 7 <> 6 THEN concat('/job/US---CA---', kind, '/', id) ELSE '' END AS path FROM {item_text}) a) b
    WHERE rn = 1""")


def _workday_sql(has_detail: str) -> str:
    return job_columns(
        company="company", title="title",
        location="CASE WHEN k % 4 <> 0 THEN city WHEN path <> '' THEN concat('US - CA - ', kind) ELSE '5' END",
        url="concat('https://wd.example.com/en-US/board', path)", source="'workday'",
        source_id=f"CASE WHEN {has_detail} THEN concat('JR', id) WHEN k % 2 = 0 THEN concat('R-', id) ELSE path END",
        description=f"CASE WHEN {has_detail} THEN plain ELSE '' END",
        employment_type=f"CASE WHEN {has_detail} AND k % 2 = 0 THEN 'Full time' ELSE '' END",
        published_at=f"CASE WHEN {has_detail} THEN day ELSE 'Posted 2 Days Ago' END",
        compensation=f"CASE WHEN {has_detail} THEN concat('USD ', low, ' ', high) ELSE '' END",
    ).replace("ELSE '5' END", "ELSE '' END")


@query("norm_workday", f"SELECT {_workday_sql('false')} FROM {{workday_kept}}")
def _norm_workday(inputs: Inputs) -> DataFrame:
    return _jobs(boards.workday(workday_captures(inputs)[0]))


@query("workday_detail_join", f"SELECT {_workday_sql('(k % 3 = 0 AND k % 7 <> 6)')} FROM {{workday_kept}}")
def _workday_detail_join(inputs: Inputs) -> DataFrame:
    return _jobs(boards.workday(*workday_captures(inputs)))


@query("workday_pay_text", """
    SELECT k, CASE k % 4 WHEN 0 THEN concat(low, ' a year') WHEN 1 THEN concat('USD ', low, ' ', high, ' Annual')
                         WHEN 2 THEN concat('EUR ', low) ELSE '' END AS pay FROM {items}""")
def _workday_pay_text(inputs: Inputs) -> DataFrame:
    low, high = F.col("low"), F.col("high")
    info = (
        F.when(_k() % 4 == 0, F.to_json(F.struct(F.lit(" ").alias("compensation"), F.concat(F.lit(" "), low.cast("string"), F.lit(" a year ")).alias("salary"))))
        .when(_k() % 4 == 1, F.to_json(F.struct(F.struct(
            F.lit("USD").alias("currency"), low.alias("min"), high.alias("max"), F.lit("Annual").alias("interval")).alias("salaryRange"))))
        .when(_k() % 4 == 2, F.to_json(F.struct(F.struct(F.lit("").alias("currency")).alias("salary"), F.struct(
            F.lit("EUR").alias("currency"), low.alias("min")).alias("payRange"))))
        .otherwise(F.lit('{"title":"x"}'))
    )
    rows = inputs["items"].withColumn("info", boards.workday_detail_info(info))
    return rows.select("k", boards.workday_pay_text().alias("pay"))


@query("union_boards", f"""
    SELECT {_GREENHOUSE} FROM {{item_text}} UNION ALL SELECT {_LEVER} FROM {{item_text}}
    UNION ALL SELECT {_ASHBY} FROM {{item_text}} WHERE k % 3 <> 0
    UNION ALL SELECT {_GEM} FROM {{item_text}} UNION ALL SELECT {_RECRUITEE} FROM {{item_text}} WHERE k % 4 <> 0""")
def _union_boards(inputs: Inputs) -> DataFrame:
    captures = (
        greenhouse_captures(inputs).unionByName(lever_captures(inputs)).unionByName(ashby_captures(inputs))
        .unionByName(gem_captures(inputs)).unionByName(recruitee_captures(inputs))
    )
    return _jobs(boards.normalize(captures, ["greenhouse", "lever", "ashby", "gem", "recruitee"]))


# ---- which captures count ---------------------------------------------------------------------------------

@query("enrich_candidates", """
    SELECT k, company FROM {items} WHERE k % 5 IN (1, 3)""")
def _enrich_candidates(inputs: Inputs) -> DataFrame:
    return capture.enrich_candidates(inputs["items"]).select("k", "company")


# Thirty pages a board; the listing order on a page is the order of the line items.
view("board_pages", """
    SELECT DISTINCT l_suppkey AS company, concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS listing_key,
           (l_orderkey * 7 + l_linenumber * 13) % 30 AS page_no, l_orderkey * 10 + l_linenumber AS pos
    FROM {lineitem}""")
# Boards with an even key lose page 9 (empty); boards divisible by three repeat page 3 as page 4.
view("captured_pages", """
    SELECT company, CASE WHEN company % 3 = 0 AND page_no = 4 THEN concat(listing_key, 'x') ELSE listing_key END AS listing_key, page_no, pos
    FROM {board_pages} WHERE NOT (company % 2 = 0 AND page_no = 9) AND NOT (company % 3 = 0 AND page_no = 4)
    UNION ALL SELECT company, listing_key, CAST(4 AS BIGINT), pos FROM {board_pages} WHERE company % 3 = 0 AND page_no = 3""")
view("page_sizes", """
    SELECT p.company, p.page_no, count(c.listing_key) AS n_rows
    FROM (SELECT DISTINCT company, page_no FROM {board_pages}) p
    LEFT JOIN {captured_pages} c ON c.company = p.company AND c.page_no = p.page_no GROUP BY p.company, p.page_no""")


@query("first_copies", """
    SELECT company, listing_key, CAST(floor(min(page_no * 10000000000 + pos) / 10000000000) AS BIGINT) AS page_no
    FROM {captured_pages} GROUP BY company, listing_key""")
def _first_copies(inputs: Inputs) -> DataFrame:
    return capture.first_copies(inputs["captured_pages"]).select("company", "listing_key", "page_no")


# Boards divisible by four lose page 12 altogether.
@query("page_gaps", """
    SELECT company, first_page, last_page, last_page - first_page + 1 - captured AS missing_pages, empty_pages FROM (
        SELECT p.company, min(p.page_no) AS first_page, max(p.page_no) AS last_page, count(*) AS captured,
               count(CASE WHEN n_rows = 0 AND p.page_no < last THEN 1 END) AS empty_pages
        FROM {page_sizes} p JOIN (SELECT company, max(page_no) AS last FROM {page_sizes} GROUP BY company) l ON l.company = p.company
        WHERE NOT (p.company % 4 = 0 AND p.page_no = 12) GROUP BY p.company) b
    WHERE last_page - first_page + 1 > captured OR empty_pages > 0""")
def _page_gaps(inputs: Inputs) -> DataFrame:
    lost = (F.col("company") % 4 == 0) & (F.col("page_no") == 12)
    return capture.page_gaps(inputs["page_sizes"].filter(~lost))


view("variants", """
    SELECT l_suppkey AS company, l_orderkey, l_linenumber, l_linenumber AS variant_rank FROM {lineitem}
    WHERE l_linenumber >= 1 + l_suppkey % 5""")


@query("first_nonempty_variant", """
    SELECT company, l_orderkey, variant_rank FROM {variants} WHERE variant_rank = 1 + company % 5""")
def _first_nonempty_variant(inputs: Inputs) -> DataFrame:
    return capture.first_nonempty_variant(inputs["variants"]).select("company", "l_orderkey", "variant_rank")


@query("discover_boards", """
    SELECT n_name AS company, tenant, board, min(s_suppkey) AS page_id FROM (
        SELECT s_suppkey, n_name, concat('t', CAST(s_suppkey % 4 AS VARCHAR)) AS tenant, unnest(['Main', concat('B', CAST(s_suppkey % 3 AS VARCHAR))]) AS board
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey) t
    GROUP BY n_name, tenant, board""")
def _discover_boards(inputs: Inputs) -> DataFrame:
    tenant = F.concat(F.lit("t"), (F.col("s_suppkey") % 4).cast("string"))
    html = F.concat(F.lit('<script src="/wday/cxs/'), tenant, F.lit('/Main/jobs"></script>{"u":"https://h/wday/cxs/'), tenant,
                    F.lit("/B"), (F.col("s_suppkey") % 3).cast("string"), F.lit('?x=1","v":"/wday/cxs/'), tenant, F.lit('/Main/x"}'))
    pages = inputs["supplier"].join(inputs["nation"], F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("n_name").alias("company"), F.col("s_suppkey").alias("page_id"), html.alias("html"))
    return capture.discover_boards(pages).select("company", "tenant", "board", "page_id")


# Seeds: supplier pages; two of three carry JSON-LD, every fifth was not captured.
view("seed_pages", """
    SELECT s_suppkey AS k, n_name AS company, s_name AS name, n_nationkey,
           concat('https://wd.example.com/', CASE WHEN s_suppkey % 6 = 5 THEN 'about' ELSE 'job' END, '/Oslo/Lead-', CAST(s_suppkey AS STRING), '_R',
                  CAST(s_suppkey % 40 AS STRING)) AS url
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""")


@query("seed_rows", """
    SELECT company, url, source_id, title, location, description FROM (
        SELECT *, row_number() OVER (PARTITION BY company, source_id ORDER BY k) AS rn FROM (
            SELECT k, company, url,
                   CASE WHEN k % 3 = 0 THEN concat('ID-', CAST(k % 20 AS VARCHAR)) ELSE concat('R', CAST(k % 40 AS VARCHAR)) END AS source_id,
                   CASE WHEN k % 3 < 2 THEN concat('Posting ', CAST(k AS VARCHAR)) WHEN k % 2 = 0 THEN name ELSE concat('Lead ', CAST(k AS VARCHAR)) END AS title,
                   CASE WHEN k % 3 < 2 THEN concat('Oslo, NO; ', company) WHEN k % 2 = 0 THEN 'Seed place' ELSE '' END AS location,
                   CASE WHEN k % 3 < 2 THEN concat('Work & ', name) WHEN k % 2 = 0 THEN 'Seed text' ELSE '' END AS description
            FROM {seed_pages} WHERE k % 5 <> 4 AND k % 6 <> 5) a) b
    WHERE rn = 1""")
def _seed_rows(inputs: Inputs) -> DataFrame:
    rows = inputs["seed_pages"]
    seeded = (_k() % 3 == 2) & (_k() % 2 == 0)
    seeds = rows.select(
        "company", _k().alias("seq"), "url", F.when(seeded, F.col("name")).alias("title"),
        F.when(seeded, F.lit("Seed place")).alias("location"), F.when(seeded, F.lit("<b>Seed</b> text")).alias("description"))
    identifier = F.when(_k() % 3 == 0, F.concat(F.lit('{"value":"ID-'), (_k() % 20).cast("string"), F.lit('"}'))).otherwise(F.lit("null"))
    posting = F.concat(
        F.lit('{"@graph":[{"@type":"WebPage"},{"@type":"JobPosting","title":"Posting '), _k().cast("string"),
        F.lit('","description":"<p>Work &amp; '), F.col("name"), F.lit('</p>","identifier":'), identifier,
        F.lit(',"jobLocation":[{"address":{"addressLocality":"Oslo","addressCountry":"NO"}},"'), F.col("company"), F.lit('"]}]}'))
    html = F.concat(F.lit("<html><body>"), F.when(_k() % 3 < 2, F.concat(
        F.lit('<script type="application/ld+json">'), posting, F.lit("</script>"))).otherwise(F.lit("")), F.lit("<p>x</p></body></html>"))
    captured = rows.filter(_k() % 5 != 4).select(F.col("url"), html.alias("html"))
    parsed = dom.parse_pages(captured, url="url").select(
        "url", dom.element_text(dom.find_first("h1", "h2")).alias("heading"), jsonld.first_posting(True).alias("posting"))
    posted = parsed.withColumn("posting", F.when(F.col("posting").isNotNull(), F.col("posting").withField(
        "location", F.col("posting.all_locations"))))
    out = capture.seed_rows(seeds, posted)
    return out.select("company", "url", "source_id", "title", "location", "description")


view("hops", """
    SELECT DISTINCT l_suppkey % 7 AS company, l_partkey AS a, (l_partkey * 7 + l_suppkey) % 1999 AS b FROM {lineitem}""")


@query("link_closure", """
    WITH RECURSIVE reach(company, page) AS (
        SELECT company, min(a) FROM {hops} GROUP BY company
        UNION SELECT h.company, h.b FROM reach r JOIN {hops} h ON h.company = r.company AND h.a = r.page)
    SELECT company, page FROM reach""")
def _link_closure(inputs: Inputs) -> DataFrame:
    hops = inputs["hops"]
    links = hops.select("company", F.col("a").alias("from_url"), F.col("b").alias("to_url"))
    seeds = hops.groupBy("company").agg(F.min("a").alias("url"))
    return capture.link_closure(seeds, links).select("company", F.col("url").alias("page"))

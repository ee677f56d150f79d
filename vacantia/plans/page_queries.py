"""Page operators and link policies: the given web pages, and parts as job lists and detail pages.

Job lists are built as HTML from the flat ``items`` view, at most 500 postings a page, and read back by
the page operators; the SQL twins work on the flat anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.operators import dom, health, jsonld, links, pages
from vacantia.plans.catalog import Inputs, job_columns, query, view
from vacantia.schemas import JOB_FIELDS

_PAGE = ["company", "page_url", "page_no"]


def _k() -> Column:
    return F.col("k")




# ---- the given pages ----------------------------------------------------------------------------------------

def web_pages(inputs: Inputs) -> DataFrame:
    """Given pages; the language part of the URL stands for the company."""
    return dom.parse_pages(inputs["pages"].select(
        F.regexp_extract("url", "^https?://[^/]*/([a-z]+)/", 1).alias("company"), F.col("url").alias("page_url"),
        F.col("page_id").alias("page_no"), "html"))


_ENTITIES = ("replace(replace(replace(replace({}, '&middot;', '·'), '&copy;', '©'), '&quot;', chr(34)), '&amp;', '&')")
view("web_anchors", r"""
    SELECT page_id, url, regexp_extract(url, '^https?://[^/]*/([a-z]+)/', 1) AS company, pos,
           regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(%s, concat(' ', chr(9), chr(10), chr(13))) AS label,
           concat(regexp_extract(url, '^(https?://[^/?#]*)', 1), regexp_extract(a, 'href="([^"]*)"', 1)) AS link
    FROM (SELECT page_id, url, unnest(l) AS a, unnest(range(1, len(l) + 1)) AS pos
          FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*>[^<]*</a>') AS l FROM {pages}) y) x
""" % _ENTITIES.format("regexp_extract(a, '>([^<]*)<', 1)"))


@query("dom_nodes", """
    SELECT page_id, tag, count(*) AS n FROM (
        SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!.*?>', '', 'gs'), '<script>.*?</script>', '<script>', 'gs'),
                               '<([a-z][a-z0-9]*)', 1)) AS tag FROM {pages}) t
    GROUP BY page_id, tag""")
def _dom_nodes(inputs: Inputs) -> DataFrame:
    return dom.nodes(web_pages(inputs), ["page_no"]).groupBy(F.col("page_no").alias("page_id"), "tag").agg(F.count("*").alias("n"))


@query("page_links", "SELECT page_id, href, link, label, count(*) AS n FROM {web_anchors} GROUP BY ALL")
def _page_links(inputs: Inputs) -> DataFrame:
    anchors = dom.page_links(web_pages(inputs), ["page_no"])
    return anchors.groupBy(F.col("page_no").alias("page_id"), "href", "link", "label").agg(F.count("*").alias("n"))


# Seeds: ten parts name a title each for the company of one page.
view("title_seeds", """
    SELECT p_partkey AS seq, CAST(floor(p_partkey / 10) AS BIGINT) AS company, split_part(p_name, ' ', 1) AS title, 'Here' AS default_location FROM {part}""")


@query("seed_title_hit", """
    SELECT t.seq, p.url FROM {title_seeds} t
    JOIN (SELECT page_id, url, lower(regexp_replace(regexp_replace(html, '<!--.*?-->|<script.*?</script>|<style.*?</style>', '<br>', 'gs'), '<[^>]*>', ' ', 'g')) AS low
          FROM {pages}) p ON p.page_id = t.company AND contains(low, lower(title))""")
def _seed_title_hit(inputs: Inputs) -> DataFrame:
    texts = web_pages(inputs).select(F.col("page_no").alias("company"), "page_url", dom.page_text().alias("text"))
    jobs = pages.seed_title_jobs(texts, inputs["title_seeds"])
    return jobs.select(F.col("capture_seq").alias("seq"), "url")


# ---- job lists from parts -------------------------------------------------------------------------------------

#: Per platform: path (or URL) of a posting and its host.
_HREF = {
    "jobvite": "concat('/x/job/o', id)",
    "icims": "concat('/jobs/', id, '/', replace(name, ' ', '-'), '/job')",
    "promega": "concat('/jobs/', id)",
    "smartrecruiters": "concat('https://jobs.smartrecruiters.com/x/Job/', id)",
    "jazzhr": "concat('https://x.applytojob.com/apply/', id)",
    "ultipro": "concat('https://recruiting.ultipro.com/x/JobBoard/OpportunityDetail?o=', id)",
    "successfactors": "concat('/job/', replace(name, ' ', '-'), '/', id, '/')",
    "kula": "concat('/', board, '/', id)",
    "oracle": "concat('/job/', id)",
    "foundation": "concat('/jobs/', id, '-', replace(name, ' ', '-'))",
    "career_page": "concat('/careers/', id)",
    "browser": "concat('/positions/', id)",
    "adp": "concat('https://workforcenow.adp.com/r/', id)",
}
_TITLE = "concat(title, ' ', id)"


def _anchor_view(platform: str) -> str:
    """Anchors of a platform's job lists: one per posting, and for three of four a second, odd one."""
    href = _HREF[platform]
    absolute = f"CASE WHEN {href} LIKE 'http%' THEN {href} ELSE concat('https://', board, '.example.com', {href}) END"
    query_string = "CASE WHEN k % 3 = 0 THEN '?src=list' ELSE '' END" if platform in ("successfactors", "kula") else "''"
    sql = f"""
    SELECT k, k * 2 AS seq, company, board, page_no, title, concat({href}, {query_string}) AS href, {_TITLE} AS label, concat({absolute}, {query_string}) AS link
    FROM {{items}}
    UNION ALL
    SELECT k, k * 2 + 1, company, board, page_no, title,
           CASE k % 4 WHEN 0 THEN {href} WHEN 1 THEN '/privacy' WHEN 2 THEN concat({href}, '9999') ELSE concat('https://boards.greenhouse.io/x/', id) END,
           CASE k % 4 WHEN 0 THEN 'View posting' WHEN 1 THEN 'Privacy policy' WHEN 2 THEN '' ELSE {_TITLE} END,
           CASE k % 4 WHEN 0 THEN {absolute} WHEN 1 THEN concat('https://', board, '.example.com/privacy')
                WHEN 2 THEN concat({absolute}, '9999') ELSE concat('https://boards.greenhouse.io/x/', id) END
    FROM {{items}}"""
    name = f"anchors_{platform}"
    view(name, sql)
    # First anchor of each URL per company, labelled or not, as the policies see them.
    return name


_ANCHORS = {platform: _anchor_view(platform) for platform in _HREF}


def listing_pages(inputs: Inputs, platform: str) -> DataFrame:
    """Job lists as HTML, parsed."""
    label = F.replace(F.col("label"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<li><a class='job' href='"), "href", F.lit("'><b>"), label, F.lit("</b></a><br></li>"))
    rows = inputs[_ANCHORS[platform]].select("company", "board", "page_no", F.struct("seq", item.alias("html")).alias("item"))
    listed = inputs.pages_of(rows, "company", "board", "page_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda i: i["html"]), "\n").alias("list"))
    html = F.concat(F.lit("<!DOCTYPE html><html><head><title>Jobs</title><style>a{}</style></head><body><h1>Jobs</h1><ul>"),
                    "list", F.lit("</ul></body></html>"))
    return dom.parse_pages(listed.select(
        "company", "board", "page_no",
        F.concat(F.lit("https://"), "board", F.lit(".example.com/list")).alias("page_url"), html.alias("html")))


def listing_anchors(inputs: Inputs, platform: str) -> DataFrame:
    return dom.page_links(listing_pages(inputs, platform), ["company", "board", "page_url", "page_no"])


view("detail_text", """
    SELECT *, concat(title, ' ', id) AS label,
           concat('Careers ', title, ' II Location: ', city, ' Date: ', day, ' About & more') AS text,
           concat('Careers Location: ', city, ' Date: ', day, ' About & more') AS bare_text,
           k % 5 <> 4 AS captured, k % 3 AS form FROM {items}""")


def detail_facts(inputs: Inputs, platform: str, graph: bool | None = None) -> DataFrame:
    """Detail pages of four of five postings: JSON-LD, with a heading, or without one, by key."""
    rows = inputs["detail_text"].filter("captured")
    rows = rows.join(
        inputs[_ANCHORS[platform]].filter(F.col("seq") == _k() * 2).select("k", F.col("link").alias("url_")), "k")
    address = F.struct(F.col("city").alias("addressLocality"), F.lit("").alias("addressRegion"), F.lit("US").alias("addressCountry"))
    item = F.to_json(F.struct(
        F.lit("JobPosting").alias("@type"), F.concat("title", F.lit(" III")).alias("title"),
        F.struct(F.concat(F.lit("ID-"), F.col("id")).alias("value")).alias("identifier"),
        F.concat(F.lit("<p>Posted &amp; "), F.col("kind"), F.lit("</p>")).alias("description"),
        F.array(F.lit("FULL_TIME"), F.lit("INTERN")).alias("employmentType"), F.col("day").alias("datePosted"),
        F.lit("2025-01-01").alias("validThrough"),
        F.when(_k() % 2 == 0, F.array(F.struct(address.alias("address")))).alias("jobLocation"),
        F.struct(F.lit("USD").alias("currency"), F.struct(
            F.col("low").alias("minValue"), F.when(_k() % 2 == 0, F.col("high")).alias("maxValue"), F.lit("YEAR").alias("unitText")
        ).alias("value")).alias("baseSalary")))
    body = F.concat(F.lit("<p>Location: "), "city", F.lit("</p><p>Date: "), "day", F.lit("</p><p>About &amp; more</p>"))
    page = (
        F.when(F.col("form") == 0, F.concat(F.lit("<script type='application/ld+json'>"), item, F.lit("</script>"), body))
        .when(F.col("form") == 1, F.concat(F.lit("<main><h1>"), "title", F.lit(" II</h1>"), body, F.lit("</main>")))
        .otherwise(F.concat(F.lit("<main>"), body, F.lit("</main>")))
    )
    plain = F.substring_index("url_", "?", 1) if platform in ("successfactors", "kula") else F.col("url_")
    return links.detail_facts(rows.select(
        "company", plain.alias("url"),
        F.concat(F.lit("<html><head><title>Careers</title></head><body>"), page, F.lit("</body></html>")).alias("html")), graph)


def _jobs(df: DataFrame) -> DataFrame:
    return df.select(*JOB_FIELDS)


def _first_links(platform: str, keep: str, url: str = "link") -> str:
    """SQL for the first kept anchor of each URL per company."""
    return f"""
        SELECT * FROM (SELECT *, {url} AS url, row_number() OVER (PARTITION BY company, {url} ORDER BY page_no, seq) AS rn
                       FROM {{{_ANCHORS[platform]}}} WHERE {keep}) f WHERE rn = 1"""


def _plain(platform: str, source: str, keep: str, id_length: int = 20) -> None:
    sql = job_columns(company="company", title="label", url="url", source=f"'{source}'", source_id=f"substr(sha1(url), 1, {id_length})")

    @query(f"links_{platform}", f"SELECT {sql} FROM ({_first_links(platform, keep)}) l")
    def _run(inputs: Inputs) -> DataFrame:
        return _jobs(links.links_to_jobs(listing_anchors(inputs, platform), platform))


_plain("jobvite", "jobvite", "label <> '' AND contains(link, '/job/')")
_plain("icims", "icims", "label <> '' AND regexp_matches(link, '/jobs/[0-9]+/.+?/job', 'i')")
_plain("promega", "promega", "label <> '' AND regexp_matches(link, '/jobs/[0-9]+([?]|$)', 'i')")
_plain("smartrecruiters", "smartrecruiters", "label <> '' AND contains(link, 'smartrecruiters.com') AND contains(lower(link), '/job')", 16)
_plain("adp", "adp", "contains(link, 'workforcenow.adp.com') AND regexp_matches(label, '(Scientist|Manager)')")


def _detailed(platform: str, keep: str, columns: str, url: str = "link", where: str = "true") -> str:
    """SQL for kept anchors with what their posting's detail page holds; odd anchors have no detail."""
    return f"""
        SELECT {columns} FROM (
            SELECT l.company, l.label, l.url, l.seq, t.k IS NOT NULL AND t.captured AS captured, coalesce(t.form, -1) AS form, t.title, t.city, t.day,
                   t.kind, t.id, t.low, t.high, l.k, CASE WHEN t.form = 1 THEN t.text ELSE t.bare_text END AS text
            FROM ({_first_links(platform, keep, url)}) l
            LEFT JOIN {{detail_text}} t ON t.k = l.k AND l.seq = l.k * 2 AND t.captured) d WHERE {where}"""


_HEADED = "captured AND form = 1"
_LD = "captured AND form = 0"
_SHA = "substr(sha1(url), 1, 20)"


@query("links_jazzhr", _detailed("jazzhr", "label <> '' AND contains(link, 'applytojob.com')", job_columns(
    company="company", title=f"CASE WHEN {_HEADED} THEN concat(title, ' II') ELSE label END", url="url", source="'jazzhr'", source_id=_SHA,
    description="CASE WHEN captured THEN text ELSE '' END", location="CASE WHEN captured THEN concat(city, ' Date') ELSE '' END")))
def _links_jazzhr(inputs: Inputs) -> DataFrame:
    return _jobs(links.jazzhr_jobs(listing_anchors(inputs, "jazzhr"), detail_facts(inputs, "jazzhr")))


@query("links_ultipro", _detailed("ultipro", "length(label) > 2 AND regexp_matches(link, '(JobDetails|JobBoard|Opportunity)', 'i')", job_columns(
    company="company", title=f"CASE WHEN {_HEADED} THEN concat(title, ' II') ELSE label END", url="url", source="'ultipro'", source_id=_SHA,
    description="CASE WHEN captured THEN text ELSE '' END", location="CASE WHEN captured THEN concat(city, ' Date') ELSE '' END")))
def _links_ultipro(inputs: Inputs) -> DataFrame:
    return _jobs(links.ultipro_jobs(listing_anchors(inputs, "ultipro"), detail_facts(inputs, "ultipro")))


@query("links_successfactors", _detailed(
    "successfactors", "regexp_matches(split_part(link, '?', 1), '/job/.+?/[0-9]+/?$', 'i')", job_columns(
        company="company", title=f"CASE WHEN {_HEADED} THEN concat(title, ' II') WHEN label <> '' THEN label ELSE regexp_extract(url, '/([^/]+)/[^/]+/?$', 1) END",
        url="url", source="'successfactors'",
        source_id="regexp_extract(url, '/([0-9]+)/?$', 1)", description="CASE WHEN captured THEN text ELSE '' END",
        location="CASE WHEN captured THEN city ELSE '' END", published_at="CASE WHEN captured THEN day END"),
    url="split_part(link, '?', 1)"))
def _links_successfactors(inputs: Inputs) -> DataFrame:
    return _jobs(links.successfactors_jobs(listing_anchors(inputs, "successfactors"), detail_facts(inputs, "successfactors")))


_SALARY = "CASE WHEN k % 2 = 0 THEN concat('USD ', low, '-', high, ' / YEAR') ELSE concat('USD ', low, ' / YEAR') END"


@query("links_kula", _detailed(
    "kula", "regexp_matches(split_part(href, '?', 1), '^/[a-z0-9]+/[0-9]+$')", job_columns(
        company="company", title=f"CASE WHEN {_LD} THEN concat(title, ' III') ELSE concat(title, ' II') END", url="url", source="'kula'",
        source_id="regexp_extract(url, '([0-9]+)$', 1)", description=f"CASE WHEN {_LD} THEN concat('Posted & ', kind) ELSE text END",
        location=f"CASE WHEN {_LD} AND k % 2 = 0 THEN concat(city, ', US') ELSE '' END",
        employment_type=f"CASE WHEN {_LD} THEN 'FULL_TIME, INTERN' ELSE '' END",
        published_at=f"CASE WHEN {_LD} THEN day END", updated_at=f"CASE WHEN {_LD} THEN '2025-01-01' END",
        compensation=f"CASE WHEN {_LD} THEN {_SALARY} ELSE '' END"),
    url="split_part(link, '?', 1)", where="captured AND form <> 2"))
def _links_kula(inputs: Inputs) -> DataFrame:
    return _jobs(links.kula_jobs(listing_anchors(inputs, "kula"), detail_facts(inputs, "kula", graph=True)))


@query("links_oracle", _detailed("oracle", "label <> '' AND regexp_matches(href, '/job/([^/]+/)?[0-9]+/?|/jobs/[^?#]+', 'i')", job_columns(
    company="company", title=f"CASE WHEN {_LD} THEN concat(title, ' III') WHEN {_HEADED} THEN concat(title, ' II') ELSE label END", url="url",
    source="'oracle'", source_id=f"CASE WHEN {_LD} THEN concat('ID-', id) WHEN captured THEN {_SHA} ELSE url END",
    location=f"CASE WHEN {_LD} AND k % 2 = 0 THEN concat(city, ', US') ELSE '' END",
    description=f"CASE WHEN {_LD} THEN concat('Posted & ', kind) WHEN captured THEN text ELSE '' END")))
def _links_oracle(inputs: Inputs) -> DataFrame:
    return _jobs(links.oracle_jobs(listing_anchors(inputs, "oracle"), detail_facts(inputs, "oracle", graph=False)))


@query("links_foundation", _detailed("foundation", "label <> '' AND contains(href, '/jobs/')", job_columns(
    company="company", title=f"CASE WHEN {_LD} THEN concat(title, ' III') WHEN {_HEADED} THEN concat(title, ' II') ELSE replace(regexp_extract(url, '([^/]+)$', 1), '-', ' ') END",
    url="url", source="'foundation'", source_id=f"CASE WHEN {_LD} THEN concat('ID-', id) ELSE regexp_extract(url, '([^/]+)$', 1) END",
    location=f"CASE WHEN {_LD} AND k % 2 = 0 THEN concat(city, ', US') ELSE '' END",
    description=f"CASE WHEN {_LD} THEN concat('Posted & ', kind) ELSE replace(text, 'Careers ', '') END"), where="captured"))
def _links_foundation(inputs: Inputs) -> DataFrame:
    return _jobs(links.foundation_jobs(listing_anchors(inputs, "foundation"), detail_facts(inputs, "foundation", graph=False)))


_ENRICHED = """
    SELECT l.company, l.page_no, l.label, l.url, l.seq, t.k IS NOT NULL AS c, coalesce(t.form, -1) AS form, t.title, t.city, t.kind, t.id, l.k,
           CASE WHEN t.form = 1 THEN t.text ELSE t.bare_text END AS text
    FROM (%s) l LEFT JOIN {detail_text} t ON t.k = l.k AND l.seq = l.k * 2 AND t.captured"""
_CAREER = _ENRICHED % _first_links(
    "career_page", "label <> '' AND regexp_matches(label, 'scientist|data science|genomic|manager', 'i') AND (contains(link, '.example.com/') OR contains(link, 'greenhouse.io')) AND regexp_matches(lower(link), '/job|/career|/position|/opening|apply')")


@query("links_career_page", f"SELECT " + job_columns(
    company="company", title="CASE WHEN c AND form = 0 THEN concat(title, ' III') WHEN c AND form = 1 THEN concat(title, ' II') ELSE label END", url="url",
    source="'career_page'", source_id="CASE WHEN c AND form = 0 THEN concat('ID-', id) ELSE substr(sha1(url), 1, 16) END",
    location="CASE WHEN c AND form = 0 AND k % 2 = 0 THEN concat(city, ', US') ELSE '' END",
    description="CASE WHEN c AND form = 0 THEN concat('Posted & ', kind) WHEN c THEN text ELSE '' END") + f" FROM ({_CAREER}) x")
def _links_career_page(inputs: Inputs) -> DataFrame:
    return _jobs(links.career_page_jobs(
        listing_anchors(inputs, "career_page"), detail_facts(inputs, "career_page", graph=False)))


_BROWSER = _first_links("browser", "link <> '' AND NOT contains(lower(concat(label, ' ', link)), 'privacy') AND (contains(link, '/positions/') OR contains(link, 'greenhouse.io'))")


@query("links_browser", f"""
    SELECT """ + job_columns(
    company="company", title="CASE WHEN c AND form = 1 THEN concat(title, ' II') WHEN label = '' THEN 'Job opening' ELSE label END", url="url",
    source="'browser_career'", source_id=_SHA, location="CASE WHEN c THEN concat(city, ' Date') ELSE '' END",
    description="CASE WHEN c THEN text ELSE '' END") + f"""
    FROM ({_ENRICHED % _BROWSER}) x
    WHERE label <> '' OR c AND form = 1""")
def _links_browser(inputs: Inputs) -> DataFrame:
    return _jobs(links.browser_jobs(listing_anchors(inputs, "browser"), detail_facts(inputs, "browser")))


# ---- navigation, external and embedded links -------------------------------------------------------------------

view("site_anchors", """
    SELECT s_suppkey AS k, l_linenumber AS seq, s_name AS company, concat('https://s', CAST(s_suppkey AS STRING), '.example.com/') AS page_url,
           CASE l_linenumber % 4 WHEN 0 THEN concat('https://www.example.org/p', CAST(l_partkey AS STRING))
                WHEN 1 THEN concat('/open/', CAST(l_partkey % 50 AS STRING))
                WHEN 2 THEN CASE WHEN s_suppkey % 3 = 0 THEN concat('/jobs/', CAST(l_partkey AS STRING)) ELSE '/team' END
                ELSE concat('https://jobs.lever.co/', CAST(l_partkey AS STRING)) END AS href,
           CASE l_linenumber % 4 WHEN 1 THEN CASE WHEN l_partkey % 2 = 0 THEN 'View all jobs' ELSE 'Our mission' END
                WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'Open roles' ELSE 'Lever' END ELSE 'More info' END AS label,
           l_orderkey * 10 + l_linenumber AS at
    FROM {supplier} JOIN {lineitem} ON l_suppkey = s_suppkey""".replace(" AS at", " AS place"))


def site_pages(inputs: Inputs) -> DataFrame:
    """Suppliers' sites: one page per ten thousand orders, its anchors from line items; lever links as frames for some."""
    frame = (F.col("k") % 5 == 0) & F.col("href").contains("lever.co")
    tag = F.when(frame, F.concat(F.lit("<iframe src='"), "href", F.lit("'></iframe>"))).otherwise(
        F.concat(F.lit("<a href='"), "href", F.lit("'>"), "label", F.lit("</a>")))
    rows = inputs["site_anchors"].select(
        "company", "page_url", F.floor(F.col("place") / 100000).alias("page_no"), F.struct("place", "href", tag.alias("html")).alias("item"))
    body = inputs.pages_of(rows, "company", "page_url", "page_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("item")), lambda i: i["html"]), " ").alias("html"))
    return dom.parse_pages(body)


_ABSOLUTE = "CASE WHEN href LIKE 'http%' THEN href ELSE concat(rtrim(page_url, '/'), href) END"


@query("external_links", f"""
    SELECT company, string_agg(concat(label, ' -> ', link), ' || ' ORDER BY place, href) AS external_links FROM (
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY place, href) AS rn FROM (
            SELECT *, {_ABSOLUTE} AS link FROM {{site_anchors}}
            WHERE href LIKE 'http%' AND NOT (k % 5 = 0 AND contains(href, 'lever.co'))) a) b
    WHERE rn <= 8 GROUP BY company""")
def _external_links(inputs: Inputs) -> DataFrame:
    return links.external_links(dom.page_links(site_pages(inputs), _PAGE))


@query("entry_links", f"""
    SELECT company, url, label FROM (
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY place, href) AS nr FROM (
            SELECT *, row_number() OVER (PARTITION BY company, url ORDER BY place, href) AS rn FROM (
                SELECT *, {_ABSOLUTE} AS url FROM {{site_anchors}} WHERE label = 'View all jobs') a) b WHERE rn = 1) c
    WHERE nr <= 3 AND company NOT IN (
        SELECT company FROM {{site_anchors}} WHERE href LIKE '/jobs/%'
           OR contains(href, 'lever.co') AND label <> 'Open roles' AND k % 5 <> 0)""")
def _entry_links(inputs: Inputs) -> DataFrame:
    return links.entry_links(dom.page_links(site_pages(inputs), _PAGE)).select("company", "url", "label")


@query("embedded_boards", f"""
    SELECT DISTINCT company, {_ABSOLUTE} AS url FROM {{site_anchors}}
    WHERE href LIKE '/jobs/%' OR contains(href, 'lever.co') AND label <> 'Open roles' AND k % 5 <> 0""")
def _embedded_boards(inputs: Inputs) -> DataFrame:
    return links.embedded_boards(site_pages(inputs)).select("company", "url")


# ---- JSON-LD ---------------------------------------------------------------------------------------------------

def jsonld_pages(inputs: Inputs) -> DataFrame:
    """Suppliers' pages with an object, a list, a graph, or unreadable JSON-LD, by key mod 4."""
    key = F.col("k")
    place = F.struct(F.struct(
        F.col("company").alias("addressLocality"), F.lit("").alias("addressRegion"), F.lit("FI").alias("addressCountry")).alias("address"))
    other = F.struct(F.lit("Turku").alias("addressLocality"), F.lit("Finland").alias("addressCountry"))
    locations = F.when(key % 3 == 0, F.to_json(place)).when(
        key % 3 == 1, F.concat(F.lit("["), F.to_json(place), F.lit(","), F.to_json(other), F.lit("]"))).otherwise(F.lit('""'))
    item = F.concat(
        F.lit('{"@type":"JobPosting","title":"'), F.col("name"), F.lit('","url":"https://x.example.com/'), key.cast("string"),
        F.lit('","identifier":'), F.when(key % 2 == 0, F.concat(F.lit('{"value":'), key.cast("string"), F.lit("}"))).otherwise(
            F.concat(F.lit('"N'), key.cast("string"), F.lit('"'))),
        F.lit(',"description":"<p>At <b>'), F.col("company"), F.lit('</b> &amp; more</p>","employmentType":'),
        F.when(key % 2 == 0, F.lit('["FULL_TIME","PART_TIME"]')).otherwise(F.lit('"CONTRACTOR"')),
        F.lit(',"datePosted":"2024-02-0'), (key % 9 + 1).cast("string"), F.lit('","jobLocation":'), locations,
        F.lit(',"applicantLocationRequirements":{"@type":"Country","name":"US"},"baseSalary":{"currency":"EUR","value":{"minValue":'),
        (key * 100).cast("string"), F.when(key % 2 == 0, F.concat(F.lit(',"maxValue":'), (key * 200).cast("string"))).otherwise(F.lit("")),
        F.lit(',"unitText":"MONTH"}}}'))
    site = F.lit('{"@type":"WebSite"}')
    body = (
        F.when(key % 4 == 0, item).when(key % 4 == 1, F.concat(F.lit("["), site, F.lit(","), item, F.lit(","), item, F.lit("]")))
        .when(key % 4 == 2, F.concat(F.lit('{"@graph":['), site, F.lit(","), item, F.lit("]}")))
        .otherwise(F.concat(F.lit("{broken "), item))
    )
    html = F.concat(F.lit("<head><script type='application/ld+json'>"), body, F.lit("</script></head><body>x</body>"))
    return dom.parse_pages(inputs["seed_pages"].select(
        "k", "company", F.col("url").alias("page_url"), F.lit(0).alias("page_no"), html.alias("html")))


_COPIES = "(SELECT unnest(range(0, 2)) AS copy)"


@query("jsonld_jobs", f"""
    SELECT k, CAST(copy AS INTEGER) AS pos, name AS title FROM {{seed_pages}} CROSS JOIN {_COPIES} c
    WHERE k % 4 IN (0, 2) AND copy = 0 OR k % 4 = 1""")
def _jsonld_jobs(inputs: Inputs) -> DataFrame:
    rows = jsonld.jsonld_jobs(jsonld_pages(inputs), ["k"], graph=True)
    return rows.select("k", "pos", F.try_variant_get("item", "$.title", "string").alias("title"))


def _posting(inputs: Inputs, graph: bool = True) -> DataFrame:
    parsed = jsonld_pages(inputs).select("k", "company", "page_url", jsonld.first_posting(graph).alias("posting"))
    return parsed.filter(F.col("posting").isNotNull())


@query("jsonld_to_job", "SELECT " + job_columns(
    company="company", title="name", location="CASE WHEN k % 3 = 2 THEN '' ELSE concat(company, ', FI') END",
    url="concat('https://x.example.com/', CAST(k AS VARCHAR))", source="'career_page'",
    source_id="CASE WHEN k % 2 = 0 THEN CAST(k AS VARCHAR) ELSE concat('N', CAST(k AS VARCHAR)) END",
    description="concat('At ', company, ' & more')", employment_type="CASE WHEN k % 2 = 0 THEN 'FULL_TIME, PART_TIME' ELSE 'CONTRACTOR' END",
    published_at="concat('2024-02-0', CAST(k % 9 + 1 AS VARCHAR))",
    compensation="CASE WHEN k % 2 = 0 THEN concat('EUR ', k * 100, '-', k * 200, ' / MONTH') ELSE concat('EUR ', k * 100, ' / MONTH') END",
) + " FROM {seed_pages} WHERE k % 4 IN (0, 1)")
def _jsonld_to_job(inputs: Inputs) -> DataFrame:
    return _jobs(jsonld.posting_to_job(_posting(inputs, graph=False), "posting", "career_page", "page_url", dated=True))


@query("schema_location", """
    SELECT k, CASE WHEN k % 3 = 2 THEN '' ELSE concat(company, ', FI') END AS first_location,
           CASE k % 3 WHEN 0 THEN concat(company, ', FI') WHEN 1 THEN concat(company, ', FI; Turku, Finland') ELSE '' END AS all_locations
    FROM {seed_pages} WHERE k % 4 <> 3""")
def _schema_location(inputs: Inputs) -> DataFrame:
    return _posting(inputs).select(
        "k", F.col("posting.location").alias("first_location"), F.col("posting.all_locations").alias("all_locations"))


@query("jsonld_salary", """
    SELECT k, CASE WHEN k % 2 = 0 THEN concat('EUR ', k * 100, '-', k * 200, ' / MONTH') ELSE concat('EUR ', k * 100, ' / MONTH') END AS salary
    FROM {seed_pages} WHERE k % 4 <> 3""")
def _jsonld_salary(inputs: Inputs) -> DataFrame:
    return _posting(inputs).select("k", F.col("posting.salary").alias("salary"))


# ---- headings, cards and labels ----------------------------------------------------------------------------------

view("heading_items", """
    SELECT k, company, board, page_no, concat(title, ' ', CAST(k % 7 AS STRING)) AS title, city,
           row_number() OVER (PARTITION BY company, page_no ORDER BY k) AS nr FROM {items}""")


def heading_pages(inputs: Inputs) -> DataFrame:
    """Company pages: three headings, the marker, headings with a place beside them, from the 12th on benefits."""
    place = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<p>"), "city", F.lit("</p>"))).otherwise(F.lit("<h4></h4>"))
    item = F.concat(
        F.when(F.col("nr") == 4, F.lit("<h2>Open positions</h2>")).when(F.col("nr") == 12, F.lit("<h2>Our benefits</h2>")).otherwise(F.lit("")),
        F.lit("<h3>"), "title", F.lit("</h3>"), place,
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("<a href='/d/"), F.col("k").cast("string"), F.lit("'>View details</a>"))).otherwise(F.lit("")))
    rows = inputs.pages_of(inputs["heading_items"], "company", "board", "page_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("nr", item.alias("html")))), lambda i: i["html"]), "").alias("list"))
    return dom.parse_pages(rows.select(
        "company", F.concat(F.lit("https://"), "board", F.lit(".example.com/p"), F.col("page_no").cast("string")).alias("page_url"),
        "page_no", F.concat(F.lit("<body><div>"), "list", F.lit("</div></body>")).alias("html")))


@query("heading_jobs", """
    SELECT company, title, location, url, substr(sha1(concat(url, title, location)), 1, 16) AS source_id FROM (
        SELECT *, row_number() OVER (PARTITION BY company, url, lower(regexp_replace(title, '[^A-Za-z0-9]+', '-', 'g')) ORDER BY nr) AS rn FROM (
            SELECT company, CASE WHEN nr = 12 THEN 'Our benefits' ELSE title END AS title, nr,
                   CASE WHEN nr = 12 THEN title WHEN k % 2 = 0 THEN city ELSE '' END AS location,
                   concat('https://', board, '.example.com/p', CAST(page_no AS VARCHAR)) AS url
            FROM {heading_items} WHERE nr BETWEEN 4 AND 12) a) b
    WHERE rn = 1""")
def _heading_jobs(inputs: Inputs) -> DataFrame:
    return pages.heading_jobs(heading_pages(inputs)).select("company", "title", "location", "url", "source_id")


@query("prev_heading", """
    SELECT company, concat('/d/', CAST(k AS VARCHAR)) AS href, title AS heading FROM {heading_items} WHERE k % 3 = 0""")
def _prev_heading(inputs: Inputs) -> DataFrame:
    anchors = dom.page_links(
        heading_pages(inputs), _PAGE, heading=lambda e, lists: dom.element_text(dom.heading_before(e, "h2", "h3")))
    return anchors.select("company", "href", "heading")


@query("next_link", """
    SELECT company, title, page_no, nr, min(CASE WHEN k % 3 = 0 THEN concat(lpad(CAST(nr AS VARCHAR), 4, '0'), '/d/', CAST(k AS VARCHAR)) END)
               OVER (PARTITION BY company, page_no ORDER BY nr ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_href
    FROM {heading_items}""".replace("SELECT company, title, page_no, nr, min(", "SELECT company, title, page_no, substr(min(").replace(
    "AS next_href", ", 5) AS next_href"))
def _next_link(inputs: Inputs) -> DataFrame:
    heads = dom.outline(heading_pages(inputs), _PAGE).filter("tag = 'h3'")
    return heads.select("company", "title", "page_no", F.col("next_href"))


@query("label_value", """
    SELECT k, city AS location, day, concat(city, ' Date') AS loose FROM {detail_text}""")
def _label_value(inputs: Inputs) -> DataFrame:
    lines = F.concat(F.lit("Careers\nLOCATION:  "), "city", F.lit(" \nDate: "), "day", F.lit("\nMore"))
    flat = F.concat(F.lit("Careers Job Location - "), "city", F.lit(" Date: "), "day")
    return inputs["detail_text"].select(
        "k", pages.label_value(lines, links.LINE_LOCATION).alias("location"), pages.label_value(lines, links.LINE_DATE).alias("day"),
        pages.label_value(flat, links.JAZZHR_LOCATION).alias("loose"))


@query("location_triple", r"""
    SELECT k, CASE WHEN k % 2 = 0 THEN concat(city, ', Oslo, Norway') ELSE '' END AS place FROM {items}""")
def _location_triple(inputs: Inputs) -> DataFrame:
    text = F.when(_k() % 2 == 0, F.concat(F.lit("1 Work type: Hybrid · "), "city", F.lit(", Oslo, Norway (4)"))).otherwise(F.lit("Oslo, Norway 5"))
    return inputs["items"].select("k", links.location_triple(text).alias("place"))


@query("card_segments", """
    SELECT company, concat(label, '') AS title, concat(kindcase, ', CA, US') AS location FROM (
        SELECT DISTINCT company, page_no, concat(title, ' ', id) AS label, concat(upper(substr(kind, 1, 1)), lower(substr(kind, 2)), ' Town') AS kindcase
        FROM {items} WHERE k % 5 IN (0, 1, 3)) x""")
def _card_segments(inputs: Inputs) -> DataFrame:
    town = F.concat(F.initcap("kind"), F.lit(" Town, CA, US"))
    age = F.when(_k() % 2 == 0, F.lit(" 19 days agoFull Time ")).otherwise(F.lit(" 2 months ago Temporary "))
    card = F.struct("k", F.concat("title", F.lit(" "), "id", F.lit(" | "), town, age).alias("text"))
    texts = inputs.pages_of(inputs["items"], "company", "page_no").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(card)), lambda c: c["text"]), "").alias("list"))
    rows = texts.select("company", F.concat(F.lit("https://adp.example.com/"), F.col("page_no").cast("string")).alias("page_url"),
                        F.concat(F.lit("Welcome Oslo, NO, US Current Openings (5 of 9) Search "), "list", F.lit(" Copyright x, CA, US")).alias("text"))
    return pages.card_segments(rows).select("company", "title", "location")


@query("verified_empty", """
    SELECT k, k % 5 = 0 OR k % 3 < 2 AS verified_empty FROM {items}""")
def _verified_empty(inputs: Inputs) -> DataFrame:
    text = F.when(_k() % 3 == 0, F.concat("title", F.lit(": there are NO jobs"))).when(
        _k() % 3 == 1, F.lit("Current openings (0 of 0)")).otherwise(F.concat("title", F.lit(" Current openings (1 of 1)")))
    platform = F.when(_k() % 5 == 0, F.lit("empty")).otherwise(F.lit("adp"))
    return inputs["items"].select("k", health.verified_empty(platform, text).alias("verified_empty"))


def card_pages(inputs: Inputs) -> DataFrame:
    """Pages of cards with title, link, text and a location attribute."""
    item = F.concat(
        F.lit("<article class='card big' data-loc=' "), "city", F.lit(" '><h3 class='name x'>"), "title", F.lit(" <i>"), "id",
        F.lit("</i></h3><p class='text'>"), "kind", F.lit("  &amp; more</p>"),
        F.when(_k() % 4 != 3, F.concat(F.lit("<a href='/view/detail?id="), "id", F.lit("'>View details</a>"))).otherwise(F.lit("")),
        F.lit("</article>"))
    rows = inputs.pages_of(inputs["items"], "company", "board", "page_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", item.alias("html")))), lambda i: i["html"]), "").alias("list"))
    return dom.parse_pages(rows.select(
        "company", F.concat(F.lit("https://"), "board", F.lit(".example.com/careers/all")).alias("page_url"), "page_no",
        F.concat(F.lit("<body><section>"), "list", F.lit("</section></body>")).alias("html")))


_VIEW_URL = "concat('https://', board, '.example.com/view/detail?id=', id)"


@query("card_fields", f"""
    SELECT company, concat(title, ' ', id) AS title, {_VIEW_URL} AS url, concat(kind, ' & more') AS description, city AS location
    FROM {{items}} WHERE k % 4 <> 3""")
def _card_fields(inputs: Inputs) -> DataFrame:
    return pages.card_fields(
        card_pages(inputs), "card", title_class="name", description_class="text", location_attribute="data-loc",
    ).select("company", "title", "url", "description", "location")


@query("links_hologic", f"""
    SELECT {job_columns(company="company", title="concat(title, ' ', id)", location="concat(kind, '  & more')",
                        url=_VIEW_URL, source="'hologic'", source_id=f"substr(sha1({_VIEW_URL}), 1, 20)")}
    FROM {{items}} WHERE k % 4 <> 3""")
def _links_hologic(inputs: Inputs) -> DataFrame:
    return _jobs(links.hologic_jobs(card_pages(inputs)))


@query("links_adaptive", f"""
    SELECT {job_columns(company="company", title="concat(title, ' ', id)", url="concat('https://www.example.com/apply/', id)", source="'adaptive'",
                        source_id="id", description="concat(title, ' ', id, ' Learn more')")}
    FROM {{items}} WHERE k % 4 <> 3""")
def _links_adaptive(inputs: Inputs) -> DataFrame:
    item = F.concat(
        F.lit("<li><h4>"), "title", F.lit(" "), "id", F.lit("</h4>"),
        F.when(_k() % 4 != 3, F.concat(F.lit("<a href='apply/"), "id", F.lit("'>Learn more</a>"))).otherwise(F.lit("<a href='/about'>About</a>")),
        F.lit("</li>"))
    rows = inputs.pages_of(inputs["items"], "company", "page_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", item.alias("html")))), lambda i: i["html"]), "").alias("list"))
    parsed = dom.parse_pages(rows.select(
        "company", F.lit("https://www.example.com/list").alias("page_url"), "page_no", F.concat(F.lit("<ul>"), "list", F.lit("</ul>")).alias("html")))
    return _jobs(links.adaptive_jobs(parsed, "https://www.example.com"))


@query("links_indigo", f"""
    SELECT {job_columns(company="company", title="CASE WHEN k % 4 = 0 THEN concat('Detail ', id) ELSE concat(title, ' ', id) END",
                        url="concat('https://', board, '.example.com/job-application/', id)", source="'indigo_ag'",
                        source_id="substr(sha1(concat('https://', board, '.example.com/job-application/', id)), 1, 20)",
                        description="CASE WHEN k % 4 = 0 THEN concat('Detail ', id, ' text') ELSE '' END")}
    FROM {{items}}""")
def _links_indigo(inputs: Inputs) -> DataFrame:
    item = F.concat(
        F.lit("<div><div><h5>"), "title", F.lit(" "), "id", F.lit("</h5></div><p><span><a href='/job-application/"), "id", F.lit("'>"),
        F.when(_k() % 3 == 0, F.lit("Apply here")).when(_k() % 3 == 1, F.concat("title", F.lit(" "), "id")).otherwise(F.lit("")),
        F.lit("</a></span></p></div><a href='/other'>x</a>"))
    rows = inputs.pages_of(inputs["items"], "company", "board", "page_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", item.alias("html")))), lambda i: i["html"]), "").alias("list"))
    site = F.concat(F.lit("https://"), "board", F.lit(".example.com"))
    parsed = dom.parse_pages(rows.select(
        "company", F.concat(site, F.lit("/careers")).alias("page_url"), "page_no", F.concat(F.lit("<main>"), "list", F.lit("</main>")).alias("html")))
    details = inputs["items"].filter(_k() % 4 == 0).select(
        "company", F.concat(site, F.lit("/job-application/"), "id").alias("url"),
        F.concat(F.lit("<h2>Detail "), "id", F.lit("</h2><p>text</p>")).alias("html"))
    return _jobs(links.indigo_jobs(parsed, links.detail_facts(details)))


@query("links_eligo", f"""
    SELECT {job_columns(company="company", title="concat(title, ' ', id)",
                        location="CASE WHEN k % 3 = 0 OR k % 2 = 0 THEN 'Paris' ELSE '' END", url="url", source="'eligo'", source_id=_SHA)}
    FROM (SELECT k, company, title, id, CASE k % 3 WHEN 0 THEN concat('https://', board, '.example.com/d/', id)
                   ELSE concat('https://', board, '.example.com/jobs#', replace(lower(title), ' ', '-'), '-', id) END AS url
          FROM {{items}} WHERE k % 3 <> 2) x""")
def _links_eligo(inputs: Inputs) -> DataFrame:
    item = F.concat(
        F.lit("<h3>"), "title", F.lit(" "), "id", F.lit("</h3>"),
        F.when(_k() % 3 == 0, F.concat(F.lit("<div>Paris <a href='/d/"), "id", F.lit("'>DETAILS</a></div>")))
        .when(_k() % 3 == 1, F.concat(F.lit("Full Time "), F.when(_k() % 2 == 0, F.lit("paris")).otherwise(F.lit("lyon")), F.lit("<a href='/x'>Apply</a>")))
        .otherwise(F.lit("<p>closed</p><a href='/x'>Apply</a>")))
    rows = inputs.pages_of(inputs["items"], "company", "board", "page_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("k", item.alias("html")))), lambda i: i["html"]), "").alias("list"))
    parsed = dom.parse_pages(rows.select(
        "company", F.concat(F.lit("https://"), "board", F.lit(".example.com/jobs")).alias("page_url"), "page_no",
        F.concat(F.lit("<body><h3>Before</h3>Full time<h2>Current Job Openings</h2>"), "list", F.lit("</body>")).alias("html")))
    return _jobs(links.eligo_jobs(parsed))

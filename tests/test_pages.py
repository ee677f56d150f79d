import hashlib
import json

from pyspark.sql import functions as F

from vacantia.functions.text import fragment_text
from vacantia.operators import dom, jsonld, links, pages

PAGE = "company string, page_url string, page_no int, html string"


def parse(spark, *htmls, url="https://x.org/a/b"):
    return dom.parse_pages(spark.createDataFrame([("c", url, i, h) for i, h in enumerate(htmls)], PAGE))


def anchors(spark, html, url="https://x.org/careers", board="acme"):
    return dom.page_links(parse(spark, html, url=url), ["company", "page_url", "page_no"]).withColumn("board", F.lit(board))


def details(spark, pages_by_url, graph=None):
    rows = [("c", u, h) for u, h in pages_by_url.items()]
    return links.detail_facts(spark.createDataFrame(rows, "company string, url string, html string"), graph)


def titles(df):
    return [(r["title"], r["url"]) for r in df.orderBy("capture_seq").collect()]


def test_elements(spark):
    html = "<!DOCTYPE html><title>T</title><p>a<p>b <b>c</b><br/><div/>d<script>x</script><template><i>no</i></template></p></q><!-- z -->e&amp;f&nbsp;"
    row = parse(spark, html).select("texts", "elements").collect()[0]
    assert row["texts"] == ["T", "a", "b", "c", "d", "e&f"]
    tree = [(e["tag"], e["seq"], e["parent"], e["last"]) for e in row["elements"]]
    assert tree == [("title", 1, 0, 1), ("p", 2, 0, 9), ("p", 3, 2, 9), ("b", 4, 3, 4), ("br", 5, 3, 5), ("div", 6, 3, 6),
                    ("script", 7, 3, 7), ("template", 8, 3, 9), ("i", 9, 8, 9)]


def test_fragment_text_agrees_with_the_page_parser(spark):
    htmls = ["<p>a<p>b", "<div>x &amp; y</div><!-- c -->z", "t<br>u<style>s{}</style><b> v </b>", "<ul><li>1</li><li>2</li></ul>", "", "no tags"]
    df = spark.createDataFrame([("c", "u", i, h) for i, h in enumerate(htmls)], PAGE)
    flat = [r[0] for r in df.orderBy("page_no").select(fragment_text(F.col("html"))).collect()]
    full = [r[0] for r in dom.parse_pages(df).orderBy("page_no").select(dom.page_text()).collect()]
    assert flat == full


def test_links_are_resolved(spark):
    hrefs = ["c?x=1", "/d", "//h.com/e", "https://z.org/f?q=1", "../g", "#h", "", "mailto:a@b", "/a/./b", "https://z.org", "?k=v", "/p#f"]
    html = "".join(f'<a href="{h}">{i}</a>' for i, h in enumerate(hrefs))
    got = [r["link"] for r in dom.page_links(parse(spark, html), ["page_url"]).orderBy("seq").collect()]
    assert got == ["https://x.org/a/c?x=1", "https://x.org/d", "https://h.com/e", "https://z.org/f?q=1", "https://x.org/g", "https://x.org/a/b#h",
                   "https://x.org/a/b", "mailto:a@b", "https://x.org/a/b", "https://z.org", "https://x.org/a/b?k=v", "https://x.org/p#f"]


def test_neighbours(spark):
    page = parse(spark, "<h2>One</h2><div><h3>Two</h3><a href='/a'>x</a></div><h4>Three</h4><p><a href='/b'>y</a></p>")
    rows = dom.page_links(page, ["company"], before=lambda e, lists: dom.element_text(dom.heading_before(e, "h2", "h3"))).orderBy("seq").collect()
    assert [r["before"] for r in rows] == ["Two", "Two"]
    heads = dom.outline(page, ["company"]).orderBy("seq").collect()
    assert [(r["title"], r["next_href"]) for r in heads] == [("One", "/a"), ("Two", "/a"), ("Three", "/b")]


def test_a_page_with_very_many_links_and_headings(spark):
    """Work on a page grows with its length: 5,000 headings and 20,000 links take seconds, not a product of both."""
    import time

    page = parse(spark, "".join(f"<h3>Role {i}</h3>" + "".join(f"<a href='/d/{i}-{k}'>x</a>" for k in range(4)) for i in range(5000)))
    start = time.time()
    rows = dom.page_links(page, ["company"], before=lambda e, lists: dom.element_text(dom.heading_before(e, "h1", "h3"))).collect()
    assert len(rows) == 20_000 and all(r["href"].startswith(f"/d/{r['before'].split()[1]}-") for r in rows)
    heads = dom.outline(page, ["company"]).collect()
    assert len(heads) == 5000 and all(r["next_href"] == f"/d/{r['title'].split()[1]}-0" for r in heads)
    assert time.time() - start < 60


def test_jsonld_on_pages(spark):
    job = json.dumps({"@type": "JobPosting", "title": "T"})
    scripts = [job, f"[{job},{job}]", '{"@graph":[{"@type":"X"},' + job + "]}", "{bad", '{"@type":["JobPosting"]}']
    htmls = [f'<script type="application/ld+json">{s}</script>' for s in scripts] + [f"<script>{job}</script>"]
    page = parse(spark, *htmls)
    with_graph = page.groupBy().agg(F.sum(F.size(jsonld.page_postings(True)))).collect()[0][0]
    without = page.groupBy().agg(F.sum(F.size(jsonld.page_postings(False)))).collect()[0][0]
    assert (with_graph, without) == (4, 3)


def test_simple_policies(spark):
    html = ("<a href='/job/1'>One</a><a href='/job/1'>Again</a><a href='/job/2'></a><a href='/jobs/12/x/job?y'>I</a>"
            "<a href='/jobs/34?z'>P</a><a href='https://jobs.smartrecruiters.com/a/POSITION'>S</a>")
    a = anchors(spark, html)
    assert titles(links.links_to_jobs(a, "jobvite")) == [("One", "https://x.org/job/1")]
    assert titles(links.links_to_jobs(a, "icims")) == [("I", "https://x.org/jobs/12/x/job?y")]
    assert titles(links.links_to_jobs(a, "promega")) == [("P", "https://x.org/jobs/34?z")]
    smart = links.links_to_jobs(a, "smartrecruiters").collect()[0]
    assert smart["source_id"] == hashlib.sha1(smart["url"].encode()).hexdigest()[:16]


def test_kula(spark):
    html = "<a href='/acme/123?src=x'>a</a><a href='https://careers.kula.ai/acme/123'>b</a><a href='/acme/456/'>c</a><a href='/acme/about'>n</a><a href='/other/7'>o</a>"
    a = anchors(spark, html, url="https://careers.kula.ai/acme")
    posting = {"@graph": [{"@type": "JobPosting", "title": " A  B ", "jobLocation": [{"address": {"addressLocality": "Oslo"}}], "datePosted": "d"}]}
    facts = details(spark, {
        "https://careers.kula.ai/acme/123": f'<script type="application/ld+json">{json.dumps(posting)}</script>',
        "https://careers.kula.ai/acme/456": "<h2>Head</h2><p>Work type: Hybrid · Oslo, Viken, Norway (5)</p>"}, graph=True)
    rows = links.kula_jobs(a, facts).orderBy("url").collect()
    assert [(r["title"], r["location"], r["source_id"]) for r in rows] == [("A B", "Oslo", "123"), ("Head", "Oslo, Viken, Norway", "456")]


def test_oracle_and_foundation(spark):
    a = anchors(spark, "<a href='/job/123'>L</a><a href='/job/124'>M</a><a href='/jobs/search?x'>N</a>")
    facts = details(spark, {"https://x.org/job/123": '<script type="application/ld+json">{"@type":"JobPosting","title":"J","identifier":{"value":123}}</script>'}, graph=False)
    rows = links.oracle_jobs(a, facts).orderBy("url").collect()
    assert [(r["title"], r["source_id"]) for r in rows] == [("J", "123"), ("M", "https://x.org/job/124"), ("N", "https://x.org/jobs/search?x")]
    b = anchors(spark, "<a href='/jobs/search'>all</a><a href='/jobs/5-lead-chef'>x</a>")
    found = links.foundation_jobs(b, details(spark, {"https://x.org/jobs/5-lead-chef": "<title>t</title><main> main <b>text</b></main>"}, graph=False)).collect()
    assert [(r["title"], r["source_id"], r["description"]) for r in found] == [("5 lead chef", "5-lead-chef", "main text")]
    page = parse(spark, "<a href='/about'>x</a>").withColumn("page_no", F.lit(1))
    assert links.first_page_errors(page, links.foundation_jobs(a, facts)).count() == 1


def test_successfactors(spark):
    a = anchors(spark, "<a href='/job/Cambridge-Chef/1410613800/?utm=1'></a><a href='/job/Cambridge-Chef/1410613800/'>later</a><a href='/job/x/y1'>no</a>")
    facts = details(spark, {"https://x.org/job/Cambridge-Chef/1410613800/": "<p>Date: Jan 1</p><p>Location:  Cambridge </p><p>Text</p>"})
    row = links.successfactors_jobs(a, facts).collect()[0]
    assert (row["title"], row["source_id"], row["location"], row["published_at"]) == ("Cambridge Chef", "1410613800", "Cambridge", "Jan 1")
    assert row["description"] == "Date: Jan 1 Location:  Cambridge Text"


def test_career_page_details_and_headings(spark):
    html = ("<a href='/career/1'>Data Scientist</a><a href='/career/2'>Director</a><a href='/career/3'>Chef</a><a href='https://evil.com/job'>Engineer</a>"
            "<a href='https://boards.greenhouse.io/x/jobs/1'>Engineer</a><a href='/careers'>Scientist root</a>")
    a = anchors(spark, html)
    facts = details(spark, {"https://x.org/career/1": "<h1>Senior Scientist</h1>", "https://x.org/career/2": "<h1>Director X</h1>"}, graph=False)
    rows = links.career_page_jobs(a, facts).orderBy("url").collect()
    assert [(r["title"], r["description"]) for r in rows] == [("Engineer", ""), ("Senior Scientist", "Senior Scientist"), ("Director X", "Director X")]


def test_nothing_is_cut(spark):
    """Title, location and pay far behind any prefix; a detail page captured twice."""
    from vacantia.functions.pay import apply_pay

    long_title, filler = "Scientist " + "of many words " * 40, "lorem ipsum " * 2500
    a = anchors(spark, f"<a href='https://c.applytojob.com/apply/1'>{long_title}</a>")
    body = f"<h1>{long_title}</h1><p>{filler}</p><p>Location: Oslo, Norway</p><p>The base salary is $100,000 - $120,000 annually.</p>"
    facts = details(spark, {"https://c.applytojob.com/apply/1": body})
    row = apply_pay(links.jazzhr_jobs(a, facts)).collect()[0]
    assert row["title"] == long_title.strip() and row["location"].startswith("Oslo, Norway") and row["compensation"] == "$100,000–$120,000/yr"
    assert len(row["description"]) > 25_000
    twice = spark.createDataFrame(
        [("c", "u", "<h1>old</h1>", 1), ("c", "u", "<h1>new</h1>", 2), ("c", "u", "<h1>new</h1>", 2)], "company string, url string, html string, captured_at int")
    assert [r["h1"] for r in links.detail_facts(twice).collect()] == ["new"]


def test_browser_links(spark):
    html = ("<a href='/jobs/1'>Scientist</a><a href='/jobs/1'>dup</a><a href='/x'>Lab manager</a><a href='/y'>News</a><a href='https://boards.greenhouse.io/'></a>"
            "<a href='https://jobs.lever.co/a/b'>Open Roles</a><a href='https://jobs.lever.co/a'></a><a href='/jobs/terms'>Terms</a><a href='mailto:x@lever.co'>m</a>")
    facts = details(spark, {"https://x.org/jobs/1": "<h1>Careers</h1>", "https://x.org/x": "<h2>Lab Manager</h2><p>Locations - Oslo, Norway 1</p>"})
    rows = links.browser_jobs(anchors(spark, html), facts).orderBy("url").collect()
    # "Location" matches before "Locations", so the plural's s starts the value; generic titles are dropped.
    assert [(r["title"], r["location"]) for r in rows] == [("Lab Manager", "s - Oslo, Norway")]


def test_entry_and_external_links(spark):
    html = "<a href='/o'>View all jobs</a><a href='/o'>search jobs</a><a href='https://b.com/1'>Search Jobs</a><a href='/z'>Careers hub</a>"
    a = anchors(spark, html)
    entries = links.entry_links(a, own_terms=("hub",)).orderBy("rank").collect()
    assert [r["url"] for r in entries] == ["https://x.org/o", "https://b.com/1", "https://x.org/z"]
    assert links.entry_links(anchors(spark, html + "<a href='/jobs/9'>x</a>")).count() == 0
    assert links.external_links(a).collect()[0]["external_links"] == "Search Jobs -> https://b.com/1"


def test_heading_jobs_stop_and_place(spark):
    html = ("<h1>Acme</h1><h3>Before</h3><h2>Current openings</h2><h3>Chef</h3><p>Oslo</p><h3>chef!</h3><h3>View more</h3><h3>Baker</h3><h4>x</h4>"
            "<h2>Our Benefits</h2><h3>Pension</h3>")
    rows = pages.heading_jobs(parse(spark, html)).orderBy("capture_seq").collect()
    assert [(r["title"], r["location"]) for r in rows] == [
        ("Chef", "Oslo"), ("Baker", ""), ("x", "Our Benefits"), ("Our Benefits", "Pension")]
    assert rows[0]["source_id"] == hashlib.sha1(b"https://x.org/a/bChefOslo").hexdigest()[:16]
    assert pages.heading_jobs(parse(spark, "<h2>Team</h2><h3>Chef</h3>")).count() == 0


def test_hologic_both_layouts(spark):
    boxed = "<li><h3>Chef</h3>Oslo <a href='/1'>View Details</a></li><h2>Up</h2><p><a href='/2'>view detail</a></p>"
    loose = "<h3>Baker</h3><p>x</p><a href='/3'>See details</a>"
    rows = links.hologic_jobs(parse(spark, boxed, loose)).orderBy("url").collect()
    assert [(r["title"], r["location"]) for r in rows] == [("Chef", "Oslo"), ("Up", ""), ("Baker", "")]


def test_indigo_climbs_six_levels(spark):
    near = "<div><h3>Chef</h3><p><span><a href='/job-application/1'>Apply here</a></span></p></div>"
    far = "<section><h3>Far</h3>" + "<i>" * 7 + "<a href='/job-application/2'></a>" + "</i>" * 7 + "</section>"
    rows = links.indigo_jobs(parse(spark, near, far), details(spark, {"none": ""})).collect()
    assert [r["title"] for r in rows] == ["Chef"]


def test_adaptive_prefers_jsonld(spark):
    job = json.dumps({"@type": "JobPosting", "title": "J", "url": "https://x/1", "employmentType": "FULL_TIME"})
    card = "<li><h3>Card title</h3> in Seattle <a href='/career/9'>Learn more</a></li><li><a href='/career'>Careers</a></li>"
    both = links.adaptive_jobs(parse(spark, f'<script type="application/ld+json">{job}</script>' + card), "https://s.com").collect()
    assert [(r["title"], r["source_id"], r["employment_type"]) for r in both] == [("J", "1", "FULL_TIME")]
    only = links.adaptive_jobs(parse(spark, card), "https://s.com").collect()
    assert [(r["title"], r["url"], r["source_id"], r["description"]) for r in only] == [
        ("Card title", "https://s.com/career/9", "9", "Card title in Seattle Learn more")]


def test_eligo(spark):
    html = ("<h2>Current Job Openings</h2><h3>Genetic engineering</h3><h3>Chef</h3><p>Full time, PARIS</p><h3>Baker</h3><div>Lyon <a href='/d'>DETAILS</a></div>"
            "<h3>Closed</h3><p>no</p><a href='https://eligo.breezy.hr/p/1'>go</a>")
    rows = links.eligo_jobs(parse(spark, html)).orderBy("capture_seq").collect()
    # A heading without its own details link takes the next one on the page; its second use is a copy.
    assert [(r["title"], r["location"], r["url"]) for r in rows] == [
        ("Chef", "Paris", "https://x.org/d"), ("Closed", "Paris", "https://eligo.breezy.hr/p/1")]
    plain = links.eligo_jobs(parse(spark, "<h2>Current job openings</h2><h3>A B</h3>Full Time <h3>C</h3>no")).collect()
    assert [(r["title"], r["location"], r["url"]) for r in plain] == [("A B", "", "https://x.org/a/b#a-b")]


def test_adp_cards(spark):
    text = ("Home Current Openings (2 of 2) Search Senior Scientist San Diego, CA, US 19 days agoFull Time Regulatory Director - La Jolla, CA, US "
            "30+ Privacy | x")
    df = spark.createDataFrame([("c", "https://a", text)], "company string, page_url string, text string")
    rows = pages.card_segments(df).orderBy("capture_seq").collect()
    # Without punctuation between them, the words of a title belong to the place, as in the pattern itself.
    assert [r["location"] for r in rows] == [r["location"] for r in rows if r["location"].endswith(", CA, US")]
    clear = ("Current Openings (2 of 2) Search Scientist 1 | San Diego, CA, US 19 days agoFull Time Regulatory Director (2) La Jolla, CA, US 30 Copyright")
    df = spark.createDataFrame([("c", "https://a", clear)], "company string, page_url string, text string")
    rows = pages.card_segments(df).orderBy("capture_seq").collect()
    assert [(r["title"], r["location"]) for r in rows] == [("Scientist 1", "San Diego, CA, US"), ("Regulatory Director (2)", "La Jolla, CA, US")]


def test_seed_titles_and_cards(spark):
    texts = spark.createDataFrame([("c", "u", "We seek a CHEF now")], "company string, page_url string, text string")
    seeds = spark.createDataFrame([("c", "Chef", "Here", 1), ("c", "Baker", "", 2), ("d", "Chef", "", 3)], "company string, title string, default_location string, seq long")
    assert [(r["title"], r["location"]) for r in pages.seed_title_jobs(texts, seeds).collect()] == [("Chef", "Here")]
    html = "<div class='card x' data-l=' Oslo '><b class='t'>A  b</b><a href='/1'>go</a><p class='d'>D</p></div><div class='card'><a>none</a></div>"
    rows = pages.card_fields(parse(spark, html), "card", title_class="t", description_class="d", location_attribute="data-l").collect()
    assert [(r["title"], r["url"], r["description"], r["location"]) for r in rows] == [("A b", "https://x.org/1", "D", "Oslo")]


def test_length_rules_are_parameters(spark):
    site = "https://acme.rec.pro.ultipro.com/b"
    html = '<a href="https://recruiting.ultipro.com/JobDetails/1">QA</a><a href="https://recruiting.ultipro.com/JobDetails/2">Chemist</a>'
    found, facts = anchors(spark, html, url=site), details(spark, {})
    assert [t for t, _ in titles(links.ultipro_jobs(found, facts))] == ["Chemist"]
    assert [t for t, _ in titles(links.ultipro_jobs(found, facts, min_label=0))] == ["QA", "Chemist"]

    cards = parse(spark, '<div><a href="/job/1">QA</a></div><div><a href="/job/2">Apply now</a><h3>Lead chemist</h3></div>')
    assert links.adaptive_jobs(cards, "https://s.com").count() == 0
    got = links.adaptive_jobs(cards, "https://s.com", min_card=0, chrome_card=0)
    assert sorted(t for t, _ in titles(got)) == ["Lead chemist", "QA"]


def test_headings_parse_pages_once(spark):
    from pyspark.sql import functions as F

    page = "<h2>Open positions</h2><h3>Chemist</h3><p>Oslo</p><h3>Chemist</h3><p>Bergen</p>"
    df = spark.createDataFrame([("c", "https://x.org/a", 0, page), ("c", "https://x.org/a", 0, page), ("d", "https://x.org/b", 0, "<p>none</p>")], PAGE)
    jobs = pages.heading_jobs(dom.parse_pages(df))
    plan = jobs._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "MapInPandas" not in plan
    rows = jobs.select("company", "title", "location", F.length("description").alias("n")).collect()
    assert [(r["company"], r["title"], r["location"]) for r in rows] == [("c", "Chemist", "Oslo")] and rows[0]["n"] > 20


def test_plain_tags_are_read_without_the_parser(spark, monkeypatch):
    from html.parser import HTMLParser

    class Slow(dom._PageReader):
        parse_starttag = HTMLParser.parse_starttag

    def read(reader, *htmls):
        found = dom._Nodes()
        for html in htmls:
            monkeypatch.setattr(dom, "_PageReader", reader)
            assert dom._read_page(found, html, "https://x.org/a/b") is None
            monkeypatch.undo()
        return [column.to_pylist() for column in found.arrays()]

    plain = "<ul>" + "<li class='x'><a href='/jobs/1'>A &amp; B</a> <b>c</b></li>\n" * 50 + "</ul>"
    odd = (
        "<H1>a</H1><a HREF='/x' href='/y'>b</A>c<br>d</br><img src='/i'></img><script type='application/ld+json'>{'<a>'}</script><title>t<b>u</b></title>"
        "<template><i>no</i>no</template>z<a href=\"?q&amp;r\">e</a><a href='/s'/>f<p>1 < 2 & 3</p></p><!-- <a> --><rt>g</rt><rt>h<i>j</i></rt><h2></h2>"
        "<iframe src='https://b.com/1'></iframe><div><a name='n'> </a><article><a href='../u'>k</a>l")
    assert read(dom._PageReader, plain, odd, "", plain + odd) == read(Slow, plain, odd, "", plain + odd)

    asked = []
    monkeypatch.setattr(HTMLParser, "check_for_whole_start_tag", lambda self, i: asked.append(i))
    read(dom._PageReader, plain)
    assert asked == []


def test_plain_words_need_no_pattern(spark):
    from pyspark.sql import functions as F

    pattern = "(?iuUd)(kis|data kiss|/job/)"
    letters = [*map(chr, range(1, 0xD800)), chr(0x1F600)]
    rows = [(text,) for c in letters for text in (c + "is", "k" + c + "s", "ki" + c)] + [("x/JOB/",), ("DATA KIS",), ("",), (None,)]
    df = spark.createDataFrame(rows, "text string")
    same = df.filter(~F.col("text").rlike(pattern).eqNullSafe(links.has_word(F.col("text"), pattern)))
    assert same.collect() == []
    assert df.filter(links.has_word(F.col("text"), pattern)).count() == df.filter(F.col("text").rlike(pattern)).count() > 3

    parsed = parse(spark, "<a href='/jobs/1'>Chemist</a>")
    for found in (links.embedded_boards(parsed), links.entry_links(dom.page_links(parsed, ["company", "page_url", "page_no"]))):
        assert "RLIKE" not in found._jdf.queryExecution().executedPlan().toString()


def test_entry_links_of_companies_with_many_job_links(spark):
    jobs = "".join(f"<a href='/jobs/{i}'>Chemist {i}</a>" for i in range(50))
    df = spark.createDataFrame([
        ("c", "https://x.org/", 0, "<a href='/o'>View all jobs</a>" + jobs), ("c", "https://x.org/", 1, "<a href='/p'>Open roles now</a>"),
        ("d", "https://y.org/", 0, "<a href='/o'>View all jobs</a><a href='http://[x'>Open roles now</a><a href='/o'>Search jobs</a>")], PAGE)
    found = links.entry_links(dom.page_links(dom.parse_pages(df), ["company", "page_url", "page_no"])).orderBy("rank")
    assert found.columns == ["company", "url", "label", "page_no", "seq", "rank"]
    assert [(r["company"], r["url"], r["label"]) for r in found.collect()] == [
        ("d", "https://y.org/o", "View all jobs"), ("d", None, "Open roles now")]

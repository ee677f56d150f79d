"""Pages as tables of elements. The only Python in it is one Arrow job that tokenizes HTML.

The job turns a page into one row with two arrays in document order: ``elements`` and ``texts`` (the
visible text nodes, trimmed). An element knows its parent, its last descendant and its range of texts, so
text, siblings and neighbours are built-in array expressions on that row: no operator on pages needs a
shuffle, however many pages a board has. ``elements[seq]`` is a direct lookup, and an element knows the headings before it
and the link after it, so work on a page grows with its length.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from vacantia.functions.text import let

# Fixed values of HTML: elements without content, and elements whose text is not page text.
VOID_ELEMENTS = frozenset(
    "area base br col embed hr img input keygen link menuitem meta param source track wbr "
    "basefont bgsound command frame image isindex nextid spacer".split()
)
HIDDEN_ELEMENTS = frozenset(("script", "style", "template", "rt", "rp"))
BOX_ELEMENTS = frozenset(("article", "li", "div"))
JSON_LD = "application/ld+json"

ELEMENT_TYPE = (
    "struct<seq:int,parent:int,last:int,box:int,tag:string,attrs:map<string,string>,"
    "text_from:int,text_to:int,own:string,link:string,next_link:int,heads:array<int>>"
)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_LEVEL = {tag: level for level, tag in enumerate(HEADINGS)}

# Plain links, which need no resolving: without dot segments, empty queries and fragments.
_SITE = re.compile(r"https?://[A-Za-z0-9.:-]+(?=[/?#]|$)")
_ABSOLUTE = re.compile(r"https?://[A-Za-z0-9.:-]+/[A-Za-z0-9_/=&%+~-]*(?:\?[A-Za-z0-9_/=&%+~.-]+)?")
_ROOTED = re.compile(r"/(?!/)[A-Za-z0-9_/=&%+~-]*(?:\?[A-Za-z0-9_/=&%+~.-]+)?")
#: A plain tag and the text up to the next one: ASCII names, quoted values without references. If the element ends there, its end
#: tag and the text behind it belong to the match. All else is left to the parser.
_PLAIN = re.compile(
    r"<(?:(?P<tag>[A-Za-z][A-Za-z0-9]*)((?:[ \t\r\n]+[A-Za-z][A-Za-z0-9_:.-]*=(?:\"[^\"<>&]*\"|'[^'<>&]*'))*+)[ \t\r\n]*"
    r"|/([A-Za-z][A-Za-z0-9]*))>([^<]*+)(?:</(?P=tag)>([^<]*+))?+(?=<)")
_PLAIN_ATTRIBUTE = re.compile(r"([A-Za-z][A-Za-z0-9_:.-]*)=(?:\"([^\"]*)\"|'([^']*)')")
#: Elements after whose start tag the parser reads text by other rules.
_RAW_ELEMENTS = frozenset(
    (*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"))
_NO_ATTRIBUTES: dict[str, str] = {}
#: Pages per output batch; bounds the Python worker's memory.
_BATCH_PAGES = 200


class _Nodes:
    """Elements and texts of a batch of pages, column by column; ``starts`` mark where a page begins."""

    def __init__(self):
        self.parent, self.last, self.box, self.tag = [], [], [], []
        self.text_from, self.text_to, self.link = [], [], []
        self.attr_names, self.attr_values, self.attr_starts = [], [], [0]
        #: The next anchor with a target, and the row of ``head_rows`` with the last heading of each level before the element (0: none).
        self.next_link, self.heads, self.head_rows = [], [], [(0,) * len(HEADINGS)]
        self.texts, self.starts, self.text_starts = [], [0], [0]
        #: Text of JSON-LD scripts by row.
        self.own = {}

    def sizes(self) -> dict[str, int]:
        return {name: len(column) for name, column in vars(self).items() if name != "own"}

    def cut(self, sizes: dict[str, int]) -> None:
        """Forget what came after ``sizes`` were taken."""
        for name, size in sizes.items():
            del getattr(self, name)[size:]
        self.own = {at: text for at, text in self.own.items() if at < sizes["tag"]}

    def arrays(self) -> tuple[pa.Array, pa.Array]:
        starts = np.array(self.starts, np.int32)
        seq = np.arange(1, len(self.tag) + 1, dtype=np.int32) - np.repeat(starts[:-1], np.diff(starts))
        numbers = [pa.array(seq), *[pa.array(c, pa.int32()) for c in (self.parent, self.last, self.box)]]
        attrs = pa.MapArray.from_arrays(
            pa.array(self.attr_starts, pa.int32()), pa.array(self.attr_names, pa.string()), pa.array(self.attr_values, pa.string()))
        ranges = [pa.array(c, pa.int32()) for c in (self.text_from, self.text_to)]
        own = [None] * len(self.tag)
        for at, text in self.own.items():
            own[at] = text
        ends = [pa.array(c, pa.string()) for c in (own, self.link)]
        names = ["seq", "parent", "last", "box", "tag", "attrs", "text_from", "text_to", "own", "link", "next_link", "heads"]
        heads = np.array(self.head_rows, np.int32)[np.array(self.heads, np.int64)]
        near = [pa.array(self.next_link, pa.int32()), pa.ListArray.from_arrays(
            pa.array(np.arange(0, heads.size + 1, len(HEADINGS), dtype=np.int32)), pa.array(heads.ravel()))]
        elements = pa.StructArray.from_arrays([*numbers, pa.array(self.tag, pa.string()), attrs, *ranges, *ends, *near], names=names)
        return (pa.ListArray.from_arrays(pa.array(starts), elements),
                pa.ListArray.from_arrays(pa.array(self.text_starts, pa.int32()), pa.array(self.texts, pa.string())))


class _PageReader(HTMLParser):
    """Appends the elements and text nodes of one page to ``nodes``.

    Runs of plain tags are read by one pattern, since the parser's own steps cost several times as much; every other token goes
    through the parser.
    """

    def __init__(self, nodes: _Nodes, base_url: str | None):
        super().__init__(convert_charrefs=True)
        self.nodes, self.base_url = nodes, base_url or ""
        site = _SITE.match(self.base_url)
        self._site = site.group() if site else ""
        self._start, self._text_start = len(nodes.tag), len(nodes.texts)
        self._open, self._open_tags, self._buffer, self._hidden = [], Counter(), [], 0
        #: Row of the last heading of each level.
        self._heads = 0

    def _flush(self):
        if not self._buffer:
            return
        text = "".join(self._buffer)
        self._buffer.clear()
        if self._hidden:
            at = self._open[-1]
            if at in self.nodes.own:
                self.nodes.own[at] += text
        else:
            text = text.strip()
            if text:
                self.nodes.texts.append(text)

    def _link(self, attrs):
        if "href" not in attrs and "src" not in attrs:
            return None
        target = attrs.get("href") or attrs.get("src") or ""
        if target.startswith("/"):
            if self._site and _ROOTED.fullmatch(target):
                return self._site + target
        elif _ABSOLUTE.fullmatch(target):
            return target
        try:
            return urljoin(self.base_url, target)
        except ValueError:
            return None

    def parse_starttag(self, i):
        rawdata, plain, buffer, texts = self.rawdata, _PLAIN.match, self._buffer, self.nodes.texts
        start = i
        while token := plain(rawdata, i):
            tag, attrs, closed, text, behind = token.groups()
            if tag is None:
                self.handle_endtag(closed.lower())
            else:
                tag = tag.lower()
                if tag in _RAW_ELEMENTS:
                    break
                attrs = {name.lower(): one or other for name, one, other in _PLAIN_ATTRIBUTE.findall(attrs)} if attrs else _NO_ATTRIBUTES
                if behind is None or tag in VOID_ELEMENTS:
                    self._element(tag, attrs)
                    if behind is not None:
                        # The end tag of a void element ends nothing.
                        if text:
                            buffer.append(unescape(text))
                        self.handle_endtag(tag)
                        text = behind
                else:
                    # An element without elements is neither opened nor closed.
                    at = self._element(tag, attrs, leaf=True)
                    if text and not self._hidden and tag not in HIDDEN_ELEMENTS:
                        text = (unescape(text) if "&" in text else text).strip()
                        if text:
                            texts.append(text)
                            self.nodes.text_to[at] += 1
                    text = behind
            if text:
                buffer.append(unescape(text) if "&" in text else text)
            i = token.end()
        return i if i > start else super().parse_starttag(i)

    def handle_starttag(self, tag, attrs):
        self._element(tag, {k: v or "" for k, v in attrs})

    def _element(self, tag, attrs, leaf=False):
        if self._buffer:
            self._flush()
        nodes = self.nodes
        at, texts = len(nodes.tag), len(nodes.texts) - self._text_start
        seq = at - self._start + 1
        nodes.last.append(seq)
        if self._open:
            around = self._open[-1]
            parent = around - self._start + 1
            nodes.parent.append(parent)
            # The innermost open article, list item or division.
            nodes.box.append(parent if nodes.tag[around] in BOX_ELEMENTS else nodes.box[around])
        else:
            nodes.parent.append(0)
            nodes.box.append(0)
        nodes.tag.append(tag)
        nodes.text_from.append(texts)
        nodes.text_to.append(texts)
        if tag == "script" and attrs.get("type") == JSON_LD:
            nodes.own[at] = ""
        nodes.heads.append(self._heads)
        if tag == "a":
            nodes.link.append(self._link(attrs))
            if "href" in attrs:
                nodes.next_link.extend([seq] * (at - len(nodes.next_link)))
        else:
            nodes.link.append(self._link(attrs) if tag == "iframe" else None)
            if tag in _LEVEL:
                row = list(nodes.head_rows[self._heads])
                row[_LEVEL[tag]] = seq
                self._heads = len(nodes.head_rows)
                nodes.head_rows.append(tuple(row))
        if attrs:
            nodes.attr_names.extend(attrs)
            nodes.attr_values.extend(attrs.values())
        nodes.attr_starts.append(len(nodes.attr_names))
        if not leaf and tag not in VOID_ELEMENTS:
            self._open.append(at)
            self._open_tags[tag] += 1
            self._hidden += tag in HIDDEN_ELEMENTS
        return at

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._buffer:
            self._flush()
        if self._open_tags.get(tag):
            while self._close() != tag:
                pass

    def _close(self):
        nodes, at = self.nodes, self._open.pop()
        tag = nodes.tag[at]
        nodes.last[at], nodes.text_to[at] = len(nodes.tag) - self._start, len(nodes.texts) - self._text_start
        self._open_tags[tag] -= 1
        self._hidden -= tag in HIDDEN_ELEMENTS
        return tag

    def handle_data(self, data):
        self._buffer.append(data)

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def unknown_decl(self, data):
        self._flush()

    def read(self, html: str):
        self.feed(html)
        self.close()
        self._flush()
        while self._open:
            self._close()
        self.nodes.next_link.extend([0] * (len(self.nodes.tag) - len(self.nodes.next_link)))


def _read_page(nodes: _Nodes, html: str, base_url: str | None) -> str | None:
    """Append a page; a page that the tokenizer cannot read is empty, and the reason is returned."""
    before, problem = nodes.sizes(), None
    try:
        _PageReader(nodes, base_url).read(html)
    except Exception as error:  # noqa: BLE001  whatever a page holds, it must not end the job
        nodes.cut(before)
        problem = f"{type(error).__name__}: {error}"
    nodes.starts.append(len(nodes.tag))
    nodes.text_starts.append(len(nodes.texts))
    return problem


def parse_pages(pages: DataFrame, html: str = "html", url: str = "page_url") -> DataFrame:
    """Replace the HTML column by ``elements``, ``texts`` and ``parse_error`` (null for pages that could be read); ``url`` is
    the base of relative links."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType(kept + T.StructType.fromDDL(f"elements array<{ELEMENT_TYPE}>, texts array<string>, parse_error string").fields)
    names = [f.name for f in kept]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _BATCH_PAGES):
                batch, nodes = whole.slice(start, _BATCH_PAGES), _Nodes()
                problems = [
                    _read_page(nodes, body or "", base) for body, base in zip(batch.column(html).to_pylist(), batch.column(url).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(n) for n in names], *nodes.arrays(), pa.array(problems, pa.string())],
                    names=[*names, "elements", "texts", "parse_error"])

    return pages.mapInArrow(parse, schema)


def page_errors(parsed: DataFrame) -> DataFrame:
    """(company, error) of the pages that could not be read."""
    return parsed.filter(F.col("parse_error").isNotNull()).select("company", F.col("parse_error").alias("error"))


def nodes(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """One row per element."""
    return parsed.select(*keys, F.explode("elements").alias("e")).select(*keys, "e.*")


def page_text(separator: str = " ") -> Column:
    return F.array_join("texts", separator)


def element_text(element: Column, separator: str = " ") -> Column:
    """Visible text of an element; most have one text or none, which needs no slice."""
    several = F.array_join(
        F.slice(F.col("texts"), element["text_from"] + 1, element["text_to"] - element["text_from"]), separator)
    return F.when(element["text_to"] == element["text_from"], F.lit("")).when(
        element["text_to"] == element["text_from"] + 1, F.get("texts", element["text_from"])).otherwise(several)


def attr(element: Column, name: str) -> Column:
    return F.try_element_at(element["attrs"], F.lit(name))


def has_class(element: Column, class_name: str) -> Column:
    return F.array_contains(F.split(F.coalesce(attr(element, "class"), F.lit("")), r"\s+"), class_name)


def find_all(*tags: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def first_of(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(1))


def last_of(elements: Column) -> Column:
    return F.try_element_at(elements, F.lit(-1))


def find_first(*tags: str) -> Column:
    return first_of(find_all(*tags))


def element(seq: Column) -> Column:
    """The element with this number; null when there is none."""
    return F.try_element_at(F.col("elements"), F.when(seq > 0, seq))


def inside(outer: Column, elements: Column) -> Column:
    """Those of ``elements`` that lie inside ``outer``."""
    return F.filter(elements, lambda e: (e["seq"] > outer["seq"]) & (e["seq"] <= outer["last"]))


def next_sibling(e: Column) -> Column:
    """The next element with the same parent: in document order, what follows the element's last descendant."""
    return let(element(e["last"] + 1), lambda n: F.when(n["parent"] == e["parent"], n))


def heading_before(e: Column, *tags: str) -> Column:
    """The last heading of these levels that starts before the element; found while the page was read, so a look-up."""
    found = [F.element_at(e["heads"], _LEVEL[tag] + 1) for tag in tags]
    return element(F.greatest(*found) if len(found) > 1 else found[0])


def link_after(e: Column) -> Column:
    """The first anchor with a target that starts after the element."""
    return element(e["next_link"])


def anchor_elements() -> Column:
    return F.filter("elements", lambda e: (e["tag"] == "a") & attr(e, "href").isNotNull())


def describe_each(items: Column, lists: dict[str, Column], describe: Callable[[Column, Column], Column]) -> Column:
    """``describe(item, bound)`` for every item; the lists to search are computed once and bound by name."""
    bound = F.struct(items.alias("_items"), *[lists[name].alias(name) for name in lists])
    return let(bound, lambda b: F.transform(b["_items"], lambda e: describe(e, b)))


def page_links(parsed: DataFrame, keys: list[str], lists: dict[str, Column] | None = None, **context) -> DataFrame:
    """One row per anchor: seq, href, link (absolute), label, and ``context`` computed from (anchor, lists)."""
    def describe(e: Column, bound: Column) -> Column:
        extra = [fn(e, bound).alias(name) for name, fn in context.items()]
        return F.struct(
            e["seq"].alias("seq"), attr(e, "href").alias("href"), e["link"].alias("link"),
            element_text(e).alias("label"), *extra)

    rows = parsed.select(*keys, F.explode(describe_each(anchor_elements(), lists or {}, describe)).alias("a"))
    return rows.select(*keys, "a.*")


def outline(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Headings with the anchor that follows each of them."""
    def describe(h: Column, bound: Column) -> Column:
        return let(link_after(h), lambda after: F.struct(
            h["seq"].alias("seq"), h["tag"].alias("tag"), element_text(h).alias("title"),
            attr(after, "href").alias("next_href"), element_text(after).alias("next_label")))

    heads = describe_each(find_all(*HEADINGS), {}, describe)
    rows = parsed.select(*keys, F.explode(heads).alias("h"))
    return rows.select(*keys, "h.*")

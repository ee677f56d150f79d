"""String helpers shared by all operators; every one is a built-in Spark expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from html.entities import html5

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def compute_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add costly columns so that later filters on them do not compute them a second time.

    The optimizer moves a filter below a projection by repeating its expressions; it does not move one below
    a generator, so the columns are generated as one row of one struct.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [F.col(name) for name in df.columns if name not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def squash_ws(col: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)\s+", " "))


def strip(col: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), r"(?U)^\s+|\s+$", "")


def non_empty(col: Column) -> Column:
    """Empty text as null, so that ``coalesce`` acts like Python's ``or``."""
    return F.when(col != "", col)


def first_non_empty(*cols: Column) -> Column:
    return F.coalesce(*[non_empty(c) for c in cols], F.lit(""))


def slug(col: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), F.lit("-"))


def synthetic_id(url: Column, length: int = 20) -> Column:
    """Leading hex digits of the URL's SHA-1."""
    return F.substring(F.sha1(url.cast("binary")), 1, length)


def heading_url(page_url: Column, title: Column) -> Column:
    return F.concat(page_url, F.lit("#"), slug(title))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def last_path_part(url: Column) -> Column:
    return F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)


def safe_number(col: Column) -> Column:
    """Tolerant number: blank or unreadable text is 0."""
    return F.coalesce(F.trim(col).try_cast("double"), F.lit(0.0))


def html_escape(col: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


#: HTML names that count without a semicolon too, longest first.
_BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|(?:" + "|".join(_BARE_NAMES) + "))"


def _windows_character(code: int) -> str:
    """What HTML makes of the codes 128 to 159."""
    try:
        return bytes([code]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(code)


def _numbered(code: Column) -> Column:
    """The character of a code point as HTML reads it: no code kills the job."""
    windows = F.array(*[F.lit(_windows_character(c)) for c in range(128, 160)])
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    control = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127)
    none = control | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(code.isNull() | (code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(code.between(128, 159), F.try_element_at(windows, (code - 127).cast("int")))
        .when(none, F.lit("")).otherwise(plain))


def html_unescape(col: Column) -> Column:
    """Character references to characters, as HTML 5 reads them.

    The text is split at its references once and joined with their values, so nothing is unescaped twice.
    """
    # One literal that Spark folds to a map; the separators occur in no name and no value.
    names = F.str_to_map(F.lit("\u0001".join(f"{n}\u0002{c}" for n, c in html5.items())), F.lit("\u0001"), F.lit("\u0002"))
    bare = r"^&(" + "|".join(_BARE_NAMES) + ")"

    def number(digits: Column, base: int) -> Column:
        # More digits than any code point has: out of range whatever they are.
        return let(F.regexp_replace(digits, "^0+", ""), lambda short: F.when(F.length(short) <= 7, F.coalesce(
            F.conv(F.when(short == "", F.lit("0")).otherwise(short), base, 10).cast("bigint"), F.lit(0))))

    def named(ref: Column) -> Column:
        prefix = F.regexp_extract(ref, bare, 1)
        return F.coalesce(
            F.try_element_at(names, F.substr(ref, F.lit(2))),
            F.when(prefix != "", F.concat(F.try_element_at(names, prefix), F.substr(ref, F.length(prefix) + 2))), ref)

    def value(ref: Column) -> Column:
        return (
            F.when(ref == "&amp;", F.lit("&")).when(ref == "&nbsp;", F.lit("\u00a0")).when(ref == "&lt;", F.lit("<")).when(ref == "&gt;", F.lit(">"))
            .when(ref.rlike("^&#[xX]"), let(number(F.regexp_extract(ref, "([0-9a-fA-F]+);?$", 1), 16), _numbered))
            .when(ref.startswith("&#"), let(number(F.regexp_extract(ref, "([0-9]+);?$", 1), 10), _numbered))
            .otherwise(named(ref)))

    def resolve(text: Column) -> Column:
        values = F.transform(F.regexp_extract_all(text, F.lit(_REFERENCE), F.lit(0)), value)
        pieces = F.split(text, _REFERENCE, -1)
        joined = F.array_join(F.zip_with(pieces, values, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
        return F.when(text.contains("&"), joined).otherwise(text)

    return let(col, resolve)


#: Elements whose text is not page text, and comments.
_HIDDEN = r"(?is)<!--.*?-->|<(script|style|template|rt|rp)\b[^>]*+>.*?</\1\s*>"
#: A tag, a declaration or a processing instruction; quoted attribute values may hold '>'.
_TAG = (
    r"""</?[A-Za-z][^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
    r"""|<![^>]*+>|<\?[^>]*+>"""
)


def _text_nodes(html: Column) -> Column:
    """The raw text nodes of a fragment in one text; U+0001 cannot occur in a document, so one unescape pass serves all."""
    return F.array_join(F.split(F.regexp_replace(html, _HIDDEN, "<br>"), _TAG), "\u0001")


def _readable(nodes: Column) -> Column:
    trimmed = F.transform(F.split(nodes, "\u0001"), strip)
    return F.array_join(F.filter(trimmed, lambda p: p != ""), " ")


def fragment_text(col: Column) -> Column:
    """Readable text of an HTML fragment: text nodes trimmed, empty ones dropped, joined by a blank."""
    return _readable(html_unescape(_text_nodes(F.coalesce(col, F.lit("")))))


def fragment_or_plain(col: Column) -> Column:
    """Readable text of what may be a fragment or plain text with character references, unescaped in one pass."""
    value = F.coalesce(col, F.lit(""))
    is_html = value.contains("<") & value.contains(">")
    raw = html_unescape(F.when(is_html, _text_nodes(value)).otherwise(value))
    return let(raw, lambda r: F.when(is_html, _readable(r)).otherwise(F.replace(r, F.lit("\u00a0"), F.lit(" "))))


def element_html(html: Column, class_name: str) -> Column:
    """Inner HTML of the first element that carries ``class_name``; null when there is none."""
    opener = (
        r"""(?is)<([A-Za-z][A-Za-z0-9]*)\b[^>]*?\bclass\s*=\s*["'](?:[^"']*\s)?"""
        + class_name + r"""(?:\s[^"']*)?["'][^>]*>"""
    )

    def inner(opened: Column) -> Column:
        tag = F.regexp_extract(opened, opener, 1)
        return let(
            F.struct(F.substr(html, F.instr(html, opened) + F.length(opened)).alias("rest"),
                     F.concat(F.lit("(?i)</?"), tag, F.lit(r"\b[^>]*>")).alias("same_tag")),
            lambda s: _until_closed(s["rest"], F.regexp_extract_all(s["rest"], s["same_tag"], F.lit(0))))

    return F.when(
        html.contains(class_name), let(F.regexp_extract(html, opener, 0), lambda o: F.when(o != "", inner(o))))


def _until_closed(rest: Column, tags: Column) -> Column:
    """The part of ``rest`` before the tag that closes the element just opened; ``tags`` are those of its name."""
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("depth"), F.lit(0).alias("end"))

    def step(acc: Column, tag: Column) -> Column:
        here = F.position(tag, rest, acc["at"])
        depth = acc["depth"] + F.when(tag.startswith("</"), F.lit(-1)).otherwise(F.lit(1))
        return F.struct(
            (here + F.length(tag)).cast("int").alias("at"),
            depth.cast("int").alias("depth"),
            F.when((acc["end"] == 0) & (depth == 0), here).otherwise(acc["end"]).cast("int").alias("end"),
        )

    return let(F.aggregate(tags, start, step)["end"],
               lambda end: F.when(end > 0, F.substr(rest, F.lit(1), end - 1)).otherwise(rest))

"""Repair of locations that a board delivered as numbers, blanks or URL segments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from vacantia.functions.text import last_path_part, non_empty, strip, url_path

# What counts as evidence of a location.
PATH_SEGMENT = r"/job/([^/]+)/[^/]+$"
SEGMENT_NAMES_PLACE = r"(?iuUd)(?:US|United[- ]States|Remote|CA|California)"
DESCRIPTION_PLACES = (
    r"(?iuUd)located in\s+((?:US|United States)\s*-\s*[A-Z]{2}\s*-\s*[A-Za-z .-]+)",
    r"(?iuUd)locations?\s+((?:US|United States)\s*-\s*[A-Z]{2}\s*-\s*[A-Za-z .-]+)",
    r"(?iuUd)\b(US\s*-\s*Remote)\b",
)


def is_malformed(value: Column) -> Column:
    text = strip(value)
    return (
        (text == "")
        | text.rlike(r"(?U)\A[\d.,;:+_-]+\z")
        | ((F.length(text) <= 2) & ~text.rlike("[A-Za-z]{2}"))
    )


def from_path(path: Column) -> Column:
    """Location written into a job path such as ``/job/US---CA---San-Diego/x``."""
    segment = strip(F.regexp_extract(F.coalesce(path, F.lit("")), PATH_SEGMENT, 1))
    spaced = F.replace(
        F.replace(F.replace(segment, F.lit("---"), F.lit(" - ")), F.lit("--"), F.lit(" - ")),
        F.lit("_"), F.lit(" "))
    lone_dash = F.regexp_replace(spaced, r"(?U)(?<!\s)-(?!\s)", " ")
    text = F.btrim(F.regexp_replace(lone_dash, r"(?U)\s+", " "), F.lit(" -"))
    return F.when(segment.rlike(SEGMENT_NAMES_PLACE), text).otherwise(F.lit(""))


def from_description(description: Column) -> Column:
    text = F.coalesce(description, F.lit(""))
    found = [non_empty(F.regexp_extract(text, pattern, 1)) for pattern in DESCRIPTION_PLACES]
    return F.btrim(F.regexp_replace(F.coalesce(*found, F.lit("")), r"(?U)\s+", " "), F.lit(" ."))


def normalize_location(value: Column, path: Column, description: Column) -> Column:
    """The board's value if usable, else the path's, else the description's, else empty."""
    return F.when(~is_malformed(value), strip(value)).otherwise(
        F.coalesce(non_empty(from_path(path)), from_description(description)))


def slug_title(url: Column) -> Column:
    """Readable title from the last part of a job URL, without a requisition suffix."""
    tail = F.coalesce(last_path_part(url_path(url)), F.lit(""))
    bare = F.regexp_replace(tail, r"(?i)_((?:R|JR)\d+[A-Za-z0-9-]*)$", "")
    return strip(F.regexp_replace(bare, "[-_]+", " "))

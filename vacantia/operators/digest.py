"""Digest of new matches: tiers, plain lines and HTML cards, one text row per posting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vacantia.functions.text import html_escape, non_empty
from vacantia.operators.scoring import match_reasons
from vacantia.schemas import text_or_empty

# Tier limits and their captions, in print order.
TIERS = (("Exceptional", 85, "85–100"), ("Strong", 75, "75–84"), ("Review", 0, "65–74"))
UNTITLED, NO_COMPANY, NO_LOCATION, NO_PAY = "Untitled role", "Unknown company", "Location not listed", "Not listed"


def digest_score(df: DataFrame) -> Column:
    """Whole-number score of a report row read back as text.

    A missing or blank ``total`` is 0; ``score`` counts only where ``total`` is unreadable.
    """
    if "total" not in df.columns:
        return F.lit(0)
    readable = [F.coalesce(non_empty(F.col(name).cast("string")), F.lit("0")).try_cast("double")
                for name in ("total", "score") if name in df.columns]
    return F.coalesce(*readable, F.lit(0.0)).cast("int")


def _tier(score: Column, pick: int) -> Column:
    (top, top_limit, _), (middle, middle_limit, _), _last = TIERS
    return (
        F.when(score >= top_limit, F.lit(TIERS[0][pick]))
        .when(score >= middle_limit, F.lit(TIERS[1][pick]))
        .otherwise(F.lit(TIERS[2][pick]))
    )


def with_tier(rows: DataFrame) -> DataFrame:
    """Add ``digest_score``, ``tier``, ``tier_caption`` and ``tier_order``."""
    scored = rows.withColumn("digest_score", digest_score(rows))
    score = F.col("digest_score")
    order = F.when(score >= TIERS[0][1], F.lit(1)).when(score >= TIERS[1][1], F.lit(2)).otherwise(F.lit(3))
    return scored.withColumns({"tier": _tier(score, 0), "tier_caption": _tier(score, 2), "tier_order": order})


def digest_tiers(rows: DataFrame) -> DataFrame:
    """Tier sizes and captions in print order; empty tiers are left out."""
    return (
        with_tier(rows).groupBy("tier_order", "tier", "tier_caption")
        .agg(F.count("*").alias("roles"), F.max("digest_score").alias("best_score"))
        .orderBy("tier_order")
    )


def in_digest_order(rows: DataFrame) -> DataFrame:
    """Rows by tier, then score descending; equal scores keep their listing order, which repeats across companies, so company
    and posting decide the rest."""
    more = [c for c in ("company", "source", "source_id", "url") if c in rows.columns]
    return with_tier(rows).orderBy("tier_order", F.desc("digest_score"), "capture_seq", *more)


def digest_lines(rows: DataFrame) -> DataFrame:
    """The plain-text block of each posting in column ``block``, its lines separated by ``\\n``."""
    why = F.array_join(match_reasons(), " · ")
    location = F.coalesce(non_empty(text_or_empty("location")), F.lit(NO_LOCATION))
    pay = F.coalesce(non_empty(text_or_empty("compensation")), F.lit(NO_PAY))
    block = F.concat(
        F.col("digest_score").cast("string"), F.lit(" — "), F.coalesce("company", F.lit(NO_COMPANY)),
        F.lit(" — "), F.coalesce("title", F.lit(UNTITLED)),
        F.lit("\n   "), location, F.lit(" · Compensation: "), pay,
        F.when(why != "", F.concat(F.lit("\n   Why: "), why)).otherwise(F.lit("")),
        F.when(text_or_empty("url") != "", F.concat(F.lit("\n   "), F.col("url"))).otherwise(F.lit("")),
        F.lit("\n"),
    )
    return in_digest_order(rows).withColumn("block", block)


def digest_cards(rows: DataFrame) -> DataFrame:
    """The HTML card of each posting in column ``card``; all values are escaped."""
    why = F.array_join(F.transform(match_reasons(), html_escape), " · ")
    company = html_escape(F.coalesce("company", F.lit(NO_COMPANY)))
    title = html_escape(F.coalesce("title", F.lit(UNTITLED)))
    location = html_escape(F.coalesce(non_empty(text_or_empty("location")), F.lit(NO_LOCATION)))
    pay = html_escape(F.coalesce(non_empty(text_or_empty("compensation")), F.lit(NO_PAY)))
    url = html_escape(text_or_empty("url"))
    link = F.when(
        url != "", F.concat(F.lit('<a href="'), url, F.lit('" style="font-weight:600">View posting</a>'))
    ).otherwise(F.lit(""))
    reasons = F.when(why != "", F.concat(
        F.lit("<div style=\"color:#555;margin-top:5px;font-size:13px\"><strong>Why:</strong> "), why, F.lit("</div>"))
    ).otherwise(F.lit(""))
    card = F.concat(
        F.lit("<div style='margin:0 0 10px 0;padding:11px 13px;border:1px solid #ddd;border-radius:7px'>"
              "<div style='font-size:16px;font-weight:700'>"),
        F.col("digest_score").cast("string"), F.lit(" · "), company,
        F.lit("</div><div style='font-size:15px;margin-top:2px'>"), title,
        F.lit("</div><div style='color:#555;margin-top:5px;font-size:13px'>"), location,
        F.lit(" &nbsp;·&nbsp; Compensation: "), pay, F.lit("</div>"), reasons,
        F.lit("<div style='margin-top:6px;font-size:13px'>"), link, F.lit("</div></div>"),
    )
    return in_digest_order(rows).withColumn("card", card)


def plain_digest(rows: DataFrame) -> DataFrame:
    """The whole plain digest as ordered text rows (``position``, ``line``): head, tier titles, blocks."""
    blocks = digest_lines(rows)
    head = rows.agg(F.count("*").alias("n")).select(
        F.lit(0).alias("tier_order"), F.lit(0).alias("part"), F.lit(0).alias("neg_score"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.col("n").cast("string"), F.lit(" new biotech job match(es) scored 65 or higher:\n")).alias("line"))
    titles = with_tier(rows).select("tier_order", "tier").distinct().select(
        "tier_order", F.lit(0).alias("part"), F.lit(0).alias("neg_score"), F.lit(0).cast("bigint").alias("seq"),
        F.concat(F.upper("tier"), F.lit(" FIT\n"), F.repeat(F.lit("-"), F.length("tier") + 4)).alias("line"))
    body = blocks.select(
        "tier_order", F.lit(1).alias("part"), (-F.col("digest_score")).alias("neg_score"),
        F.col("capture_seq").alias("seq"), F.col("block").alias("line"))
    return head.unionByName(titles).unionByName(body).orderBy("tier_order", "part", "neg_score", "seq").select("line")

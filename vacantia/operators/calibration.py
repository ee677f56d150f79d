"""Back-test of scoring rules against human ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from vacantia.operators.scoring import Profile, with_score

MIN_RATED, MIN_POSITIVE = 25, 2


def backtest_rows(postings: DataFrame, ratings: DataFrame, old: Profile, new: Profile, keep: list[str]) -> DataFrame:
    """Old score, new score and rating per rated posting.

    Ratings are joined before scoring, so only rated postings run through the patterns.
    """
    rated = postings.join(ratings, "stable_key")
    before = with_score(rated, old).select(*rated.columns, F.col("total").alias("old_score"), F.col("band").alias("old_band"))
    after = with_score(before, new)
    rating_fields = [c for c in ratings.columns if c != "stable_key"]
    return after.select(
        "stable_key", *keep, *rating_fields, "old_score", "old_band",
        F.col("total").alias("new_score"), F.col("band").alias("new_band"))


def confusion(rows: DataFrame, dims: list[str], threshold: int, score: str = "new_score") -> DataFrame:
    """Hits and misses of "score >= threshold" against the wish to apply, per combination of ``dims``."""
    said, wanted = F.col(score) >= threshold, F.col("wanted")
    return rows.groupBy(*dims).agg(
        F.count("*").alias("rated"),
        F.count_if(said & wanted).alias("true_positive"),
        F.count_if(said & ~wanted).alias("false_positive"),
        F.count_if(~said & wanted).alias("false_negative"),
        F.count_if(~said & ~wanted).alias("true_negative"),
    )


def threshold_table(rows: DataFrame, score: str = "new_score") -> DataFrame:
    """Selected and wanted postings, precision and recall at every score that occurs.

    Rows are first counted per score (at most 101 values), so the ordered window is tiny.
    """
    per_score = rows.groupBy(F.col(score).alias("threshold")).agg(
        F.count("*").alias("n"), F.count_if(F.col("wanted")).alias("n_wanted"))
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    selected, wanted = F.sum("n").over(down), F.sum("n_wanted").over(down)
    return per_score.select(
        "threshold", selected.alias("selected"), wanted.alias("selected_wanted"),
        F.round(wanted / selected, 6).alias("precision"),
        F.round(wanted / F.nullif(F.sum("n_wanted").over(whole), F.lit(0)), 6).alias("recall"),
    )


def rating_coverage(ratings: DataFrame) -> DataFrame:
    """Whether there are enough ratings, positives and historical examples to calibrate on."""
    counted = ratings.agg(
        F.count("*").alias("rated"),
        F.count_if(F.col("wanted")).alias("positives"),
        F.count_if(~F.col("wanted")).alias("negatives"),
    )
    return counted.withColumns({
        "enough_rated": F.col("rated") >= MIN_RATED,
        "enough_positives": F.col("positives") >= MIN_POSITIVE,
    })

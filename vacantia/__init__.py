"""Posting analytics on Spark: normalize, enrich, score, track and report job postings."""

__version__ = "0.1.0"

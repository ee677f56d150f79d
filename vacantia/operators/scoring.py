"""Rule scoring: a profile becomes Column expressions, so a score is one projection without a join."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_
from typing import NamedTuple

import pandas as pd
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vacantia.functions.regex import FLAGS, PatternError, any_match, folded, java_pattern
from vacantia.functions.text import compute_once, strip
from vacantia.schemas import RULE_SCHEMA, text_or_empty

# Category caps, default band limits, version label, reason labels and limits.
CATEGORY_CAPS = {"domain_fit": 25, "technical_fit": 20, "operating_model_fit": 15, "leadership_fit": 10}
DEFAULT_BANDS = {"exceptional": 85, "strong": 75, "review": 65}
SCORING_VERSION = "food-biotech-v1"
REASONS = (
    ("role_fit", 30, "Target computational biology / bioinformatics role"),
    ("domain_fit", 25, "Strong scientific-domain match"),
    ("technical_fit", 20, "Strong technical overlap"),
    ("operating_model_fit", 15, "Applications / workflows / cross-functional product work"),
    ("leadership_fit", 10, "Technical / project / people leadership"),
)
REASON_MIN_FRACTION, REASON_LIMIT = 0.65, 3

COMPONENTS = [
    "role_fit", "domain_fit", "technical_fit", "operating_model_fit", "leadership_fit",
    "seniority_adjustment", "other_penalty", "location_fit",
]
CATEGORY_SECTIONS = {
    "domain_fit": "domain_rules", "technical_fit": "technical_rules",
    "operating_model_fit": "operating_model_rules", "leadership_fit": "leadership_rules",
}
PATTERN_SECTIONS = ("role_rules", "domain_rules", "technical_rules", "operating_model_rules",
                    "leadership_rules", "seniority_rules")
PENALTY_SLOTS = ("title_patterns", "text_patterns", "unless_title_patterns", "unless_text_patterns")
INTERACTION_SLOTS = ("all_title_pattern_groups", "all_text_pattern_groups")
READY_STATUS = "personalized_ready"
PROFILE_VARIABLE = "VACANTIA_PROFILE"

Profile = Mapping[str, object]
Rules = Sequence[Mapping[str, object]] | None


class RuleText(NamedTuple):
    """Text that rules are searched in, and its folded form if that is at hand."""

    text: Column
    folded: Column | None = None

    def has(self, patterns: Sequence[str] | None) -> Column:
        return any_match(patterns, self.text, self.folded)


def load_profile(path: str | None = None) -> dict:
    """Read a JSON or YAML profile; ``VACANTIA_PROFILE`` names the default file."""
    path = path or os.environ.get(PROFILE_VARIABLE, "")
    if not path:
        raise FileNotFoundError(f"give a profile path or set {PROFILE_VARIABLE}")
    with open(path, encoding="utf-8") as handle:
        if path.endswith(".json"):
            return json.load(handle) or {}
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML profiles need the yaml package; use JSON instead") from error
        return yaml.safe_load(handle) or {}


def first_match(text: RuleText, rules: Rules, value_key: str) -> Column:
    """Value of the first rule with a hit, else 0."""
    chain = None
    for rule in rules or []:
        hit = text.has(rule.get("patterns"))
        value = F.lit(int(rule.get(value_key, 0)))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(0) if chain is None else chain.otherwise(F.lit(0))


def _sum(terms: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0))


def category_score(text: RuleText, rules: Rules, cap: int) -> Column:
    """Sum of the weights of all rules with a hit, at most ``cap``."""
    terms = [
        F.when(text.has(rule.get("patterns")), F.lit(int(rule.get("weight", 0)))).otherwise(F.lit(0))
        for rule in rules or []
    ]
    return F.least(F.lit(cap), _sum(terms))


def penalties(title: RuleText, text: RuleText, rules: Rules) -> Column:
    """Sum of adjustments. An absent pattern list counts as a hit; the 'unless' lists cancel a rule."""
    terms = []
    for rule in rules or []:
        conditions = [target.has(rule[slot])
                      for slot, target in (("title_patterns", title), ("text_patterns", text)) if rule.get(slot)]
        conditions += [~target.has(rule[slot])
                       for slot, target in (("unless_title_patterns", title), ("unless_text_patterns", text))
                       if rule.get(slot)]
        applies = reduce(and_, conditions, F.lit(True))
        terms.append(F.when(applies, F.lit(int(rule.get("adjustment", 0)))).otherwise(F.lit(0)))
    return _sum(terms)


def interaction_bonus(title: RuleText, text: RuleText, rules: Rules) -> Column:
    """Sum of bonuses of rules whose every pattern group has a hit; a rule without groups always applies."""
    terms = []
    for rule in rules or []:
        groups = [target.has(group)
                  for slot, target in (("all_title_pattern_groups", title), ("all_text_pattern_groups", text))
                  for group in rule.get(slot) or []]
        applies = reduce(and_, groups, F.lit(True))
        terms.append(F.when(applies, F.lit(int(rule.get("bonus", 0)))).otherwise(F.lit(0)))
    return _sum(terms)


def posting_text() -> Column:
    """Title, description and "department team", joined by blanks."""
    meta = F.concat_ws(" ", text_or_empty("department"), text_or_empty("team"))
    return F.concat_ws(" ", text_or_empty("title"), text_or_empty("description"), meta)


def band(total: Column, profile: Profile) -> Column:
    limits = {**DEFAULT_BANDS, **(profile.get("score_bands") or {})}
    return (
        F.when(total >= int(limits["exceptional"]), F.lit("Exceptional"))
        .when(total >= int(limits["strong"]), F.lit("Strong"))
        .when(total >= int(limits["review"]), F.lit("Review"))
        .otherwise(F.lit("Lower Fit"))
    )


def with_rule_text(df: DataFrame) -> DataFrame:
    """Add the texts that rules read: ``_text`` and the folded forms of it and of the title."""
    return df.withColumn("_text", posting_text()).withColumns({
        "_text_folded": folded(F.col("_text")), "_title_folded": folded(F.col("title"))})


RULE_TEXT_COLUMNS = ("_text", "_text_folded", "_title_folded")


def rule_texts() -> tuple[RuleText, RuleText]:
    """Title and text of rows made by ``with_rule_text``."""
    return (RuleText(text_or_empty("title"), F.col("_title_folded")),
            RuleText(F.col("_text"), F.col("_text_folded")))


def with_score(df: DataFrame, profile: Profile) -> DataFrame:
    """Add the eight score components, penalty, total, band and scoring_version."""
    title, text = rule_texts()
    components = {
        "role_fit": first_match(title, profile.get("role_rules"), "score"),
        **{
            name: category_score(text, profile.get(CATEGORY_SECTIONS[name]), cap)
            for name, cap in CATEGORY_CAPS.items()
        },
        "seniority_adjustment": first_match(title, profile.get("seniority_rules"), "adjustment"),
        "other_penalty": penalties(title, text, profile.get("penalty_rules"))
        + interaction_bonus(title, text, profile.get("interaction_rules")),
        "location_fit": F.lit(0),
    }
    # A threshold on the total must not run all patterns a second time.
    scored = compute_once(with_rule_text(df), components).drop(*RULE_TEXT_COLUMNS)
    raw = _sum([F.col(name) for name in COMPONENTS])
    return (
        scored
        .withColumns({
            "penalty": F.col("seniority_adjustment") + F.col("other_penalty"),
            "total": F.greatest(F.lit(0), F.least(F.lit(100), raw)),
            "scoring_version": F.lit(SCORING_VERSION),
        })
        .withColumn("band", band(F.col("total"), profile))
    )


SCORE_FIELDS = COMPONENTS + ["total", "band", "scoring_version", "penalty"]


def location_eligible(profile: Profile) -> Column:
    """Location gate. Allowed places are tested before excluded ones, first on the location, then on the URL."""
    rules = profile.get("location") or {}
    if not rules.get("enabled", True):
        return F.lit(True)
    place = F.lower(strip(F.concat(text_or_empty("location"), F.lit(" "), text_or_empty("workplace_type"))))
    url = F.lower(text_or_empty("url"))
    allowed, excluded = rules.get("allowed_patterns"), rules.get("excluded_patterns")
    fallback = F.lit(bool(rules.get("allow_ambiguous", True)))
    return (
        F.when((place == "") & (url == ""), fallback)
        .when(any_match(allowed, place), F.lit(True))
        .when(any_match(excluded, place), F.lit(False))
        .when(any_match(excluded, url), F.lit(False))
        .when(any_match(allowed, url), F.lit(True))
        .otherwise(fallback)
    )


def with_gate(df: DataFrame, profile: Profile) -> DataFrame:
    return df.withColumn("alert_eligible", location_eligible(profile))


def with_rule_hits(df: DataFrame, profile: Profile) -> DataFrame:
    """Add ``rule_hits``: names of the rules that hit, as ``section/name``, in profile order."""
    title, text = rule_texts()
    tests = []
    for section in PATTERN_SECTIONS:
        target = title if section in ("role_rules", "seniority_rules") else text
        for rule in profile.get(section) or []:
            label = F.lit(f"{section}/{rule.get('name')}")
            tests.append(F.when(target.has(rule.get("patterns")), label))
    hits = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    return with_rule_text(df).withColumn("rule_hits", hits).drop(*RULE_TEXT_COLUMNS)


def match_reasons(limit: int = REASON_LIMIT) -> Column:
    """Labels of the components that reach 65 % of their cap: strongest first, ties in fixed order."""
    entries = F.array(*[
        F.struct(
            (-(F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) / F.lit(cap))).alias("rank"),
            F.lit(position).alias("position"),
            F.lit(label).alias("label"),
        )
        for position, (name, cap, label) in enumerate(REASONS)
    ])
    strong = F.filter(entries, lambda e: -e["rank"] >= REASON_MIN_FRACTION)
    return F.transform(F.slice(F.sort_array(strong), 1, limit), lambda e: e["label"])


def profile_patterns(spark: SparkSession, profile: Profile) -> DataFrame:
    """All patterns of a profile as rows (section, ordinal, name, slot, pattern)."""
    rows = []

    def add(section, ordinal, name, slot, patterns):
        rows.extend((section, ordinal, name, slot, str(p)) for p in patterns or [])

    for section in PATTERN_SECTIONS:
        for i, rule in enumerate(profile.get(section) or []):
            add(section, i, rule.get("name"), "patterns", rule.get("patterns"))
    for i, rule in enumerate(profile.get("penalty_rules") or []):
        for slot in PENALTY_SLOTS:
            add("penalty_rules", i, rule.get("name"), slot, rule.get(slot))
    for i, rule in enumerate(profile.get("interaction_rules") or []):
        for slot in INTERACTION_SLOTS:
            for group in rule.get(slot) or []:
                add("interaction_rules", i, rule.get("name"), slot, group)
    for slot in ("allowed_patterns", "excluded_patterns"):
        add("location", 0, "location", slot, (profile.get("location") or {}).get(slot))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _pattern_problem(patterns: pd.Series) -> pd.Series:
    def check(pattern):
        try:
            re.compile(pattern, re.I)
            java_pattern(pattern)
        except (re.error, PatternError) as error:
            return str(error)
        return None

    return patterns.map(check)


def lint_patterns(rules: DataFrame) -> DataFrame:
    """Rows of ``rules`` whose pattern is not usable, with the reason in ``problem``."""
    problem = F.pandas_udf(_pattern_problem, "string")
    return rules.withColumn("problem", problem(F.col("pattern"))).filter(F.col("problem").isNotNull())


def engine_problem(spark: SparkSession, pattern: str | None) -> str | None:
    """Why a rule pattern cannot be used: it is no pattern of its dialect, or the engine does not compile its translation."""
    problem = _pattern_problem(pd.Series([pattern or ""])).iloc[0]
    if problem is None:
        try:
            spark._jvm.java.util.regex.Pattern.compile(FLAGS + java_pattern(pattern or ""))
        except IllegalArgumentException as error:
            problem = str(error)
    return problem


def lint_profile(spark: SparkSession, profile: Profile, allow_starter: bool = False) -> DataFrame:
    """Problems of a profile: empty required sections, unusable patterns, status not ready."""
    general = [(section, f"{section} is empty") for section in ("role_rules", "domain_rules") if not profile.get(section)]
    if profile.get("profile_status", "missing") != READY_STATUS and not allow_starter:
        general.append(("profile_status", f"profile_status is not '{READY_STATUS}'"))
    # A profile is configuration: its patterns are compiled here by the engine that will run them.
    patterns = profile_patterns(spark, profile).collect()
    found = [
        (r["section"], "/".join(x for x in (r["name"], r["slot"]) if x is not None), r["pattern"], problem)
        for r in patterns if (problem := engine_problem(spark, r["pattern"])) is not None]
    return spark.createDataFrame(
        [(s, "", "", p) for s, p in general] + found, "section string, place string, pattern string, problem string")

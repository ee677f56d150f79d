"""Scoring, gate, reasons, lint, reports, digest and back-test over documents as postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacantia.functions.identity import with_stable_key
from vacantia.functions.regex import any_match
from vacantia.functions.text import safe_number, squash_ws, synthetic_id, heading_url
from vacantia.operators import calibration, digest, history, reports, scoring
from vacantia.operators.scoring import with_gate, with_score
from vacantia.plans.catalog import Inputs, query, view
from vacantia.plans.views import PROFILE_A, PROFILE_B, postings, scored
from vacantia.session import scratch_path
from vacantia.sources.tables import read_report, write_report

MIN_SCORE = 65


@query("stable_key", """
    SELECT source_id, substr(sha256(lower(concat(company, '|', source, '|', source_id))), 1, 24) AS stable_key FROM {postings}""")
def _stable_key(inputs: Inputs) -> DataFrame:
    return with_stable_key(postings(inputs)).select("source_id", "stable_key")


@query("synthetic_id", """
    SELECT source_id, substr(sha1(url), 1, 20) AS id20, substr(sha1(url), 1, 16) AS id16,
           concat(url, '#', trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-')) AS heading_url
    FROM {postings}""")
def _synthetic_id(inputs: Inputs) -> DataFrame:
    return postings(inputs).select(
        "source_id", synthetic_id(F.col("url")).alias("id20"), synthetic_id(F.col("url"), 16).alias("id16"),
        heading_url(F.col("url"), F.col("title")).alias("heading_url"))


@query("squash_ws", r"""
    SELECT doc_id, trim(regexp_replace(text, '[\s\x0b\x85\pZ]+', ' ', 'g')) AS squashed FROM {documents}""")
def _squash_ws(inputs: Inputs) -> DataFrame:
    return inputs["documents"].select("doc_id", squash_ws(F.col("text")).alias("squashed"))


@query("rule_any", r"""
    SELECT source_id, regexp_matches(title, '(^|[^\p{L}])the([^\p{L}]|$)', 'i') AS has_the,
           regexp_matches(description, '(^|[^\p{L}\p{N}_])qu', 'i') OR regexp_matches(description, 'license', 'i') AS has_qu,
           false AS no_patterns
    FROM {postings}""")
def _rule_any(inputs: Inputs) -> DataFrame:
    return postings(inputs).select(
        "source_id", any_match([r"(^|[^\p{L}])the([^\p{L}]|$)"], F.col("title")).alias("has_the"),
        any_match([r"\bqu", "license"], F.col("description")).alias("has_qu"),
        any_match([], F.col("title")).alias("no_patterns"))


def _component(*names: str):
    def run(inputs: Inputs) -> DataFrame:
        return scored(inputs).select("source_id", *names)

    return run


for _name, _columns in {
    "score_role": ("role_fit",),
    "score_category": ("domain_fit", "technical_fit", "operating_model_fit", "leadership_fit"),
    "score_seniority": ("seniority_adjustment",),
    "score_total": ("role_fit", "domain_fit", "technical_fit", "operating_model_fit", "leadership_fit", "penalty",
                    "location_fit", "total", "scoring_version"),
    "score_band": ("total", "band"),
    "location_gate": ("alert_eligible",),
}.items():
    query(_name, f"SELECT source_id, {', '.join(_columns)} FROM {{scored_a}}")(_component(*_columns))


@query("score_penalty", """
    SELECT source_id, (CASE WHEN regexp_matches(title, 'ion', 'i') AND NOT regexp_matches(concat(title, ' ', description), 'license', 'i') THEN -15 ELSE 0 END
            + CASE WHEN regexp_matches(concat(title, ' ', description), '@', 'i') AND NOT regexp_matches(title, 'er', 'i') THEN -5 ELSE 0 END) AS penalty
    FROM {postings}""")
def _score_penalty(inputs: Inputs) -> DataFrame:
    title, text = scoring.rule_texts()
    return scoring.with_rule_text(postings(inputs)).select(
        "source_id", scoring.penalties(title, text, PROFILE_A["penalty_rules"]).alias("penalty"))


@query("score_interaction", """
    SELECT source_id, CASE WHEN regexp_matches(title, 'e', 'i') AND regexp_matches(concat(title, ' ', description), 'ering', 'i')
                AND regexp_matches(concat(title, ' ', description), 'qu|wh', 'i') THEN 5 ELSE 0 END + 1 AS bonus
    FROM {postings}""")
def _score_interaction(inputs: Inputs) -> DataFrame:
    title, text = scoring.rule_texts()
    rules = [*PROFILE_A["interaction_rules"], {"name": "always", "bonus": 1}]
    return scoring.with_rule_text(postings(inputs)).select(
        "source_id", scoring.interaction_bonus(title, text, rules).alias("bonus"))


@query("rule_hits", r"""
    SELECT source_id, concat_ws(',',
        CASE WHEN regexp_matches(title, '(^|[^\p{L}])the([^\p{L}]|$)', 'i') THEN 'role_rules/the' END,
        CASE WHEN regexp_matches(title, 'tion', 'i') THEN 'role_rules/tion' END, 'role_rules/default',
        CASE WHEN regexp_matches(txt, 'ering', 'i') THEN 'domain_rules/ering' END,
        CASE WHEN regexp_matches(txt, 'license', 'i') THEN 'domain_rules/license' END,
        CASE WHEN regexp_matches(txt, 'der', 'i') THEN 'domain_rules/der' END,
        CASE WHEN regexp_matches(txt, '[0-9]{4}', 'i') THEN 'technical_rules/year' END,
        CASE WHEN regexp_matches(txt, 'qu', 'i') THEN 'technical_rules/qu' END,
        CASE WHEN regexp_matches(txt, 'that|pour', 'i') THEN 'technical_rules/that' END,
        CASE WHEN regexp_matches(txt, 'ment|heit', 'i') THEN 'operating_model_rules/ment' END,
        CASE WHEN regexp_matches(txt, 'ing', 'i') THEN 'operating_model_rules/ing' END,
        CASE WHEN regexp_matches(txt, 'an', 'i') THEN 'operating_model_rules/an' END,
        CASE WHEN regexp_matches(txt, 'st', 'i') THEN 'leadership_rules/st' END,
        CASE WHEN regexp_matches(txt, 'er', 'i') THEN 'leadership_rules/er' END,
        CASE WHEN regexp_matches(title, '^an', 'i') THEN 'seniority_rules/an' END) AS hits
    FROM (SELECT *, concat(title, ' ', description, '  ') AS txt FROM {postings}) p""")
def _rule_hits(inputs: Inputs) -> DataFrame:
    return scoring.with_rule_hits(postings(inputs), PROFILE_A).select("source_id", F.array_join("rule_hits", ",").alias("hits"))


_REASONS_SQL = """
    SELECT stable_key, string_agg(label, ' · ' ORDER BY frac DESC, pos) AS why FROM (
        SELECT *, row_number() OVER (PARTITION BY stable_key ORDER BY frac DESC, pos) AS rn FROM (
            SELECT stable_key, role_fit / 30.0::DOUBLE AS frac, 0 AS pos, 'Target computational biology / bioinformatics role' AS label FROM {scored_a}
            UNION ALL SELECT stable_key, domain_fit / 25.0::DOUBLE, 1, 'Strong scientific-domain match' FROM {scored_a}
            UNION ALL SELECT stable_key, technical_fit / 20.0::DOUBLE, 2, 'Strong technical overlap' FROM {scored_a}
            UNION ALL SELECT stable_key, operating_model_fit / 15.0::DOUBLE, 3, 'Applications / workflows / cross-functional product work' FROM {scored_a}
            UNION ALL SELECT stable_key, leadership_fit / 10.0::DOUBLE, 4, 'Technical / project / people leadership' FROM {scored_a}
        ) c WHERE frac >= 0.65) r WHERE rn <= 3 GROUP BY stable_key"""
view("reasons", _REASONS_SQL)


@query("match_reasons", """
    SELECT s.source_id, coalesce(r.why, '') AS why FROM {scored_a} s LEFT JOIN {reasons} r ON r.stable_key = s.stable_key""")
def _match_reasons(inputs: Inputs) -> DataFrame:
    return scored(inputs).select("source_id", F.array_join(scoring.match_reasons(), " · ").alias("why"))


@query("lint_profile")
def _lint_profile(inputs: Inputs) -> DataFrame:
    """Pattern rows made from part names; some are broken on purpose."""
    key, name = F.col("p_partkey"), F.col("p_name")
    broken = (
        F.when(key % 6 == 0, F.concat(name, F.lit("("))).when(key % 6 == 1, F.concat(F.lit("["), name))
        .when(key % 6 == 2, F.concat(F.lit("(?i)"), name)).otherwise(F.concat(name, F.lit("s?")))
    )
    rules = inputs["part"].select(
        F.col("p_type").alias("section"), key.cast("int").alias("ordinal"), F.col("p_brand").alias("name"),
        F.lit("patterns").alias("slot"), broken.alias("pattern"))
    return scoring.lint_patterns(rules)


# ---- reports --------------------------------------------------------------------------------------------

_REPORT_COLUMNS = "company, title, location, url, total, band, alert_eligible, stable_key"
view("best_a", """
    SELECT * FROM (
        SELECT *, row_number() OVER (
            PARTITION BY trim(regexp_replace(lower(company), '[\\s\\x0b\\x85\\pZ]+', ' ', 'g')),
                         trim(regexp_replace(lower(title), '[\\s\\x0b\\x85\\pZ]+', ' ', 'g'))
            ORDER BY total DESC, capture_seq) AS rn
        FROM {scored_a}) x WHERE rn = 1""".replace("\\\\", "\\"))
view("report_a", """
    SELECT * FROM (
        SELECT *, row_number() OVER (
            PARTITION BY trim(regexp_replace(lower(company), '[\\s\\x0b\\x85\\pZ]+', ' ', 'g')),
                         trim(regexp_replace(lower(title), '[\\s\\x0b\\x85\\pZ]+', ' ', 'g'))
            ORDER BY total DESC, capture_seq) AS rn
        FROM {scored_a} WHERE total >= 65 AND alert_eligible) x WHERE rn = 1""".replace("\\\\", "\\"))


def _report(inputs: Inputs, min_score: int = MIN_SCORE) -> DataFrame:
    return reports.ranked_report(scored(inputs), min_score)


@query("alert_dedupe", f"SELECT {_REPORT_COLUMNS} FROM {{best_a}}")
def _alert_dedupe(inputs: Inputs) -> DataFrame:
    return reports.alert_dedupe(scored(inputs)).select(*_REPORT_COLUMNS.split(", "))


view("keys_a", "SELECT stable_key FROM {scored_a} WHERE capture_seq % 3 <> 0")
view("flagged_a", """SELECT s.*, k.stable_key IS NULL AS is_new FROM {scored_a} s LEFT JOIN {keys_a} k ON k.stable_key = s.stable_key""")


def flagged(inputs: Inputs) -> DataFrame:
    """Scored postings with is_new against a history that knows two thirds of them; new keys are found before the scoring."""
    keyed = with_stable_key(postings(inputs))
    known = keyed.filter(F.col("capture_seq") % 3 != 0).select("stable_key")
    return with_gate(with_score(history.with_is_new(known, keyed), PROFILE_A), PROFILE_A).drop("description")


@query("report_filter", "SELECT source_id, total, is_new FROM {flagged_a} WHERE total >= 50 AND alert_eligible AND is_new")
def _report_filter(inputs: Inputs) -> DataFrame:
    return reports.report_filter(flagged(inputs), 50, new_only=True).select("source_id", "total", "is_new")


@query("ranked_report", f"SELECT {_REPORT_COLUMNS} FROM {{report_a}} ORDER BY total DESC, company DESC, title DESC")
def ranked_report(inputs: Inputs) -> DataFrame:
    return _report(inputs).select(*_REPORT_COLUMNS.split(", "))


@query("report_roundtrip", """
    SELECT company, title, location, url, CAST(total AS VARCHAR) AS total, band, stable_key FROM {report_a}""")
def _report_roundtrip(inputs: Inputs) -> DataFrame:
    columns = ["company", "title", "location", "url", "total", "band", "stable_key"]
    path = scratch_path(inputs.spark, "report")
    write_report(_report(inputs).select(*columns), path)
    return read_report(inputs.spark, path, columns)


# ---- digest ---------------------------------------------------------------------------------------------

@query("digest_tiers", """
    SELECT CASE tier WHEN 'Exceptional' THEN 1 WHEN 'Strong' THEN 2 ELSE 3 END AS tier_order, tier,
           CASE tier WHEN 'Exceptional' THEN '85–100' WHEN 'Strong' THEN '75–84' ELSE '65–74' END AS tier_caption,
           count(*) AS roles, max(total) AS best_score
    FROM (SELECT total, CASE WHEN total >= 85 THEN 'Exceptional' WHEN total >= 75 THEN 'Strong' ELSE 'Review' END AS tier FROM {best_a}) t
    GROUP BY tier""")
def _digest_tiers(inputs: Inputs) -> DataFrame:
    return digest.digest_tiers(reports.alert_dedupe(scored(inputs)))


@query("digest_lines", """
    SELECT b.stable_key, concat(CAST(b.total AS VARCHAR), ' — ', b.company, ' — ', b.title, chr(10), '   ', b.location,
           ' · Compensation: Not listed', CASE WHEN r.why IS NULL THEN '' ELSE concat(chr(10), '   Why: ', r.why) END,
           chr(10), '   ', b.url, chr(10)) AS block
    FROM {report_a} b LEFT JOIN {reasons} r ON r.stable_key = b.stable_key""")
def _digest_lines(inputs: Inputs) -> DataFrame:
    return digest.digest_lines(_report(inputs)).select("stable_key", "block")


def _esc(sql: str) -> str:
    return (f"replace(replace(replace(replace(replace({sql}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
            "chr(39), '&#x27;')")


@query("digest_cards", f"""
    SELECT b.stable_key, concat(
        '<div style=', chr(39), 'margin:0 0 10px 0;padding:11px 13px;border:1px solid #ddd;border-radius:7px', chr(39), '>',
        '<div style=', chr(39), 'font-size:16px;font-weight:700', chr(39), '>', CAST(b.total AS VARCHAR), ' · ', {_esc('b.company')}, '</div>',
        '<div style=', chr(39), 'font-size:15px;margin-top:2px', chr(39), '>', {_esc('b.title')}, '</div>',
        '<div style=', chr(39), 'color:#555;margin-top:5px;font-size:13px', chr(39), '>', {_esc('b.location')}, ' &nbsp;·&nbsp; Compensation: Not listed</div>',
        CASE WHEN r.why IS NULL THEN '' ELSE concat('<div style="color:#555;margin-top:5px;font-size:13px"><strong>Why:</strong> ', {_esc('r.why')}, '</div>') END,
        '<div style=', chr(39), 'margin-top:6px;font-size:13px', chr(39), '><a href="', {_esc('b.url')}, '" style="font-weight:600">View posting</a></div></div>') AS card
    FROM {{report_a}} b LEFT JOIN {{reasons}} r ON r.stable_key = b.stable_key""")
def _digest_cards(inputs: Inputs) -> DataFrame:
    return digest.digest_cards(_report(inputs)).select("stable_key", "card")


@query("safe_number", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN 0.0 WHEN 2 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS number
    FROM {events}""")
def _safe_number(inputs: Inputs) -> DataFrame:
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.col("value").cast("string")).when(kind == 1, F.lit(""))
        .when(kind == 2, F.concat(F.lit("n/a "), F.col("event_id").cast("string")))
        .otherwise(F.concat(F.lit(" "), F.col("event_id").cast("string")))
    )
    return inputs["events"].select("event_id", safe_number(text).alias("number"))


# ---- counters -------------------------------------------------------------------------------------------

view("attempted", "SELECT DISTINCT source AS name, 'documents' AS platform FROM {documents} UNION ALL SELECT 'no postings', 'documents'")
view("stats_a", """
    SELECT a.name AS company, a.platform, count(f.stable_key) AS retrieved,
           count(CASE WHEN f.total >= 65 AND f.alert_eligible THEN 1 END) AS matching,
           count(CASE WHEN f.is_new THEN 1 END) AS first_seen
    FROM {attempted} a LEFT JOIN {flagged_a} f ON f.company = a.name GROUP BY a.name, a.platform""")


@query("board_stats", "SELECT * FROM {stats_a}")
def _board_stats(inputs: Inputs) -> DataFrame:
    return reports.board_stats(inputs["attempted"], flagged(inputs), MIN_SCORE)


def _errors(inputs: Inputs) -> DataFrame:
    return inputs["run_status"].filter(~F.col("ok"))


@query("run_totals", """
    SELECT count(*) AS companies_attempted, CAST(sum(retrieved) AS BIGINT) AS jobs_retrieved,
           CAST(sum(first_seen) AS BIGINT) AS new_jobs, (SELECT count(*) FROM {run_status} WHERE NOT ok) AS company_errors
    FROM {stats_a}""")
def _run_totals(inputs: Inputs) -> DataFrame:
    return reports.run_totals(reports.board_stats(inputs["attempted"], flagged(inputs), MIN_SCORE), _errors(inputs))


@query("run_summary", """
    SELECT count(*) AS companies_attempted, CAST(sum(retrieved) AS BIGINT) AS jobs_retrieved,
           CAST(sum(first_seen) AS BIGINT) AS new_jobs, (SELECT count(*) FROM {run_status} WHERE NOT ok) AS company_errors,
           (SELECT count(*) FROM {report_a}) AS exported,
           (SELECT count(*) FROM (SELECT DISTINCT lower(company), trim(regexp_replace(lower(title), '\\s+', ' ', 'g')) FROM {flagged_a}
                                  WHERE total >= 65 AND alert_eligible AND is_new) d) AS exported_new,
           '[{"company":"no postings","platform":"documents","warning":"ZERO_RESULT_UNVERIFIED"}]' AS warnings_json,
           'run-1' AS run_id, '2024-01-01 00:00:00' AS started_at, '2024-01-01 00:01:30' AS completed_at,
           CAST(90 AS DOUBLE) AS elapsed_seconds
    FROM {stats_a}""".replace("\\\\", "\\"))
def _run_summary(inputs: Inputs) -> DataFrame:
    from vacantia.operators.health import zero_result_warnings

    # Written once, as a run does: four reports read it.
    path = scratch_path(inputs.spark, "results")
    flagged(inputs).write.parquet(path)
    rows = inputs.spark.read.parquet(path)
    stats = reports.board_stats(inputs["attempted"], rows, MIN_SCORE)
    boards = stats.select("company", "platform", F.lit(False).alias("zero_jobs_verified"), F.lit(False).alias("zero_result_verified"))
    warnings = zero_result_warnings(boards, stats.select("company", F.col("retrieved").alias("n")))
    return reports.run_summary(
        stats, _errors(inputs), warnings, "run-1", "2024-01-01 00:00:00", "2024-01-01 00:01:30",
        reports.ranked_report(rows, MIN_SCORE), reports.ranked_report(rows, MIN_SCORE, new_only=True))


@query("sample_titles", """
    SELECT company, string_agg(title, ' | ' ORDER BY seq) AS sample_titles FROM (
        SELECT *, row_number() OVER (PARTITION BY company ORDER BY seq) AS rn FROM (
            SELECT company, trim(title, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(133), chr(160))) AS title, min(capture_seq) AS seq
            FROM {postings} GROUP BY 1, 2) t WHERE title <> '') r
    WHERE rn <= 5 GROUP BY company""")
def _sample_titles(inputs: Inputs) -> DataFrame:
    return reports.sample_titles(postings(inputs))


# ---- back-test ------------------------------------------------------------------------------------------

view("backtest", """
    SELECT a.stable_key, a.location, r.wanted, a.total AS old_score, a.band AS old_band, b.total AS new_score, b.band AS new_band
    FROM {scored_a} a JOIN {scored_b} b ON b.stable_key = a.stable_key
    JOIN (SELECT substr(sha256(lower(concat(company, '|', source, '|', source_id))), 1, 24) AS stable_key,
                 quality = 1 AND toxic = 0 AS wanted FROM {labels} JOIN {postings} ON doc_id = capture_seq) r
      ON r.stable_key = a.stable_key""")


def _backtest(inputs: Inputs) -> DataFrame:
    return calibration.backtest_rows(
        with_stable_key(postings(inputs)), inputs["ratings"], PROFILE_A, PROFILE_B, ["location"])


@query("backtest_rows", "SELECT * FROM {backtest}")
def _backtest_rows(inputs: Inputs) -> DataFrame:
    return _backtest(inputs)


@query("backtest_confusion", """
    SELECT location, new_band, count(*) AS rated, count(CASE WHEN new_score >= 65 AND wanted THEN 1 END) AS true_positive,
           count(CASE WHEN new_score >= 65 AND NOT wanted THEN 1 END) AS false_positive,
           count(CASE WHEN new_score < 65 AND wanted THEN 1 END) AS false_negative,
           count(CASE WHEN new_score < 65 AND NOT wanted THEN 1 END) AS true_negative
    FROM {backtest} GROUP BY location, new_band""")
def _backtest_confusion(inputs: Inputs) -> DataFrame:
    return calibration.confusion(_backtest(inputs), ["location", "new_band"], 65)


@query("backtest_threshold", """
    SELECT threshold, CAST(sum(n) OVER w AS BIGINT) AS selected, CAST(sum(nw) OVER w AS BIGINT) AS selected_wanted,
           round(sum(nw) OVER w / sum(n) OVER w, 6) AS precision, round(sum(nw) OVER w / sum(nw) OVER (), 6) AS recall
    FROM (SELECT new_score AS threshold, count(*) AS n, count(CASE WHEN wanted THEN 1 END) AS nw FROM {backtest} GROUP BY 1) t
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)""")
def _backtest_threshold(inputs: Inputs) -> DataFrame:
    return calibration.threshold_table(_backtest(inputs))


@query("rating_coverage", """
    SELECT count(*) AS rated, count(CASE WHEN wanted THEN 1 END) AS positives, count(CASE WHEN NOT wanted THEN 1 END) AS negatives,
           count(*) >= 25 AS enough_rated, count(CASE WHEN wanted THEN 1 END) >= 2 AS enough_positives
    FROM (SELECT quality = 1 AND toxic = 0 AS wanted FROM {labels} JOIN {postings} ON doc_id = capture_seq) r""")
def _rating_coverage(inputs: Inputs) -> DataFrame:
    return calibration.rating_coverage(inputs["ratings"])

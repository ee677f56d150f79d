"""Input views over the given tables, and the rule profiles the queries run with."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vacantia.functions.identity import with_stable_key
from vacantia.operators.scoring import with_gate, with_score
from vacantia.plans.catalog import Inputs, view
from vacantia.schemas import as_jobs

PROFILE_A = {
    "profile_name": "rules a",
    "profile_status": "personalized_ready",
    "score_bands": {"exceptional": 85, "strong": 75, "review": 65},
    "role_rules": [
        {"name": "the", "score": 30, "patterns": [r"(^|[^\p{L}])the([^\p{L}]|$)"]},
        {"name": "tion", "score": 10, "patterns": ["tion"]},
        {"name": "default", "score": 2, "patterns": [".*"]},
    ],
    "domain_rules": [
        {"name": "ering", "weight": 15, "patterns": ["ering"]},
        {"name": "license", "weight": 10, "patterns": ["license"]},
        {"name": "der", "weight": 10, "patterns": ["der"]},
    ],
    "technical_rules": [
        {"name": "year", "weight": 5, "patterns": ["[0-9]{4}"]},
        {"name": "qu", "weight": 5, "patterns": ["qu"]},
        {"name": "that", "weight": 15, "patterns": ["that", "pour"]},
    ],
    "operating_model_rules": [
        {"name": "ment", "weight": 5, "patterns": ["ment", "heit"]},
        {"name": "ing", "weight": 10, "patterns": ["ing"]},
        {"name": "an", "weight": 5, "patterns": ["an"]},
    ],
    "leadership_rules": [
        {"name": "st", "weight": 6, "patterns": ["st"]},
        {"name": "er", "weight": 6, "patterns": ["er"]},
    ],
    "seniority_rules": [{"name": "an", "adjustment": -30, "patterns": ["^an"]}],
    "penalty_rules": [
        {"name": "title", "adjustment": -15, "title_patterns": ["ion"], "unless_text_patterns": ["license"]},
        {"name": "text", "adjustment": -5, "text_patterns": ["@"], "unless_title_patterns": ["er"]},
    ],
    "interaction_rules": [
        {"name": "both", "bonus": 5, "all_title_pattern_groups": [["e"]], "all_text_pattern_groups": [["ering"], ["qu", "wh"]]},
    ],
    "location": {"enabled": True, "allow_ambiguous": True, "allowed_patterns": ["en|fr"], "excluded_patterns": ["de"]},
}
PROFILE_B = {
    **PROFILE_A,
    "profile_name": "rules b",
    "domain_rules": [{**PROFILE_A["domain_rules"][0], "weight": 5}, *PROFILE_A["domain_rules"][1:]],
    "leadership_rules": [{**PROFILE_A["leadership_rules"][0], "weight": 1}, *PROFILE_A["leadership_rules"][1:]],
}

view("postings", """
    SELECT source AS company, split_part(text, chr(10), 1) AS title, lang AS location,
           concat('https://example.org/', lang, '/job/', CAST(doc_id AS STRING)) AS url,
           'documents' AS source, CAST(doc_id AS STRING) AS source_id, text AS description,
           doc_id AS capture_seq
    FROM {documents}""")


def postings(inputs: Inputs) -> DataFrame:
    """Documents as postings."""
    df = inputs["postings"]
    return as_jobs(df, **{c: F.col(c) for c in df.columns})


def scored(inputs: Inputs, profile=PROFILE_A) -> DataFrame:
    """Documents as scored and gated postings with their key; the long text is left behind."""
    return with_gate(with_score(with_stable_key(postings(inputs)), profile), profile).drop("description")


def _hit(pattern: str, target: str) -> str:
    return f"regexp_matches({target}, '{pattern}', 'i')"


def score_sql(profile) -> str:
    """The score of PROFILE_A or PROFILE_B as SQL over ``postings``."""
    def weight(section, i):
        rule = profile[section][i]
        test = " OR ".join(_hit(p, "txt") for p in rule["patterns"])
        return f"CASE WHEN {test} THEN {rule['weight']} ELSE 0 END"

    def total(section, cap):
        return f"least({cap}, {' + '.join(weight(section, i) for i in range(len(profile[section])))})"

    return f"""
    SELECT p.*, CASE WHEN {_hit(profile['role_rules'][0]['patterns'][0], 'title')} THEN 30
                     WHEN {_hit('tion', 'title')} THEN 10 ELSE 2 END AS role_fit,
           {total('domain_rules', 25)} AS domain_fit,
           {total('technical_rules', 20)} AS technical_fit,
           {total('operating_model_rules', 15)} AS operating_model_fit,
           {total('leadership_rules', 10)} AS leadership_fit,
           CASE WHEN {_hit('^an', 'title')} THEN -30 ELSE 0 END AS seniority_adjustment,
           (CASE WHEN {_hit('ion', 'title')} AND NOT {_hit('license', 'txt')} THEN -15 ELSE 0 END
            + CASE WHEN {_hit('@', 'txt')} AND NOT {_hit('er', 'title')} THEN -5 ELSE 0 END
            + CASE WHEN {_hit('e', 'title')} AND {_hit('ering', 'txt')}
                    AND ({_hit('qu', 'txt')} OR {_hit('wh', 'txt')}) THEN 5 ELSE 0 END) AS other_penalty
    FROM (SELECT *, concat(title, ' ', description, '  ') AS txt FROM {{postings}}) p"""


_TOTAL = """
    SELECT * EXCLUDE (txt), 0 AS location_fit, seniority_adjustment + other_penalty AS penalty,
           greatest(0, least(100, role_fit + domain_fit + technical_fit + operating_model_fit + leadership_fit
                                  + seniority_adjustment + other_penalty)) AS total,
           substr(sha256(lower(concat(company, '|', source, '|', source_id))), 1, 24) AS stable_key,
           CASE WHEN regexp_matches(lower(location), 'en|fr', 'i') THEN true
                WHEN regexp_matches(lower(location), 'de', 'i') THEN false
                WHEN regexp_matches(lower(url), 'de', 'i') THEN false
                WHEN regexp_matches(lower(url), 'en|fr', 'i') THEN true ELSE true END AS alert_eligible,
           'food-biotech-v1' AS scoring_version
    FROM {%s}"""
_BAND = """SELECT *, CASE WHEN total >= 85 THEN 'Exceptional' WHEN total >= 75 THEN 'Strong'
                          WHEN total >= 65 THEN 'Review' ELSE 'Lower Fit' END AS band FROM {%s}"""
view("parts_a", score_sql(PROFILE_A))
view("total_a", _TOTAL % "parts_a")
view("scored_a", _BAND % "total_a")
view("parts_b", score_sql(PROFILE_B))
view("total_b", _TOTAL % "parts_b")
view("scored_b", _BAND % "total_b")

# Orders as postings with pay wording in nine shapes; a < b are whole amounts.
view("pay_amounts", """
    SELECT *, concat(CAST(CAST(floor(a / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(a % 1000 AS STRING), 3, '0')) AS a_text,
           concat(CAST(CAST(floor(b / 1000) AS BIGINT) AS STRING), ',', lpad(CAST(b % 1000 AS STRING), 3, '0')) AS b_text,
           CAST(floor(a / 1000) AS BIGINT) AS a_k, CAST(floor(b / 1000) AS BIGINT) AS b_k
    FROM (SELECT o_orderkey, o_orderkey % 9 AS shape, CAST(floor(o_totalprice / 4) AS BIGINT) + 20000 AS a,
                 CAST(floor(o_totalprice / 4) AS BIGINT) + 20500 + (o_orderkey % 40) * 500 AS b, o_totalprice
          FROM {orders}) x""")
view("pay_text", """
    SELECT o_orderkey, shape, a, b, a_text, b_text, a_k, b_k,
           CASE shape WHEN 0 THEN concat('USD ', CAST(a AS STRING), '-', CAST(b AS STRING))
                      WHEN 3 THEN concat(CAST(a_k AS STRING), '-', CAST(b_k AS STRING), 'k')
                      WHEN 7 THEN concat('EUR ', b_text, '-', a_text, ' year')
                      WHEN 6 THEN 'Not listed' ELSE '' END AS compensation,
           CASE shape WHEN 1 THEN concat('We offer $', a_text, ' – $', b_text, ' per year plus bonus.')
                      WHEN 2 THEN concat('Pay Range: ', a_text, ' - ', b_text,
                                         CASE o_orderkey % 3 WHEN 0 THEN ' USD' WHEN 1 THEN ' EUR' ELSE '' END)
                      WHEN 4 THEN concat('Up to £', a_text, ' to £', b_text, ' each.')
                      WHEN 5 THEN concat('Lunch money $12,000 - $14,000 yearly. ', repeat('lorem ipsum ', 20),
                                         'The base salary is $', a_text, ' - $', b_text, ' annually.')
                      WHEN 6 THEN 'Founded 1998 - 2005 in $5 - $9 tents.'
                      WHEN 8 THEN concat('<p>Join us</p><div class="content-pay-transparency"><div class="pay-range"><span>$',
                                         a_text, '</span><span>—</span><span>$', b_text, ' USD</span></div></div><p>Apply</p>')
                      ELSE '' END AS description
    FROM {pay_amounts}""")

view("locations", """
    SELECT c_custkey, n_nationkey,
           CASE c_custkey % 5 WHEN 0 THEN '5' WHEN 1 THEN '' WHEN 2 THEN '12.5' WHEN 3 THEN n_name ELSE 'X' END AS value,
           CASE c_custkey % 5 WHEN 0 THEN concat('/job/US---CA---San-Diego-', CAST(n_nationkey AS STRING), '/Role_R', CAST(c_custkey AS STRING))
                WHEN 1 THEN '/job/Berlin/Role' WHEN 2 THEN '/job/Oslo/Role' WHEN 3 THEN '/job/US/Role'
                ELSE concat('/job/Remote_US--Office-', CAST(n_nationkey AS STRING), '/Role') END AS path,
           CASE c_custkey % 5 WHEN 1 THEN concat('The lab is located in US - CA - San Diego, building ', CAST(n_nationkey AS STRING))
                WHEN 2 THEN CASE WHEN n_nationkey % 2 = 0 THEN 'Work US -  Remote, 4 days' ELSE 'no place' END
                ELSE 'Text' END AS description
    FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey""")

# Events as repeated runs: company = event type, key = type and user, run = day.
view("sightings", """
    SELECT event_type AS company, concat(event_type, '-', CAST(user_id AS STRING)) AS stable_key,
           CAST(ts AS DATE) AS run, event_id AS capture_seq, value
    FROM {events} WHERE (day(ts) * 7 + length(event_type)) % 11 <> 0""")
view("run_status", """
    SELECT DISTINCT event_type AS company, CAST(ts AS DATE) AS run,
           (day(ts) * 7 + length(event_type)) % 11 <> 0 AS ok
    FROM {events}""")
view("run_counts", """
    SELECT s.company, s.run, s.ok, count(g.stable_key) AS n
    FROM {run_status} s LEFT JOIN (SELECT DISTINCT company, run, stable_key FROM {sightings}) g
      ON g.company = s.company AND g.run = s.run
    GROUP BY s.company, s.run, s.ok""")
# The last six days as one run against the history of the days before.
# Users with a number that ends in 7 came in the last days only.
view("past", "SELECT * FROM {sightings} WHERE day(run) < 25 AND NOT stable_key LIKE '%7'")
view("past_status", "SELECT * FROM {run_status} WHERE day(run) < 25")
view("now", "SELECT * FROM {sightings} WHERE day(run) >= 25")
# The same run, in which the captures of some companies failed.
view("now_good", "SELECT * FROM {sightings} WHERE day(run) >= 25 AND length(company) <> 5")
view("now_ok", "SELECT DISTINCT company FROM {run_status} WHERE day(run) >= 25 AND length(company) <> 5")

view("registry", """
    SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 9 THEN 'Supplier#twin' ELSE s_name END AS name,
           CASE s_suppkey % 7 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'workday' WHEN 3 THEN 'kula'
                WHEN 4 THEN 'mystery' WHEN 5 THEN 'empty' ELSE 'career_page' END AS platform,
           CASE s_suppkey % 3 WHEN 0 THEN CAST(NULL AS BOOLEAN) WHEN 1 THEN true ELSE false END AS enabled,
           CASE s_suppkey % 4 WHEN 0 THEN CAST(NULL AS STRING) WHEN 1 THEN 'user2' ELSE 'user1' END AS target_profile,
           CASE WHEN s_suppkey % 2 = 0 THEN concat('board', CAST(s_suppkey AS STRING)) ELSE '' END AS board,
           CASE WHEN s_suppkey % 5 = 0 THEN CAST(NULL AS STRING) ELSE 'host.example.com' END AS host,
           CASE WHEN s_suppkey % 9 = 0 THEN '' ELSE n_name END AS tenant,
           CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'https://example.com' END AS url
    FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""")


def registry(inputs: Inputs) -> DataFrame:
    """Suppliers as a company registry."""
    options = F.map_filter(
        F.create_map(*[x for key in ("board", "host", "tenant", "url") for x in (F.lit(key), F.col(key))]),
        lambda _, v: v.isNotNull())
    return inputs["registry"].select("name", "platform", "enabled", "target_profile", options.alias("options"))


view("ratings", """
    SELECT substr(sha2(lower(concat(company, '|', source, '|', source_id)), 256), 1, 24) AS stable_key,
           quality = 1 AND toxic = 0 AS wanted
    FROM {labels} JOIN {postings} ON doc_id = capture_seq""")

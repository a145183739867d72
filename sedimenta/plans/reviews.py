"""The domain rules over inputs that the star tables give: reviews, controls, audits, coverage, takedowns, requests.

Each input is a SELECT that Spark and DuckDB both run; the rule itself is the operator here and the rule's own SQL there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import consensus, coverage, disclosure, estimators, planning

from . import rule_views, rules
from .given import Given
from .registry import RULE_ORACLES, query, table

SPARK = {"list": "array", "gather": "collect_list", **{t: f"{{{t}}}" for t in ("customer", "supplier", "part", "orders", "lineitem", "events", "region", "nation")}}
DUCK = {"list": "list_value", "gather": "list"} | {t: t for t in SPARK if t not in ("list", "gather")}


def fed(spark: SparkSession, sf_dir: str, select: str) -> DataFrame:
    """An input's rows, with the star tables for their names in braces."""
    text = select.format(**SPARK)
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in DUCK if f"{{{t}}}" in text})


def twin(rule: str, *inputs: tuple[Given, str]) -> str:
    """A rule's SQL with its given tables replaced by inputs."""
    sql = RULE_ORACLES[rule]
    for given, select in inputs:
        assert given.sql in sql, given.name
        sql = sql.replace(given.sql, f"{given.name} AS ({select.format(**DUCK)})")
    return sql


OUTCOME = "CASE WHEN event_id % 11 = 0 THEN 'skipped' WHEN event_type = 'error' THEN 'cant_tell' WHEN event_type = 'signup' THEN 'cant_view' WHEN event_id % 7 < 5 THEN 'yes' ELSE 'no' END"
SUBJECT = "CAST(event_id % 2500 AS STRING)"
REVIEWS = f"""SELECT {SUBJECT} AS subject, CAST(user_id AS STRING) AS reviewer, CAST(event_id AS STRING) AS event, {OUTCOME} AS outcome, user_id % 3 <> 0 AS qualified,
  CAST(CASE WHEN user_id % 4 = 0 THEN 1.25 WHEN user_id % 4 = 1 THEN 0.5 END AS DOUBLE) AS weight FROM {{events}}"""
ADJUDICATIONS = f"""SELECT CAST(c_custkey AS STRING) AS subject, CASE WHEN c_custkey % 6 = 0 THEN CAST(c_custkey % 20 AS STRING) ELSE 'x' END AS adjudicator, 'a' || CAST(c_custkey AS STRING) AS event,
  CASE WHEN c_custkey % 9 = 0 THEN 'cant_tell' WHEN c_acctbal > 2000 THEN 'yes' ELSE 'no' END AS outcome, c_custkey % 7 <> 0 AS qualified,
  CASE WHEN c_custkey % 4 = 3 THEN {{list}}('a' || CAST(c_custkey AS STRING)) ELSE sources END AS sources FROM {{customer}}
  JOIN (SELECT {SUBJECT} AS subject, {{gather}}(CAST(event_id AS STRING)) AS sources FROM {{events}} WHERE {OUTCOME} IN ('yes', 'no') GROUP BY {SUBJECT}) d ON d.subject = CAST(c_custkey AS STRING) WHERE c_custkey % 3 <> 1"""
GATES = f"SELECT CAST(p_partkey AS STRING) AS subject, {', '.join(f'CASE WHEN p_partkey % 13 <> {k} THEN p_partkey % {k + 7} <> 1 END AS {g}' for k, g in enumerate(consensus.GATES))} FROM {{part}}"


@query(twin("q_rule_consensus", (rules.REVIEWS, REVIEWS), (rules.ADJUDICATIONS, ADJUDICATIONS), (rules.GATES, GATES)))
def q_consensus_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of each subject that events review, customers adjudicate and parts gate."""
    return consensus.layers(*(fed(spark, sf_dir, x) for x in (REVIEWS, ADJUDICATIONS, GATES)))


CONTROLS = """SELECT CAST(user_id AS STRING) AS reviewer, CASE WHEN event_id % 2 = 0 THEN 'yes' ELSE 'no' END AS expected,
  CASE WHEN value > 90 THEN 'cannot_tell' WHEN (event_id % 2 = 0) = (value < 60 + user_id % 30) THEN 'yes' ELSE 'no' END AS actual FROM {events} WHERE event_id % 2 = 0 OR user_id % 5 <> 0"""
OVERLAPS = """SELECT CAST(user_id AS STRING) AS reviewer, CAST(event_id AS STRING) AS item, CASE WHEN value < 50 THEN 'yes' ELSE 'no' END AS label,
  CASE WHEN event_id % 4 = 0 THEN {list}('yes', 'no') WHEN (event_id % 5 < 4) = (value < 50) THEN {list}('yes') ELSE {list}('no') END AS peers,
  CASE WHEN event_id % 3 = 0 THEN CASE WHEN (event_id % 7 < 6) = (value < 50) THEN 'yes' ELSE 'no' END END AS adjudicated FROM {events} WHERE user_id % 6 <> 0"""


@query(twin("q_rule_reliability", (rules.CONTROLS, CONTROLS), (rules.OVERLAPS, OVERLAPS)))
def q_reviewer_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as reviewers, their events as controls and overlaps."""
    return estimators.reliability(fed(spark, sf_dir, CONTROLS), fed(spark, sf_dir, OVERLAPS))


PLANS = f"""SELECT 'p' || CAST(r_regionkey AS STRING) AS plan, CASE WHEN r_regionkey = 1 THEN 'targeted_failure_discovery' ELSE 'representative_audit' END AS kind,
  CASE WHEN r_regionkey = 2 THEN 'targeted_priority' ELSE 'stratified_random' END AS design, r_regionkey <> 2 AS representative, CASE WHEN r_regionkey <> 3 THEN r_regionkey <> 4 END AS blind,
  CASE WHEN r_regionkey <> 2 THEN '{estimators.INCLUSION}' END AS method, CASE WHEN r_regionkey = 4 THEN {{list}}('owner_id') ELSE {{list}}('owner_id', 'observation_id') END AS grouping_keys FROM {{region}}"""
STRATA = """SELECT 'p' || CAST(n_regionkey AS STRING) AS plan, 's' || CAST(n_nationkey AS STRING) AS stratum, CAST(0.2 AS DOUBLE) AS weight, n AS population
  FROM {nation} JOIN (SELECT c_nationkey, count(*) AS n FROM {customer} GROUP BY c_nationkey) c ON c_nationkey = n_nationkey"""
RECORDS = """SELECT 'p' || CAST(n_regionkey AS STRING) AS plan, 'r' || CAST(c_custkey AS STRING) AS record, 's' || CAST(n_nationkey AS STRING) AS stratum,
  CAST(CASE WHEN c_custkey % 50 = 0 AND n_regionkey = 2 THEN NULL ELSE 0.5 END AS DOUBLE) AS p, 'o' || CAST(c_custkey % 40 AS STRING) AS owner, 'b' || CAST(c_custkey AS STRING) AS observation,
  CASE WHEN c_acctbal > 1000 THEN 'correct' ELSE 'incorrect' END AS outcome FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0"""


@query(twin("q_rule_audit", (rules.PLANS, PLANS), (rules.STRATA, STRATA), (rules.RECORDS, RECORDS)))
def q_audit_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as audits of their nations' customers; what keeps each from estimating a population."""
    return estimators.audit_blockers(*(fed(spark, sf_dir, x) for x in (PLANS, STRATA, RECORDS)))


MEDIA = "CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING)"
SPECIES = "SELECT 'k' || CAST(s_suppkey AS STRING) AS taxon_key FROM {supplier}"
CHOSEN = f"SELECT DISTINCT {MEDIA} AS media, CAST(l_orderkey AS STRING) AS observation FROM {{lineitem}} WHERE l_linenumber <= 3"
SEEN = "SELECT CAST(o_orderkey AS STRING) AS observation, CAST(o_custkey AS STRING) AS observer, 'p:' || CAST(o_custkey % 90 AS STRING) AS accepted_key FROM {orders}"
OBJECTS = f"SELECT {MEDIA} AS media, CASE WHEN min(l_returnflag) = 'R' THEN 'broken' ELSE 'valid' END AS decode_status, 'h' || CAST(min(l_partkey) AS STRING) AS sha256, CAST(max(l_partkey) AS BIGINT) AS bytes FROM {{lineitem}} GROUP BY {MEDIA}"
DECIDED = f"SELECT DISTINCT CASE WHEN l_suppkey % 9 <> 0 THEN 'k' || CAST(l_suppkey AS STRING) END AS taxon_key, {MEDIA} AS media, 'p:' || CAST(l_suppkey % 90 AS STRING) AS accepted_key, CASE WHEN l_linestatus = 'O' THEN 'eligible' ELSE 'denied' END AS gate FROM {{lineitem}}"


@query(twin("q_rule_coverage", (rule_views.SPECIES, SPECIES), (rule_views.CHOSEN, CHOSEN), (rule_views.SEEN, SEEN), (rule_views.OBJECTS, OBJECTS), (rule_views.DECIDED, DECIDED)))
def q_species_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as species, lines as their media, orders as observations."""
    chosen, seen, objects = (fed(spark, sf_dir, x) for x in (CHOSEN, SEEN, OBJECTS))
    return coverage.coverage(fed(spark, sf_dir, SPECIES), fed(spark, sf_dir, DECIDED), coverage.selected_objects(chosen, seen, objects))


@query(twin("q_rule_unique_content", (rule_views.OBJECTS, OBJECTS)))
def q_unique_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as objects, parts as their contents."""
    return coverage.unique_content(fed(spark, sf_dir, OBJECTS))


TAKEDOWNS = """SELECT 't' || CAST(c_custkey AS STRING) AS request, c_custkey * 137 % 200000 AS opened_s, CASE c_custkey % 4 WHEN 0 THEN 'reject' WHEN 1 THEN NULL ELSE 'uphold' END AS decision, c_custkey % 5 <> 0 AS sealed FROM {customer}"""
DEPENDS = """SELECT 't' || CAST(o_custkey AS STRING) AS request, 'd' || CAST(o_orderkey AS STRING) AS dependency, CASE WHEN o_orderstatus = 'F' OR o_custkey % 3 = 0 THEN 'removed' WHEN o_orderstatus = 'P' THEN 'quarantined' END AS action FROM {orders} WHERE o_orderkey % 4 = 0"""


@query(twin("q_rule_takedowns", (rule_views.TAKEDOWNS, TAKEDOWNS), (rule_views.DEPENDS, DEPENDS)))
def q_takedown_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as takedown requests, their orders as dependencies."""
    return disclosure.takedown_states(fed(spark, sf_dir, TAKEDOWNS), fed(spark, sf_dir, DEPENDS), 100_000)


CANDIDATES = """SELECT CAST(p_partkey AS STRING) AS id, CAST(p_size AS BIGINT) AS calls, CAST(CASE WHEN p_partkey % 11 <> 0 THEN p_partkey % 7 END AS DOUBLE) AS unique_per_call,
  CAST(CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 10 / 100.0 END AS DOUBLE) AS positive, p_partkey % 5 AS windows, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey * 997 % 100000 END AS last_s FROM {part}"""


@query(twin("q_rule_candidates", (rules.CANDIDATES, CANDIDATES)))
def q_candidate_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as candidates that cool down or stop."""
    c = [F.col(x) for x in ("calls", "unique_per_call", "positive", "windows", "last_s")]
    state = planning.candidate_state(*c, F.lit(100_000), least_calls=10, low_unique=2, low_positive=0.05, stop_windows=3, cooldown_h=24)
    rows = fed(spark, sf_dir, CANDIDATES).select("id", state.alias("s"), planning.age_need(F.col("last_s"), F.lit(100_000), 48).alias("age"))
    return rows.select("id", "s.state", "s.next_s", "age")


ATTEMPTS = """SELECT 'x:' || CAST(event_id AS STRING) AS execution, CASE event_type WHEN 'error' THEN 'uncertain' WHEN 'view' THEN 'released' ELSE 'consumed' END AS budget,
  CAST(CASE event_id % 6 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 404 WHEN 3 THEN 500 WHEN 4 THEN 200 END AS INT) AS status, CAST(event_id % 5 AS INT) AS attempt, CASE WHEN user_id % 4 = 0 THEN event_id % 100 END AS retry_after FROM {events}"""


@query(twin("q_rule_retry", (rules.ATTEMPTS, ATTEMPTS)))
def q_retry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, retried with deterministic jitter."""
    r = planning.retry(F.col("budget"), F.col("status"), F.col("attempt"), F.col("execution"), F.col("retry_after"))
    return fed(spark, sf_dir, ATTEMPTS).select("execution", r.alias("r")).select("execution", F.col("r.status").alias("state"), "r.reason", "r.next_attempt", "r.delay_s")

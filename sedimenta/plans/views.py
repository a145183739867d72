"""The rules of names, views and public gates over inputs that the star tables give, as in reviews and intake."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import disclosure, discovery, taxonomy

from . import rule_views
from .intake import LISTING, NAMED, TAXA, _crosswalk, _lineage
from .registry import query
from .reviews import fed, twin

# --- names as queries

NAMES = """SELECT 'n' || CAST(p_partkey AS STRING) AS assertion, 'k' || CAST(p_partkey AS STRING) AS taxon_key, CASE WHEN p_partkey % 3 = 0 THEN 'White  ' || p_name || ' ' || CAST(p_partkey AS STRING) ELSE 'Aus ' || p_name || ' ' || CAST(p_partkey AS STRING) END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN 'white ' || p_name || ' ' || CAST(p_partkey AS STRING) ELSE 'aus ' || p_name || ' ' || CAST(p_partkey AS STRING) END AS normalized, CASE p_partkey % 3 WHEN 0 THEN 'english_vernacular' WHEN 1 THEN 'accepted_scientific' ELSE 'scientific_synonym' END AS name_type,
  CASE WHEN p_partkey % 10 = 9 THEN 'genus' ELSE 'species' END AS rank, CASE WHEN p_partkey % 3 = 0 THEN 'en' ELSE 'zxx' END AS language, CASE p_partkey % 3 WHEN 0 THEN 'authority_vernacular' WHEN 1 THEN 'accepted_authority' ELSE 'provider_linked_synonym' END AS trust,
  'none_detected' AS homonym_risk, p_partkey >= 0 AS eligible, 'accepted_name' AS reason, 'p' AS provider FROM {part}"""
KNOWN = "SELECT 'k' || CAST(p_partkey + 1 AS STRING) AS taxon_key, 'aus ' || p_name || ' ' || CAST(p_partkey AS STRING) AS normalized FROM {part} WHERE p_partkey % 29 = 0"
COUNTS = "SELECT 'k' || CAST(p_partkey AS STRING) AS taxon_key, count(l_partkey) AS n FROM {part} LEFT JOIN {lineitem} ON l_partkey = p_partkey GROUP BY p_partkey"
ASSOCIATED = "SELECT 'a' || CAST(o_orderkey AS STRING) AS association, 'n' || CAST(o_custkey AS STRING) AS assertion FROM {orders}"


def _without(column: str, sql: str) -> str:
    return f"SELECT * EXCLUDE ({column}) FROM ({sql})"


@query(_without("place", twin("q_rule_definitions", (rule_views.NAMES, NAMES))))
def q_query_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names as query definitions."""
    return discovery.definitions(fed(spark, sf_dir, NAMES)).select("assertion", "taxon_key", "normalized", "tier", "language", "definition", "compiler_fingerprint")


@query(twin("q_rule_requests", (rule_views.NAMES, NAMES), (rule_views.ASSOCIATED, ASSOCIATED)))
def q_shared_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders associate customers' names; associations share the request of their term."""
    defined = discovery.definitions(fed(spark, sf_dir, NAMES))
    known = defined.select("assertion", "definition", F.col("compiler_fingerprint").alias("fingerprint"))
    rows = discovery.requests(fed(spark, sf_dir, ASSOCIATED).join(known.hint("merge"), "assertion").drop("assertion"), defined, {"method": "search"})
    shared = rows.groupBy("request").agg(F.count("*").alias("shared"))
    return rows.join(shared.hint("merge"), "request").join(defined.select("definition", "normalized").hint("merge"), "definition").select("association", "normalized", "parameters", "request", "shared")


@query(twin("q_rule_name_collisions", (rule_views.NAMES, NAMES), (rule_views.KNOWN, KNOWN)))
def q_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts' names that another part has."""
    return taxonomy.colliding_names(fed(spark, sf_dir, NAMES).select("taxon_key", "normalized"), fed(spark, sf_dir, KNOWN))


@query(twin("q_rule_catalogue", *LISTING, NAMED[1], (rule_views.NAMES, NAMES), (rule_views.COUNTS, COUNTS)))
def q_species_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as species with names, providers, open conflicts and their lines."""
    rows = taxonomy.species(fed(spark, sf_dir, TAXA), accepted_only=False).select("taxon_key", "name", _lineage().alias("lineage"))
    return taxonomy.catalogue(rows, _crosswalk(spark, sf_dir), fed(spark, sf_dir, NAMES).select("taxon_key", "name_type", "name", "assertion"), fed(spark, sf_dir, COUNTS))


# --- views and public gates

BLIND = ", ".join(f"c_custkey % {n + 9} <> 0 AS {b}" for n, b in enumerate(disclosure.BLIND))
CAMPAIGNS = f"""SELECT 'c' || CAST(c_custkey AS STRING) AS campaign, CASE WHEN c_custkey % 4 = 0 THEN 'closed' ELSE 'open' END AS campaign_status, c_mktsegment AS question, 'j' || CAST(c_nationkey AS STRING) AS project, 2 + c_custkey % 3 AS target_count,
  1 + c_custkey % 2 AS minimum_qualified, c_custkey % 2 = 0 AS expert_gate, {BLIND} FROM {{customer}}"""
STATUS = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN 'assigned' WHEN 1 THEN 'opened' WHEN 2 THEN 'expired' WHEN 3 THEN 'withdrawn' ELSE 'responded' END"
WORK = f"SELECT 'w' || CAST(o_orderkey AS STRING) AS assignment, 'c' || CAST(o_custkey AS STRING) AS campaign, 'm' || CAST(o_orderkey % 150 AS STRING) AS media, {STATUS} AS assignment_status, 'r' || CAST(o_orderkey % 40 AS STRING) AS reviewer FROM {{orders}}"
MEDIA = """SELECT 'm' || CAST(p_partkey AS STRING) AS media, CASE WHEN p_partkey % 3 = 0 THEN 'm' || CAST(p_partkey + 1 AS STRING) END AS parent, CASE WHEN p_partkey % 5 <> 0 THEN 'ph' || CAST(p_partkey AS STRING) END AS photo, CASE WHEN p_partkey % 7 = 0 THEN 'draft' ELSE 'committed' END AS media_state,
  CASE WHEN p_partkey % 8 = 0 THEN 'broken' ELSE 'valid' END AS decode_status, CASE WHEN p_partkey % 9 = 0 THEN 'denied' ELSE 'allowed' END AS rights_status, p_partkey % 10 <> 0 AS display_allowed, 'h' || CAST(p_partkey AS STRING) AS image_sha256 FROM {part}"""
TOLD = "SELECT 'd' || CAST(event_id AS STRING) AS disclosure, 'w' || CAST(event_id * 3 AS STRING) AS assignment, 'released' AS disclosure_state, event_type AS model_label, event_id % 5 AS peer_yes_count, event_id % 3 AS peer_no_count, props AS secret FROM {events}"
JUDGES = f"SELECT 'j' || CAST(o_orderkey AS STRING) AS assignment, 'f' || CAST(o_custkey AS STRING) AS conflict, {STATUS} AS assignment_status FROM {{orders}}"
CONFLICTS = "SELECT 'f' || CAST(c_custkey AS STRING) AS conflict, 'c' || CAST(c_custkey AS STRING) AS campaign, 'm' || CAST(c_custkey AS STRING) AS media, CASE WHEN c_custkey % 2 = 0 THEN 'species' ELSE 'stage' END AS conflict_field, 2 + c_custkey % 4 AS source_event_count FROM {customer}"
TARGETS = "SELECT DISTINCT 'c' || CAST(o_custkey AS STRING) AS campaign, 'm' || CAST(o_orderkey % 150 AS STRING) AS media FROM {orders} WHERE o_orderkey % 4 <> 0"
PROFILES = """SELECT 'u' || CAST(c_custkey AS STRING) AS caller, 'r' || CAST(c_custkey AS STRING) AS profile, 'r' || CAST(c_custkey AS STRING) AS reviewer, CASE WHEN c_custkey % 3 = 0 THEN 'unverified' ELSE 'verified' END AS qualification,
  c_name AS public_name, CASE WHEN c_custkey % 8 = 0 THEN 'suspended' ELSE 'active' END AS status FROM {customer}"""
MEMBERS = """SELECT 'j' || CAST(n_nationkey AS STRING) AS project, 'r' || CAST(c_custkey AS STRING) AS profile, 'r' || CAST(c_custkey AS STRING) AS reviewer, CASE c_custkey % 4 WHEN 0 THEN 'curator' WHEN 1 THEN 'expert' ELSE 'reviewer' END AS role,
  CASE WHEN (c_custkey + n_nationkey) % 5 = 0 THEN 'suspended' ELSE 'active' END AS status FROM {customer} JOIN {nation} ON n_regionkey = c_custkey % 5"""
RELEASES = "SELECT 'x' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS candidate, 'm' || CAST(l_partkey AS STRING) AS media FROM {lineitem} GROUP BY l_orderkey, l_linenumber, l_partkey"
ASKED = "SELECT 'media_object' AS kind, 'm' || CAST(c_custkey AS STRING) AS target FROM {customer} WHERE c_custkey % 12 = 1 UNION ALL SELECT 'photo', 'ph' || CAST(c_custkey AS STRING) FROM {customer} WHERE c_custkey % 17 = 2"
PAGED = "SELECT 'g' || CAST(user_id AS STRING) AS page, 'a' || CAST(event_id % 300 AS STRING) AS asset, CAST(event_id % 310 AS STRING) AS photo, CASE WHEN event_id % 40 = 0 THEN 'blocked' ELSE 'eligible' END AS state FROM {events}"
NEXT = """SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'disagreement' WHEN 1 THEN 'potential_gap' WHEN 2 THEN 'reference_image' ELSE 'high_impact_release' END AS campaign_kind, user_id % 4 AS active, user_id % 2 AS active_experts, user_id % 3 AS active_qualified,
  CAST(3 AS BIGINT) AS target_count, 1 + event_id % 3 AS minimum_qualified, event_type <> 'view' AS expert_gate FROM {events}"""
WORKED = ((rule_views.CAMPAIGNS, CAMPAIGNS), (rule_views.WORK, WORK), (rule_views.MEDIA, MEDIA))


@query(twin("q_rule_blind", *WORKED))
def q_blind_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as assignments of customers' campaigns over parts as media."""
    return disclosure.blind_assignments(*(fed(spark, sf_dir, x) for x in (WORK, CAMPAIGNS, MEDIA)))


@query(twin("q_rule_post_decision", (rule_views.TELL, TOLD), WORKED[1]))
def q_post_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as disclosures of assignments."""
    return disclosure.post_decision(fed(spark, sf_dir, TOLD), fed(spark, sf_dir, WORK))


@query(twin("q_rule_adjudication_queue", (rule_views.JUDGES, JUDGES), (rule_views.CONFLICTS, CONFLICTS), WORKED[0], WORKED[2]))
def q_adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judges of customers' conflicts."""
    return disclosure.adjudication_queue(*(fed(spark, sf_dir, x) for x in (JUDGES, CONFLICTS, CAMPAIGNS, MEDIA)))


@query(twin("q_rule_progress", *WORKED[:2], (rule_views.TARGETS, TARGETS), (rule_views.PROFILES, PROFILES), (rule_views.MEMBERS, MEMBERS)))
def q_assignment_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets of campaigns with what was assigned and answered, and by whom."""
    work = fed(spark, sf_dir, WORK).withColumnRenamed("assignment_status", "status")
    return disclosure.assignment_progress(fed(spark, sf_dir, CAMPAIGNS), fed(spark, sf_dir, TARGETS), work, fed(spark, sf_dir, PROFILES), fed(spark, sf_dir, MEMBERS))


@query(twin("q_rule_next_assignment", (rule_views.NEXT, NEXT)))
def q_next_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as campaigns' states; why and to whom the next assignment goes."""
    return disclosure.next_assignment(fed(spark, sf_dir, NEXT)).select("id", "reason", "required_role")


@query(twin("q_rule_taken_down", (rule_views.RELEASES, RELEASES), (rule_views.ASKED, ASKED), WORKED[2]))
def q_taken_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as release candidates under a customer's rights request, by lineage or photo."""
    return disclosure.taken_down(fed(spark, sf_dir, RELEASES), fed(spark, sf_dir, MEDIA), fed(spark, sf_dir, ASKED))


@query(twin("q_rule_pages", (rule_views.PAGED, PAGED)))
def q_admitted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as pages of their events' assets, whole or not at all."""
    return disclosure.admitted_page(fed(spark, sf_dir, PAGED))


SIGNUPS = """SELECT CASE WHEN c_custkey % 11 <> 0 THEN 'u' || CAST(c_custkey * 2 AS STRING) END AS caller, CASE c_custkey % 9 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS anonymous, 'j' || CAST(c_nationkey AS STRING) AS project,
  CASE c_custkey % 8 WHEN 0 THEN 'x' WHEN 1 THEN 'me@' || c_mktsegment WHEN 2 THEN 'see http://' || c_mktsegment ELSE ' ' || c_name || ' ' END AS name FROM {customer}"""
PROJECTS = "SELECT 'j' || CAST(n_nationkey AS STRING) AS project, CASE WHEN n_nationkey % 6 = 0 THEN 'closed' ELSE 'active' END AS status FROM {nation}"


@query(twin("q_rule_registrations", (rule_views.SIGNUPS, SIGNUPS), (rule_views.PROJECTS, PROJECTS), (rule_views.PROFILES, PROFILES), (rule_views.MEMBERS, MEMBERS)))
def q_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers ask to join nations' projects."""
    return disclosure.registrations(*(fed(spark, sf_dir, x) for x in (SIGNUPS, PROJECTS, PROFILES, MEMBERS)))

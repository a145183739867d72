"""The rules of occurrences, names, providers and requests over inputs that the star tables give.

As in reviews, each input is a SELECT that Spark and DuckDB both run; the rule is the operator here and the rule's own SQL there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import coverage, decisions, discovery, occurrence, taxonomy

from . import rule_views, rules
from .registry import query
from .reviews import CHOSEN, SEEN, fed, twin

# --- occurrences and locations


def raw(source: str, **given: str) -> str:
    """A SELECT of raw text fields; those that aren't given are null."""
    fields = [f"{given.get(c, 'CAST(NULL AS STRING)')} AS {c}" for c in [*occurrence.TEXTS, *occurrence.OTHERS]]
    return f"SELECT event_id + 1 AS source_row_number, {', '.join(fields)} FROM {source}"


RAW = raw(
    "{events}", id="' r' || CAST(event_id AS STRING) || ' '", dataResourceUid="'dr' || CAST(user_id % 7 AS STRING)", license="CASE WHEN event_id % 3 = 0 THEN 'CC-BY' ELSE 'CC0' END",
    decimalLatitude="CASE WHEN event_id % 17 = 0 THEN 'NaN' WHEN event_id % 19 = 0 THEN ' ' ELSE '-' || CAST(event_id % 97 AS STRING) || '.' || CAST(event_id % 10 AS STRING) END",
    decimalLongitude="CAST(100 + event_id % 60 AS STRING) || '.5'", spatiallyValid="CASE event_id % 5 WHEN 0 THEN 'false' WHEN 1 THEN ' ' WHEN 2 THEN 'TRUE' WHEN 3 THEN 'true' END",
    eventDate="CASE event_id % 6 WHEN 0 THEN '2001/02' WHEN 1 THEN ' ' WHEN 2 THEN CAST(1500 + event_id % 700 AS STRING) ELSE CAST(1880 + event_id % 150 AS STRING) || '-02-03' END",
    basisOfRecord="CASE event_type WHEN 'view' THEN 'HUMAN_OBSERVATION' WHEN 'click' THEN 'FOSSIL_SPECIMEN' ELSE 'other' END", taxonConceptID="'c' || CAST(user_id % 40 AS STRING)",
    sensitive="CASE event_id % 11 WHEN 0 THEN 'generalised' WHEN 1 THEN 'alreadyGeneralised' END", assertions="CASE event_id % 4 WHEN 0 THEN 'A| B |' WHEN 1 THEN event_type END",
    coordinateUncertaintyInMeters="CASE event_id % 7 WHEN 0 THEN 'inf' WHEN 1 THEN ' 30.5 ' WHEN 2 THEN CAST(event_id AS STRING) WHEN 3 THEN 'far' END",
)
BROKEN = raw(
    "{events}", id="CASE WHEN event_id % 13 = 0 THEN ' ' ELSE CAST(event_id AS STRING) END", dataResourceUid="CASE WHEN user_id % 7 <> 0 THEN 'dr' END", license="CASE event_id % 5 WHEN 0 THEN 'CC-BY-NC' WHEN 1 THEN NULL WHEN 2 THEN 'CC-BY' ELSE 'CC0' END",
    spatiallyValid="CASE event_id % 6 WHEN 0 THEN 'maybe' WHEN 1 THEN 'True' END", sensitive="CASE event_id % 7 WHEN 0 THEN 'hidden' WHEN 1 THEN 'generalised' END", assertions="CASE event_id % 8 WHEN 0 THEN 'A|B|A' WHEN 1 THEN 'A|B' END",
)
CONCEPTS = "SELECT 'c' || CAST(s_suppkey AS STRING) AS taxon_concept_id, 'k' || CAST(s_suppkey AS STRING) AS taxon_key FROM {supplier}"
BLOCKED = "SELECT 'dr' || CAST(r_regionkey AS STRING) AS data_resource_uid FROM {region} WHERE r_regionkey % 2 = 1"


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrence.normalise(fed(spark, sf_dir, RAW), fed(spark, sf_dir, CONCEPTS), rules.RECEIPT, rules.LICENCES)


@query(twin("q_rule_occurrences", (rules.RAW, RAW), (rules.CONCEPTS, CONCEPTS)))
def q_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw text rows, typed, with suppliers as taxon concepts."""
    return _typed(spark, sf_dir).select(
        "source_row_number", "record_id", "taxon_key", "taxon_match_state", "decimal_latitude", "decimal_longitude", "coordinate_uncertainty_meters", "has_coordinates", "coordinate_in_range", "spatially_valid", "sensitive_status",
        "coordinates_publicly_generalised", "spatial_aggregation_eligibility", "event_year", "temporal_evidence_band", "evidence_category", "licence", "data_resource_uid", "quality_assertions", "quality_assertion_count",
    )


@query(twin("q_rule_occurrence_faults", (rules.BROKEN, BROKEN)))
def q_occurrence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw rows with what keeps them out."""
    return occurrence.faults(fed(spark, sf_dir, BROKEN), rules.LICENCES).select("source_row_number", "faults")


@query(twin("q_rule_eligible", (rules.RAW, RAW), (rules.BLOCKED, BLOCKED)))
def q_eligible_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that may be counted in space and whose resource no region blocks."""
    return occurrence.without_blocked(occurrence.eligible(_typed(spark, sf_dir)), fed(spark, sf_dir, BLOCKED)).select("record_id", "data_resource_uid")


LOCATION_RULES = """SELECT 's' || CAST(p_partkey AS STRING) AS subject, CASE p_partkey % 5 WHEN 0 THEN 'withhold' WHEN 1 THEN 'generalise' ELSE 'publish' END AS action, CASE p_partkey % 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'sensitive' ELSE 'not_sensitive' END AS sensitivity,
  CASE p_partkey % 3 WHEN 0 THEN {list}('cell') WHEN 1 THEN {list}('cell', 'region') ELSE {list}('region') END AS scopes, CASE WHEN p_partkey % 11 <> 0 THEN CAST(3 + p_size % 5 AS INT) END AS ceiling, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 20 END AS minimum_count FROM {part} WHERE p_partkey % 17 <> 0"""
LOCATIONS = """SELECT 's' || CAST(l_partkey AS STRING) AS subject, CASE WHEN l_orderkey % 2 = 0 THEN 'cell' ELSE 'region' END AS scope, CASE l_orderkey % 9 WHEN 0 THEN 'withheld' WHEN 1 THEN 'generalised' WHEN 2 THEN 'coarse_rollup' ELSE 'exact' END AS precision,
  CASE WHEN l_orderkey % 5 <> 0 THEN CAST(1 + l_orderkey % 7 AS INT) END AS resolution, CAST(l_quantity AS BIGINT) AS record_count FROM {lineitem}"""
LIMITS = """SELECT 's' || CAST(p_partkey AS STRING) AS subject, 'p1' AS provider, p_partkey % 8 <> 0 AS used, CASE p_partkey % 6 WHEN 0 THEN 'private' WHEN 1 THEN 'public_generalised' ELSE 'public_processed' END AS disclosure, CASE WHEN p_partkey % 10 <> 0 THEN CAST(2 + p_size % 6 AS INT) END AS ceiling FROM {part} WHERE p_partkey % 9 <> 0
  UNION ALL SELECT 's' || CAST(p_partkey AS STRING), 'p2', p_partkey % 4 = 0, CASE WHEN p_partkey % 12 <> 0 THEN 'public_geo' END, CAST(5 AS INT) FROM {part} WHERE p_partkey % 4 <> 3"""


@query(twin("q_rule_location", (rules.RULES, LOCATION_RULES), (rules.REQUESTS, LOCATIONS), (rules.CONSTRAINTS, LIMITS)))
def q_location_publication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as location requests of their parts; state, ceiling and blockers."""
    return decisions.location_decisions(*(fed(spark, sf_dir, x) for x in (LOCATION_RULES, LOCATIONS, LIMITS)), rules.PUBLIC_STATES, ("p1",))


# --- taxa, names and providers

#: A genus for every twenty parts; species share a name with a neighbour now and then.
GENUS = "'G' || CAST(p_partkey % 20 AS STRING)"
EPITHET = "'s' || CAST(p_partkey - CASE WHEN p_partkey % 40 = 20 THEN 20 ELSE 0 END AS STRING)"
TAXA = f"""SELECT 'k' || CAST(p_partkey AS STRING) AS taxon_key, {GENUS} || CASE WHEN p_partkey % 3 = 0 THEN ' (Sub) ' ELSE ' ' END || {EPITHET} AS name, CASE WHEN p_partkey % 10 = 9 THEN 'genus' ELSE 'species' END AS rank,
  CASE WHEN p_partkey % 15 = 0 THEN 'doubtful' ELSE 'accepted' END AS status, 'F' || CAST(p_partkey % 4 AS STRING) AS family, {GENUS} AS genus, CAST(p_partkey AS INT) AS ordinal, p_partkey + 1000 AS p1, CASE WHEN p_partkey % 8 <> 0 THEN p_partkey + 5000 END AS p2 FROM {{part}}"""
LISTED = f"""SELECT CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE '' END || CAST(p_partkey AS STRING) AS id, upper({GENUS}) || '  ' || {EPITHET} AS name, CASE WHEN p_partkey % 10 = 9 THEN 'Genus' ELSE 'Species' END AS rank,
  CASE WHEN p_partkey % 7 = 0 THEN 'Fx' WHEN p_partkey % 7 <> 1 THEN 'F' || CAST(p_partkey % 4 AS STRING) END AS family, CASE WHEN p_partkey % 2 = 0 THEN {GENUS} END AS genus FROM {{part}} WHERE p_partkey % 6 <> 0
  UNION ALL SELECT CAST(p_partkey + 900000 AS STRING), {GENUS} || ' ' || {EPITHET}, 'species', CAST(NULL AS STRING), {GENUS} FROM {{part}} WHERE p_partkey % 13 = 0"""
SERVICE = f"""SELECT 'k' || CAST(p_partkey AS STRING) AS taxon_key, p_partkey % 9 <> 0 AS found, CASE WHEN p_partkey % 9 <> 0 THEN lower({GENUS}) || CASE WHEN p_partkey % 10 = 9 THEN ' (sub) ' ELSE '  ' END || {EPITHET} || CASE WHEN p_partkey % 14 = 0 THEN 'a' ELSE '' END END AS name,
  CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 10 = 9 THEN 'GENUS' ELSE 'species' END END AS rank, CASE WHEN p_partkey % 9 <> 0 THEN CASE p_partkey % 8 WHEN 0 THEN 'fuzzyMatch' WHEN 1 THEN 'canonicalMatch' ELSE 'exactMatch' END END AS match_type,
  CASE p_partkey % 5 WHEN 0 THEN {{list}}('noIssue') WHEN 1 THEN {{list}}('noIssue', 'homonym') END AS issues, CASE WHEN p_partkey % 16 = 1 THEN 'Fy' WHEN p_partkey % 2 = 0 THEN 'F' || CAST(p_partkey % 4 AS STRING) END AS family, {GENUS} AS genus,
  CASE WHEN p_partkey % 12 = 0 THEN '' ELSE 's' || CAST(p_partkey AS STRING) END AS id FROM {{part}} WHERE p_partkey % 21 <> 0"""
LISTING, NAMED = ((rule_views.TAXA, TAXA), (rule_views.LISTED, LISTED)), ((rule_views.TAXA, TAXA), (rule_views.SERVICE, SERVICE))


def _lineage() -> Column:
    return F.map_filter(F.create_map(F.lit("family"), F.col("family"), F.lit("genus"), F.col("genus")), lambda k, v: v.isNotNull())


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = fed(spark, sf_dir, TAXA).select("taxon_key", "name", "rank", _lineage().alias("expected"))
    return taxonomy.match_candidates(taxa, fed(spark, sf_dir, LISTED).select("id", "name", "rank", _lineage().alias("lineage")))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    taxa = fed(spark, sf_dir, TAXA).select("taxon_key", taxonomy.query_name(F.col("name"), F.col("rank")).alias("q"), F.col("rank").alias("r"), _lineage().alias("e"))
    answers = fed(spark, sf_dir, SERVICE).select("taxon_key", "found", "name", "rank", "match_type", "issues", _lineage().alias("lineage"), "id")
    m = taxonomy.match_by_name(F.col("q"), F.col("r"), F.col("e"), {c: F.col(c) for c in ("found", "name", "rank", "match_type", "issues", "lineage", "id")})
    return taxa.join(answers, "taxon_key").select("taxon_key", m.alias("m")).select("taxon_key", "m.state", "m.reasons", "m.identifier")


def _crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.crosswalk(fed(spark, sf_dir, TAXA), {"listing": _listing(spark, sf_dir), "service": _named(spark, sf_dir)})


@query(twin("q_rule_listing", *LISTING))
def q_listing_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as taxa, matched with a listing by comparable name and rank."""
    return _listing(spark, sf_dir)


@query(twin("q_rule_name_service", *NAMED))
def q_name_service_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name service's answers against the lineages of parts as taxa."""
    return _named(spark, sf_dir)


@query(twin("q_rule_conflicts", *LISTING, NAMED[1]))
def q_provider_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What didn't match, by provider and type."""
    return taxonomy.conflicts(_crosswalk(spark, sf_dir))


@query(twin("q_rule_conflict_counts", *LISTING, NAMED[1]))
def q_provider_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts by provider and by type."""
    return taxonomy.conflict_counts(taxonomy.conflicts(_crosswalk(spark, sf_dir)))


@query(twin("q_rule_provider_queries", LISTING[0]))
def q_provider_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted species, each to two providers' queries."""
    return taxonomy.provider_queries(taxonomy.species(fed(spark, sf_dir, TAXA)), {"P1": ("p1", 300, 900), "P2": ("p2", 200, 600)})


PROVIDED = "SELECT s_suppkey AS provider_key, 'k' || CAST(s_suppkey AS STRING) AS taxon_key FROM {supplier}"


@query(twin("q_rule_media_taxa", (rule_views.CHOSEN, CHOSEN), (rule_views.SEEN, SEEN), (rule_views.PROVIDED, PROVIDED)))
def q_media_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as media, orders as their observations, suppliers as the crosswalk."""
    return coverage.media_with_taxon(*(fed(spark, sf_dir, x) for x in (CHOSEN, SEEN, PROVIDED)), "p")


# --- requests

BATCHES = "SELECT o_orderkey AS batch, {list}('k' || CAST(o_custkey AS STRING), 'k' || CAST(o_orderkey AS STRING)) AS keys, {list}(CASE WHEN o_custkey % 3 <> 0 THEN o_orderstatus END, o_orderpriority) AS responses FROM {orders}"


@query(twin("q_rule_zip", (rule_views.BATCHES, BATCHES)))
def q_zipped_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches of two keys with responses by position."""
    return taxonomy.zip_responses(fed(spark, sf_dir, BATCHES))


ASSOCIATIONS = """SELECT 'a' || CAST(o_orderkey AS STRING) AS association, 'f' || CAST(o_orderkey AS STRING) AS fingerprint FROM {orders} WHERE o_orderkey % 11 <> 0
  UNION ALL SELECT 'a' || CAST(o_orderkey AS STRING), 'f' || CAST(o_orderkey AS STRING) FROM {orders} WHERE o_orderkey % 50 = 1"""
LINKS = """SELECT 'l' || CAST(o_orderkey AS STRING) AS link, 'a' || CAST(o_orderkey AS STRING) AS association, CASE WHEN o_orderkey % 17 = 0 THEN 'g' ELSE 'f' END || CAST(o_orderkey AS STRING) AS fingerprint, 'r' || CAST(o_custkey AS STRING) AS request FROM {orders} WHERE o_orderkey % 13 <> 0
  UNION ALL SELECT 'm' || CAST(o_orderkey AS STRING), 'a' || CAST(o_orderkey AS STRING), CASE WHEN o_orderkey % 17 = 0 THEN 'g' ELSE 'f' END || CAST(o_orderkey AS STRING), 'r' || CAST(o_custkey + 1 AS STRING) FROM {orders} WHERE o_orderkey % 60 = 2"""
EXECUTED = "SELECT 'r' || CAST(c_custkey AS STRING) AS request, 'x' || CAST(c_custkey AS STRING) AS receipt, 'p' || c_name AS page_fingerprint FROM {customer} WHERE c_custkey % 8 <> 0"


@query(twin("q_rule_ledger_faults", (rule_views.ASSOCIATIONS, ASSOCIATIONS), (rule_views.LINKS, LINKS), (rule_views.EXECUTED, EXECUTED)))
def q_association_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as associations and links, customers as executed requests; completeness both ways."""
    return discovery.ledger_faults(*(fed(spark, sf_dir, x) for x in (ASSOCIATIONS, LINKS, EXECUTED)))


@query(twin("q_rule_ledger", (rule_views.LINKS, LINKS), (rule_views.EXECUTED, EXECUTED)))
def q_association_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each link of an executed request."""
    return discovery.ledger_rows(fed(spark, sf_dir, LINKS), fed(spark, sf_dir, EXECUTED))


TRIES = """SELECT 'x' || CAST(user_id AS STRING) AS execution, CAST(event_id AS INT) AS attempt, CAST(CASE event_id % 5 WHEN 0 THEN 503 WHEN 1 THEN 404 WHEN 2 THEN NULL ELSE 200 END AS INT) AS status,
  CASE WHEN event_id % 4 <> 0 THEN event_type || ' é ' || props END AS body, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM {events}"""


@query(twin("q_rule_request_ledger", (rule_views.TRIES, TRIES)))
def q_request_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as attempts, in hash-only rows."""
    return discovery.request_ledger(fed(spark, sf_dir, TRIES))

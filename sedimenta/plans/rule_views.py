"""Rules of names, requests, views and coverage over small given tables (D, P, J, A, X rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import coverage, disclosure, discovery, taxonomy

from .given import Given, over
from .registry import rule
from .rules import some

# --- taxa, names and providers

TAXA = Given("taxa", "taxon_key string, name string, rank string, status string, family string, genus string, ordinal int, p1 long, p2 long", [
    ("k1", "Aus (Bus) albus", "species", "accepted", "Fam", "Aus", 3, 11, 21), ("k2", "Aus niger", "species", "accepted", "Fam", "Aus", 4, 12, 22), ("k3", "Aus", "genus", "accepted", "Fam", "Aus", 2, 13, 23),
    ("k4", "Cus rufus", "species", "accepted", "Gam", "Cus", 6, 14, None), ("k5", "Dus old", "species", "doubtful", "Gam", "Dus", 7, 15, 25), ("k6", "Cus duplex", "species", "accepted", "Gam", "Cus", 8, 16, 26), ("k7", "Cus falsus", "species", "accepted", "Gam", "Cus", 9, 17, 27),
])
LISTED = Given("listed", "id string, name string, rank string, family string, genus string", [
    ("101", "aus  ALBUS", "Species", "Fam", "Aus"), ("102", "Aus niger", "species", "Wrong", "Aus"), ("103", "Aus", "genus", None, None), ("x4", "Cus rufus", "species", "Gam", "Cus"), ("106", "Cus duplex", "species", "Gam", "Cus"), ("107", "Cus duplex", "species", None, "Cus"),
])


def _expected(family: str = "family", genus: str = "genus"):
    return F.map_filter(F.create_map(F.lit("family"), F.col(family), F.lit("genus"), F.col(genus)), lambda k, v: v.isNotNull())


def _listing(spark: SparkSession) -> DataFrame:
    taxa = TAXA.df(spark).select("taxon_key", "name", "rank", _expected().alias("expected"))
    return taxonomy.match_candidates(taxa, LISTED.df(spark).select("id", "name", "rank", _expected().alias("lineage")))


LISTING_SQL = r"""
n AS (SELECT taxon_key, rank, family, genus, lower(regexp_replace(regexp_replace(name, '^(\S+)\s+\([^)]+\)\s+', '\1 '), '\s+', ' ', 'g')) AS n FROM taxa),
m AS (SELECT t.taxon_key, l.id, coalesce(t.family = l.family, TRUE) AND coalesce(t.genus = l.genus, TRUE) AS fits FROM n t LEFT JOIN listed l ON t.n = lower(regexp_replace(regexp_replace(l.name, '^(\S+)\s+\([^)]+\)\s+', '\1 '), '\s+', ' ', 'g')) AND t.rank = lower(l.rank)),
p AS (SELECT taxon_key, count(id) AS candidate_count, count(*) FILTER (WHERE id IS NOT NULL AND fits) AS n, min(id) FILTER (WHERE fits) AS id FROM m GROUP BY 1),
listing AS (SELECT taxon_key, CASE WHEN candidate_count = 0 THEN 'unmatched' WHEN n <> 1 OR NOT regexp_full_match(id, '[0-9]+') THEN 'conflict' ELSE 'matched' END AS state,
  CASE WHEN candidate_count = 0 THEN ['provider_no_match'] WHEN n = 0 THEN ['classification_mismatch'] WHEN n > 1 THEN ['ambiguous_multiple_matches'] WHEN NOT regexp_full_match(id, '[0-9]+') THEN ['missing_or_non_numeric_identifier'] ELSE [] END::VARCHAR[] AS reasons,
  CASE WHEN n = 1 AND regexp_full_match(id, '[0-9]+') THEN id END AS identifier, candidate_count FROM p)
"""


@rule(over(TAXA, LISTED, then=f", {LISTING_SQL} SELECT * FROM listing"))
def q_rule_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of a listing by comparable name and rank."""
    return _listing(spark)


SERVICE = Given("service", "taxon_key string, found boolean, name string, rank string, match_type string, issues array<string>, family string, genus string, id string", [
    ("k1", True, "Aus albus", "species", "exactMatch", ["noIssue"], "Fam", "Aus", "s1"), ("k2", True, "Aus niger", "genus", "fuzzyMatch", ["homonym"], "Gam", "Aus", "s2"), ("k3", False, None, None, None, None, None, None, None),
    ("k4", True, "Cus rufus", "SPECIES", "canonicalMatch", None, None, None, ""), ("k5", True, "Dus new", "species", "exactMatch", None, "Gam", "Xus", "s5"),
])


def _service(spark: SparkSession) -> DataFrame:
    rows = TAXA.df(spark).select("taxon_key", taxonomy.query_name(F.col("name"), F.col("rank")).alias("q"), F.col("rank").alias("r"), _expected().alias("e"))
    s = SERVICE.df(spark).select("taxon_key", "found", "name", "rank", "match_type", "issues", _expected().alias("lineage"), "id")
    m = taxonomy.match_by_name(F.col("q"), F.col("r"), F.col("e"), {c: F.col(c) for c in ("found", "name", "rank", "match_type", "issues", "lineage", "id")})
    return rows.join(s, "taxon_key").select("taxon_key", m.alias("m")).select("taxon_key", "m.state", "m.reasons", "m.identifier")


SERVICE_SQL = rf"""
q AS (SELECT t.taxon_key, t.rank AS r, t.family AS ef, t.genus AS eg, lower(regexp_replace(regexp_replace(t.name, '^(\S+)\s+\([^)]+\)\s+', '\1 '), '\s+', ' ', 'g')) AS n, s.* EXCLUDE (taxon_key) FROM taxa t JOIN service s USING (taxon_key)),
w AS (SELECT *, {some(("name_mismatch", r"n IS DISTINCT FROM lower(regexp_replace(regexp_replace(name, '^(\S+)\s+\([^)]+\)\s+', '\1 '), '\s+', ' ', 'g'))"), ("rank_mismatch", "lower(coalesce(rank, '')) <> r"), ("non_exact_match", "coalesce(match_type NOT IN ('exactMatch', 'canonicalMatch'), TRUE)"),
    ("provider_issue", "len(list_filter(issues, lambda x: x <> 'noIssue')) > 0"), ("family_mismatch", "ef <> family"), ("genus_mismatch", "eg <> genus"), ("missing_identifier", "coalesce(id, '') = ''"))} AS rs FROM q),
named AS (SELECT taxon_key, CASE WHEN NOT found THEN 'unmatched' WHEN len(rs) > 0 THEN 'conflict' ELSE 'matched' END AS state, CASE WHEN NOT found THEN ['provider_no_match'] ELSE rs END::VARCHAR[] AS reasons, CASE WHEN found AND len(rs) = 0 THEN id END AS identifier FROM w)
"""


@rule(over(TAXA, SERVICE, then=f", {SERVICE_SQL} SELECT * FROM named"))
def q_rule_name_service(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name service's answers against expected lineages."""
    return _service(spark)


BACKBONE = Given("backbone", "taxon_key string, found boolean, name string, rank string, match_type string, status string, synonym boolean, family string, id string", [
    ("k1", True, "Aus albus", "SPECIES", "EXACT", "ACCEPTED", None, "Fam", "7"), ("k2", True, "Aus niger", "SPECIES", "EXACT", "SYNONYM", True, "Fam", "8"), ("k4", True, "Cus rufa", "SPECIES", "VARIANT", "ACCEPTED", False, None, "y9"), ("k5", False, None, None, None, None, None, None, None),
])


@rule(over(TAXA, BACKBONE, then=rf"""
, q AS (SELECT t.taxon_key, t.rank AS r, t.family AS ef, lower(regexp_replace(t.name, '^(\S+)\s+\([^)]+\)\s+', '\1 ')) AS n, s.* EXCLUDE (taxon_key) FROM taxa t JOIN backbone s USING (taxon_key)),
w AS (SELECT *, {some(("name_mismatch", "n IS DISTINCT FROM lower(name)"), ("rank_mismatch", "lower(rank) <> r"), ("non_exact_match", "match_type IS DISTINCT FROM 'EXACT'"), ("non_accepted_usage", "status IS DISTINCT FROM 'ACCEPTED' OR coalesce(synonym, FALSE)"),
    ("family_mismatch", "ef <> family"), ("missing_or_non_numeric_identifier", "NOT coalesce(regexp_full_match(id, '[0-9]+'), FALSE)"))} AS rs FROM q)
SELECT taxon_key, CASE WHEN NOT found THEN 'unmatched' WHEN len(rs) > 0 THEN 'conflict' ELSE 'matched' END AS state, CASE WHEN NOT found THEN ['provider_no_match'] ELSE rs END::VARCHAR[] AS reasons, CASE WHEN found AND len(rs) = 0 THEN id END AS identifier FROM w
"""))
def q_rule_backbone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16: a backbone's answers."""
    rows = TAXA.df(spark).select("taxon_key", taxonomy.query_name(F.col("name"), F.col("rank")).alias("q"), F.col("rank").alias("r"), _expected().alias("e"))
    lineage = F.map_filter(F.create_map(F.lit("family"), F.col("family")), lambda k, v: v.isNotNull())
    s = BACKBONE.df(spark).select("taxon_key", "found", "name", "rank", "match_type", "status", "synonym", lineage.alias("lineage"), "id")
    m = taxonomy.match_by_usage(F.col("q"), F.col("r"), F.col("e"), {c: F.col(c) for c in ("found", "name", "rank", "match_type", "status", "synonym", "lineage", "id")})
    return rows.join(s, "taxon_key").select("taxon_key", m.alias("m")).select("taxon_key", "m.state", "m.reasons", "m.identifier")


CROSSWALK_SQL = f"""{LISTING_SQL}, {SERVICE_SQL},
cross_ AS (SELECT taxon_key, 'listing' AS provider, state, reasons, identifier FROM listing UNION ALL
  SELECT t.taxon_key, 'service', coalesce(state, 'unmatched'), coalesce(reasons, ['provider_no_match']), identifier FROM taxa t LEFT JOIN named USING (taxon_key)),
conf AS (SELECT taxon_key, provider, state, CASE WHEN list_contains(reasons, 'ambiguous_multiple_matches') THEN 'ambiguous_provider_concept'
  WHEN list_has_any(reasons, ['name_mismatch', 'rank_mismatch', 'family_mismatch', 'genus_mismatch', 'classification_mismatch']) THEN 'incompatible_provider_concept' WHEN list_contains(reasons, 'non_accepted_usage') THEN 'provider_status_conflict'
  WHEN list_contains(reasons, 'non_exact_match') THEN 'non_exact_provider_match' WHEN list_contains(reasons, 'provider_issue') THEN 'provider_reported_issue'
  WHEN list_has_any(reasons, ['provider_no_match', 'missing_identifier', 'missing_or_non_numeric_identifier']) THEN 'missing_provider_concept' ELSE 'unclassified_provider_conflict' END AS conflict_type, reasons FROM cross_ WHERE state <> 'matched')
"""


def _crosswalk(spark: SparkSession) -> DataFrame:
    return taxonomy.crosswalk(TAXA.df(spark), {"listing": _listing(spark), "service": _service(spark)})


@rule(over(TAXA, LISTED, SERVICE, then=f", {CROSSWALK_SQL} SELECT * FROM conf"))
def q_rule_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What didn't match, by provider and type."""
    return taxonomy.conflicts(_crosswalk(spark))


@rule(over(TAXA, LISTED, SERVICE, then=f", {CROSSWALK_SQL} SELECT 'provider' AS dimension, provider AS value, count(*) AS n FROM conf GROUP BY provider UNION ALL SELECT 'type', conflict_type, count(*) FROM conf GROUP BY conflict_type"))
def q_rule_conflict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return taxonomy.conflict_counts(taxonomy.conflicts(_crosswalk(spark)))


NAMES = Given("names", "assertion string, taxon_key string, name string, normalized string, name_type string, rank string, language string, trust string, homonym_risk string, eligible boolean, reason string, provider string", [
    ("n1", "k1", "Aus albus", "aus albus", "accepted_scientific", "species", "zxx", "accepted_authority", "none_detected_locally", True, "accepted_name", "p"), ("n2", "k1", "White  Aus", "white aus", "english_vernacular", "species", "en", "authority_vernacular", "none_detected", True, "safe_vernacular", "p"),
    ("n3", "k3", "Aus", "aus", "accepted_scientific", "genus", "zxx", "accepted_authority", "none_detected", True, "accepted_name", "p"), ("n4", "k2", "Aus niger", "aus niger", "scientific_synonym", "species", "zxx", "provider_linked_synonym", "none_detected", True, "synonym", "p"),
])
WRONG = Given("names", NAMES.schema, [
    ("N 1", "k1", " ", " ", "accepted_scientific", "species", "zxx", "accepted_authority", "none_detected", True, "fine", "p"), ("w2", "k1", "White", "whyte", "nickname", "tribe", "en", "anyone", "collision", False, "excluded_homonym", ""),
    ("w3", "k1", "White", "white", "english_vernacular", "species", "de", "accepted_authority", "none_detected", True, "review pending", "p"), ("w4", None, "White", "white", "english_vernacular", "species", None, None, None, None, None, None),
])


@rule(over(NAMES, then="""SELECT assertion, taxon_key, normalized, CASE rank WHEN 'species' THEN 1 WHEN 'genus' THEN 2 WHEN 'family' THEN 3 ELSE 4 END AS tier, language,
  row_number() OVER (ORDER BY CASE rank WHEN 'species' THEN 1 WHEN 'genus' THEN 2 ELSE 3 END, normalized, taxon_key, assertion) AS place, 'query:v1:' || substr(compiler_fingerprint, 1, 24) AS definition, compiler_fingerprint
  FROM (SELECT *, sha256('{"assertion":"' || assertion || '","language":"' || language || '","name":"' || name || '","name_type":"' || name_type || '","normalized":"' || normalized || '","provider":"' || provider || '","rank":"' || rank || '","taxon_key":"' || taxon_key || '","tier":'
    || CASE rank WHEN 'species' THEN 1 WHEN 'genus' THEN 2 ELSE 3 END || ',"trust":"' || trust || '"}') AS compiler_fingerprint FROM names)"""))
def q_rule_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible assertions as query definitions, in their order."""
    from pyspark.sql.window import Window

    rows = discovery.definitions(NAMES.df(spark))
    place = F.row_number().over(Window.orderBy("tier", "normalized", "taxon_key", "assertion")).cast("long")
    return rows.select("assertion", "taxon_key", "normalized", "tier", "language", place.alias("place"), "definition", "compiler_fingerprint")


@rule(over(WRONG, then=f"""SELECT assertion, {some(("invalid_assertion_id", "NOT coalesce(regexp_full_match(assertion, '[a-z0-9][a-z0-9._:-]*'), FALSE)"), ("invalid_taxon_key", "NOT coalesce(regexp_full_match(taxon_key, '[a-z0-9][a-z0-9._:-]*'), FALSE)"), ("invalid_name", "trim(name) = ''"),
    ("invalid_normalized_name", "trim(normalized) = ''"), ("normalized_name_differs", "normalized <> trim(lower(name))"), ("name_type_not_supported", "name_type NOT IN ('accepted_scientific', 'scientific_synonym', 'english_vernacular', 'trusted_vernacular')"),
    ("rank_has_no_tier", "rank NOT IN ('species', 'genus', 'family', 'order', 'superfamily')"), ("not_eligible", "NOT coalesce(eligible, FALSE)"), ("eligibility_reason_contradicts", "coalesce(reason, '') = '' OR reason LIKE 'excluded\\_%' ESCAPE '\\' OR reason LIKE '%pending%'"),
    ("homonym_risk", "NOT coalesce(homonym_risk LIKE 'none\\_detected%' ESCAPE '\\', FALSE)"), ("no_language", "coalesce(language, '') = ''"), ("language_differs", "(name_type = 'english_vernacular' AND language <> 'en') OR (name_type IN ('accepted_scientific', 'scientific_synonym') AND language <> 'zxx')"),
    ("trust_insufficient", "NOT coalesce((name_type = 'accepted_scientific' AND trust IN ('accepted_authority', 'accepted_global_authority')) OR (name_type = 'english_vernacular' AND trust IN ('authority_vernacular', 'provider_curated_vernacular')), FALSE)"), ("no_provider", "coalesce(provider, '') = ''"))} AS faults FROM names"""))
def q_rule_definition_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps an assertion from becoming a query."""
    return discovery.definition_faults(WRONG.df(spark)).select("assertion", "faults")


ASSOCIATED = Given("associated", "association string, assertion string", [("a1", "n1"), ("a2", "n1"), ("a3", "n2")])


@rule(over(NAMES, ASSOCIATED, then="""SELECT a.association, n.normalized, '{"method":"search","text":"' || n.normalized || '"}' AS parameters, 'request:v1:' || substr(sha256('{"method":"search","text":"' || n.normalized || '"}'), 1, 24) AS request,
  count(*) OVER (PARTITION BY n.normalized) AS shared FROM associated a JOIN names n USING (assertion)"""))
def q_rule_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Associations share the request of their term."""
    defined = discovery.definitions(NAMES.df(spark))
    a = ASSOCIATED.df(spark).join(defined.select("assertion", "definition", F.col("compiler_fingerprint").alias("fingerprint")), "assertion").drop("assertion")
    rows = discovery.requests(a, defined, {"method": "search"})
    shared = rows.groupBy("request").agg(F.count("*").alias("shared"))
    return rows.join(shared, "request").join(defined.select("definition", "normalized"), "definition").select("association", "normalized", "parameters", "request", "shared")


ASSOCIATIONS = Given("assoc", "association string, fingerprint string", [("a1", "f1"), ("a2", "f2"), ("a3", "f3"), ("a3", "f3"), ("a5", "f5"), ("a6", "f6")])
LINKS = Given("links", "link string, association string, fingerprint string, request string", [("l1", "a1", "f1", "r1"), ("l2", "a2", "g2", "r1"), ("l3", "a3", "f3", "r1"), ("l4", "a4", "f4", "r1"), ("l6", "a6", "f6", "r9"), ("l7", "a6", "f6", "r1")])
EXECUTED = Given("executed", "request string, receipt string, page_fingerprint string", [("r1", "x1", "p1")])


@rule(over(ASSOCIATIONS, LINKS, EXECUTED, then=f"""
, a AS (SELECT association, count(*) AS na, min(fingerprint) AS own FROM assoc GROUP BY 1), l AS (SELECT association, count(*) AS nl, min(fingerprint) AS cited, count(*) FILTER (WHERE request NOT IN (SELECT request FROM executed)) AS elsewhere FROM links GROUP BY 1)
SELECT association, unnest({some(("association_repeats", "na > 1"), ("link_without_association", "na IS NULL"), ("association_without_link", "nl IS NULL"), ("association_has_several_links", "nl > 1"), ("fingerprint_differs", "own <> cited"), ("request_not_executed", "elsewhere > 0"))}) AS fault FROM a FULL JOIN l USING (association)
"""))
def q_rule_ledger_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completeness both ways."""
    return discovery.ledger_faults(ASSOCIATIONS.df(spark), LINKS.df(spark), EXECUTED.df(spark))


@rule(over(LINKS, EXECUTED, then="""SELECT receipt, association, 'ledger:v1:' || substr(h, 1, 24) AS record, h AS fingerprint FROM (SELECT receipt, association, sha256('{"link":"' || link || '","page":"' || page_fingerprint || '","receipt":"' || receipt || '"}') AS h FROM links JOIN executed USING (request))"""))
def q_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each link of an executed request."""
    return discovery.ledger_rows(LINKS.df(spark), EXECUTED.df(spark))


TRIES = Given("tries", "execution string, attempt int, status int, body string, error string", [("x1", 0, 200, "{}", None), ("x1", 1, 200, None, None), ("x2", 0, 503, None, "busy"), ("x3", 0, None, None, None), ("x4", 0, 200, "é", "parse"), ("x5", 0, 404, "gone", None)])


@rule(over(TRIES, then="""
, t AS (SELECT *, CASE WHEN (coalesce(status BETWEEN 200 AND 299, FALSE) AND (body IS NULL OR error IS NOT NULL)) OR (body IS NOT NULL AND error IS NOT NULL) THEN 'quarantined' WHEN coalesce(status BETWEEN 200 AND 299, FALSE) THEN 'success' ELSE 'failed' END AS state FROM tries)
SELECT execution, attempt, status, state, sha256(body) AS body_sha256, strlen(body)::BIGINT AS body_bytes, CASE WHEN state <> 'success' THEN sha256(coalesce(error, '')) END AS error_sha256 FROM t
"""))
def q_rule_request_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash-only rows."""
    return discovery.request_ledger(TRIES.df(spark))


ITEMS = Given("items", "kind string, input_fingerprint string", [("decode", "f1"), ("decode", "f2"), ("count", "f1")])
JOURNAL = Given("journal", "kind string, input string, output string", [("decode", "f1", "o1")])


@rule(over(ITEMS, JOURNAL, then="SELECT i.kind, input_fingerprint, CASE WHEN output IS NULL THEN 'execute' ELSE 'reuse_committed' END AS action, output AS committed_output FROM items i LEFT JOIN journal j ON i.kind = j.kind AND i.input_fingerprint = j.input"))
def q_rule_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is committed is used again."""
    done = discovery.resume_plan(JOURNAL.df(spark).select("kind", F.col("input").alias("input_fingerprint")), spark.createDataFrame([], "work string, output string"))
    journal = done.select("work", "kind", F.col("input_fingerprint").alias("input")).join(JOURNAL.df(spark), ["kind", "input"]).select("work", "output")
    return discovery.resume_plan(ITEMS.df(spark), journal).drop("work")


KNOWN = Given("known", "taxon_key string, normalized string", [("k1", "aus albus"), ("k9", "aus niger"), ("k8", "aus niger"), ("k2", "aus niger")])


@rule(over(NAMES, KNOWN, then="SELECT n.normalized, n.taxon_key, list_sort(list(DISTINCT o.taxon_key)) AS other_taxa FROM names n JOIN (SELECT taxon_key, normalized FROM known UNION SELECT taxon_key, normalized FROM names) o ON n.normalized = o.normalized AND n.taxon_key <> o.taxon_key GROUP BY ALL"))
def q_rule_name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that another taxon has."""
    return taxonomy.colliding_names(NAMES.df(spark).select("taxon_key", "normalized"), KNOWN.df(spark))


COUNTS = Given("counts", "taxon_key string, n long", [("k1", 5), ("k2", 0), ("k4", 2), ("k5", 1), ("k6", 7), ("k7", 0)])


@rule(over(TAXA, LISTED, SERVICE, NAMES, COUNTS, then=f""", {CROSSWALK_SQL}
SELECT t.taxon_key, t.name, family, genus, coalesce((SELECT list(n.name ORDER BY lower(n.name), n.assertion) FROM names n WHERE n.taxon_key = t.taxon_key AND name_type = 'english_vernacular'), []) AS english_names,
  coalesce((SELECT list(n.name ORDER BY lower(n.name), n.assertion) FROM names n WHERE n.taxon_key = t.taxon_key AND name_type = 'scientific_synonym'), []) AS synonyms,
  (SELECT list(concat_ws(':', provider, state, identifier) ORDER BY concat_ws(':', provider, state, identifier)) FROM cross_ x WHERE x.taxon_key = t.taxon_key) AS providers, (SELECT count(*) FROM conf x WHERE x.taxon_key = t.taxon_key) AS open_conflicts, c.n AS records
FROM taxa t JOIN counts c USING (taxon_key) WHERE rank = 'species'
"""))
def q_rule_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species catalogue."""
    rows = taxonomy.species(TAXA.df(spark), accepted_only=False).select("taxon_key", "name", _expected().alias("lineage"))
    return taxonomy.catalogue(rows, _crosswalk(spark), NAMES.df(spark).select("taxon_key", "name_type", "name", "assertion"), COUNTS.df(spark))


@rule(over(TAXA, then="SELECT taxon_key, name, source, source_taxon_id, page_size, maximum_records FROM (SELECT taxon_key, name, 'P1' AS source, p1::VARCHAR AS source_taxon_id, 300 AS page_size, 900 AS maximum_records FROM taxa WHERE rank = 'species' AND status = 'accepted' UNION ALL SELECT taxon_key, name, 'P2', p2::VARCHAR, 200, 600 FROM taxa WHERE rank = 'species' AND status = 'accepted')"))
def q_rule_provider_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted species, each to two queries."""
    return taxonomy.provider_queries(taxonomy.species(TAXA.df(spark)), {"P1": ("p1", 300, 900), "P2": ("p2", 200, 600)})


@rule(over(TAXA, NAMES, then="SELECT assertion, row_number() OVER (ORDER BY ordinal, name_type <> 'accepted_scientific', name_type, n.name, assertion) AS place FROM names n JOIN taxa t USING (taxon_key)"))
def q_rule_pack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in pack order."""
    from pyspark.sql.window import Window

    rows = taxonomy.pack_order(NAMES.df(spark).select("taxon_key", "name_type", "name", "assertion"), TAXA.df(spark))
    order = Window.orderBy("ordinal", F.col("name_type") != "accepted_scientific", "name_type", "name", "assertion")
    return rows.select("assertion", F.row_number().over(order).cast("long").alias("place"))


BATCHES = Given("batches", "batch long, keys array<string>, responses array<string>", [(1, ["k1", "k2"], ["a", None]), (2, ["k3"], ["c"]), (3, [], [])])


@rule(over(BATCHES, then="SELECT batch, unnest(keys) AS taxon_key, unnest(responses) AS response FROM batches"))
def q_rule_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by position."""
    return taxonomy.zip_responses(BATCHES.df(spark))


# --- views and public gates

CAMPAIGNS = Given("campaigns", "campaign string, campaign_status string, question string, project string, target_count long, minimum_qualified long, expert_gate boolean, " + ", ".join(f"{b} boolean" for b in disclosure.BLIND), [
    ("c1", "open", "what?", "j1", 3, 2, True, True, True, True, True, True), ("c2", "open", "who?", "j1", 2, 1, False, True, False, True, True, True), ("c3", "closed", "why?", "j2", 2, 1, False, True, True, True, True, True),
])
WORK = Given("work", "assignment string, campaign string, media string, assignment_status string, reviewer string", [
    ("w1", "c1", "m1", "assigned", "r1"), ("w2", "c1", "m2", "opened", "r2"), ("w3", "c2", "m1", "assigned", "r1"), ("w4", "c3", "m1", "assigned", "r1"), ("w5", "c1", "m1", "expired", "r2"), ("w6", "c1", "m1", "responded", "r3"), ("w7", "c1", "m3", "responded", "r4"),
])
MEDIA = Given("media", "media string, parent string, photo string, media_state string, decode_status string, rights_status string, display_allowed boolean, image_sha256 string", [
    ("m1", None, "ph1", "committed", "valid", "allowed", True, "h1"), ("m2", "m1", None, "committed", "broken", "allowed", True, "h2"), ("m3", "m2", None, "committed", "valid", "denied", True, "h3"), ("m4", None, "ph4", "committed", "valid", "allowed", True, "h4"),
])
FIT = "media_state = 'committed' AND decode_status = 'valid' AND rights_status = 'allowed' AND display_allowed"


@rule(over(CAMPAIGNS, WORK, MEDIA, then=f"SELECT assignment, campaign, media, question, assignment_status, image_sha256, FALSE AS scientific_claim_allowed FROM work JOIN campaigns USING (campaign) JOIN media USING (media) WHERE assignment_status IN ('assigned', 'opened', 'responded') AND campaign_status = 'open' AND {FIT} AND {' AND '.join(disclosure.BLIND)}"))
def q_rule_blind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11."""
    return disclosure.blind_assignments(WORK.df(spark), CAMPAIGNS.df(spark), MEDIA.df(spark))


TELL = Given("tell", "disclosure string, assignment string, disclosure_state string, model_label string, peer_yes_count long, peer_no_count long, secret string", [("d1", "w1", "released", "x", 2, 1, "s"), ("d2", "w99", "released", "y", 0, 0, "s")])


@rule(over(TELL, WORK, then="SELECT disclosure, assignment, disclosure_state, model_label, peer_yes_count, peer_no_count FROM tell SEMI JOIN work USING (assignment)"))
def q_rule_post_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    return disclosure.post_decision(TELL.df(spark), WORK.df(spark))


JUDGES = Given("judges", "assignment string, conflict string, assignment_status string", [("j1", "f1", "assigned"), ("j2", "f2", "assigned"), ("j3", "f1", "withdrawn")])
CONFLICTS = Given("conflicts", "conflict string, campaign string, media string, conflict_field string, source_event_count long", [("f1", "c1", "m1", "species", 2), ("f2", "c3", "m1", "stage", 3)])


@rule(over(JUDGES, CONFLICTS, CAMPAIGNS, MEDIA, then=f"SELECT assignment, conflict, campaign, media, assignment_status, conflict_field, source_event_count, image_sha256 FROM judges JOIN conflicts USING (conflict) JOIN campaigns USING (campaign) JOIN media USING (media) WHERE assignment_status IN ('assigned', 'opened', 'responded') AND campaign_status = 'open' AND {FIT}"))
def q_rule_adjudication_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    return disclosure.adjudication_queue(JUDGES.df(spark), CONFLICTS.df(spark), CAMPAIGNS.df(spark), MEDIA.df(spark))


TARGETS = Given("targets", "campaign string, media string", [("c1", "m1"), ("c1", "m3"), ("c2", "m9")])
PROFILES = Given("profiles", "caller string, profile string, reviewer string, qualification string, public_name string, status string", [("u1", "r1", "r1", "verified", "Ann", "active"), ("u2", "r2", "r2", "unverified", "Bo", "active"), ("u3", "r3", "r3", "verified", "Cy", "suspended"), ("u4", "r4", "r4", "verified", "Di", "active")])
MEMBERS = Given("members", "project string, profile string, reviewer string, role string, status string", [("j1", "r1", "r1", "reviewer", "active"), ("j1", "r3", "r3", "expert", "active"), ("j1", "r4", "r4", "curator", "suspended"), ("j2", "r4", "r4", "curator", "active")])


@rule(over(CAMPAIGNS, WORK, TARGETS, PROFILES, MEMBERS, then="""SELECT t.campaign, t.media, c.target_count, count(*) FILTER (WHERE w.assignment_status NOT IN ('expired', 'withdrawn')) AS assigned, count(*) FILTER (WHERE w.assignment_status = 'responded') AS responded,
  greatest(c.target_count - count(*) FILTER (WHERE w.assignment_status NOT IN ('expired', 'withdrawn')), 0) AS remaining, c.minimum_qualified, count(*) FILTER (WHERE w.assignment_status = 'responded' AND p.qualification = 'verified') AS responded_qualified,
  NOT c.expert_gate OR coalesce(bool_or(w.assignment_status = 'responded' AND p.qualification = 'verified' AND m.role IN ('expert', 'curator', 'administrator')), FALSE) AS expert_gate_satisfied
FROM targets t JOIN campaigns c USING (campaign) LEFT JOIN work w ON w.campaign = t.campaign AND w.media = t.media LEFT JOIN profiles p ON p.reviewer = w.reviewer LEFT JOIN members m ON m.project = c.project AND m.reviewer = w.reviewer AND m.status = 'active' GROUP BY t.campaign, t.media, c.target_count, c.minimum_qualified, c.expert_gate"""))
def q_rule_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, X2."""
    a = WORK.df(spark).withColumnRenamed("assignment_status", "status")
    return disclosure.assignment_progress(CAMPAIGNS.df(spark), TARGETS.df(spark), a, PROFILES.df(spark), MEMBERS.df(spark))


NEXT = Given("next_", "id long, campaign_kind string, active long, active_experts long, active_qualified long, target_count long, minimum_qualified long, expert_gate boolean", [
    (1, "disagreement", 1, 0, 0, 2, 1, False), (2, "disagreement", 2, 0, 0, 2, 1, False), (3, "potential_gap", 0, 0, 0, 2, 1, True), (4, "reference_image", 0, 0, 0, 2, 1, True), (5, "high_impact_release", 2, 0, 2, 3, 2, True), (6, "high_impact_release", 1, 0, 1, 3, 2, True), (7, "high_impact_release", 2, 1, 2, 3, 2, True),
])


@rule(over(NEXT, then="""SELECT id, CASE campaign_kind WHEN 'disagreement' THEN CASE WHEN active >= 2 THEN 'conflict' ELSE 'ordinary' END WHEN 'potential_gap' THEN 'potential_gap' WHEN 'reference_image' THEN 'reference' ELSE 'ordinary' END AS reason,
  CASE WHEN campaign_kind = 'high_impact_release' THEN CASE WHEN expert_gate AND active_experts = 0 AND active = target_count - 1 THEN 'expert' WHEN active_qualified < minimum_qualified THEN 'qualified' END END AS required_role FROM next_"""))
def q_rule_next_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D12."""
    return disclosure.next_assignment(NEXT.df(spark)).select("id", "reason", "required_role")


COMMENTS = Given("comments", "review string, comment string", [("v1", "fine"), ("v2", "rude"), ("v3", "back"), ("v4", ""), ("v5", None)])
CASES = Given("cases", "case string, review string, project string, target string", [("q1", "v2", "j1", "r1"), ("q2", "v3", "j1", "r2"), ("q3", "v3", "j2", "r4")])
EFFECTS = Given("effects", "event string, case string, effect string, recorded_s long, sequence int", [("e1", "q1", "hidden", 5, 1), ("e2", "q1", "unchanged", 9, 2), ("e3", "q2", "hidden", 5, 1), ("e4", "q3", "restored", 5, 1), ("e5", "q2", "unchanged", 8, 2)])


@rule(over(COMMENTS, Given("cases", CASES.schema.replace("case ", "case_ "), CASES.rows), Given("effects", EFFECTS.schema.replace(" case ", " case_ "), EFFECTS.rows), then="""
, l AS (SELECT review, effect, row_number() OVER (PARTITION BY review ORDER BY recorded_s DESC, event DESC) AS k FROM effects JOIN cases USING (case_) WHERE effect <> 'unchanged')
SELECT c.review, CASE WHEN l.effect = 'hidden' THEN NULL ELSE comment END AS display_comment, CASE WHEN l.effect = 'hidden' THEN 'hidden' ELSE 'visible' END AS visibility_state FROM comments c LEFT JOIN l ON l.review = c.review AND k = 1 WHERE length(comment) > 0"""))
def q_rule_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D26."""
    return disclosure.moderated_comments(COMMENTS.df(spark), CASES.df(spark), EFFECTS.df(spark))


REPORTERS = Given("reporters", "case string, reporter string", [("q1", "r2"), ("q3", "r4")])


@rule(over(Given("cases", CASES.schema.replace("case ", "case_ "), CASES.rows), Given("reporters", "case_ string, reporter string", REPORTERS.rows), PROFILES, then='SELECT DISTINCT caller, c.case_ AS "case" FROM cases c LEFT JOIN reporters r USING (case_) JOIN profiles p ON p.profile = c.target OR p.profile = r.reporter'))
def q_rule_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J30."""
    return disclosure.case_parties(CASES.df(spark), REPORTERS.df(spark), PROFILES.df(spark).select("caller", "profile"))


NOTES = Given("notes", "case string, curator string, note string", [("q1", "r4", "no"), ("q3", "r4", " first "), ("q3", "r4", "second"), ("q3", "r4", "  "), ("q3", "r1", "no")])


@rule(over(Given("cases", CASES.schema.replace("case ", "case_ "), CASES.rows), Given("notes", NOTES.schema.replace("case ", "case_ "), NOTES.rows), Given("effects", EFFECTS.schema.replace(" case ", " case_ "), EFFECTS.rows), MEMBERS, then="""SELECT n.case_ AS "case", curator, trim(note) AS note,
  ((SELECT coalesce(max(sequence), 0) FROM effects e WHERE e.case_ = n.case_) + row_number() OVER (PARTITION BY n.case_ ORDER BY curator, note))::INT AS sequence FROM notes n JOIN cases c USING (case_) JOIN members m ON m.project = c.project AND m.reviewer = curator AND m.status = 'active' AND m.role IN ('curator', 'administrator') WHERE length(trim(note)) BETWEEN 1 AND 4000"""))
def q_rule_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D34."""
    return disclosure.curator_notes(NOTES.df(spark), CASES.df(spark), MEMBERS.df(spark), EFFECTS.df(spark))


SIGNUPS = Given("signups", "caller string, anonymous boolean, project string, name string", [("u9", False, "j1", " Newt "), ("u9", False, "jx", "Newt"), (None, False, "j1", "Newt"), ("u8", True, "j1", "Newt"), ("u7", False, "j1", "me@x"), ("u1", False, "j1", "Other"), ("u2", None, "j1", "Bo"), ("u3", False, "j1", "Cy"), ("u6", False, "j1", "see http://x"), ("u5", False, "j1", "x"), ("u4", False, "j1", "Di")])
PROJECTS = Given("projects", "project string, status string", [("j1", "active"), ("jx", "closed")])


@rule(over(SIGNUPS, PROJECTS, PROFILES, MEMBERS, then=r"""
, j AS (SELECT s.*, trim(name) AS n, x.project IS NOT NULL AS known, p.status AS ps, p.public_name, m.status AS ms FROM signups s LEFT JOIN (SELECT project FROM projects WHERE status = 'active') x USING (project) LEFT JOIN profiles p ON p.caller = s.caller LEFT JOIN members m ON m.profile = p.profile AND m.project = s.project),
r AS (SELECT *, CASE WHEN caller IS NULL THEN 'not_authenticated' WHEN coalesce(anonymous, FALSE) THEN 'anonymous_account' WHEN length(n) NOT BETWEEN 2 AND 80 OR contains(n, '@') OR regexp_matches(lower(n), '(^|\s)https?://') THEN 'invalid_public_name' WHEN NOT known THEN 'no_active_project'
  WHEN ps <> 'active' THEN 'profile_requires_curator' WHEN ms <> 'active' THEN 'membership_requires_curator' END AS reason FROM j)
SELECT caller, project, CASE WHEN reason IS NOT NULL THEN 'refused' WHEN ps IS NULL THEN 'created' WHEN ms IS NULL THEN 'joined' ELSE 'unchanged' END AS result, reason, CASE WHEN reason IS NULL THEN coalesce(public_name, n) END AS public_name FROM r"""))
def q_rule_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D29."""
    return disclosure.registrations(SIGNUPS.df(spark), PROJECTS.df(spark), PROFILES.df(spark), MEMBERS.df(spark))


RELEASES = Given("releases", "candidate string, media string", [("x1", "m1"), ("x2", "m3"), ("x3", "m4")])
ASKED = Given("asked", "kind string, target string", [("media_object", "m2"), ("photo", "ph4")])


@rule(over(RELEASES, ASKED, MEDIA, then="""
, h AS (SELECT media FROM media WHERE media IN (SELECT target FROM asked WHERE kind = 'media_object') OR photo IN (SELECT target FROM asked WHERE kind = 'photo')),
c AS (SELECT media FROM h UNION SELECT m.media FROM media m WHERE m.parent IN (SELECT media FROM h) UNION SELECT m.media FROM media m JOIN media p ON m.parent = p.media WHERE p.parent IN (SELECT media FROM h))
SELECT candidate FROM releases SEMI JOIN c USING (media)"""))
def q_rule_taken_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release candidates under a rights request, by lineage or photo."""
    return disclosure.taken_down(RELEASES.df(spark), MEDIA.df(spark), ASKED.df(spark))


TAKEDOWNS = Given("takedowns", "request string, opened_s long, decision string, sealed boolean", [("t1", 0, None, False), ("t2", 0, "uphold", True), ("t3", 90_000, "uphold", True), ("t4", 0, "reject", False), ("t5", 90_000, "uphold", False), ("t6", 90_000, "uphold", True)])
DEPENDS = Given("depends", "request string, dependency string, action string", [("t2", "d1", None), ("t2", "d2", "removed"), ("t3", "d3", "removed")])


@rule(over(TAKEDOWNS, DEPENDS, then="""
, d AS (SELECT t.*, count(dependency) AS dependencies, count(dependency) FILTER (WHERE action IS NULL) AS open FROM takedowns t LEFT JOIN depends USING (request) GROUP BY ALL),
s AS (SELECT *, CASE WHEN decision = 'reject' THEN 'rejected' WHEN decision IS NULL OR NOT sealed THEN 'review' WHEN open > 0 THEN 'resolving' ELSE 'completed' END AS state FROM d)
SELECT request, opened_s + 86400 AS deadline_s, dependencies, open, state, state IN ('review', 'resolving') AND 100000 > opened_s + 86400 AS overdue FROM s"""))
def q_rule_takedowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D32, D25."""
    return disclosure.takedown_states(TAKEDOWNS.df(spark), DEPENDS.df(spark), 100_000)


SHOWN = {
    "asset": "a1", "photo": "1", "page": "g1", "approval": "ok", "photographer": "Ann", "owner": "o", "licence_id": "4", "attribution": "by Ann", "source_url": "https://photos.example/photos/o/1", "licence_url": "https://licences.example/by/4.0", "image_url": "/media/1.jpg",
    "visibility_state": "public", "is_current": True, "rights_status": "allowed", "display_allowed": True, "redistribution_allowed": True, "media_state": "committed", "object_kind": "public_thumbnail", "removal_case": None,
    "source_record_fingerprint": "a" * 64, "rights_fingerprint": "b" * 64, "display_fingerprint": "c" * 64, "cached_s": 1000, "revalidated_s": 2000, "expires_s": 90_000,
}
SHOWN_SCHEMA = ", ".join(f"{c} {'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for c, v in SHOWN.items())
ITEMS_SHOWN = Given("shown", SHOWN_SCHEMA, [tuple((SHOWN | change).values()) for change in (
    {}, {"asset": "a2", "photo": "2", "approval": "old"}, {"asset": "a3", "photo": "3"}, {"asset": "a4", "photo": "4", "page": "g2", "photographer": " ", "source_url": "http://photos.example/photos/o/4", "image_url": "/media/4.jpg?x=1"},
    {"asset": "a5", "photo": "5", "page": "g2", "rights_status": "denied", "expires_s": 9000, "display_fingerprint": "C" * 64}, {"asset": "a6", "photo": "6", "page": "g3"}, {"asset": "a7", "photo": "6", "page": "g3"}, {"asset": "a8", "photo": "8", "page": "g4", "is_current": None, "removal_case": "x", "revalidated_s": 500, "expires_s": 900_000},
)])
APPROVALS = Given("approvals", "approval string, active boolean, revoked_s long", [("ok", True, None), ("old", True, 5)])
REMOVALS = Given("removals", "photo string", [("3",)])
POLICY = {"host": "photos.example", "path": "/photos/", "thumbnails": "/media/", "longest_s": 100_000}


@rule(over(ITEMS_SHOWN, APPROVALS, REMOVALS, then=f"""
, r AS (SELECT *, list_sort({some(*[(f"no_{c}", f"trim({c}) = ''") for c in ("photographer", "owner", "licence_id", "attribution")], ("source_link_not_exact", "source_url NOT LIKE 'https://photos.example/photos/%'"), ("licence_link_invalid", "licence_url NOT LIKE 'https://%'"),
    ("thumbnail_not_internal", "image_url NOT LIKE '/media/%' OR contains(image_url, '?')"), *[(f"{c}_not_eligible", f"{c} IS DISTINCT FROM {str(v).upper() if isinstance(v, bool) else chr(39) + v + chr(39)}") for c, v in disclosure.PUBLIC.items()], ("removed", "removal_case IS NOT NULL"),
    *[(f"invalid_{c}", f"NOT regexp_full_match({c}, '[0-9a-f]{{64}}')") for c in ("source_record_fingerprint", "rights_fingerprint", "display_fingerprint")], ("timeline_invalid", "NOT (cached_s <= revalidated_s AND revalidated_s <= 50000)"), ("cache_too_long", "expires_s - cached_s > 100000"),
    ("cache_expired", "expires_s <= 50000"), ("revalidation_stale", "50000 - revalidated_s > 86400"), ("approval_not_active", "approval NOT IN (SELECT approval FROM approvals WHERE active AND revoked_s IS NULL)"), ("removal_case_exists", "photo IN (SELECT photo FROM removals)"))}) AS reasons FROM shown)
SELECT asset, photo, CASE WHEN len(reasons) = 0 THEN 'eligible' ELSE 'blocked' END AS state, reasons FROM r"""))
def q_rule_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a public page may show, and why not."""
    return disclosure.public_display(ITEMS_SHOWN.df(spark), APPROVALS.df(spark), REMOVALS.df(spark), 50_000, **POLICY)


PAGED = Given("paged", "page string, asset string, photo string, state string", [("g1", "a1", "1", "eligible"), ("g1", "a2", "2", "eligible"), ("g2", "a3", "3", "eligible"), ("g2", "a4", "3", "blocked"), *[("g3", f"b{i}", f"{i}", "eligible") for i in range(31)]])


@rule(over(PAGED, then=f", f AS (SELECT page, {some(('too_many', 'count(*) > 30'), ('duplicate', 'count(DISTINCT photo) < count(*) OR count(DISTINCT asset) < count(*)'), ('not_eligible', "bool_or(state <> 'eligible')"))} AS faults FROM paged GROUP BY page) SELECT page, len(faults) = 0 AS admitted, faults FROM f"))
def q_rule_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages."""
    return disclosure.admitted_page(PAGED.df(spark))


CANDIDATE_COLUMNS = "candidate string, media string, species string, consensus string, state string, fingerprint string, " + ", ".join(f"{g} boolean" for g in disclosure.CANDIDATE_GATES) + ", expert_required boolean, expert_passed boolean, cell string, date string"
ALL_GATES = (True,) * len(disclosure.CANDIDATE_GATES)
PROPOSED = Given("proposed", CANDIDATE_COLUMNS, [
    ("x1", "m1", "s1", "k3", "eligible", "h1", *ALL_GATES, True, True, "cell", "2020"), ("x2", "m3", "s1", "k3", "draft", "h2", *ALL_GATES[1:], False, True, None, None, "2020"), ("x3", "m4", "s2", "k6", "approved", "h3", *ALL_GATES, False, None, "cell", "2020"),
])
LAYERS = Given("layers", "consensus string, campaign string, media string, species string, layer string, status string, decision string, outcome string, revision int", [
    ("k1", "c1", "m1", "s1", "community", "reached", "yes", "supported", 2), ("k2", "c1", "m1", "s1", "qualified", "reached", "yes", "supported", 1), ("k3", "c1", "m1", "s1", "release", "reached", "yes", "release_ready", 1),
    ("k4", "c1", "m4", "s2", "community", "reached", "yes", "supported", 1), ("k5", "c2", "m4", "s2", "qualified", "disputed", None, "uncertain", 1), ("k6", "c1", "m4", "s2", "release", "reached", "yes", "release_ready", 1), ("k7", "c1", "m4", "s2", "release", "reached", "yes", "release_ready", 2),
])
RECEIPTS = Given("receipts", "receipt string, candidate string, candidate_fingerprint string, community string, qualified string", [("p1", "x1", "h1", "k1", "k2"), ("p2", "x2", "other", "k1", None), ("p3", "x3", "h3", "k4", "k5")])
PLACES = Given("places", "target_kind string, target string, state string", [("release_candidate", "x1", "publish"), ("release_candidate", "x2", "withheld"), ("geographic_impact", "x3", "publish")])
L3 = ("release", "release_ready"), ("community", "supported"), ("qualified", "supported")


@rule(over(RECEIPTS, PROPOSED, LAYERS, MEDIA, PLACES, then=f"""
, k AS (SELECT *, max(revision) OVER (PARTITION BY campaign, media, layer) AS last FROM layers),
j AS (SELECT r.receipt, r.candidate_fingerprint, c.*, m.media_state, m.rights_status AS m_rights, {', '.join(f"{a}.status AS {a}_status, {a}.decision AS {a}_decision, {a}.outcome AS {a}_outcome, {a}.revision AS {a}_revision, {a}.last AS {a}_last, {a}.campaign AS {a}_campaign, {a}.media AS {a}_media, {a}.species AS {a}_species" for a, _ in L3)}
  FROM receipts r LEFT JOIN proposed c USING (candidate) LEFT JOIN media m ON m.media = c.media LEFT JOIN k release ON release.consensus = c.consensus AND release.layer = 'release' LEFT JOIN k community ON community.consensus = r.community AND community.layer = 'community' LEFT JOIN k qualified ON qualified.consensus = r.qualified AND qualified.layer = 'qualified')
SELECT receipt, list_sort({some(("lineage_differs", "fingerprint IS DISTINCT FROM candidate_fingerprint"), ("candidate_state_not_eligible", "coalesce(state NOT IN ('eligible', 'approved', 'exported'), TRUE)"), *[(f"gate:{g}", f"NOT coalesce({g}, FALSE)") for g in disclosure.CANDIDATE_GATES],
    ("gate:expert_review_passed", "NOT coalesce(NOT expert_required OR expert_passed, FALSE)"), ("no_coordinate_or_date", "cell IS NULL OR date IS NULL"), ("media_not_releasable", "NOT coalesce(media_state = 'committed' AND m_rights = 'allowed', FALSE)"),
    *[(f"{a}_consensus_missing", f"NOT coalesce({a}_status = 'reached' AND {a}_decision = 'yes' AND {a}_outcome = '{o}', FALSE)") for a, o in L3], *[(f"{a}_consensus_superseded", f"NOT coalesce({a}_revision = {a}_last, FALSE)") for a, _ in L3],
    ("layers_do_not_share_lineage", "NOT coalesce(" + " AND ".join(f"release_{x} = community_{x} AND release_{x} = qualified_{x}" for x in ("campaign", "media", "species")) + " AND release_media = media AND release_species = species, FALSE)"),
    ("location_not_publishable", "candidate NOT IN (SELECT target FROM places WHERE target_kind = 'release_candidate' AND state IN ('publish', 'generalised'))"), ("media_taken_down", "candidate = 'x2'"))}) AS faults FROM j
"""))
def q_rule_release_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a release receipt from holding."""
    taken = disclosure.taken_down(PROPOSED.df(spark).select("candidate", "media"), MEDIA.df(spark), spark.createDataFrame([("media_object", "m2")], "kind string, target string"))
    return disclosure.release_receipt_faults(RECEIPTS.df(spark), PROPOSED.df(spark), LAYERS.df(spark), MEDIA.df(spark), disclosure.publishable(PLACES.df(spark), "release_candidate"), taken)


# --- coverage

SPECIES = Given("species", "taxon_key string", [("k1",), ("k2",), ("k3",), ("k4",), ("k5",)])
CHOSEN = Given("chosen", "media string, observation string", [("m1", "o1"), ("m2", "o1"), ("m3", "o2"), ("m4", "o3")])
SEEN = Given("seen", "observation string, observer string, accepted_key string", [("o1", "r1", "p:1"), ("o2", "r2", "p:1"), ("o3", "r1", "p:2"), ("o4", "r9", "p:9")])
OBJECTS = Given("objects", "media string, decode_status string, sha256 string, bytes long", [("m1", "valid", "h1", 10), ("m2", "valid", "h1", 10), ("m3", "valid", "h3", 7), ("m4", "broken", "h4", 5), ("m9", "valid", None, 1)])
DECIDED = Given("decided", "taxon_key string, media string, accepted_key string, gate string", [("k1", "m1", "p:1", "eligible"), ("k1", "m2", "p:1", "eligible"), ("k1", "m3", "p:1", "eligible"), ("k2", "m4", "p:2", "eligible"), ("k2", "m5", "p:3", "denied"), ("k3", "m6", "p:4", "denied"), ("k4", "m7", "p:5", "eligible"), (None, "m8", "p:6", "eligible")])


@rule(over(SPECIES, CHOSEN, SEEN, OBJECTS, DECIDED, then=f"""
, d AS (SELECT taxon_key, count(*) AS candidates, count(*) FILTER (WHERE gate = 'eligible') AS eligible, CASE WHEN count(DISTINCT accepted_key) = 1 THEN min(accepted_key) END AS provider_key FROM decided WHERE taxon_key IS NOT NULL GROUP BY 1),
s AS (SELECT taxon_key, count(*) AS selected, count(*) FILTER (WHERE decode_status = 'valid') AS valid, count(DISTINCT sha256) FILTER (WHERE decode_status = 'valid') AS contents, count(DISTINCT observer) FILTER (WHERE decode_status = 'valid') AS observers
  FROM chosen JOIN seen USING (observation) JOIN objects USING (media) JOIN decided USING (media) GROUP BY 1),
j AS (SELECT taxon_key, provider_key, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('candidates', 'eligible', 'selected', 'valid', 'contents', 'observers'))} FROM species LEFT JOIN d USING (taxon_key) LEFT JOIN s USING (taxon_key)),
f AS (SELECT *, selected - valid AS failed, valid - contents AS duplicate_excess FROM j)
SELECT *, CASE WHEN candidates = 0 THEN 'no_candidate_media' WHEN eligible = 0 THEN 'no_automated_gate_eligible_media' WHEN selected = 0 THEN 'eligible_not_selected' WHEN valid = 0 THEN 'selected_no_valid_decode' ELSE 'provisional_decode_only' END AS coverage_status,
  {some(("no_candidate_media", "candidates = 0"), ("no_automated_gate_eligible_media", "eligible = 0"), ("no_selected_media", "selected = 0"), ("download_or_decode_failure", "failed > 0"), ("provisional_support_below_target", "valid < 20"), ("observer_diversity_low", "valid > 0 AND observers <= 1"), ("exact_content_duplicate_pending_resolution", "duplicate_excess > 0"), ("human_review_absent", "TRUE"))} AS flags FROM f
"""))
def q_rule_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14, J14, D18."""
    chosen = coverage.selected_objects(CHOSEN.df(spark), SEEN.df(spark), OBJECTS.df(spark))
    return coverage.coverage(SPECIES.df(spark), DECIDED.df(spark), chosen)


PROVIDED = Given("provided", "provider_key long, taxon_key string", [(1, "k1"), (3, "k3")])


@rule(over(CHOSEN, SEEN, PROVIDED, then="SELECT media, observation, accepted_key, taxon_key FROM chosen JOIN seen USING (observation) LEFT JOIN provided ON accepted_key = 'p:' || provider_key"))
def q_rule_media_taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J7."""
    return coverage.media_with_taxon(CHOSEN.df(spark), SEEN.df(spark), PROVIDED.df(spark), "p")


@rule(over(OBJECTS, then="SELECT sum(n)::BIGINT AS objects, count(*) AS contents, sum(bytes)::BIGINT AS unique_bytes FROM (SELECT sha256, count(*) AS n, max(bytes) AS bytes FROM objects WHERE decode_status = 'valid' GROUP BY 1)"))
def q_rule_unique_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A34."""
    return coverage.unique_content(OBJECTS.df(spark))

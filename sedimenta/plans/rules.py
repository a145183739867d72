"""Domain rules over small given tables, so that the rules themselves are compared with SQL (D, P, J, A, X rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.text import json_number, json_text, jcs, restricted
from sedimenta.operators import consensus, coverage, decisions, disclosure, discovery, estimators, occurrence, planning, sampling, taxonomy

from .given import Given, over
from .registry import rule


def some(*pairs: tuple[str, str]) -> str:
    """SQL: the names whose condition holds, in order."""
    cases = ", ".join(f"CASE WHEN {condition} THEN '{name}' END" for name, condition in pairs)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)::VARCHAR[]"


# --- reviews and consensus

REVIEWS = Given("reviews", "subject string, reviewer string, event string, outcome string, qualified boolean, weight double", [
    ("agree", "r1", "e1", "yes", True, 1.5), ("agree", "r2", "e2", "yes", True, None), ("agree", "r3", "e3", "skipped", False, None),
    ("split", "r1", "e4", "yes", True, 2.0), ("split", "r2", "e5", "no", True, None), ("ruled", "r1", "e6", "yes", True, None), ("ruled", "r2", "e7", "no", False, None),
    ("misruled", "r1", "e8", "yes", True, None), ("misruled", "r2", "e9", "no", True, None), ("unsure", "r1", "f1", "cant_tell", True, None), ("dark", "r1", "f2", "cant_view", True, None),
    ("late", "r1", "f3", "skipped", True, None), ("late", "r2", "f4", "skipped", False, None), ("one", "r1", "f5", "yes", False, None), ("doubt", "r1", "f6", "yes", True, 0.5),
    ("doubt", "r2", "f7", "yes", True, None), ("doubt", "r3", "f8", "cant_tell", True, None), ("against", "r1", "f9", "no", True, None), ("against", "r2", "g1", "no", True, 1.25),
])
ADJUDICATIONS = Given("adjudications", "subject string, adjudicator string, event string, outcome string, qualified boolean, sources array<string>", [
    ("ruled", "x1", "a1", "yes", True, ["e7", "e6"]), ("misruled", "r1", "a2", "cant_tell", False, ["e8", "e8", "a2"]), ("agree", "x1", "a3", "yes", True, ["e1", "e2"]),
])
GATES = Given("gates", "subject string, " + ", ".join(f"{g} boolean" for g in consensus.GATES), [
    ("agree", True, True, True, True, True, True), ("ruled", True, True, True, True, True, True), ("split", True, True, False, True, True, True), ("against", False, True, True, None, True, True),
])


@rule(over(REVIEWS, ADJUDICATIONS, GATES, then=f"""
, p AS (SELECT subject, count(*) FILTER (WHERE outcome = 'yes') AS y, count(*) FILTER (WHERE outcome = 'no') AS n, count(*) FILTER (WHERE outcome = 'cant_tell') AS u,
  count(*) FILTER (WHERE outcome = 'cant_view') AS f, list(reviewer) AS rs, list_sort(list(event) FILTER (WHERE outcome IN ('yes', 'no'))) AS ds,
  count(*) FILTER (WHERE qualified) AS qa, count(*) FILTER (WHERE qualified AND outcome = 'yes') AS qy, count(*) FILTER (WHERE qualified AND outcome = 'no') AS qn,
  count(*) FILTER (WHERE qualified AND outcome = 'cant_tell') AS qu, coalesce(sum(coalesce(weight, 1.0)) FILTER (WHERE qualified AND outcome = 'yes'), 0) AS wy,
  coalesce(sum(coalesce(weight, 1.0)) FILTER (WHERE qualified AND outcome = 'no'), 0) AS wn FROM reviews GROUP BY 1),
a AS (SELECT p.*, j.outcome AS jo, CASE WHEN j.adjudicator IS NULL THEN [] ELSE {some(
    ("outcome_not_decisive", "j.outcome NOT IN ('yes', 'no')"), ("not_qualified", "NOT j.qualified"), ("not_independent", "list_contains(rs, j.adjudicator)"),
    ("sources_repeat", "len(j.sources) > len(list_distinct(j.sources))"), ("cites_itself", "list_contains(j.sources, j.event)"), ("no_decisive_disagreement", "NOT (y > 0 AND n > 0)"),
    ("sources_incomplete", "y > 0 AND n > 0 AND list_sort(list_distinct(j.sources)) <> ds"))} END AS faults, j.adjudicator IS NOT NULL AS judged,
  {some(*((b, f"NOT coalesce({g}, FALSE)") for g, b in consensus.GATES.items()))} AS missing
  FROM p LEFT JOIN adjudications j USING (subject) LEFT JOIN gates USING (subject)),
b AS (SELECT *, judged AND len(faults) = 0 AS valid FROM a),
o AS (SELECT *, CASE WHEN y + n = 0 THEN CASE WHEN u > 0 THEN 'uncertain_only' WHEN f > 0 THEN 'media_failure' ELSE 'deferred' END
  WHEN y > 0 AND n > 0 THEN CASE WHEN valid THEN 'adjudicated' ELSE 'unresolved_disagreement' END WHEN u > 0 THEN 'unresolved_disagreement' WHEN y + n < 2 THEN 'pending' ELSE 'complete_agreement' END AS overall,
  CASE WHEN valid THEN 'available' WHEN qa = 0 THEN 'unavailable' WHEN qy + qn < 2 THEN 'pending' WHEN qy > 0 AND qn > 0 OR qu > 0 THEN 'blocked' ELSE 'available' END AS qs,
  CASE WHEN valid THEN CASE jo WHEN 'yes' THEN 'supported' ELSE 'not_supported' END WHEN qa = 0 OR qy + qn < 2 THEN NULL WHEN qy > 0 AND qn > 0 OR qu > 0 THEN 'uncertain' WHEN qy > 0 THEN 'supported' ELSE 'not_supported' END AS qo FROM b),
l AS (
  SELECT subject, overall, least(y, n) AS dissent, 'community' AS layer,
    CASE overall WHEN 'pending' THEN 'pending' WHEN 'unresolved_disagreement' THEN 'blocked' WHEN 'adjudicated' THEN 'blocked' WHEN 'deferred' THEN 'unavailable' ELSE 'available' END AS status,
    CASE overall WHEN 'pending' THEN NULL WHEN 'media_failure' THEN overall WHEN 'deferred' THEN overall WHEN 'complete_agreement' THEN CASE WHEN y > 0 THEN 'supported' ELSE 'not_supported' END ELSE 'uncertain' END AS outcome,
    CASE overall WHEN 'pending' THEN ['decisive_reviews_below_required'] WHEN 'unresolved_disagreement' THEN ['human_disagreement_requires_adjudication']
      WHEN 'adjudicated' THEN ['source_dissent_retained_after_adjudication'] WHEN 'deferred' THEN ['all_effective_reviews_deferred'] ELSE [] END AS blockers, y::DOUBLE AS support_total, n::DOUBLE AS oppose_total FROM o
  UNION ALL
  SELECT subject, overall, least(y, n), 'qualified', qs, qo, list_concat(CASE WHEN valid THEN [] WHEN qa = 0 THEN ['qualified_reviews_unavailable'] WHEN qy + qn < 2 THEN ['qualified_decisive_reviews_below_required']
    WHEN qy > 0 AND qn > 0 THEN ['qualified_disagreement_requires_adjudication'] WHEN qu > 0 THEN ['qualified_uncertainty_unresolved'] ELSE [] END, list_transform(faults, lambda x: 'adjudication:' || x)), wy, wn FROM o
  UNION ALL
  SELECT subject, overall, least(y, n), 'release', CASE WHEN qo = 'not_supported' OR (qo = 'supported' AND qs = 'available' AND len(missing) = 0) THEN 'available' ELSE 'blocked' END,
    CASE WHEN qo = 'supported' AND qs = 'available' AND len(missing) = 0 THEN 'release_ready' ELSE 'not_release_ready' END,
    CASE WHEN qo = 'not_supported' THEN [] WHEN qs <> 'available' THEN list_append(missing, 'qualified_consensus_unavailable') ELSE missing END, qy, qn FROM o)
SELECT subject, overall, layer, status, outcome, list_sort(blockers)::VARCHAR[] AS blockers, support_total, oppose_total, dissent,
  CASE WHEN outcome IN ('supported', 'release_ready', 'not_supported') OR (outcome = 'uncertain' AND status = 'available') OR outcome = 'media_failure' THEN 'reached'
    WHEN outcome = 'not_release_ready' AND status = 'available' THEN 'rejected' WHEN status = 'blocked' THEN 'disputed' ELSE 'insufficient' END AS stored_status,
  CASE WHEN outcome IN ('supported', 'release_ready') THEN 'yes' WHEN outcome = 'not_supported' THEN 'no' WHEN outcome = 'uncertain' AND status = 'available' THEN 'cannot_tell' WHEN outcome = 'media_failure' THEN 'cannot_view' END AS stored_decision
FROM l
"""))
def q_rule_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three layers of each subject, as they are stored."""
    return consensus.layers(REVIEWS.df(spark), ADJUDICATIONS.df(spark), GATES.df(spark))


CONTROLS = Given("controls", "reviewer string, expected string, actual string", [
    *[("able", "yes", "yes" if i < 9 else "no") for i in range(10)], *[("able", "no", "no" if i < 8 else "yes") for i in range(10)], *[("new", "yes", "yes")] * 4, ("new", "no", "cannot_tell"), ("only_controls", "yes", "no"),
])
OVERLAPS = Given("overlap_rows", "reviewer string, item string, label string, peers array<string>, adjudicated string", [
    *[("able", f"i{i}", "yes" if i % 2 else "no", ["yes" if (i % 2) == (i < 8) else "no"], ("yes" if i % 2 else "no") if i < 4 else ("no" if i % 2 else "yes") if i == 4 else None) for i in range(10)],
    ("new", "i1", "yes", ["yes", "no"], None), ("new", "i2", "no", ["no"], "no"),
])


@rule(over(CONTROLS, OVERLAPS, then=f"""
, c AS (SELECT reviewer, count(*) AS control_attempts, count(*) FILTER (WHERE expected = 'yes') AS positive_controls, count(*) FILTER (WHERE expected = 'no') AS negative_controls,
  count(*) FILTER (WHERE expected = actual) AS cr, count(*) FILTER (WHERE expected = actual AND expected = 'yes') AS tp, count(*) FILTER (WHERE expected = actual AND expected = 'no') AS tn FROM controls GROUP BY 1),
o AS (SELECT reviewer, count(*) AS overlap_items, sum(len(peers)) AS pairs, sum(len(list_filter(peers, lambda x: x = label))) AS agreeing,
  count(adjudicated) AS adjudicated_overlap, count(*) FILTER (WHERE adjudicated = label) AS ar FROM overlap_rows GROUP BY 1),
r AS (SELECT reviewer, item, unnest(list_append(peers, label)) AS code FROM overlap_rows),
n AS (SELECT reviewer, item, code, count(*) AS k FROM r GROUP BY ALL), m AS (SELECT reviewer, item, sum(k) AS m, sum(k * k) AS sq FROM n GROUP BY ALL HAVING sum(k) > 1),
d AS (SELECT reviewer, count(*) AS items, sum(m)::DOUBLE AS t, sum((m * m - sq) / (m - 1)) AS d FROM m GROUP BY 1),
e AS (SELECT reviewer, sum(k * k) AS csq FROM (SELECT reviewer, code, sum(k) AS k FROM n SEMI JOIN m USING (reviewer, item) GROUP BY ALL) GROUP BY 1),
k AS (SELECT reviewer, CASE WHEN items > 1 AND t * t > csq THEN 1 - (d / t) / ((t * t - csq) / (t * (t - 1))) END AS alpha FROM d JOIN e USING (reviewer)),
j AS (SELECT reviewer, coalesce(control_attempts, 0) AS control_attempts, coalesce(positive_controls, 0) AS positive_controls, coalesce(negative_controls, 0) AS negative_controls, coalesce(overlap_items, 0) AS overlap_items,
  coalesce(adjudicated_overlap, 0) AS adjudicated_overlap, coalesce(cr, 0) AS cr, coalesce(tp, 0) AS tp, coalesce(tn, 0) AS tn, coalesce(pairs, 0) AS pairs, coalesce(agreeing, 0) AS agreeing, coalesce(ar, 0) AS ar, alpha
  FROM c FULL JOIN o USING (reviewer) LEFT JOIN k USING (reviewer)),
b AS (SELECT *, list_sort({some(*((f"{x}_below_minimum", f"{x} < {least}") for x, least in estimators.LEAST.items()))}) AS blockers, (15.0 + cr + ar)::DOUBLE AS a, (5.0 + control_attempts + adjudicated_overlap - cr - ar)::DOUBLE AS z FROM j),
f AS (SELECT *, CASE WHEN len(blockers) = 0 THEN a / (a + z) END AS estimate, sqrt(a * z / ((a + z) * (a + z) * (a + z + 1))) AS sd FROM b)
SELECT reviewer, control_attempts, positive_controls, negative_controls, overlap_items, adjudicated_overlap, cr / nullif(control_attempts, 0) AS control_accuracy, (agreeing / nullif(pairs, 0))::DOUBLE AS pairwise_agreement,
  ar / nullif(adjudicated_overlap, 0) AS adjudicated_accuracy, CASE WHEN positive_controls >= 10 THEN tp / positive_controls END AS sensitivity, CASE WHEN negative_controls >= 10 THEN tn / negative_controls END AS specificity,
  alpha, blockers, estimate, CASE WHEN estimate IS NOT NULL THEN greatest(0, estimate - 1.959963984540054 * sd) END AS low, CASE WHEN estimate IS NOT NULL THEN least(1, estimate + 1.959963984540054 * sd) END AS high,
  CASE WHEN estimate IS NOT NULL THEN greatest(0.5, least(2.0, 1 + (estimate - 0.75) / 0.25)) END AS weight
FROM f
"""))
def q_rule_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, blockers, the shrunk estimate and the weight of reviewers."""
    return estimators.reliability(CONTROLS.df(spark), OVERLAPS.df(spark))


PLANS = Given("plans", "plan string, kind string, design string, representative boolean, blind boolean, method string, grouping_keys array<string>", [
    ("good", "representative_audit", "stratified_random", True, True, estimators.INCLUSION, ["owner_id", "observation_id"]),
    ("bad", "representative_audit", "targeted_priority", False, None, "none", ["owner_id"]), ("aimed", "targeted_failure_discovery", "targeted_priority", False, False, None, []),
    ("part", "representative_audit", "simple_random", True, True, estimators.INCLUSION, ["owner_id", "observation_id"]),
])
STRATA = Given("strata", "plan string, stratum string, weight double, population long", [
    ("good", "s1", 0.6, None), ("good", "s2", 0.4, None), ("bad", "s1", 0.6, None), ("bad", "s2", 0.5, None), ("aimed", "s1", None, 5), ("part", "s1", 0.5, None), ("part", "s2", None, 9),
])
RECORDS = Given("records", "plan string, record string, stratum string, p double, owner string, observation string, outcome string", [
    ("good", "r1", "s1", 0.1, "o1", "b1", "supported"), ("good", "r2", "s1", 0.1, "o1", "b2", "not_supported"), ("good", "r3", "s2", 1.0, "o2", "b3", "supported"),
    ("bad", "r4", "s1", 0.0, None, "b4", "uncertain"), ("bad", "r5", "s2", 1.5, "o3", None, "supported"), ("bad", "r6", "s1", None, "o3", "b5", "deferred"),
    ("part", "r7", "s1", 0.5, "o4", "b6", "supported"), ("part", "r8", "s2", 0.5, "o5", "b6", "supported"),
])


@rule(over(PLANS, STRATA, RECORDS, then=f"""
, f AS (
  SELECT plan, unnest({some(("sampling_design_is_not_probability_based", "design NOT IN ('simple_random', 'stratified_random', 'clustered_random')"), ("sampling_plan_not_representative", "NOT coalesce(representative, FALSE)"),
    ("audit_not_blind", "NOT coalesce(blind, FALSE)"), ("inclusion_probability_method_missing_or_unsupported", f"method IS DISTINCT FROM '{estimators.INCLUSION}'"),
    ("owner_grouping_key_missing", "NOT list_contains(grouping_keys, 'owner_id')"), ("observation_grouping_key_missing", "NOT list_contains(grouping_keys, 'observation_id')"))}) AS b FROM plans
  UNION SELECT plan, 'invalid_inclusion_probability:' || record FROM records WHERE NOT coalesce(p > 0 AND p <= 1, FALSE)
  UNION SELECT plan, 'owner_group_missing:' || record FROM records WHERE owner IS NULL UNION SELECT plan, 'observation_group_missing:' || record FROM records WHERE observation IS NULL
  UNION SELECT s.plan, 'stratum_without_decisive_reviews:' || s.stratum FROM strata s WHERE NOT EXISTS (SELECT 1 FROM records r WHERE r.plan = s.plan AND r.stratum = s.stratum AND r.outcome IN ('supported', 'not_supported'))
  UNION SELECT x.plan, 'owner_observation_group_crosses_strata' FROM records x JOIN records y ON x.plan = y.plan AND (x.owner = y.owner OR x.observation = y.observation) AND x.stratum < y.stratum
  UNION SELECT plan, CASE WHEN count(weight) = count(*) THEN 'stratum_population_weights_do_not_sum_to_one' WHEN count(weight) > 0 THEN 'stratum_population_weights_partially_declared' ELSE 'stratum_population_sizes_missing' END
    FROM strata GROUP BY plan HAVING CASE WHEN count(weight) = count(*) THEN abs(sum(weight) - 1) > 1e-9 WHEN count(weight) > 0 THEN TRUE ELSE count(population) < count(*) END)
SELECT plan, CASE WHEN kind = 'targeted_failure_discovery' THEN ['targeted_failure_discovery_is_not_population_representative'] ELSE list_sort(coalesce(bs, []))::VARCHAR[] END AS blockers
FROM plans LEFT JOIN (SELECT plan, list(b) AS bs FROM f GROUP BY 1) USING (plan)
"""))
def q_rule_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps an audit from estimating a population."""
    return estimators.audit_blockers(PLANS.df(spark), STRATA.df(spark), RECORDS.df(spark))


# --- location

RULES = Given("rules", "subject string, action string, sensitivity string, scopes array<string>, ceiling int, minimum_count long", [
    ("open", "publish", "not_sensitive", ["cell", "region"], 7, 1), ("soft", "generalise", "sensitive", ["cell"], 5, 3), ("shut", "withhold", "unknown", ["cell"], None, None),
    ("few", "publish", "not_sensitive", ["region"], 7, 10), ("fine", "publish", "not_sensitive", ["cell"], 7, 1), ("coarse", "publish", "not_sensitive", ["region"], 7, 1),
])
REQUESTS = Given("requests", "subject string, scope string, precision string, resolution int, record_count long", [
    ("open", "cell", "exact", 5, 9), ("soft", "cell", "exact", 7, 4), ("shut", "cell", "withheld", 3, 9), ("few", "region", "exact", None, 9), ("fine", "cell", "exact", 6, 2), ("coarse", "region", "coarse_rollup", None, 2), ("none", "cell", "exact", 3, 5),
])
CONSTRAINTS = Given("constraints", "subject string, provider string, used boolean, disclosure string, ceiling int", [
    ("open", "p1", True, "public_processed", 6), ("open", "p2", False, "private", None), ("soft", "p1", True, "public_generalised", 5), ("shut", "p2", True, "hidden", None),
    ("few", "p1", True, "public_processed", 7), ("fine", "p1", True, "public_processed", 5), ("coarse", "p1", True, "public_generalised", 5), ("coarse", "p2", True, "public_geo", 4),
])
PUBLIC_STATES = {"p1": ("public_processed", "public_generalised"), "p2": ("public_geo",)}


@rule(over(RULES, REQUESTS, CONSTRAINTS, then=f"""
, c AS (SELECT subject, list(provider) AS ps, count(*) FILTER (WHERE used) AS n_used, min(ceiling) FILTER (WHERE used) AS c_ceiling,
  list(DISTINCT provider || '_location_not_public') FILTER (WHERE used AND NOT coalesce((provider = 'p1' AND disclosure IN ('public_processed', 'public_generalised')) OR (provider = 'p2' AND disclosure = 'public_geo'), FALSE)) AS hidden,
  list(DISTINCT provider || '_resolution_mapping_missing') FILTER (WHERE used AND ceiling IS NULL) AS unmapped FROM constraints GROUP BY 1),
j AS (SELECT q.*, r.action, r.sensitivity, r.scopes, r.minimum_count, ps, coalesce(n_used, 0) AS n_used, hidden, unmapped, least(r.ceiling, c_ceiling) AS top FROM requests q LEFT JOIN rules r USING (subject) LEFT JOIN c USING (subject)),
b AS (SELECT *, list_sort(list_concat({some(("missing_p1_provider_constraint", "NOT coalesce(list_contains(ps, 'p1'), FALSE)"), ("missing_provider_constraints", "ps IS NULL"),
    ("sensitive_location_policy_withholds", "coalesce(action = 'withhold', TRUE) OR coalesce(sensitivity = 'unknown', TRUE)"), ("scope_not_permitted", "NOT coalesce(list_contains(scopes, scope), FALSE)"),
    ("source_location_withheld", "precision = 'withheld'"), ("sensitive_exact_location_forbidden", "sensitivity = 'sensitive' AND precision = 'exact'"),
    ("minimum_public_record_count_not_met", "NOT coalesce(record_count >= minimum_count, FALSE)"), ("no_permitted_provider_location_used", "n_used = 0"), ("public_resolution_ceiling_missing", "top IS NULL"),
    ("requested_resolution_exceeds_ceiling", "scope = 'cell' AND NOT coalesce(resolution <= top, FALSE)"))}, coalesce(hidden, []), coalesce(unmapped, [])))::VARCHAR[] AS blockers FROM j)
SELECT subject, CASE WHEN len(blockers) > 0 THEN 'withheld' WHEN action = 'generalise' OR precision IN ('generalised', 'coarse_rollup') THEN 'generalised' ELSE 'publish' END AS publication_state,
  CASE WHEN len(blockers) = 0 THEN top END AS ceiling, blockers FROM b
"""))
def q_rule_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication state, ceiling and blockers of location requests."""
    return decisions.location_decisions(RULES.df(spark), REQUESTS.df(spark), CONSTRAINTS.df(spark), PUBLIC_STATES, ("p1",))


# --- planning

CANDIDATES = Given("candidates", "id string, calls long, unique_per_call double, positive double, windows long, last_s long", [
    ("fresh", 0, None, None, 0, None), ("rich", 50, 20.0, 0.5, 9, 1000), ("cool", 20, 1.0, 0.0, 1, 99_000), ("thawed", 20, 1.0, None, 1, 1000), ("dead", 20, 0.5, 0.01, 3, 1000), ("unknown", 20, None, 0.0, 5, 1000), ("few", 4, 0.0, 0.0, 5, 1000),
])


@rule(over(CANDIDATES, then="""
, c AS (SELECT *, calls >= 10 AND coalesce(unique_per_call <= 2, FALSE) AND coalesce(positive <= 0.05, TRUE) AS low FROM candidates)
SELECT id, CASE WHEN low AND windows >= 3 THEN 'stopped_low_yield' WHEN low AND 100000 < last_s + 86400 THEN 'cooldown_low_yield' ELSE 'eligible' END AS state,
  CASE WHEN low AND windows < 3 AND 100000 < last_s + 86400 THEN last_s + 86400 END AS next_s, CASE WHEN last_s IS NULL THEN 1.0::DOUBLE ELSE least(1, greatest(0, (100000 - last_s) / 3600 / 48))::DOUBLE END AS age FROM c
"""))
def q_rule_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-yield candidates cool down, then stop; the age of the last query as a need."""
    c = [F.col(x) for x in ("calls", "unique_per_call", "positive", "windows", "last_s")]
    state = planning.candidate_state(*c, F.lit(100_000), least_calls=10, low_unique=2, low_positive=0.05, stop_windows=3, cooldown_h=24)
    return CANDIDATES.df(spark).select("id", state.alias("s"), planning.age_need(F.col("last_s"), F.lit(100_000), 48).alias("age")).select("id", "s.state", "s.next_s", "age")


ATTEMPTS = Given("attempts", "execution string, budget string, status int, attempt int, retry_after long", [
    ("x:1", "consumed", 429, 0, None), ("x:2", "consumed", 503, 2, 90), ("x:3", "consumed", 503, 3, 90), ("x:4", "uncertain", None, 0, None), ("x:5", "released", 500, 0, None), ("x:6", "consumed", 404, 0, 5), ("x:7", "consumed", 501, 0, None),
    ("x:8", "consumed", 500, 1, 1), ("x:9", None, 500, 1, 1),
])


@rule(over(ATTEMPTS, then="""
, a AS (SELECT *, CASE WHEN budget = 'uncertain' THEN 'blocked_accounting_reconciliation' WHEN budget IS DISTINCT FROM 'consumed' THEN 'not_retryable' WHEN attempt >= 3 THEN 'exhausted'
    WHEN status IN (429, 500, 502, 503, 504) THEN 'scheduled' ELSE 'not_retryable' END AS state,
  ('0x' || substr(sha256(execution || ':' || (attempt + 1)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE AS u FROM attempts)
SELECT execution, state, CASE WHEN budget = 'uncertain' THEN 'uncertain_send_may_have_reached_provider' WHEN budget IS DISTINCT FROM 'consumed' THEN 'no_consumed_provider_attempt' WHEN attempt >= 3 THEN 'maximum_retry_attempts_reached'
    WHEN state = 'scheduled' THEN 'retryable_http_status' ELSE 'response_not_retryable' END AS reason, CASE WHEN state = 'scheduled' THEN attempt + 1 END AS next_attempt,
  CASE WHEN state = 'scheduled' THEN greatest(ceil(least(2 * pow(2, attempt), 300) * (0.5 + u * 0.5)), coalesce(retry_after, 0))::BIGINT END AS delay_s FROM a
"""))
def q_rule_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retry dispositions with deterministic jitter."""
    r = planning.retry(F.col("budget"), F.col("status"), F.col("attempt"), F.col("execution"), F.col("retry_after"))
    return ATTEMPTS.df(spark).select("execution", r.alias("r")).select("execution", F.col("r.status").alias("state"), "r.reason", "r.next_attempt", "r.delay_s")


PARTS = Given("parts", "id string, west double, south double, east double, north double, from_s long, to_s long", [
    ("time", 0.0, 0.0, 4.0, 2.0, 10, 13), ("odd", 0.0, 0.0, 4.0, 2.0, 10, 12), ("wide", 0.0, 0.0, 4.0, 2.0, 10, 10), ("high", 0.0, 0.0, 1.0, 2.0, 10, 10), ("square", 0.0, 0.0, 2.0, 2.0, 5, 5),
])


@rule(over(PARTS, then="""
, s AS (SELECT *, from_s < to_s AS t, from_s + (to_s - from_s) // 2 AS mid, east - west >= north - south AS w FROM parts)
SELECT id || '/0' AS id, west, south, CASE WHEN NOT t AND w THEN (west + east) / 2 ELSE east END AS east, CASE WHEN NOT t AND NOT w THEN (south + north) / 2 ELSE north END AS north, from_s, CASE WHEN t THEN mid ELSE to_s END AS to_s FROM s
UNION ALL
SELECT id || '/1', CASE WHEN NOT t AND w THEN (west + east) / 2 ELSE west END, CASE WHEN NOT t AND NOT w THEN (south + north) / 2 ELSE south END, east, north, CASE WHEN t THEN mid + 1 ELSE from_s END, to_s FROM s
"""))
def q_rule_bisect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """halves that count no second twice."""
    return planning.bisect(PARTS.df(spark))


PICKS = Given("picks", "taxon string, media string, observation string, observer string, score double", [
    *[(f"t{t}", f"m{t}{i:02d}", f"o{t}{i // 2}", ["a", "b", " ", None][i % 4], float(i * 7 % 11)) for t in range(3) for i in range(14)],
])


@rule()
def q_rule_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns over species under a cap an observer, best row of each observation first."""
    return sampling.round_robin_quota(PICKS.df(spark), "taxon", "observation", "observer", "media", [F.col("score").desc()], per_group=5, per_observer=4)


# --- occurrences

RAW = Given("raw", "source_row_number long, " + ", ".join(f"{c} string" for c in [*occurrence.TEXTS, *occurrence.OTHERS]), [
    tuple([n, *[given.get(c) for c in [*occurrence.TEXTS, *occurrence.OTHERS]]]) for n, given in enumerate([
        {"id": " r1 ", "dataResourceUid": "dr1", "license": "CC0", "decimalLatitude": "-35.1", "decimalLongitude": "149.0", "spatiallyValid": "TRUE", "eventDate": "2001-02-03", "basisOfRecord": "HUMAN_OBSERVATION", "taxonConceptID": "c1", "assertions": "A| B |"},
        {"id": "r2", "dataResourceUid": "dr1", "license": "CC-BY", "decimalLatitude": "95", "decimalLongitude": "149", "spatiallyValid": "true", "eventDate": "1899", "basisOfRecord": "other", "taxonConceptID": "c9"},
        {"id": "r3", "dataResourceUid": "dr2", "license": "CC0", "decimalLatitude": "NaN", "decimalLongitude": "149", "spatiallyValid": "false", "eventDate": "2001/02", "coordinateUncertaintyInMeters": "inf"},
        {"id": "r4", "dataResourceUid": "dr2", "license": "CC0", "decimalLatitude": "-20", "decimalLongitude": "140", "eventDate": "3000", "coordinateUncertaintyInMeters": " 30.5 "},
        {"id": "r5", "dataResourceUid": "dr2", "license": "CC0", "decimalLatitude": "-20", "decimalLongitude": "140", "spatiallyValid": "false", "eventDate": "1949-12"},
        {"id": "r6", "dataResourceUid": "dr3", "license": "CC0", "decimalLatitude": "-20", "decimalLongitude": "140", "spatiallyValid": "true", "sensitive": "alreadyGeneralised", "eventDate": "1999", "taxonConceptID": "c1"},
        {"id": "r7", "dataResourceUid": "dr3", "license": "CC0", "decimalLongitude": "140", "spatiallyValid": " ", "eventDate": " ", "basisOfRecord": "FOSSIL_SPECIMEN"},
    ], start=1)
])
BROKEN = Given("raw", RAW.schema, [
    tuple([n, *[given.get(c) for c in [*occurrence.TEXTS, *occurrence.OTHERS]]]) for n, given in enumerate([
        {"id": " ", "dataResourceUid": "dr1", "license": "CC0"}, {"id": "r2", "dataResourceUid": None, "license": "CC-BY-NC"}, {"id": "r3", "dataResourceUid": "d", "license": "CC0", "spatiallyValid": "maybe", "sensitive": "hidden", "assertions": "A|B|A"},
        {"id": "r4", "dataResourceUid": "d", "license": "CC0"},
    ], start=1)
])
CONCEPTS = Given("concepts", "taxon_concept_id string, taxon_key string", [("c1", "k1"), ("c2", "k2")])
RECEIPT = {"snapshot_id": "s1", "snapshot_fingerprint": "f1", "archive_sha256": "a1", "retrieved_at": "2024-05-06T00:00:00Z"}
LICENCES = ("CC0", "CC-BY")


@rule(over(RAW, CONCEPTS, then=r"""
, t AS (SELECT source_row_number, trim(id) AS record_id, taxon_key, nullif(trim(decimalLatitude), '') AS la, nullif(trim(decimalLongitude), '') AS lo, lower(nullif(trim(spatiallyValid), '')) AS sv,
  coalesce(sensitive, 'not_supplied') AS sensitive_status, eventDate, basisOfRecord, coordinateUncertaintyInMeters AS cu, license AS licence, dataResourceUid AS data_resource_uid,
  list_filter(list_transform(string_split(coalesce(assertions, ''), '|'), lambda x: trim(x)), lambda x: x <> '') AS quality_assertions FROM raw LEFT JOIN concepts ON taxonConceptID = taxon_concept_id),
u AS (SELECT *, CASE WHEN isfinite(try_cast(la AS DOUBLE)) THEN la::DOUBLE END AS lat, CASE WHEN isfinite(try_cast(lo AS DOUBLE)) THEN lo::DOUBLE END AS lon, CASE WHEN isfinite(try_cast(trim(cu) AS DOUBLE)) THEN trim(cu)::DOUBLE END AS unc,
  CASE sv WHEN 'true' THEN TRUE WHEN 'false' THEN FALSE END AS spatially_valid, sensitive_status <> 'not_supplied' AS gen, nullif(regexp_extract(eventDate, '^(\d{4})(-|$)', 1), '')::INT AS event_year FROM t),
v AS (SELECT *, la IS NOT NULL AND lo IS NOT NULL AS has_coordinates, coalesce(lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180, FALSE) AS in_range FROM u)
SELECT source_row_number, record_id, taxon_key, CASE WHEN taxon_key IS NULL THEN 'unmatched_provider_taxon_assertion' ELSE 'exact_taxon_concept_crosswalk' END AS taxon_match_state, lat AS decimal_latitude, lon AS decimal_longitude,
  unc AS coordinate_uncertainty_meters, has_coordinates, in_range AS coordinate_in_range, spatially_valid, sensitive_status, gen AS coordinates_publicly_generalised,
  CASE WHEN NOT has_coordinates THEN 'excluded_missing_coordinates' WHEN NOT in_range THEN 'excluded_invalid_coordinates' WHEN spatially_valid IS NULL THEN 'excluded_spatial_validity_not_supplied' WHEN NOT spatially_valid THEN 'excluded_spatially_suspect'
    WHEN gen THEN 'eligible_generalised_coarse_only' ELSE 'eligible_all_configured_resolutions' END AS spatial_aggregation_eligibility, event_year,
  CASE WHEN event_year IS NULL THEN 'undated_or_unparseable' WHEN event_year < 1600 OR event_year > 2024 THEN 'outside_declared_valid_year_range' WHEN event_year < 1900 THEN 'pre_1900_historical' WHEN event_year < 1950 THEN '1900_1949_historical'
    WHEN event_year < 2000 THEN '1950_1999' ELSE '2000_snapshot_year' END AS temporal_evidence_band,
  CASE basisOfRecord WHEN 'HUMAN_OBSERVATION' THEN 'human_observation' WHEN 'FOSSIL_SPECIMEN' THEN 'fossil_specimen' ELSE 'other_or_not_supplied' END AS evidence_category, licence, data_resource_uid,
  quality_assertions::VARCHAR[] AS quality_assertions, len(quality_assertions)::INT AS quality_assertion_count FROM v
"""))
def q_rule_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text rows to typed ones."""
    typed = occurrence.normalise(RAW.df(spark), CONCEPTS.df(spark), RECEIPT, LICENCES)
    return typed.select(
        "source_row_number", "record_id", "taxon_key", "taxon_match_state", "decimal_latitude", "decimal_longitude", "coordinate_uncertainty_meters", "has_coordinates", "coordinate_in_range", "spatially_valid", "sensitive_status",
        "coordinates_publicly_generalised", "spatial_aggregation_eligibility", "event_year", "temporal_evidence_band", "evidence_category", "licence", "data_resource_uid", "quality_assertions", "quality_assertion_count",
    )


@rule(over(BROKEN, then=f"""SELECT source_row_number, {some(("no_record_id", "coalesce(trim(id), '') = ''"), ("no_data_resource", "coalesce(trim(dataResourceUid), '') = ''"), ("licence_not_allowed", "coalesce(license NOT IN ('CC0', 'CC-BY'), TRUE)"),
    ("spatial_validity_unknown", "lower(spatiallyValid) NOT IN ('true', 'false')"), ("sensitive_state_unknown", "sensitive NOT IN ('generalised', 'alreadyGeneralised')"),
    ("assertions_repeat", "len(string_split(assertions, '|')) > len(list_distinct(string_split(assertions, '|')))"))} AS faults FROM raw"""))
def q_rule_occurrence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps raw rows out."""
    return occurrence.faults(BROKEN.df(spark), LICENCES).select("source_row_number", "faults")


BLOCKED = Given("blocked", "data_resource_uid string", [("dr2",)])


@rule(over(RAW, BLOCKED, then="""SELECT trim(id) AS record_id, data_resource_uid FROM (SELECT *, dataResourceUid AS data_resource_uid FROM raw) r
WHERE lower(spatiallyValid) = 'true' AND try_cast(decimalLatitude AS DOUBLE) BETWEEN -90 AND 90 AND NOT EXISTS (SELECT 1 FROM blocked b WHERE b.data_resource_uid = r.data_resource_uid)"""))
def q_rule_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that may be counted in space and whose resource isn't blocked."""
    typed = occurrence.normalise(RAW.df(spark), CONCEPTS.df(spark), RECEIPT, LICENCES)
    return occurrence.without_blocked(occurrence.eligible(typed), BLOCKED.df(spark)).select("record_id", "data_resource_uid")


RIGHTS = Given("rights", "id long, text string", [(1, "CC BY-NC 4.0"), (2, "No derivatives, please"), (3, "cc-by-sa"), (4, "share alike"), (5, "CC BY 4.0"), (6, None), (7, "All rights reserved"), (8, "for NonCommercial use"), (9, "cc by nd")])


@rule(over(RIGHTS, then="SELECT id, coalesce(regexp_matches(lower(text), 'non[ -]?commercial|cc[ -]?by[ -]?(nc|nd|sa)|no[ -]?derivatives|share[ -]?alike'), FALSE) AS restricted FROM rights"))
def q_rule_rights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the screen of restrictive rights terms."""
    return RIGHTS.df(spark).select("id", restricted(F.col("text")).alias("restricted"))


NUMBERS = Given("numbers", "id long, x double", list(enumerate([0.0, -0.0, 1.0, -1.5, 0.1, 1e21, 1e20, 123456789012345680000.0, 1e-6, 1e-7, 1.2345e-7, 4.5, 333333333.33333329, 5e-324, 1.7976931348623157e308, None])))


@rule()
def q_rule_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 8785 numbers and objects."""
    return NUMBERS.df(spark).select("id", jcs(x=json_number(F.col("x")), id=F.col("id").cast("string"), note=json_text(F.lit('a"\n€'))).alias("json"))

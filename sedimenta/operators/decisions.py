"""Decision tables (P3, D8, D9, D13, D16, D17, D21-D25, D27, D28, D30, D31, D33): ordered rules as CASE expressions; what blocks is listed."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gate_decision(gates: Mapping[str, Column], passed: str = "release", failed: str = "blocked") -> Column:
    """struct(decision, blockers): passes if every gate is true. A null gate blocks."""
    blockers = F.array_compact(F.array(*[F.when(~F.coalesce(g, F.lit(False)), F.lit(n)) for n, g in gates.items()]))
    return F.struct(F.when(F.size(blockers) == 0, passed).otherwise(failed).alias("decision"), blockers.alias("blockers"))


def complete_gates(rows: DataFrame, subject: str, gate: str, state: str, required: tuple[str, ...]) -> DataFrame:
    """Gate rows to subject, decision, blockers: exactly the required gates, each `pass`.

    A missing, unknown or repeated gate blocks.
    """
    known = F.array(*map(F.lit, sorted(required)))
    per = rows.groupBy(subject).agg(F.array_sort(F.collect_set(gate)).alias("gates"), F.count("*").alias("n"), F.array_sort(F.collect_set(F.when(~(F.col(state) == "pass") | F.col(state).isNull(), F.col(gate)))).alias("not_passed"))
    blockers = F.array_sort(F.array_distinct(F.concat(
        "not_passed", F.transform(F.array_except(known, "gates"), lambda g: F.concat(F.lit("missing:"), g)), F.transform(F.array_except("gates", known), lambda g: F.concat(F.lit("unknown:"), g)),
        F.when(F.col("n") > F.size("gates"), F.array(F.lit("repeated"))).otherwise(F.array().cast("array<string>")),
    )))
    return per.select(subject, F.when(F.size(blockers) == 0, "release").otherwise("blocked").alias("decision"), blockers.alias("blockers"))


def spatial_eligibility(has_coordinates: Column, in_range: Column, valid: Column, generalised: Column) -> Column:
    """Six ordered outcomes of an occurrence's coordinates (P3); a validity that isn't supplied excludes like a false one, by another name."""
    return (
        F.when(~F.coalesce(has_coordinates, F.lit(False)), "excluded_missing_coordinates").when(~F.coalesce(in_range, F.lit(False)), "excluded_invalid_coordinates")
        .when(valid.isNull(), "excluded_spatial_validity_not_supplied").when(~valid, "excluded_spatially_suspect")
        .when(F.coalesce(generalised, F.lit(False)), "eligible_generalised_coarse_only").otherwise("eligible_all_configured_resolutions")
    )


def location_decisions(rules: DataFrame, requests: DataFrame, constraints: DataFrame, public_states: Mapping[str, tuple[str, ...]], required: tuple[str, ...]) -> DataFrame:
    """subject, publication_state (publish, generalised, withheld), ceiling and blockers of location requests.

    Rules: subject, action (publish, generalise, withhold), sensitivity (unknown, sensitive, ...), scopes (array), ceiling,
    minimum_count. Requests: subject, scope, precision, resolution, record_count. Constraints: subject, provider, used,
    disclosure, ceiling. public_states: each provider's disclosure states that are public; required: providers that
    must have a constraint. Whatever isn't known blocks, and a blocked location is withheld.
    """
    used, known = F.coalesce(F.col("used"), F.lit(False)), F.lit(False)
    for provider, states in public_states.items():
        known = known | ((F.col("provider") == provider) & F.coalesce(F.col("disclosure").isin(*states), F.lit(False)))
    name = lambda suffix: F.concat(F.col("provider"), F.lit(suffix))
    per = constraints.groupBy("subject").agg(
        F.collect_set("provider").alias("providers"), F.count_if(used).alias("n_used"), F.min(F.when(used, F.col("ceiling"))).alias("used_ceiling"),
        F.collect_set(F.when(used & ~known, name("_location_not_public"))).alias("hidden"), F.collect_set(F.when(used & F.col("ceiling").isNull(), name("_resolution_mapping_missing"))).alias("unmapped"),
    )
    rows = requests.join(rules.withColumnRenamed("ceiling", "rule_ceiling"), "subject", "left").join(per, "subject", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("providers", "hidden", "unmapped")}).withColumn("ceiling", F.least("rule_ceiling", "used_ceiling"))
    sensitive = F.col("sensitivity")
    blocks = {
        **{f"missing_{p}_provider_constraint": ~F.array_contains("providers", p) for p in required},
        "missing_provider_constraints": F.size("providers") == 0,
        "sensitive_location_policy_withholds": F.coalesce(F.col("action") == "withhold", F.lit(True)) | F.coalesce(sensitive == "unknown", F.lit(True)),
        "scope_not_permitted": ~F.coalesce(F.array_contains("scopes", F.col("scope")), F.lit(False)),
        "source_location_withheld": F.col("precision") == "withheld",
        "sensitive_exact_location_forbidden": (sensitive == "sensitive") & (F.col("precision") == "exact"),
        "minimum_public_record_count_not_met": ~F.coalesce(F.col("record_count") >= F.col("minimum_count"), F.lit(False)),
        "no_permitted_provider_location_used": F.coalesce("n_used", F.lit(0)) == 0,
        "public_resolution_ceiling_missing": F.col("ceiling").isNull(),
        "requested_resolution_exceeds_ceiling": (F.col("scope") == "cell") & ~F.coalesce(F.col("resolution") <= F.col("ceiling"), F.lit(False)),
    }
    blockers = F.array_sort(F.concat(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in blocks.items()])), "hidden", "unmapped"))
    rows = rows.withColumn("blockers", blockers)
    coarse = (F.col("action") == "generalise") | F.col("precision").isin("generalised", "coarse_rollup")
    state = F.when(F.size("blockers") > 0, "withheld").when(coarse, "generalised").otherwise("publish")
    return rows.select("subject", state.alias("publication_state"), F.when(F.size("blockers") == 0, F.col("ceiling")).alias("ceiling"), "blockers")


def available(value: Column, reason: str) -> Column:
    """A state-carrying value: unavailable is null with a reason, never 0."""
    return F.struct(F.when(value.isNotNull(), "available").otherwise("unavailable").alias("status"), value.alias("value"), F.when(value.isNull(), F.lit(reason)).alias("reason"))


def shape_violations(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose state-carrying column contradicts itself."""
    s = F.col(column)
    fine = ((s["status"] == "available") & s["value"].isNotNull() & s["reason"].isNull()) | ((s["status"] == "unavailable") & s["value"].isNull() & (F.length(F.trim(s["reason"])) > 0))
    return rows.where(~F.coalesce(fine, F.lit(False)))


def takedown_status(rejected: Column, dependencies: Column, open_dependencies: Column) -> Column:
    """Rejected, then completed once no dependency is open, resolving while some are, else in review."""
    return F.when(rejected, "rejected").when((dependencies > 0) & (open_dependencies == 0), "completed").when(dependencies > 0, "resolving").otherwise("review")


def next_state(rows: DataFrame, state: str, action: str, revision: str, expected_revision: str, transitions: list[tuple[str, str, str]]) -> DataFrame:
    """Commands on a state machine with optimistic revisions (D13, D28): adds next_state and refused (null, stale or illegal)."""
    spark = rows.sparkSession
    legal = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a).alias("__from"), F.lit(b).alias("__action"), F.lit(c).alias("next_state")) for a, b, c in transitions])))
    joined = rows.join(legal, (F.col(state) == F.col("__from")) & (F.col(action) == F.col("__action")), "left")
    stale = ~F.col(revision).eqNullSafe(F.col(expected_revision))
    refused = F.when(stale, "stale").when(F.col("next_state").isNull(), "illegal")
    return joined.withColumn("refused", refused).withColumn("next_state", F.when(refused.isNull(), F.col("next_state")).otherwise(F.col(state))).drop("__from", "__action")


def presence(age_s: Column, horizon_s: int = 300) -> Column:
    """No heartbeat is unavailable, an old one offline."""
    return F.when(age_s.isNull(), "unavailable").when(age_s > horizon_s, "offline").otherwise("online")


def maturity(steps: list[tuple[str, Column]]) -> Column:
    """The last step reached with all before it; null if the first isn't."""
    out, so_far = F.lit(None).cast("string"), F.lit(True)
    for name, done in steps:
        so_far = so_far & F.coalesce(done, F.lit(False))
        out = F.when(so_far, F.lit(name)).otherwise(out)
    return out


def number_grounding(claim: Column, facts: Column) -> Column:
    """Numbers of a text that no fact has; empty if all are grounded."""
    return F.array_except(F.regexp_extract_all(claim, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)"), F.lit(1)), facts)


def conflict_rows(events: DataFrame, subject: str) -> DataFrame:
    """Subjects with two events, two reviewers and two decisions at least."""
    return events.groupBy(subject).agg(F.count("*").alias("events"), F.countDistinct("reviewer").alias("reviewers"), F.countDistinct("decision").alias("decisions")).where("events >= 2 AND reviewers >= 2 AND decisions >= 2")


def appeal_effect(effects: DataFrame, case: str, seq: str, columns: list[str]) -> DataFrame:
    """The latest value other than `unchanged` of each independent effect column."""
    return effects.groupBy(case).agg(*[F.max_by(F.when(F.col(c) != "unchanged", F.col(c)), F.when(F.col(c) != "unchanged", F.col(seq))).alias(c) for c in columns])

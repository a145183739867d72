"""Layered consensus of human reviews (D1-D5, A19, K12): ordered rules, blockers that are listed, dissent that is kept.

Reviews: subject, reviewer, event (its fingerprint), outcome (yes, no, cant_tell, cant_view, skipped), qualified,
weight (an estimated reliability, null without one). Adjudications: subject, adjudicator, event, outcome, qualified,
sources (the fingerprints cited). Gates: subject and six booleans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bounds of a reviewer's weight, and each release gate with the blocker of its absence.
WEIGHTS = (0.5, 2.0)
GATES = {
    "rights_passed": "rights_gate_required", "provenance_passed": "provenance_gate_required", "conflict_resolved": "conflict_resolution_required",
    "quality_passed": "quality_gate_required", "expert_gate_satisfied": "expert_gate_required", "authorization_passed": "release_authorization_required",
}


def reviewer_weight(weight: Column) -> Column:
    """1 without an estimate; one outside WEIGHTS is an error (D3)."""
    out = F.raise_error(F.concat(F.lit("a weight outside policy: "), weight.cast("string"))).cast("double")
    return F.when(weight.isNull(), F.lit(1.0)).when(weight.between(*WEIGHTS), weight).otherwise(out)


def overall_status(yes: Column, no: Column, uncertain: Column, failures: Column, adjudicated: Column, required: Column | int) -> Column:
    """D1, from counts of the effective events and whether a valid adjudication exists."""
    decisive = yes + no
    return (
        F.when((decisive == 0) & (uncertain > 0), "uncertain_only").when((decisive == 0) & (failures > 0), "media_failure").when(decisive == 0, "deferred")
        .when((yes > 0) & (no > 0), F.when(adjudicated, "adjudicated").otherwise("unresolved_disagreement"))
        .when(uncertain > 0, "unresolved_disagreement").when(decisive < required, "pending").otherwise("complete_agreement")
    )


def database_status(status: Column, outcome: Column) -> Column:
    """struct(status, decision) of a layer's status and outcome as they are stored."""
    kept = F.struct
    of = lambda s, d: kept(F.lit(s).alias("status"), F.lit(d).cast("string").alias("decision"))
    return (
        F.when(outcome.isin("supported", "release_ready"), of("reached", "yes")).when(outcome == "not_supported", of("reached", "no"))
        .when((outcome == "uncertain") & (status == "available"), of("reached", "cannot_tell")).when(outcome == "media_failure", of("reached", "cannot_view"))
        .when((outcome == "not_release_ready") & (status == "available"), of("rejected", None)).when(status == "blocked", of("disputed", None))
        .otherwise(of("insufficient", None))
    )


def adjudication_faults(a: dict[str, Column], reviewers: Column, decisive: Column, conflict: Column) -> Column:
    """What makes an adjudication invalid; empty if nothing does.

    reviewers, decisive: arrays of the effective reviewers and of the decisive events; conflict: are there both decisions?
    """
    rules = {
        "outcome_not_decisive": ~F.coalesce(a["outcome"].isin("yes", "no"), F.lit(False)), "not_qualified": ~F.coalesce(a["qualified"], F.lit(False)),
        "not_independent": F.array_contains(reviewers, a["adjudicator"]), "sources_repeat": F.size(a["sources"]) > F.size(F.array_distinct(a["sources"])),
        "cites_itself": F.array_contains(a["sources"], a["event"]), "no_decisive_disagreement": ~conflict,
        "sources_incomplete": conflict & (F.array_sort(F.array_distinct(a["sources"])) != F.array_sort(decisive)),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()]))


def _counts(rows: DataFrame, prefix: str = "") -> list[Column]:
    is_ = lambda *o: F.col("outcome").isin(*o)
    return [F.count_if(is_("yes")).alias(prefix + "yes"), F.count_if(is_("no")).alias(prefix + "no"), F.count_if(is_("cant_tell")).alias(prefix + "uncertain")]


def layers(reviews: DataFrame, adjudications: DataFrame, gates: DataFrame, required: int = 2) -> DataFrame:
    """subject, overall, layer, status, outcome, blockers, support_total, oppose_total, dissent, stored_status, stored_decision.

    Three layers a subject: community counts all reviewers alike, qualified weighs those with standing, release needs the
    qualified layer to support and every gate to be true. A subject has one adjudication at most; an invalid one doesn't
    count, and its faults block the qualified layer.
    """
    w = reviewer_weight(F.col("weight"))
    yes, no, ok = F.col("outcome") == "yes", F.col("outcome") == "no", F.coalesce(F.col("qualified"), F.lit(False))
    per = reviews.groupBy("subject").agg(
        *_counts(reviews), F.count_if(F.col("outcome") == "cant_view").alias("failures"), F.array_sort(F.collect_set("reviewer")).alias("reviewers"),
        F.array_sort(F.collect_set(F.when(yes | no, F.col("event")))).alias("decisive"),
        F.count_if(ok).alias("q_all"), F.count_if(ok & yes).alias("q_yes"), F.count_if(ok & no).alias("q_no"), F.count_if(ok & (F.col("outcome") == "cant_tell")).alias("q_uncertain"),
        F.coalesce(F.sum(F.when(ok & yes, w)), F.lit(0.0)).alias("w_yes"), F.coalesce(F.sum(F.when(ok & no, w)), F.lit(0.0)).alias("w_no"),
    )
    ruled = adjudications.select("subject", F.struct(*[F.col(c) for c in ("adjudicator", "event", "outcome", "qualified", "sources")]).alias("a"))
    rows = per.join(ruled, "subject", "left").join(gates, "subject", "left")
    conflict = (F.col("yes") > 0) & (F.col("no") > 0)
    none = F.array().cast("array<string>")
    a = {c: F.col(f"a.{c}") for c in ("adjudicator", "event", "outcome", "qualified", "sources")}
    rows = rows.withColumn("faults", F.when(F.col("a").isNotNull(), adjudication_faults(a, F.col("reviewers"), F.col("decisive"), conflict)).otherwise(none))
    rows = rows.withColumn("valid", F.col("a").isNotNull() & (F.size("faults") == 0))
    rows = rows.withColumn("overall", overall_status(F.col("yes"), F.col("no"), F.col("uncertain"), F.col("failures"), F.col("valid"), required))

    def layer(name: str, status: Column, outcome: Column, blockers: Column, support: Column, oppose: Column) -> Column:
        return F.struct(
            F.lit(name).alias("layer"), status.alias("status"), outcome.cast("string").alias("outcome"), F.array_sort(F.array_distinct(blockers)).alias("blockers"),
            support.cast("double").alias("support_total"), oppose.cast("double").alias("oppose_total"),
        )

    o, text = F.col("overall"), lambda x: F.lit(x).cast("string")
    one = lambda x: F.array(F.lit(x))
    community = layer(
        "community", F.when(o == "pending", "pending").when(o.isin("unresolved_disagreement", "adjudicated"), "blocked").when(o == "deferred", "unavailable").otherwise("available"),
        F.when(o == "pending", text(None)).when(o.isin("unresolved_disagreement", "adjudicated", "uncertain_only"), "uncertain").when(o.isin("media_failure", "deferred"), o)
        .when(F.col("yes") > 0, "supported").otherwise("not_supported"),
        F.when(o == "pending", one("decisive_reviews_below_required")).when(o == "unresolved_disagreement", one("human_disagreement_requires_adjudication"))
        .when(o == "adjudicated", one("source_dissent_retained_after_adjudication")).when(o == "deferred", one("all_effective_reviews_deferred")).otherwise(none),
        F.col("yes"), F.col("no"),
    )
    q_yes, q_no = F.col("q_yes") > 0, F.col("q_no") > 0
    short, unsure = F.col("q_yes") + F.col("q_no") < required, F.col("q_uncertain") > 0
    q_status = F.when(F.col("valid"), "available").when(F.col("q_all") == 0, "unavailable").when(short, "pending").when((q_yes & q_no) | unsure, "blocked").otherwise("available")
    q_outcome = (
        F.when(F.col("valid"), F.when(a["outcome"] == "yes", "supported").otherwise("not_supported")).when((F.col("q_all") == 0) | short, text(None))
        .when((q_yes & q_no) | unsure, "uncertain").when(q_yes, "supported").otherwise("not_supported")
    )
    q_blockers = (
        F.when(F.col("valid"), none).when(F.col("q_all") == 0, one("qualified_reviews_unavailable")).when(short, one("qualified_decisive_reviews_below_required"))
        .when(q_yes & q_no, one("qualified_disagreement_requires_adjudication")).when(unsure, one("qualified_uncertainty_unresolved")).otherwise(none)
    )
    q_blockers = F.concat(q_blockers, F.transform("faults", lambda f: F.concat(F.lit("adjudication:"), f)))
    rows = rows.withColumn("qualified_layer", layer("qualified", q_status, q_outcome, q_blockers, F.col("w_yes"), F.col("w_no")))
    q = F.col("qualified_layer")
    missing = F.array_compact(F.array(
        *[F.when(~F.coalesce(F.col(g), F.lit(False)), F.lit(b)) for g, b in GATES.items()], F.when(q["status"] != "available", F.lit("qualified_consensus_unavailable")),
    ))
    opposed = q["outcome"].eqNullSafe(F.lit("not_supported"))
    ready = q["outcome"].eqNullSafe(F.lit("supported")) & (F.size(missing) == 0)
    release = layer(
        "release", F.when(opposed | ready, "available").otherwise("blocked"), F.when(ready, "release_ready").otherwise("not_release_ready"),
        F.when(opposed, none).otherwise(missing), F.col("q_yes"), F.col("q_no"),
    )
    out = rows.select("subject", "overall", F.least("yes", "no").alias("dissent"), F.inline(F.array(community, q, release)))
    stored = database_status(F.col("status"), F.col("outcome"))
    return out.withColumn("stored", stored).select("*", F.col("stored.status").alias("stored_status"), F.col("stored.decision").alias("stored_decision")).drop("stored")

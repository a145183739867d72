"""What may be shown to whom: views, public gates and command checks.

Every view is an allow-list of columns behind inner joins and filters; what isn't known isn't shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import descendants

#: An assignment that is being worked on, a release candidate's gates, and what a public photo must be.
OPEN = ("assigned", "opened", "responded")
CANDIDATE_GATES = (
    "all_release_gates_passed", "human_supported_identity", "qualified_consensus_passed", "coordinate_valid", "date_valid", "duplicate_independence_passed",
    "rights_provenance_passed", "quality_threshold_passed", "no_unresolved_conflict", "evidence_packet_complete",
)
PUBLIC = {
    "visibility_state": "public", "is_current": True, "rights_status": "allowed", "display_allowed": True, "redistribution_allowed": True, "media_state": "committed",
    "object_kind": "public_thumbnail",
}
BLIND = ("blind_model_label", "blind_model_score", "blind_query_term", "blind_source_comment", "blind_peer_decisions")


def _true(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def _fit_media() -> Column:
    return (F.col("media_state") == "committed") & (F.col("decode_status") == "valid") & (F.col("rights_status") == "allowed") & _true("display_allowed")


def blind_assignments(assignments: DataFrame, campaigns: DataFrame, media: DataFrame) -> DataFrame:
    """Open assignments of fully blind, open campaigns over media that may be shown; no evidence of others is among the columns."""
    rows = assignments.join(campaigns, "campaign").join(media, "media")
    blind = F.lit(True)
    for c in BLIND:
        blind = blind & _true(c)
    rows = rows.where(F.col("assignment_status").isin(*OPEN) & (F.col("campaign_status") == "open") & _fit_media() & blind)
    return rows.select("assignment", "campaign", "media", "question", "assignment_status", "image_sha256", F.lit(False).alias("scientific_claim_allowed"))


def post_decision(disclosures: DataFrame, assignments: DataFrame) -> DataFrame:
    """What a reviewer may see once decided, by assignment."""
    return disclosures.join(assignments.select("assignment"), "assignment").select("disclosure", "assignment", "disclosure_state", "model_label", "peer_yes_count", "peer_no_count")


def adjudication_queue(assignments: DataFrame, conflicts: DataFrame, campaigns: DataFrame, media: DataFrame) -> DataFrame:
    """Open adjudications with their conflict, campaign and media, if all of them may be worked on."""
    rows = assignments.join(conflicts, "conflict").join(campaigns, "campaign").join(media, "media")
    rows = rows.where(F.col("assignment_status").isin(*OPEN) & (F.col("campaign_status") == "open") & _fit_media())
    return rows.select("assignment", "conflict", "campaign", "media", "assignment_status", "conflict_field", "source_event_count", "image_sha256")


def display_reasons(as_of_s: Column, host: str, path: str, thumbnails: str, longest_s: int, stale_s: int = 24 * 3600) -> Column:
    """Why an item isn't shown; empty if it is. Times are seconds; a null of any kind is a reason."""
    sha = lambda c: F.rlike(c, F.lit("^[0-9a-f]{64}$"))
    url = lambda c, part: F.try_parse_url(F.col(c), F.lit(part))
    rules = {
        **{f"no_{c}": F.trim(c) != "" for c in ("photographer", "owner", "licence_id", "attribution")},
        "source_link_not_exact": (url("source_url", "PROTOCOL") == "https") & (url("source_url", "HOST") == host) & url("source_url", "PATH").startswith(path),
        "licence_link_invalid": (url("licence_url", "PROTOCOL") == "https") & url("licence_url", "HOST").isNotNull(),
        "thumbnail_not_internal": F.col("image_url").startswith(thumbnails) & ~F.rlike("image_url", F.lit(r"[?#]|://")),
        **{f"{c}_not_eligible": F.col(c) == v for c, v in PUBLIC.items()},
        "removed": F.col("removal_case").isNull(),
        **{f"invalid_{c}": sha(c) for c in ("source_record_fingerprint", "rights_fingerprint", "display_fingerprint")},
        "timeline_invalid": (F.col("cached_s") <= F.col("revalidated_s")) & (F.col("revalidated_s") <= as_of_s), "cache_too_long": F.col("expires_s") - F.col("cached_s") <= longest_s,
        "cache_expired": F.col("expires_s") > as_of_s, "revalidation_stale": as_of_s - F.col("revalidated_s") <= stale_s,
    }
    return F.array_compact(F.array(*[F.when(~_true(rule), F.lit(n)) for n, rule in rules.items()]))


def public_display(items: DataFrame, approvals: DataFrame, removals: DataFrame, as_of_s: int, **policy) -> DataFrame:
    """Items with state (eligible, blocked) and reasons: their own, an approval that isn't active, any removal case of the photo."""
    active = approvals.where(_true("active") & F.col("revoked_s").isNull()).select("approval", F.lit(True).alias("__active")).distinct()
    gone = removals.select("photo", F.lit(True).alias("__gone")).distinct()
    rows = items.join(active, "approval", "left").join(gone, "photo", "left")
    extra = F.array_compact(F.array(F.when(F.col("__active").isNull(), F.lit("approval_not_active")), F.when(F.col("__gone").isNotNull(), F.lit("removal_case_exists"))))
    rows = rows.withColumn("reasons", F.array_sort(F.concat(display_reasons(F.lit(as_of_s), **policy), extra)))
    return rows.select("asset", "photo", F.when(F.size("reasons") == 0, "eligible").otherwise("blocked").alias("state"), "reasons")


def admitted_page(shown: DataFrame, page: str = "page", most: int = 30) -> DataFrame:
    """A page's items, if all are eligible, none repeats and there are `most` at most; page, admitted, faults."""
    per = shown.groupBy(page).agg(F.count("*").alias("n"), F.countDistinct("photo").alias("photos"), F.countDistinct("asset").alias("assets"), F.count_if(F.col("state") != "eligible").alias("blocked"))
    faults = F.array_compact(F.array(F.when(F.col("n") > most, F.lit("too_many")), F.when((F.col("photos") < F.col("n")) | (F.col("assets") < F.col("n")), F.lit("duplicate")), F.when(F.col("blocked") > 0, F.lit("not_eligible"))))
    return per.select(page, (F.size(faults) == 0).alias("admitted"), faults.alias("faults"))


def moderated_comments(reviews: DataFrame, cases: DataFrame, events: DataFrame) -> DataFrame:
    """Comments with their visibility by the latest event that isn't `unchanged`; hidden ones are null. Blank comments are left out."""
    effects = events.where("effect <> 'unchanged'").join(cases.select("case", "review"), "case")
    last = effects.groupBy("review").agg(F.max_by("effect", F.struct("recorded_s", "event")).alias("effect"))
    rows = reviews.where(F.length("comment") > 0).join(last, "review", "left")
    hidden = F.coalesce(F.col("effect") == "hidden", F.lit(False))
    return rows.select("review", F.when(~hidden, F.col("comment")).alias("display_comment"), F.when(hidden, "hidden").otherwise("visible").alias("visibility_state"))


def assignment_progress(campaigns: DataFrame, targets: DataFrame, assignments: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Review progress of (campaign, media) targets by left joins with several conditions, one of them a constant."""
    a = targets.join(campaigns, "campaign").join(assignments.select("campaign", "media", "reviewer", F.col("status").alias("a_status")), ["campaign", "media"], "left")
    a = a.join(profiles.select("reviewer", "qualification"), "reviewer", "left")
    active = members.where("status = 'active'").select("project", "reviewer", "role")
    a = a.join(active, ["project", "reviewer"], "left")
    live, done = ~F.col("a_status").isin("expired", "withdrawn"), F.col("a_status") == "responded"
    verified = F.col("qualification") == "verified"
    expert = done & verified & F.col("role").isin("expert", "curator", "administrator")
    keys = ["campaign", "media", "target_count", "minimum_qualified", "expert_gate"]
    per = a.groupBy(*keys).agg(
        F.count_if(live).alias("assigned"), F.count_if(done).alias("responded"), F.count_if(done & verified).alias("responded_qualified"), F.coalesce(F.bool_or(expert), F.lit(False)).alias("__expert")
    )
    return per.select(
        "campaign", "media", "target_count", "assigned", "responded", F.greatest(F.col("target_count") - F.col("assigned"), F.lit(0)).alias("remaining"), "minimum_qualified", "responded_qualified",
        (~F.col("expert_gate") | F.col("__expert")).alias("expert_gate_satisfied"),
    )


def next_assignment(rows: DataFrame) -> DataFrame:
    """Rows (campaign_kind, active, active_experts, active_qualified, target_count, minimum_qualified, expert_gate) with reason and required_role."""
    kind = F.col("campaign_kind")
    reason = F.when((kind == "disagreement") & (F.col("active") >= 2), "conflict").when(kind == "potential_gap", "potential_gap").when(kind == "reference_image", "reference").otherwise("ordinary")
    impact = kind == "high_impact_release"
    role = F.when(impact & _true("expert_gate") & (F.col("active_experts") == 0) & (F.col("active") == F.col("target_count") - 1), "expert").when(impact & (F.col("active_qualified") < F.col("minimum_qualified")), "qualified")
    return rows.withColumns({"reason": reason, "required_role": role})


def case_parties(cases: DataFrame, reporters: DataFrame, callers: DataFrame) -> DataFrame:
    """(caller, case) pairs in which the caller's profile is the case's target or reporter."""
    rows = cases.select("case", "target").join(reporters.select("case", "reporter"), "case", "left")
    sides = rows.select("case", F.explode(F.array_distinct(F.array_compact(F.array("target", "reporter")))).alias("profile"))
    return callers.join(sides, "profile").select("caller", "case").distinct()


def taken_down(candidates: DataFrame, media: DataFrame, requests: DataFrame) -> DataFrame:
    """Candidates whose media, or an ancestor of it, is the target of a rights request, by itself or by its photo.

    candidates: candidate, media. media: media, parent, photo. requests: kind (media_object, photo), target.
    """
    up = media.where(F.col("parent").isNotNull()).select(F.col("media").alias("child"), "parent")
    by_media = requests.where("kind = 'media_object'").select(F.col("target").alias("node"))
    by_photo = media.join(requests.where("kind = 'photo'").select(F.col("target").alias("photo")), "photo", "left_semi").select(F.col("media").alias("node"))
    hit = descendants(up, by_media.union(by_photo).distinct()).select(F.col("node").alias("media"))
    return candidates.join(hit, "media", "left_semi").select("candidate")


def publishable(receipts: DataFrame, kind: str, state: tuple[str, ...] = ("publish", "generalised")) -> DataFrame:
    """Targets of a kind with a location receipt in a public state."""
    return receipts.where((F.col("target_kind") == kind) & F.col("state").isin(*state)).select("target").distinct()


def release_receipt_faults(receipts: DataFrame, candidates: DataFrame, consensus: DataFrame, media: DataFrame, locations: DataFrame, taken: DataFrame) -> DataFrame:
    """Receipt, faults of occurrence release receipts; empty for those that hold.

    Receipts: receipt, candidate, candidate_fingerprint, community, qualified (consensus ids). Candidates: candidate, media,
    species, consensus, state, fingerprint, the CANDIDATE_GATES, expert_required, expert_passed, cell, date. Consensus:
    consensus, campaign, media, species, layer, status, decision, outcome, revision. locations: publishable() targets;
    taken: taken_down() candidates. A layer must be its campaign's latest revision.
    """
    c = candidates.select("candidate", F.col("media").alias("c_media"), "species", F.col("consensus").alias("release"), "state", "fingerprint", *CANDIDATE_GATES, "expert_required", "expert_passed", "cell", "date")
    latest = consensus.groupBy("campaign", "media", "layer").agg(F.max("revision").alias("last"))
    known = consensus.join(latest, ["campaign", "media", "layer"])
    rows = receipts.join(c, "candidate", "left").join(media.select(F.col("media").alias("c_media"), "media_state", F.col("rights_status").alias("m_rights")), "c_media", "left")
    needs = {"release": ("release", "release_ready"), "community": ("community", "supported"), "qualified": ("qualified", "supported")}
    rules = {
        "lineage_differs": (F.col("fingerprint") == F.col("candidate_fingerprint")),
        "candidate_state_not_eligible": F.col("state").isin("eligible", "approved", "exported"),
        **{f"gate:{g}": F.col(g) for g in CANDIDATE_GATES},
        "gate:expert_review_passed": ~F.col("expert_required") | F.col("expert_passed"),
        "no_coordinate_or_date": F.col("cell").isNotNull() & F.col("date").isNotNull(),
        "media_not_releasable": (F.col("media_state") == "committed") & (F.col("m_rights") == "allowed"),
    }
    for key, (layer, outcome) in needs.items():
        some = known.where(F.col("layer") == layer).select(*[F.col(x).alias(f"{key}_{x}" if x != "consensus" else key) for x in ("consensus", "campaign", "media", "species", "status", "decision", "outcome", "revision", "last")])
        rows = rows.join(some, key, "left")
        rules[f"{key}_consensus_missing"] = (F.col(f"{key}_status") == "reached") & (F.col(f"{key}_decision") == "yes") & (F.col(f"{key}_outcome") == outcome)
        rules[f"{key}_consensus_superseded"] = F.col(f"{key}_revision") == F.col(f"{key}_last")
    same = lambda x: (F.col(f"release_{x}") == F.col(f"community_{x}")) & (F.col(f"release_{x}") == F.col(f"qualified_{x}"))
    rules["layers_do_not_share_lineage"] = same("campaign") & same("media") & same("species") & (F.col("release_media") == F.col("c_media")) & (F.col("release_species") == F.col("species"))
    rows = rows.join(locations.select(F.col("target").alias("candidate"), F.lit(True).alias("__public")), "candidate", "left").join(taken.select("candidate", F.lit(True).alias("__taken")).distinct(), "candidate", "left")
    rules |= {"location_not_publishable": F.col("__public"), "media_taken_down": F.col("__taken").isNull()}
    return rows.select("receipt", F.array_sort(F.array_compact(F.array(*[F.when(~_true(rule), F.lit(n)) for n, rule in rules.items()]))).alias("faults"))


def registrations(requests: DataFrame, projects: DataFrame, profiles: DataFrame, members: DataFrame) -> DataFrame:
    """Requests (caller, anonymous, project, name) with result: refused with its reason, or created, joined or unchanged.

    A name is 2 to 80 characters without contact details. Repeating a request changes nothing; a profile that isn't
    active needs a curator. The profile keeps its first name.
    """
    name = F.trim("name")
    rows = requests.join(projects.where("status = 'active'").select("project", F.lit(True).alias("__project")), "project", "left")
    rows = rows.join(profiles.select("caller", "profile", "public_name", F.col("status").alias("p_status")), "caller", "left")
    rows = rows.join(members.select("profile", "project", F.col("status").alias("m_status")), ["profile", "project"], "left")
    bad = F.coalesce(~F.length(name).between(2, 80) | F.rlike(name, F.lit(r"[\r\n\t]")) | F.contains(name, F.lit("@")) | F.rlike(name, F.lit(r"(?i)(?:^|\s)https?://")), F.lit(True))
    reason = (
        F.when(F.col("caller").isNull(), "not_authenticated").when(_true("anonymous"), "anonymous_account").when(bad, "invalid_public_name").when(F.col("__project").isNull(), "no_active_project")
        .when(F.col("p_status") != "active", "profile_requires_curator").when(F.col("m_status").isNotNull() & (F.col("m_status") != "active"), "membership_requires_curator")
    )
    result = F.when(reason.isNotNull(), "refused").when(F.col("p_status").isNull(), "created").when(F.col("m_status").isNull(), "joined").otherwise("unchanged")
    return rows.select("caller", "project", result.alias("result"), reason.alias("reason"), F.when(reason.isNull(), F.coalesce("public_name", name)).alias("public_name"))


def curator_notes(notes: DataFrame, cases: DataFrame, members: DataFrame, events: DataFrame) -> DataFrame:
    """Notes (case, curator, note) that may be appended, with the case's next event sequence; of several of a case each has its own.

    The curator is an active curator or administrator of the case's project; notes have 1 to 4000 characters.
    """
    from pyspark.sql.window import Window

    allowed = members.where(F.col("status") == "active").where(F.col("role").isin("curator", "administrator")).select("project", F.col("reviewer").alias("curator")).distinct()
    rows = notes.where(F.length(F.trim("note")).between(1, 4000)).join(cases.select("case", "project"), "case").join(allowed, ["project", "curator"], "left_semi")
    last = events.groupBy("case").agg(F.max("sequence").alias("last"))
    order = Window.partitionBy("case").orderBy("curator", "note")
    return rows.join(last, "case", "left").select("case", "curator", F.trim("note").alias("note"), (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).alias("sequence"))


def takedown_states(requests: DataFrame, dependencies: DataFrame, as_of_s: int, deadline_h: int = 24) -> DataFrame:
    """Takedown requests (request, opened_s, decision) with deadline_s, open and state: review, rejected, resolving or completed, and overdue.

    Dependencies: request, dependency, action (null while open). A sealed inventory without dependencies completes.
    """
    d = dependencies.groupBy("request").agg(F.count("*").alias("dependencies"), F.count_if(F.col("action").isNull()).alias("open"))
    rows = requests.join(d, "request", "left").na.fill(0, ["dependencies", "open"])
    deadline = F.col("opened_s") + deadline_h * 3600
    state = F.when(F.col("decision") == "reject", "rejected").when(F.col("decision").isNull() | ~_true("sealed"), "review").when(F.col("open") > 0, "resolving").otherwise("completed")
    return rows.select("request", deadline.alias("deadline_s"), "dependencies", "open", state.alias("state"), (state.isin("review", "resolving") & (F.lit(as_of_s) > deadline)).alias("overdue"))

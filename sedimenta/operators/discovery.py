"""From names to planned requests and their ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import canonical_json, content_id, normalised

#: The tier of a rank, the trust that each name type needs, and the language that a type must have.
TIERS = {"species": 1, "genus": 2, "family": 3, "order": 4, "superfamily": 4}
TRUST = {
    "accepted_scientific": ("accepted_authority", "accepted_global_authority"), "scientific_synonym": ("provider_linked_synonym",),
    "english_vernacular": ("authority_vernacular", "provider_curated_vernacular"), "trusted_vernacular": ("trusted_vernacular_authority",),
}
LANGUAGES = {"accepted_scientific": "zxx", "scientific_synonym": "zxx", "english_vernacular": "en"}
STABLE_ID = r"^[a-z0-9][a-z0-9._:-]{0,199}$"


def query_text(name: Column) -> Column:
    """NFKC, case-folded, single spaces."""
    return F.trim(F.regexp_replace(normalised(name), r"\s+", " "))


def definition_faults(names: DataFrame, normal: Column | None = None) -> DataFrame:
    """names with `faults`: why an assertion can't become a query, in the order of the rules.

    names: assertion, taxon_key, name, normalized, name_type, rank, language, trust, homonym_risk, eligible, reason, provider.
    """
    of = lambda table, column: F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.col(column)]
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    trusted = F.lit(False)
    for kind, some in TRUST.items():
        trusted = trusted | ((F.col("name_type") == kind) & F.col("trust").isin(*some))
    rules = {
        "invalid_assertion_id": ~F.rlike("assertion", F.lit(STABLE_ID)), "invalid_taxon_key": ~F.rlike("taxon_key", F.lit(STABLE_ID)),
        "invalid_name": blank(F.col("name")) | (F.length("name") > 200), "invalid_normalized_name": blank(F.col("normalized")) | (F.length("normalized") > 200),
        "normalized_name_differs": F.col("normalized") != (query_text(F.col("name")) if normal is None else normal),
        "name_type_not_supported": ~F.col("name_type").isin(*TRUST), "rank_has_no_tier": ~F.col("rank").isin(*TIERS), "not_eligible": ~F.col("eligible"),
        "eligibility_reason_contradicts": blank(F.col("reason")) | F.col("reason").startswith("excluded_") | F.contains("reason", F.lit("pending")),
        "homonym_risk": ~F.col("homonym_risk").startswith("none_detected"), "no_language": blank(F.col("language")),
        "language_differs": F.coalesce(of(LANGUAGES, "name_type") != F.col("language"), F.lit(False)), "trust_insufficient": ~trusted, "no_provider": blank(F.col("provider")),
    }
    return names.withColumn("faults", F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(n)) for n, rule in rules.items()])))


def definitions(names: DataFrame, normal: Column | None = None) -> DataFrame:
    """Eligible assertions as query definitions with an id by content, in order of tier, term, taxon, assertion.

    A row with faults or a term of several taxa (J12) fails the job: list them by definition_faults() and colliding_names() first.
    """
    rows = definition_faults(names, normal).withColumn("tier", F.create_map(*[F.lit(v) for kv in TIERS.items() for v in kv])[F.col("rank")])
    taxa = rows.groupBy("normalized").agg(F.countDistinct("taxon_key").alias("__taxa"))
    rows = rows.join(taxa.hint("merge"), "normalized")  # short columns look small enough to broadcast
    fault = F.when(F.size("faults") > 0, F.concat(F.col("assertion"), F.lit(": "), F.array_join("faults", ", "))).when(F.col("__taxa") > 1, F.concat(F.lit("a term of several taxa: "), "normalized"))
    checked = F.when(fault.isNull(), F.col("assertion")).otherwise(F.raise_error(fault).cast("string"))
    own = {n: F.col(n) for n in ("taxon_key", "name", "normalized", "language", "name_type", "rank", "trust", "tier", "provider")}
    digest = F.sha2(canonical_json(assertion=F.col("assertion"), **own), 256)
    rows = rows.withColumns({"compiler_fingerprint": digest, "assertion": checked})
    return rows.select(content_id("query", F.col("compiler_fingerprint")).alias("definition"), "assertion", *own, "compiler_fingerprint").orderBy("tier", "normalized", "taxon_key", "assertion")


def requests(associations: DataFrame, defined: DataFrame, common: dict[str, str]) -> DataFrame:
    """Associations (association, definition, fingerprint) with their definition's request and link, many to one request.

    A request's id comes from its parameters, so associations of one term share it. A definition that is unknown or has
    another fingerprint is an error. Distinct requests: .select("request", "request_fingerprint", "parameters").distinct().
    """
    known = defined.select("definition", "normalized", F.col("compiler_fingerprint").alias("__own"))
    rows = associations.join(known.hint("merge"), "definition", "left")
    fault = F.when(F.col("__own").isNull(), "an unknown definition").when(F.col("__own") != F.col("fingerprint"), "a definition's fingerprint differs")
    rows = rows.withColumn("association", F.when(fault.isNull(), F.col("association")).otherwise(F.raise_error(F.concat(fault, F.lit(": "), "definition")).cast("string")))
    parameters = canonical_json(text=F.col("normalized"), **{k: F.lit(v) for k, v in common.items()})
    rows = rows.withColumn("parameters", parameters).withColumn("request_fingerprint", F.sha2("parameters", 256))
    rows = rows.withColumn("request", content_id("request", F.col("request_fingerprint")))
    link = F.sha2(canonical_json(association=F.col("association"), request=F.col("request"), request_fingerprint=F.col("request_fingerprint")), 256)
    return rows.select("association", "definition", "request", "request_fingerprint", "parameters", link.alias("link_fingerprint"), content_id("link", link).alias("link"))


def ledger_faults(associations: DataFrame, links: DataFrame, executions: DataFrame) -> DataFrame:
    """Association, fault of what keeps an executed page's links from its ledger; empty if complete both ways.

    associations: association, fingerprint. links: link, association, fingerprint, request. executions: request, receipt.
    """
    a = associations.groupBy("association").agg(F.count("*").alias("n_a"), F.min("fingerprint").alias("own"))
    b = links.join(executions.select("request", F.lit(True).alias("executed")).distinct(), "request", "left")
    b = b.groupBy("association").agg(F.count("*").alias("n_l"), F.min("fingerprint").alias("cited"), F.count_if(F.col("executed").isNull()).alias("elsewhere"))
    rows = a.join(b, "association", "full")
    rules = {
        "association_repeats": F.col("n_a") > 1, "link_without_association": F.col("n_a").isNull(), "association_without_link": F.col("n_l").isNull(), "association_has_several_links": F.col("n_l") > 1,
        "fingerprint_differs": F.col("own") != F.col("cited"), "request_not_executed": F.col("elsewhere") > 0,
    }
    return rows.select("association", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(r, F.lit(False)), F.lit(n)) for n, r in rules.items()]))).alias("fault"))


def ledger_rows(links: DataFrame, executions: DataFrame) -> DataFrame:
    """Receipt, association, record id and fingerprint of each link of an executed request."""
    rows = links.join(executions.select("request", "receipt", "page_fingerprint"), "request")
    digest = F.sha2(canonical_json(receipt=F.col("receipt"), page=F.col("page_fingerprint"), link=F.col("link")), 256)
    return rows.select("receipt", "association", content_id("ledger", digest).alias("record"), digest.alias("fingerprint"))


def request_ledger(attempts: DataFrame) -> DataFrame:
    """Hash-only rows of attempts (execution, attempt, status, body, error): state success, failed or quarantined.

    No body is kept, only its digest and size. A success without a body, or a body with an error, is quarantined.
    """
    fine = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    whole = fine & F.col("body").isNotNull() & F.col("error").isNull()
    odd = (fine & ~whole) | (F.col("body").isNotNull() & F.col("error").isNotNull())
    state = F.when(odd, "quarantined").when(whole, "success").otherwise("failed")
    body = F.encode("body", "UTF-8")
    return attempts.select("execution", "attempt", "status", state.alias("state"), F.when(F.col("body").isNotNull(), F.sha2(body, 256)).alias("body_sha256"), F.octet_length(body).cast("long").alias("body_bytes"), F.when(state != "success", F.sha2(F.coalesce("error", F.lit("")), 256)).alias("error_sha256"))


def resume_plan(items: DataFrame, journal: DataFrame) -> DataFrame:
    """Items (kind, input_fingerprint) to work, action (reuse_committed or execute) and the committed output; repeated work is an error."""
    work = content_id("work", F.sha2(canonical_json(kind=F.col("kind"), input=F.col("input_fingerprint")), 256))
    rows = items.withColumn("work", work).groupBy("work", "kind", "input_fingerprint").agg(F.count("*").alias("n"))
    checked = F.when(F.col("n") == 1, F.col("work")).otherwise(F.raise_error(F.concat(F.lit("repeated work: "), "work")).cast("string"))
    done = journal.select("work", F.col("output").alias("committed_output"))
    rows = rows.withColumn("work", checked).join(done, "work", "left")
    return rows.select("work", "kind", "input_fingerprint", F.when(F.col("committed_output").isNotNull(), "reuse_committed").otherwise("execute").alias("action"), "committed_output")

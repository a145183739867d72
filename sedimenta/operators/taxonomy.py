"""Names, lineages and the reconciliation of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import comparable

#: Ranks that are compared, and the reasons of each conflict type, first match first: fixed values.
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus")
CONFLICTS = (
    ("ambiguous_provider_concept", ("ambiguous_multiple_matches",)), ("incompatible_provider_concept", ("name_mismatch", "rank_mismatch", "family_mismatch", "genus_mismatch", "classification_mismatch")),
    ("provider_status_conflict", ("non_accepted_usage",)), ("non_exact_provider_match", ("non_exact_match",)), ("provider_reported_issue", ("provider_issue",)),
    ("missing_provider_concept", ("provider_no_match", "missing_identifier", "missing_or_non_numeric_identifier")),
)


def query_name(name: Column, rank: Column) -> Column:
    """A species' or subspecies' name without its subgenus; others as they are."""
    return F.when(rank.isin("species", "subspecies"), F.regexp_replace(name, r"^(\S+)\s+\([^)]+\)\s+", "$1 ")).otherwise(name)


def comparable_name(name: Column) -> Column:
    """Without subgenus, in lower case, single spaces."""
    return comparable(F.regexp_replace(name, r"^(\S+)\s+\([^)]+\)\s+", "$1 "))


def lineage_map(path: Column, rank: Column, name: Column) -> Column:
    """rank to name, of a path array<struct<rank, name>> and the taxon itself; of ranks that repeat the last counts."""
    entries = F.concat(F.transform(path, lambda p: F.struct(p["rank"].alias("key"), p["name"].alias("value"))), F.array(F.struct(rank.alias("key"), name.alias("value"))))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)


def without_ranks(path: Column, excluded: tuple[str, ...]) -> Column:
    """A parent path without excluded ranks; its last element is the nearest parent that is kept."""
    return F.filter(path, lambda p: ~p["rank"].isin(*excluded))


def classification_reasons(expected: Column, observed: Column) -> Column:
    """`rank_mismatch` for each of RANKS that both maps name, differently."""
    e, o = (lambda r: comparable_name(F.try_element_at(expected, F.lit(r)))), (lambda r: comparable_name(F.try_element_at(observed, F.lit(r))))
    return F.array_compact(F.array(*[F.when(e(r) != o(r), F.lit(f"{r}_mismatch")) for r in RANKS]))


def _match(reasons: Column, none: Column, identifier: Column) -> Column:
    state = F.when(none, "unmatched").when(F.size(reasons) > 0, "conflict").otherwise("matched")
    return F.struct(state.alias("state"), F.when(none, F.array(F.lit("provider_no_match"))).otherwise(reasons).alias("reasons"), F.when(state == "matched", identifier).alias("identifier"))


def _reasons(expected: Column, observed: Column, rules: dict[str, Column], last: dict[str, Column]) -> Column:
    names = lambda some: F.array_compact(F.array(*[F.when(F.coalesce(rule, F.lit(True)), F.lit(n)) for n, rule in some.items()]))
    return F.concat(names(rules), classification_reasons(expected, observed), names(last))


def match_by_name(name: Column, rank: Column, expected: Column, m: dict[str, Column]) -> Column:
    """F16, a name service: struct(state, reasons, identifier). m: found, name, rank, match_type, issues, lineage (map), id."""
    rules = {
        "name_mismatch": ~comparable_name(m["name"]).eqNullSafe(comparable_name(name)), "rank_mismatch": ~F.lower(F.coalesce(m["rank"], F.lit(""))).eqNullSafe(rank),
        "non_exact_match": ~F.coalesce(m["match_type"].isin("exactMatch", "canonicalMatch"), F.lit(False)), "provider_issue": F.coalesce(F.exists(m["issues"], lambda i: i != "noIssue"), F.lit(False)),
    }
    missing = F.coalesce(m["id"], F.lit("")) == ""
    return _match(_reasons(expected, m["lineage"], rules, {"missing_identifier": missing}), ~F.coalesce(m["found"], F.lit(False)), m["id"])


def match_by_usage(name: Column, rank: Column, expected: Column, m: dict[str, Column]) -> Column:
    """F16, a backbone: as match_by_name(). m: found, name, rank, match_type, status, synonym, lineage (map), id."""
    rules = {
        "name_mismatch": ~comparable_name(m["name"]).eqNullSafe(comparable_name(name)), "rank_mismatch": ~F.lower(F.coalesce(m["rank"], F.lit(""))).eqNullSafe(rank),
        "non_exact_match": ~m["match_type"].eqNullSafe(F.lit("EXACT")), "non_accepted_usage": ~m["status"].eqNullSafe(F.lit("ACCEPTED")) | F.coalesce(m["synonym"], F.lit(False)),
    }
    missing = ~F.coalesce(F.rlike(m["id"], F.lit("^[0-9]+$")), F.lit(False))
    return _match(_reasons(expected, m["lineage"], rules, {"missing_or_non_numeric_identifier": missing}), ~F.coalesce(m["found"], F.lit(False)), m["id"])


def match_candidates(taxa: DataFrame, candidates: DataFrame) -> DataFrame:
    """F16 and J4, a listing: taxa (taxon_key, name, rank, expected map) against candidates (id, name, rank, lineage map).

    Candidates join on (comparable name, rank), one to many; those whose lineage contradicts drop out, and exactly one
    must be left. Returns taxon_key, state, reasons, identifier, candidate_count.
    """
    left = taxa.select("taxon_key", "expected", comparable_name(query_name(F.col("name"), F.col("rank"))).alias("__n"), F.col("rank").alias("__r"))
    right = candidates.select(F.col("id").alias("__id"), "lineage", comparable_name(F.col("name")).alias("__n"), F.lower("rank").alias("__r"))
    rows = left.join(right, ["__n", "__r"], "left")
    fits = F.col("lineage").isNotNull() & (F.size(classification_reasons(F.col("expected"), F.col("lineage"))) == 0)
    per = rows.groupBy("taxon_key").agg(F.count("lineage").alias("candidate_count"), F.count_if(fits).alias("n"), F.min(F.when(fits, F.col("__id"))).alias("id"))
    n, bad = F.col("n"), ~F.coalesce(F.rlike("id", F.lit("^[0-9]+$")), F.lit(False))
    reasons = F.when(F.col("candidate_count") == 0, F.array(F.lit("provider_no_match"))).when(n == 0, F.array(F.lit("classification_mismatch"))).when(n > 1, F.array(F.lit("ambiguous_multiple_matches")))
    reasons = reasons.when(bad, F.array(F.lit("missing_or_non_numeric_identifier"))).otherwise(F.array().cast("array<string>"))
    state = F.when(F.size("reasons") == 0, "matched").when(F.col("candidate_count") == 0, "unmatched").otherwise("conflict")
    per = per.withColumn("reasons", reasons).withColumn("state", state)
    return per.select("taxon_key", "state", "reasons", F.when(F.col("state") == "matched", F.col("id")).alias("identifier"), "candidate_count")


def conflict_type(reasons: Column) -> Column:
    """the first type of CONFLICTS that one of the reasons belongs to."""
    out = None
    for name, some in CONFLICTS:
        hit = F.arrays_overlap(reasons, F.array(*map(F.lit, some)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("unclassified_provider_conflict")


def crosswalk(taxa: DataFrame, matches: dict[str, DataFrame]) -> DataFrame:
    """taxon_key, provider, state, reasons, identifier for each taxon and provider; a provider that says nothing of a taxon is `unmatched`."""
    rows = None
    for provider, found in matches.items():
        some = taxa.select("taxon_key").join(found.select("taxon_key", "state", "reasons", "identifier"), "taxon_key", "left")
        some = some.select("taxon_key", F.lit(provider).alias("provider"), F.coalesce("state", F.lit("unmatched")).alias("state"), F.coalesce("reasons", F.array(F.lit("provider_no_match"))).alias("reasons"), "identifier")
        rows = some if rows is None else rows.union(some)
    return rows


def conflicts(rows: DataFrame) -> DataFrame:
    """crosswalk() rows that didn't match, with their type; one without a reason is an error."""
    why = F.when(F.size("reasons") > 0, conflict_type(F.col("reasons"))).otherwise(F.raise_error(F.concat(F.lit("no reason: "), "taxon_key")).cast("string"))
    return rows.where("state <> 'matched'").select("taxon_key", "provider", "state", why.alias("conflict_type"), "reasons")


def conflict_counts(rows: DataFrame) -> DataFrame:
    """Dimension (provider, type), value, n of conflicts() rows, sorted."""
    both = F.explode(F.array(F.struct(F.lit("provider").alias("dimension"), F.col("provider").alias("value")), F.struct(F.lit("type").alias("dimension"), F.col("conflict_type").alias("value"))))
    return rows.select(both.alias("d")).groupBy("d.dimension", "d.value").agg(F.count("*").alias("n")).orderBy("dimension", "value")


def zip_responses(batches: DataFrame) -> DataFrame:
    """Batch, keys array, responses array to taxon_key, response by position; arrays of different lengths are an error."""
    fit = F.when(F.size("keys") == F.size("responses"), F.col("keys")).otherwise(F.raise_error(F.concat(F.lit("keys and responses differ: "), F.col("batch").cast("string"))).cast("array<string>"))
    return batches.select("batch", F.inline(F.arrays_zip(fit.alias("taxon_key"), F.col("responses").alias("response"))))


def species(taxa: DataFrame, accepted_only: bool = True) -> DataFrame:
    """Species, of accepted status unless told otherwise, by name and key."""
    rows = taxa.where(F.col("rank") == "species")
    return (rows.where(F.col("status") == "accepted") if accepted_only else rows).orderBy("name", "taxon_key")


def provider_queries(rows: DataFrame, providers: dict[str, tuple[str, int, int]]) -> DataFrame:
    """A species to one query a provider; providers: name to (its id column, page size, most records). Sorted by source, name, id."""
    each = F.array(*[
        F.struct(F.lit(p).alias("source"), F.col(c).cast("string").alias("source_taxon_id"), F.lit(size).alias("page_size"), F.lit(most).alias("maximum_records"))
        for p, (c, size, most) in providers.items()
    ])
    return rows.select("taxon_key", "name", F.inline(each)).orderBy("source", "name", "source_taxon_id")


def colliding_names(names: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of names (taxon_key, normalized) whose term another taxon of `known` (or of themselves) has, with those taxa."""
    others = known.select(F.col("taxon_key").alias("other"), "normalized").union(names.select("taxon_key", "normalized")).distinct()
    rows = names.join(others, "normalized").where(F.col("taxon_key") != F.col("other"))
    return rows.groupBy("normalized", "taxon_key").agg(F.array_sort(F.collect_set("other")).alias("other_taxa"))


def catalogue(rows: DataFrame, matches: DataFrame, names: DataFrame, coverage: DataFrame) -> DataFrame:
    """A row a species, by case-folded name (L9): its family and genus, names by type, provider states, counts.

    rows: taxon_key, name, lineage (map). matches: crosswalk() rows. names: taxon_key, name_type, name, assertion.
    coverage: taxon_key, n. Every species needs a family and a genus and a coverage row, else the job fails; one
    without matches has none.
    """
    none = F.array().cast("array<string>")
    m = matches.groupBy("taxon_key").agg(F.array_sort(F.collect_list(F.concat_ws(":", "provider", "state", "identifier"))).alias("providers"), F.count_if(F.col("state") != "matched").alias("open_conflicts"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("name_type") == kind, F.struct(F.lower("name").alias("k"), F.col("name"), F.col("assertion")))))
    n = names.groupBy("taxon_key").agg(*[F.transform(of(kind), lambda s: s["name"]).alias(column) for kind, column in (("english_vernacular", "english_names"), ("scientific_synonym", "synonyms"))])
    joined = rows.join(m, "taxon_key", "left").join(n, "taxon_key", "left").join(coverage.select("taxon_key", F.col("n").alias("records")), "taxon_key", "left")
    family, genus = (F.try_element_at("lineage", F.lit(r)) for r in ("family", "genus"))
    whole = family.isNotNull() & genus.isNotNull() & F.col("records").isNotNull()
    key = F.when(whole, F.col("taxon_key")).otherwise(F.raise_error(F.concat(F.lit("an incomplete species: "), "taxon_key")).cast("string"))
    return joined.select(
        key.alias("taxon_key"), "name", family.alias("family"), genus.alias("genus"), F.coalesce("english_names", none).alias("english_names"), F.coalesce("synonyms", none).alias("synonyms"),
        F.coalesce("providers", none).alias("providers"), F.coalesce("open_conflicts", F.lit(0).cast("long")).alias("open_conflicts"), "records",
    ).orderBy(F.lower("name"), "taxon_key")


def pack_order(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """Names in the order of their taxa (ordinal), accepted ones first, then by type, name and assertion."""
    return names.join(taxa.select("taxon_key", "ordinal"), "taxon_key").orderBy("ordinal", F.col("name_type") != "accepted_scientific", "name_type", "name", "assertion")

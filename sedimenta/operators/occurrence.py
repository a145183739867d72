"""The occurrence build: raw text fields to a typed table, fail closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.text import category, fingerprint, leading_year, optional_float, optional_text, temporal_band

from .decisions import spatial_eligibility

#: What a source calls a basis of record, and the categories they become.
BASIS = {
    "human_observation": "human_observation", "observation": "unspecified_observation", "machine_observation": "machine_observation", "material_sample": "material_sample",
    "preserved_specimen": "preserved_specimen", "fossil_specimen": "fossil_specimen", "occurrence": "unspecified_occurrence",
}
GENERALISED = ("generalised", "alreadyGeneralised")
ELIGIBLE = ("eligible_all_configured_resolutions", "eligible_generalised_coarse_only")
#: Raw fields, and the columns that they become as trimmed text.
TEXTS = {
    "occurrenceID": "source_occurrence_id", "taxonConceptID": "provider_taxon_concept_id", "names_and_lsid": "provider_names_and_lsid", "scientificName": "provider_scientific_name",
    "taxonRank": "provider_taxon_rank", "species": "provider_species_name", "speciesID": "provider_species_id", "subspecies": "provider_subspecies_name", "subspeciesID": "provider_subspecies_id",
    "dataProviderName": "data_provider_name", "dataProviderUid": "data_provider_uid", "dataResourceName": "data_resource_name", "dataResourceUid": "data_resource_uid", "eventDate": "event_date",
    "basisOfRecord": "basis_of_record", "raw_basisOfRecord": "raw_basis_of_record", "license": "licence", "rights": "rights", "country": "country", "stateProvince": "state_territory",
    "bioregion": "bioregion", "localGovernment": "local_government", "references": "source_reference",
}
OTHERS = ("id", "decimalLatitude", "decimalLongitude", "coordinateUncertaintyInMeters", "spatiallyValid", "sensitive", "assertions")
#: The typed table's columns and the ones that must not be null.
TYPED = {
    "source_snapshot_id": "string", "source_snapshot_fingerprint": "string", "source_archive_sha256": "string", "source_row_number": "long", "record_id": "string",
    "source_occurrence_id": "string", "taxon_key": "string", "taxon_match_state": "string", "provider_taxon_concept_id": "string", "provider_names_and_lsid": "string",
    "provider_scientific_name": "string", "provider_taxon_rank": "string", "provider_species_name": "string", "provider_species_id": "string", "provider_subspecies_name": "string",
    "provider_subspecies_id": "string", "data_provider_name": "string", "data_provider_uid": "string", "data_resource_name": "string", "data_resource_uid": "string",
    "decimal_latitude": "double", "decimal_longitude": "double", "coordinate_uncertainty_meters": "double", "has_coordinates": "boolean", "coordinate_in_range": "boolean",
    "spatially_valid": "boolean", "sensitive_status": "string", "coordinates_publicly_generalised": "boolean", "spatial_aggregation_eligibility": "string", "event_date": "string",
    "event_year": "int", "temporal_evidence_band": "string", "basis_of_record": "string", "raw_basis_of_record": "string", "evidence_category": "string", "licence": "string", "rights": "string",
    "quality_assertions": "array<string>", "quality_assertion_count": "int", "country": "string", "state_territory": "string", "bioregion": "string", "local_government": "string",
    "source_reference": "string", "occurrence_fingerprint": "string",
}
REQUIRED = (
    "source_snapshot_id", "source_snapshot_fingerprint", "source_archive_sha256", "source_row_number", "record_id", "taxon_match_state", "data_resource_uid", "has_coordinates",
    "coordinate_in_range", "sensitive_status", "coordinates_publicly_generalised", "spatial_aggregation_eligibility", "temporal_evidence_band", "evidence_category", "licence",
    "quality_assertions", "quality_assertion_count", "occurrence_fingerprint",
)


def _assertions(x: Column) -> Column:
    return F.coalesce(F.filter(F.transform(F.split(x, r"\|"), optional_text), lambda p: p.isNotNull()), F.array().cast("array<string>"))


def faults(raw: DataFrame, licences: tuple[str, ...]) -> DataFrame:
    """raw with `faults`: what keeps a row out of the typed table, in the order of the rules; empty if nothing does."""
    t = lambda c: optional_text(F.col(c))
    valid, parts = F.lower(t("spatiallyValid")), _assertions(F.col("assertions"))
    rules = {
        "no_record_id": t("id").isNull(), "no_data_resource": t("dataResourceUid").isNull(), "licence_not_allowed": ~F.coalesce(t("license").isin(*licences), F.lit(False)),
        "spatial_validity_unknown": valid.isNotNull() & ~valid.isin("true", "false"), "sensitive_state_unknown": ~F.coalesce(t("sensitive"), F.lit("not_supplied")).isin("not_supplied", *GENERALISED),
        "assertions_repeat": F.size(parts) > F.size(F.array_distinct(parts)),
    }
    return raw.withColumn("faults", F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()])))


def normalise(raw: DataFrame, crosswalk: DataFrame, receipt: dict[str, str], licences: tuple[str, ...]) -> DataFrame:
    """Raw rows (text fields and source_row_number) to the TYPED table.

    crosswalk: taxon_concept_id, taxon_key, one row a concept; a concept without one stays unmatched. receipt: the
    snapshot's id, fingerprint, archive_sha256 and retrieved_at. Any row with faults fails the job: list them by
    faults() first. The fingerprint covers all other columns.
    """
    checked = faults(raw, licences)
    t = lambda c: optional_text(F.col(c))
    record = F.when(F.size("faults") == 0, t("id")).otherwise(
        F.raise_error(F.concat(F.lit("source row "), F.col("source_row_number").cast("string"), F.lit(": "), F.array_join("faults", ", "))).cast("string")
    )
    lat, lon, valid = optional_float(F.col("decimalLatitude")), optional_float(F.col("decimalLongitude")), F.lower(t("spatiallyValid"))
    keys = crosswalk.select(F.col("taxon_concept_id").alias("__concept"), F.col("taxon_key"))
    rows = checked.join(keys, t("taxonConceptID") == F.col("__concept"), "left")
    rows = rows.select(
        *[F.lit(receipt[k]).alias(f"source_{n}") for k, n in (("snapshot_id", "snapshot_id"), ("snapshot_fingerprint", "snapshot_fingerprint"), ("archive_sha256", "archive_sha256"))],
        F.col("source_row_number").cast("long"), record.alias("record_id"), "taxon_key", *[t(a).alias(b) for a, b in TEXTS.items()], lat.alias("decimal_latitude"), lon.alias("decimal_longitude"),
        optional_float(F.col("coordinateUncertaintyInMeters")).alias("coordinate_uncertainty_meters"), (t("decimalLatitude").isNotNull() & t("decimalLongitude").isNotNull()).alias("has_coordinates"),
        F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False)).alias("coordinate_in_range"), (valid == "true").alias("spatially_valid"),
        F.coalesce(t("sensitive"), F.lit("not_supplied")).alias("sensitive_status"), _assertions(F.col("assertions")).alias("quality_assertions"),
    )
    rows = rows.withColumns({
        "taxon_match_state": F.when(F.col("taxon_key").isNotNull(), "exact_taxon_concept_crosswalk").otherwise("unmatched_provider_taxon_assertion"),
        "coordinates_publicly_generalised": F.col("sensitive_status").isin(*GENERALISED), "event_year": leading_year(F.col("event_date")),
        "evidence_category": category(F.col("basis_of_record"), BASIS, "other_or_not_supplied"), "quality_assertion_count": F.size("quality_assertions"),
    })
    rows = rows.withColumns({
        "spatial_aggregation_eligibility": spatial_eligibility(F.col("has_coordinates"), F.col("coordinate_in_range"), F.col("spatially_valid"), F.col("coordinates_publicly_generalised")),
        "temporal_evidence_band": temporal_band(F.col("event_year"), int(receipt["retrieved_at"][:4])),
    })
    own = {c: F.col(c).cast(k) for c, k in TYPED.items() if c != "occurrence_fingerprint"}
    rows = rows.select(*[c.alias(n) for n, c in own.items()])
    return rows.withColumn("occurrence_fingerprint", fingerprint(**{n: F.col(n) for n in own})).select(*TYPED)


def unsafe_rows(table: DataFrame) -> DataFrame:
    """Rows of a table for TYPED that would not cast to it or lack a required value, with the columns at fault."""
    bad = [F.when(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull(), F.lit(c)) if not k.startswith("array") else F.lit(None).cast("string") for c, k in TYPED.items()]
    missing = [F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]
    return table.withColumn("columns", F.array_sort(F.array_distinct(F.array_compact(F.array(*bad, *missing))))).where(F.size("columns") > 0)


def eligible(table: DataFrame) -> DataFrame:
    """Rows that may be counted in space (P4); a contradiction between eligibility, coordinates and generalisation is an error."""
    rows = table.where(F.col("spatial_aggregation_eligibility").isin(*ELIGIBLE))
    coarse = F.col("spatial_aggregation_eligibility") == ELIGIBLE[1]
    fault = F.when(F.col("decimal_latitude").isNull() | F.col("decimal_longitude").isNull(), "an eligible row has no coordinates").when(
        coarse != F.col("coordinates_publicly_generalised"), "eligibility contradicts generalisation"
    )
    return rows.withColumn("record_id", F.when(fault.isNull(), F.col("record_id")).otherwise(F.raise_error(fault).cast("string")))


def without_blocked(table: DataFrame, blocked: DataFrame, membership: str = "data_resource_uid") -> DataFrame:
    """Rows of resources whose rights aren't in review (P5); rows that name no resource go too."""
    return table.where(F.col(membership).isNotNull()).join(blocked.select(membership).distinct(), membership, "left_anti")


def blocked_datasets(datasets: DataFrame, expected: DataFrame, state: str = "blocked_pending_citation_rights_resolution") -> DataFrame:
    """The expected resources' rows, sorted (P6): each must be there and still blocked, else an error."""
    rows = expected.select("data_resource_uid").distinct().join(datasets, "data_resource_uid", "left")
    fault = F.when(F.col("rights_review_state").isNull(), "a screened resource is missing").when(F.col("rights_review_state") != state, "a screened resource is no longer blocked")
    uid = F.when(fault.isNull(), F.col("data_resource_uid")).otherwise(F.raise_error(F.concat(fault, F.lit(": "), "data_resource_uid")).cast("string"))
    return rows.withColumn("data_resource_uid", uid).orderBy("data_resource_uid")


def public_sample(table: DataFrame, record_url: str) -> DataFrame:
    """The columns of a public sample (P7); a source that is no web address becomes the record's page."""
    web = F.coalesce(F.rlike("source_reference", F.lit("^https?://")), F.lit(False))
    return table.select(
        "record_id", "occurrence_fingerprint", "taxon_key", "provider_scientific_name", "data_resource_uid", "data_resource_name", "basis_of_record", "event_year",
        F.col("coordinates_publicly_generalised").alias("publicly_generalised"), F.when(web, F.col("source_reference")).otherwise(F.concat(F.lit(record_url), "record_id")).alias("source_reference"),
    )

"""Coverage diagnostics of a reference set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Valid media that a species should have.
TARGET = 20


def media_with_taxon(media: DataFrame, observations: DataFrame, crosswalk: DataFrame, prefix: str) -> DataFrame:
    """Media with their observation and the taxon of `prefix:accepted_key`, null where the crosswalk has none; an observation that isn't there is an error."""
    rows = media.join(observations, "observation", "left")
    found = F.when(F.col("accepted_key").isNotNull(), F.col("media")).otherwise(F.raise_error(F.concat(F.lit("no observation of media "), "media")).cast("string"))
    keys = crosswalk.select(F.concat(F.lit(f"{prefix}:"), F.col("provider_key").cast("string")).alias("accepted_key"), "taxon_key")
    return rows.join(keys, "accepted_key", "left").select(found.alias("media"), "observation", "accepted_key", "taxon_key")


def selected_objects(selections: DataFrame, observations: DataFrame, objects: DataFrame) -> DataFrame:
    """Selections with their observation and object; the inner joins must cover all selections, else an error."""
    o = objects.select("media", "decode_status", "sha256", "bytes")
    rows = selections.join(observations.select("observation", "observer"), "observation", "left").join(o, "media", "left")
    whole = F.col("observer").isNotNull() & F.col("decode_status").isNotNull()
    return rows.withColumn("media", F.when(whole, F.col("media")).otherwise(F.raise_error(F.concat(F.lit("a selection without its rows: "), "media")).cast("string")))


def coverage(species: DataFrame, decisions: DataFrame, selected: DataFrame) -> DataFrame:
    """Counts, status and flags of each species. decisions: taxon_key, media, accepted_key, gate. selected: selected_objects() rows.

    Duplicate excess is what valid media have beyond distinct content. A provider key is given if it is the only one.
    """
    keyed = decisions.where(F.col("taxon_key").isNotNull())
    keys = F.collect_set("accepted_key")
    d = keyed.groupBy("taxon_key").agg(F.count("*").alias("candidates"), F.count_if(F.col("gate") == "eligible").alias("eligible"), F.when(F.size(keys) == 1, keys[0]).alias("provider_key"))
    valid = F.col("decode_status") == "valid"
    s = selected.join(keyed.select("media", "taxon_key"), "media").groupBy("taxon_key").agg(
        F.count("*").alias("selected"), F.count_if(valid).alias("valid"), F.countDistinct(F.when(valid, F.col("sha256"))).alias("contents"), F.countDistinct(F.when(valid, F.col("observer"))).alias("observers")
    )
    counts = ["candidates", "eligible", "selected", "valid", "contents", "observers"]
    rows = species.join(d, "taxon_key", "left").join(s, "taxon_key", "left").na.fill(0, counts)
    rows = rows.withColumns({"failed": F.col("selected") - F.col("valid"), "duplicate_excess": F.col("valid") - F.col("contents")})
    zero = lambda c: F.col(c) == 0
    status = (
        F.when(zero("candidates"), "no_candidate_media").when(zero("eligible"), "no_automated_gate_eligible_media").when(zero("selected"), "eligible_not_selected")
        .when(zero("valid"), "selected_no_valid_decode").otherwise("provisional_decode_only")
    )
    flags = {
        "no_candidate_media": zero("candidates"), "no_automated_gate_eligible_media": zero("eligible"), "no_selected_media": zero("selected"), "download_or_decode_failure": F.col("failed") > 0,
        "provisional_support_below_target": F.col("valid") < TARGET, "observer_diversity_low": ~zero("valid") & (F.col("observers") <= 1),
        "exact_content_duplicate_pending_resolution": F.col("duplicate_excess") > 0, "human_review_absent": F.lit(True),
    }
    return rows.select("taxon_key", "provider_key", *counts, "failed", "duplicate_excess", status.alias("coverage_status"), F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in flags.items()])).alias("flags"))


def unique_content(objects: DataFrame) -> DataFrame:
    """Objects, contents (distinct hashes) and bytes of distinct contents, of those that decode."""
    valid = objects.where(F.col("decode_status") == "valid")
    one = valid.groupBy("sha256").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes"))
    return one.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("objects"), F.count("*").alias("contents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("unique_bytes"))

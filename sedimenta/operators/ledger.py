"""Append-only ledgers (W9, J20, J27, K7, K9, A28, U7, X4-X6): effective rows, idempotent appends, expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def effective(events: DataFrame, id_col: str, supersedes_col: str) -> DataFrame:
    """Rows that no row supersedes."""
    gone = events.where(F.col(supersedes_col).isNotNull()).select(F.col(supersedes_col).alias("__gone")).distinct()
    return events.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")


def supersession_violations(events: DataFrame, id_col: str, supersedes_col: str, identity_cols: list[str]) -> DataFrame:
    """Rows whose supersession is broken: target_missing, identity_changed or superseded_twice."""
    old = events.select(F.col(id_col).alias("__old"), *[F.col(c).alias(f"__{c}") for c in identity_cols])
    rows = events.where(F.col(supersedes_col).isNotNull()).join(old, F.col(supersedes_col) == F.col("__old"), "left")
    changed = F.lit(False)
    for c in identity_cols:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    one = rows.select(id_col, F.when(F.col("__old").isNull(), "target_missing").when(changed, "identity_changed").alias("violation")).where("violation IS NOT NULL")
    twice = events.where(F.col(supersedes_col).isNotNull()).groupBy(supersedes_col).agg(F.count("*").alias("n"), F.max(id_col).alias(id_col)).where("n > 1")
    return one.unionByName(twice.select(id_col, F.lit("superseded_twice").alias("violation")))


def append_idempotent(target: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """The batch's rows that the target doesn't hold yet, one a key."""
    return batch.dropDuplicates([key]).join(target.select(key), key, "left_anti")


def append_conflicts(target: DataFrame, batch: DataFrame, key: str, value_cols: list[str]) -> DataFrame:
    """Keys that the batch repeats with other values than the target has (K7)."""
    held = target.select(F.col(key).alias("__k"), F.struct(*value_cols).alias("__v"))
    return batch.join(held, F.col(key) == F.col("__k")).where(~F.struct(*value_cols).eqNullSafe(F.col("__v"))).select(key)


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key the new ones don't have, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def sequence_gaps(events: DataFrame, group: str, seq: str) -> DataFrame:
    """Rows whose sequence number isn't one more than the last of their group, from 1 on."""
    last = F.lag(seq, 1, 0).over(Window.partitionBy(group).orderBy(seq))
    return events.withColumn("expected", last + 1).where(F.col(seq) != F.col("expected"))


def latest_revision(rows: DataFrame, key: str, revision: str) -> DataFrame:
    """One row a key, of the highest revision."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), revision).alias("__r")).select(key, "__r.*")


def expectation(name: str, violations: DataFrame, *keys: str) -> DataFrame:
    """Violations as rows (expectation, key): a writer refuses a batch for which any row comes back."""
    return violations.select(F.lit(name).alias("expectation"), F.to_json(F.struct(*keys)).alias("key"))


def missing_keys(rows: DataFrame, key: str, known: DataFrame, known_key: str) -> DataFrame:
    """Foreign keys without a target; null keys aren't checked."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias("__k")), F.col(key) == F.col("__k"), "left_anti")


def repeated_keys(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

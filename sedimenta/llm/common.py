"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.session import materialize, release, shared_dir

__all__ = ["WORD", "hot_keys", "materialize", "release", "salted_join", "shared_dir", "table", "utf8"]

WORD = r"[^\x20\x09-\x0D]+"
#: A key with more than one of so many rows is hot; there are fewer such keys than this.
SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(text: Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def hot_keys(counts: DataFrame, keys: list[str], n: str, total: int) -> list[tuple[int, list[int]]]:
    """Of rows (keys, n) those with more than 1 / SHARE of `total` rows: (salts, hashes of the keys that so many split), by salts.

    Salts are powers of two below 2 * n * SHARE / total. There are fewer than SHARE such keys, of which the driver gets a
    hash each; n adds up to `total` at most.
    """
    few = counts.where(F.col(n) * SHARE > total)
    power = F.ceil(F.log2(F.col(n) * SHARE / F.lit(float(max(total, 1))))).cast("int")
    found: dict[int, list[int]] = {}
    for row in few.select(F.xxhash64(*keys).alias("key"), power.alias("power")).collect():
        found.setdefault(1 << row["power"], []).append(row["key"])
    return sorted((salts, sorted(hashes)) for salts, hashes in found.items())


def salted_join(rows: DataFrame, values: DataFrame, keys: list[str], hot: list[tuple[int, list[int]]], by: str) -> DataFrame:
    """Inner join of rows with values (one row a key) in which the rows of a hot key are dealt over its salts by a hash of `by`.

    hot: of hot_keys(). Either side tells a key's salts from its hash (keys have one type on both sides), so a key that
    shares a hot one's hash is dealt as well and still meets. A hot key's value is copied once a salt: 2 * SHARE copies
    at most, for keys of different hashes.
    """
    key = F.xxhash64(*keys)
    salts = F.coalesce(*[F.when(key.isin(hashes), F.lit(n)) for n, hashes in hot], F.lit(1)).cast("long")
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(by), salts))
    spread = values.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return dealt.join(spread, [*keys, "__salt"]).drop("__salt")

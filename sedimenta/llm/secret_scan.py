"""Secret scans with corpus-wide ownership frequency, with DataFrame functions only.

Candidates are the base matches (assignments, access key ids, long hex runs) and what wider generators propose (other
names and key formats). Every candidate's secret is hashed, and the corpus tells how many distinct repositories and
owners hold it: one that more than OWNERS owners or REPOSITORIES repositories hold is a widely copied example, the
others are owner-specific and look live. Where rows don't name a repository, owners alone decide, so one owner's secret
looks live however many documents hold it. Base spans always stay; of the proposed ones those that look live.

The counts come from an aggregate that first makes (hash, repository) and (hash, owner) distinct, so a secret that a
third of all documents copy costs one row a task; they go back to the candidates in a join whose hot hashes adaptive
execution can split.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import add_matches, cut_out, joined, without_overlaps

KINDS = ("assign", "access", "hex")
ASSIGN, ACCESS, HEX = range(3)
#: The base patterns; group 1 of the first is the secret.
NAME = r"(?i:password|passwd|secret|token|api_?key)"
BASE = {
    "assign": NAME + r"""["']?\x20*+[:=]\x20*+["']?([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
}
#: Generators of further candidates; group 1 is the secret.
MORE = {
    "assign": r"""(?i:authorization|bearer|credentials?|private_?key|access_?key|client_?id|pwd|auth)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?"""
    r"((?=[A-Za-z0-9+/_.=-]*[0-9])(?=[A-Za-z0-9+/_.=-]*[A-Za-z])[A-Za-z0-9+/_.=-]{16,}+)",
    "access": r"((?:A(?:SIA|GPA|IDA|ROA|IPA|NPA|NVA)[A-Z0-9]{16,}+)|(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_|AIza)[A-Za-z0-9_-]{16,}+)",
    "hex": r"(?<![0-9A-Za-z])((?=[0-9]*[A-F])[0-9A-F]{32,}+)(?![0-9A-Za-z])",
}
#: A secret that more distinct owners or repositories hold is an example.
OWNERS, REPOSITORIES = 2, 16
SECRET = "struct<start:int,kind:int,end:int,secret:string,is_base:boolean>"


def row_key(id_col: str, text_col: str) -> Column:
    """Names a row by its id and its text: rows that agree in both have the same spans."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def with_secret(matches: Column, kind: int, pattern: str, is_base: bool) -> Column:
    """Structs (start, kind, end, secret, is_base); the secret is group 1 if the pattern has one."""
    group = int(pattern not in (BASE["access"], BASE["hex"]))
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"), F.regexp_extract(m["text"], pattern, group).alias("secret"), F.lit(is_base).alias("is_base")),
    )


def guards(text: Column) -> dict[str, Column | None]:
    """By pattern what a text with a match holds for sure and is found faster; None where nothing is."""
    signs = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))
    names = F.rlike(text, F.lit(r"(?i)auth|bearer|credential|_?key|client|pwd"))
    return {"base_assign": signs, "base_access": F.contains(text, F.lit("AKIA")), "base_hex": None, "more_assign": names, "more_access": None, "more_hex": None}


def suspicious(text: Column) -> Column:
    """Does any pattern match? A text without a match has no candidate; some with one have none either (too short a secret)."""
    matches = []
    for column, guard in guards(text).items():
        where, name = column.split("_")
        found = F.rlike(text, F.lit((BASE if where == "base" else MORE)[name]))
        matches.append(found if guard is None else guard & found)
    return reduce(or_, matches)


def candidates(docs: DataFrame, id_col: str, text_col: str, repo_col: str | None, owner_col: str) -> DataFrame:
    """id, key, repo, owner and found: structs (start, kind, end, hash, is_base) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    repo = F.lit(None) if repo_col is None else F.col(repo_col)
    df = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), repo.cast("string").alias("repo"), F.col(owner_col).cast("string").alias("owner"), text.alias("text"))
    parts = []
    wheres = guards(F.col("text"))
    for where, patterns in (("base", BASE), ("more", MORE)):
        for kind, name in enumerate(KINDS):
            column = f"{where}_{name}"
            df = add_matches(df, column, "text", patterns[name], wheres[column])
            spans = with_secret(F.col(column), kind, patterns[name], where == "base")
            parts.append(F.filter(spans, lambda s: F.length(s["secret"]) >= 6) if column == "base_assign" else spans)
    df = df.withColumn("all", F.concat(*parts))
    base = F.filter("all", lambda s: s["is_base"])
    df = df.withColumn("base", base).withColumn("more", F.filter("all", lambda s: ~s["is_base"]))
    fresh = F.when(F.size("more") > 0, without_overlaps(F.col("more"), F.col("base"), SECRET)).otherwise(F.col("more"))
    df = df.withColumn("found", F.concat("base", fresh))
    hashed = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.sha2(s["secret"], 256).alias("hash"), s["is_base"].alias("is_base")))
    return df.select("id", "key", "repo", "owner", hashed.alias("found"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, repositories, owners: distinct counts over the corpus. Null names don't count."""
    rows = found.select("repo", "owner", F.explode("found").alias("s")).select("s.hash", "repo", "owner")
    return rows.groupBy("hash").agg(F.countDistinct("repo").alias("repositories"), F.countDistinct("owner").alias("owners"))


def judged(found: DataFrame) -> DataFrame:
    """key, live, examples: by row with candidates, its structs (start, kind, end, is_base) on either side."""
    counts = ownership(found)
    rows = found.where(F.size("found") > 0).select("key", F.explode("found").alias("s")).select("key", "s.start", "s.kind", "s.end", "s.hash", "s.is_base")
    rows = rows.join(counts, "hash").withColumn("live", (F.col("owners") <= OWNERS) & (F.col("repositories") <= REPOSITORIES))
    span = F.struct("start", "kind", "end", "is_base")
    # rows that repeat share a key, and so their spans
    return rows.groupBy("key").agg(F.collect_set(F.when(F.col("live"), span)).alias("live"), F.collect_set(F.when(~F.col("live"), span)).alias("examples"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source") -> DataFrame:
    """Every row's id_col with base, live and examples: base all base spans (start, kind, end), live and examples the
    candidates on either side (start, kind, end, is_base).

    Where rows don't name a repository (repo_col is None), owners alone decide. Null texts count as empty and
    have no spans; null owners and repositories don't count, so a secret that only they hold looks live. Rows that
    repeat count once. Very long texts are searched whole, in time that grows with the text and its matches. Other
    columns have no influence. An empty table gives an empty result.
    """
    found = materialize(candidates(docs, id_col, text_col, repo_col, owner_col), "secrets")
    verdicts = judged(found)
    none = F.array().cast("array<struct<start:int,kind:int,end:int,is_base:boolean>>")
    plain = F.transform(F.filter("found", lambda s: s["is_base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    rows = found.select(F.col("id").alias(id_col), "key", plain.alias("base")).join(verdicts, "key", "left")
    return rows.select(id_col, "base", F.coalesce("live", none).alias("live"), F.coalesce("examples", none).alias("examples"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str | None = None, owner_col: str = "source", mark: str = "<secret>") -> DataFrame:
    """docs with the live-looking secrets' spans in text_col replaced by `mark`; other rows and columns stay as they are.

    Nulls, repeated rows and very long texts as in scan(); overlapping spans become one mark. An empty table gives an
    empty result.
    """
    # the filter comes after the table: pushed below it, it would search every text again
    found = materialize(candidates(docs, id_col, text_col, repo_col, owner_col), "secrets").where(F.size("found") > 0)
    live = judged(found).where(F.size("live") > 0).select(F.col("key").alias("__secret_key"), F.col("live").alias("__secret_live"))
    # texts without a match take no part in the join, so most of the corpus isn't shuffled
    suspect = suspicious(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.where(suspect).withColumn("__secret_key", row_key(id_col, text_col)).join(live, "__secret_key", "left")
    clean = cut_out(F.col(text_col), F.col("__secret_live"), mark)
    rows = rows.withColumn(text_col, F.when(F.col("__secret_live").isNotNull(), clean).otherwise(F.col(text_col))).select(*docs.columns)
    return docs.where(~suspect).select(*docs.columns).union(rows)


def op6_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    fresh = F.transform(F.filter("live", lambda s: ~s["is_base"]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return found.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", fresh), KINDS).alias("spans"),
        F.size("live").cast("long").alias("n_live"), F.size("examples").cast("long").alias("n_example"),
    )

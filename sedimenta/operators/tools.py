"""Read-only evidence queries (X7): small results by exact identity, as functions over the engine's tables.

Every function returns a DataFrame of a closed set of columns. Nothing is matched approximately, and what is unknown
comes back as unavailable with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decisions import available, presence
from .graph import descendants


def scope(rollup: DataFrame, scope_type: str, scope_id: str | None = None) -> DataFrame:
    """A scope's counts; the nation needs no id (P20)."""
    found = rollup.where(F.col("scope_type") == scope_type)
    return found if scope_type == "nation" and scope_id is None else found.where(F.col("scope_id") == F.lit(scope_id))


def compare_sources(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """key, a_value, b_value, state: agree, differ, only_a or only_b, for each key of either source."""
    x, y = a.select(key, F.col(value).alias("a_value"), F.lit(True).alias("in_a")), b.select(key, F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    state = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").when(F.col("a_value").eqNullSafe(F.col("b_value")), "agree").otherwise("differ")
    return x.join(y, key, "full").select(key, "a_value", "b_value", state.alias("state"))


def species(catalogue: DataFrame, counts: DataFrame, key: str, taxon: str) -> DataFrame:
    """One catalogue row with its count; a species without one is unavailable, not 0."""
    joined = catalogue.where(F.col(key) == F.lit(taxon)).join(counts.select(key, "n"), key, "left")
    return joined.withColumn("records", available(F.col("n"), "no count for this species")).drop("n")


def trace(nodes: DataFrame, node: str) -> DataFrame:
    """A node's lineage, root first: node, depth, state, place, ancestor (G1). Only its own ancestors are walked.

    state: rooted, missing_parent (the topmost ancestor's parent isn't a node) or cycle (no ancestor without a parent).
    An unknown node gives no rows.
    """
    root = nodes.where(F.col("node") == F.lit(node)).select("node")
    up = descendants(nodes.where(F.col("parent").isNotNull()).select(F.col("node").alias("parent"), F.col("parent").alias("child")), root)
    rows = up.join(nodes.select("node", "parent"), "node", "left").join(nodes.select(F.col("node").alias("known"), F.lit(True).alias("is_known")), F.col("node") == F.col("known"), "left")
    ends = rows.agg(F.max(F.when(F.col("is_known"), F.col("depth"))).alias("top"), F.bool_or(F.col("is_known").isNull()).alias("lost"), F.bool_or(F.col("is_known") & F.col("parent").isNull()).alias("rooted"))
    state = F.when(F.coalesce("lost", F.lit(False)), "missing_parent").when(F.col("rooted"), "rooted").otherwise("cycle")
    return rows.where("is_known").join(ends).select(F.lit(node).alias("node"), F.col("top").alias("depth"), state.alias("state"), (F.col("top") - F.col("depth")).alias("place"), F.col("node").alias("ancestor")).orderBy("place")


def dependents(edges: DataFrame, node: str) -> DataFrame:
    """What descends from a node, with its nearest depth."""
    return descendants(edges, edges.sparkSession.range(1).select(F.lit(node).alias("node"))).where("depth > 0")


def consensus(snapshots: DataFrame, subject: str, subject_id: str) -> DataFrame:
    """The latest revision of each layer."""
    rows = snapshots.where(F.col(subject) == F.lit(subject_id))
    return rows.groupBy(subject, "layer").agg(F.max_by(F.struct("revision", "status"), "revision").alias("s")).select(subject, "layer", "s.revision", "s.status")


def worker_status(beats: DataFrame, as_of_s: int, horizon_s: int = 300) -> DataFrame:
    """The last beat of each worker and whether it is online."""
    last = beats.groupBy("worker").agg(F.max("observed_s").alias("observed_s"))
    return last.withColumn("presence", presence(F.lit(as_of_s) - F.col("observed_s"), horizon_s))


def review_batch(queue: DataFrame, k: int) -> DataFrame:
    """The next rows to review: conflicts first, then the least covered, by name and key."""
    return queue.orderBy(F.desc("conflicts"), "selected", "valid", "name", "key").limit(k)


def contribution(events: DataFrame, reviewer: str) -> DataFrame:
    """What a reviewer's effective events touch: distinct subjects, species and cells; array-valued cells count each."""
    own = events.where(F.col("reviewer") == F.lit(reviewer))
    cells = own.select(F.explode("cells").alias("cell")).agg(F.countDistinct("cell").alias("cells"))
    return own.agg(F.count("*").alias("events"), F.countDistinct("subject").alias("subjects"), F.countDistinct("species").alias("species")).join(cells)


def candidate(candidates: DataFrame, candidate_id: str) -> DataFrame:
    """One release candidate with its gates; what blocks it is listed, a gate that isn't known blocks."""
    gates = [c for c, kind in candidates.dtypes if kind == "boolean"]
    closed = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(g), F.lit(False)), F.lit(g)) for g in gates]))
    return candidates.where(F.col("candidate") == F.lit(candidate_id)).withColumn("blockers", closed)


def classification(results: DataFrame, media: str) -> DataFrame:
    """The latest classification of a medium for each model; a label without a score is unavailable."""
    last = results.where(F.col("media") == F.lit(media)).groupBy("media", "model").agg(F.max_by(F.struct("label", "score"), F.struct("recorded_s", "label")).alias("c"))
    return last.select("media", "model", F.col("c.label").alias("label"), available(F.col("c.score"), "the model gave no score").alias("score"))


def reviewer_quality(estimates: DataFrame, reviewer: str) -> DataFrame:
    """A reviewer's own estimate, or why there is none."""
    rows = estimates.where(F.col("reviewer") == F.lit(reviewer))
    return rows.select("reviewer", available(F.col("estimate"), "too little evidence").alias("estimate"), "blockers")


def pipeline_status(stages: DataFrame) -> DataFrame:
    """Stages (stage, state) with counts by state; a stage without rows isn't there."""
    return stages.groupBy("stage").agg(F.count("*").alias("items"), *[F.count_if(F.col("state") == s).alias(s) for s in ("committed", "running", "failed", "waiting")]).orderBy("stage")


def next_species(rows: DataFrame, k: int = 1) -> DataFrame:
    """The species to work on next: fewest records, most open conflicts, then the name."""
    return rows.orderBy("records", F.desc("open_conflicts"), "name", "taxon_key").limit(k)


def impact_report(events: DataFrame) -> DataFrame:
    """Reviewers with distinct subjects, species and cells of their effective events."""
    cells = events.select("reviewer", F.explode("cells").alias("cell")).groupBy("reviewer").agg(F.countDistinct("cell").alias("cells"))
    per = events.groupBy("reviewer").agg(F.count("*").alias("events"), F.countDistinct("subject").alias("subjects"), F.countDistinct("species").alias("species"))
    return per.join(cells, "reviewer", "left").na.fill(0, ["cells"]).orderBy("reviewer")


#: Bytes that a tool's result may have.
LIMIT = 65_536


def envelope(rows: DataFrame, tool: str, limit: int = LIMIT) -> DataFrame:
    """A tool's result as one row (X7): tool, row_count, result (a JSON array, rows sorted), bytes and fingerprint. Larger than `limit` is an error.

    Sizes are added up before any list is made, so a result that is too large isn't collected into one.
    """
    lines = rows.select(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line"))
    size = lines.agg(F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("n")).first()[0]
    if size + 1 > limit:
        raise ValueError(f"{tool}: a result of {size} bytes; the limit is {limit}")
    text = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("line")), ","), F.lit("]"))
    one = lines.agg(F.count("*").alias("row_count"), text.alias("result"))
    return one.select(F.lit(tool).alias("tool"), "row_count", "result", F.octet_length("result").alias("bytes"), F.sha2("result", 256).alias("fingerprint"))

"""Mixing sources to target weights by weighted fair queueing, with DataFrame operations only.

Every source is a queue of its documents, in the order of a hash; a source that the mix wants more of than it has is
served a second time from its start. Documents go in packets of at most QUANTUM words, and a packet's virtual finish
time is its source's cumulative words up to its end divided by the source's weight. All packets are range-sorted by it
together, and the order is truncated at the total budget. A source that runs out after REPEATS turns has no
more packets, so what it leaves goes to the others by weight: sources take what water filling gives them, to within
a packet.

The cumulative words are two-level prefix sums: hash ranges are summed per (source, range), the sums run over the
ranges, and a window adds the offset inside (source, range). So a source with a third of all rows is spread over
RANGES groups and no task holds a whole source. The truncation sums the parts of the range-sorted order, and
only the part in which the budget ends is looked into. As a source's packets are taken from its first on, a
source's total tells what each of its documents gives, and no packet is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialize, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
REPEATS = 2
#: Words of a packet.
QUANTUM = 256
#: Hex digits of the hash that make a range of a source.
DIGITS = 4


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET) -> DataFrame:
    """Targets by water filling, from one row a source: source, source_size.

    Sources by code point, null last, get the weights in turn. Sorted by 2 * size / weight, the capped sources
    are a prefix; what remains of the budget is dealt to the others by weight. Returns source, source_size, weight,
    target (double) and budget (words in all). The windows run over one row a source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    fill = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    rows = (
        sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("double"))
        .withColumn("ratio", REPEATS * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("all_weight", F.sum("weight").over(everything))
    )
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("capped", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * REPEATS)
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.col("left_weight"))
        # the first source that stays below its cap sets the level of all after it
        .withColumn("share", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    )
    cap = (REPEATS * F.col("source_size")).cast("double")
    target = F.least(cap, F.coalesce(F.col("share") * F.col("weight"), cap))
    return rows.select("source", "source_size", "weight", target.alias("target"), F.floor("total").cast("long").alias("budget"))


def placed(rows: DataFrame, weights: tuple[int, ...], budget: float, totals: DataFrame | None = None) -> DataFrame:
    """rows (with __source, __digest, __tie, __size) with their source's columns of source_targets() and __at, the words before them.

    totals: what is served of each source, to join as __served. The rows are shuffled once, by source and range, for both
    the window and the join.
    """
    # a name for each source that is never null, so that the join's keys are those of the window
    name = F.coalesce(F.concat(F.lit("="), F.col("__source").cast("string")), F.lit(""))
    rows = rows.withColumns({"__name": name, "__range": F.substring("__digest", 1, DIGITS)})
    ranges = rows.groupBy("__name", "__range").agg(F.sum("__size").alias("range_size"), F.first("__source").alias("source"))
    running = F.sum("range_size").over(Window.partitionBy("__name").orderBy("__range"))
    ranges = ranges.withColumn("__offset", running - F.col("range_size"))
    sizes = ranges.groupBy("__name").agg(F.first("source").alias("source"), F.sum("range_size").alias("source_size"))
    targets = source_targets(sizes.drop("__name"), weights, budget)
    targets = targets.withColumn("__name", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    if totals is not None:
        targets = targets.join(totals, "__name", "left")
    own = ["source_size", "weight", "target", "budget"]
    targets = targets.select("__name", *[F.col(c).alias(f"__{c}") for c in own], *(["__served"] if totals is not None else []))
    ranges = ranges.select("__name", "__range", "__offset").join(targets, "__name")
    within = Window.partitionBy("__name", "__range").orderBy("__digest", "__tie", "__size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__before", F.sum("__size").over(within) - F.col("__size")).join(ranges, ["__name", "__range"])
    return rows.withColumn("__at", F.col("__offset") + F.col("__before"))


def served(rows: DataFrame) -> DataFrame:
    """Of placed() rows the words that the mix takes of each source: __name, __served."""
    turns = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1))).alias("turn")
    packets = rows.where("__size > 0").select("__name", "__source", "__at", "__size", "__source_size", "__weight", "__budget", turns)
    packets = packets.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__size") - 1) / QUANTUM))).alias("k"))
    end = F.least("__size", (F.col("k") + 1) * QUANTUM)
    packets = packets.select(
        "__name", "__source", "__budget", (end - F.col("k") * QUANTUM).alias("words"),
        ((F.col("__at") + end + F.col("turn") * F.col("__source_size")) / F.col("__weight")).alias("finish"),
    )
    order = ["finish", F.col("__source").asc_nulls_last()]  # one source's packets differ in their finish
    parts = int(packets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packets = packets.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    packets = materialize(packets, "packets")
    # a row for each part of the order
    sums = packets.groupBy("part").agg(F.sum("words").alias("part_words"))
    sums = sums.withColumn("before", F.sum("part_words").over(Window.orderBy("part")) - F.col("part_words"))
    rows = packets.join(F.broadcast(sums), "part")  # as many rows as the order has parts
    whole = rows.where(F.col("before") + F.col("part_words") <= F.col("__budget")).select("__name", "words")
    cut = rows.where((F.col("before") < F.col("__budget")) & (F.col("before") + F.col("part_words") > F.col("__budget")))
    running = F.sum("words").over(Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    cut = cut.withColumn("until", F.col("before") + running)
    cut = cut.select("__name", F.greatest(F.lit(0), F.least("words", F.col("__budget") - F.col("until") + F.col("words"))).alias("words"))
    return whole.union(cut).groupBy("__name").agg(F.sum("words").alias("__served"))


OUT = ("size", "source_size", "weight", "target", "start", "finish", "taken")


def free_prefix(columns: list[str]) -> str:
    """wfq_, with underscores before it until no column begins so."""
    prefix = "wfq_"
    while any(c.lower().startswith(prefix) for c in columns):
        prefix = "_" + prefix
    return prefix


def weighted_fair_mix(
    df: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, tie: Column | None = None,
    weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, seed: str = "mix",
) -> DataFrame:
    """df's rows and columns with seven more: size, source_size, weight, target, start, finish (virtual times of the first turn) and taken.

    Their names begin with free_prefix(df.columns), wfq_ as a rule. size: the words of column text, unless given. taken:
    what the mix takes of the row, 0 to REPEATS times its size. Rows stand in the order of a hash of their id and, of
    one id or without any, of `tie` (the MD5 of column text, unless given); rows that agree in both and in size are
    alike, so reruns agree. Null sources are one source; null ids, empty or null texts (size 0), repeated rows and very
    long texts are rows like others; an empty table gives an empty result.
    """
    words = n_words(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    other = F.coalesce(F.md5(F.col("text").cast("binary")) if tie is None else tie.cast("string"), F.lit("null"))
    own = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), other))
    added = {"__size": words, "__tie": other, "__digest": F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), "__source": F.col(source_col)}
    rows = df.withColumns(added)
    slim = materialize(rows.select(*added), "sizes")
    totals = served(placed(slim, weights, budget))
    rows = placed(rows, weights, budget, materialize(totals, "served"))
    of_turn = [F.greatest(F.lit(0), F.least(F.col("__size"), F.coalesce("__served", F.lit(0)) - F.col("__at") - turn * F.col("__source_size"))) for turn in range(REPEATS)]
    values = {
        "size": F.col("__size"), "source_size": F.col("__source_size"), "weight": F.col("__weight"), "target": F.col("__target"), "start": F.col("__at") / F.col("__weight"),
        "finish": (F.col("__at") + F.col("__size")) / F.col("__weight"), "taken": sum(of_turn[1:], of_turn[0]).cast("long"),
    }
    prefix = free_prefix(df.columns)
    return rows.select(*df.columns, *[values[c].alias(prefix + c) for c in OUT])


def mixed_rows(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The mix itself, in its order: a row for each time that a row of weighted_fair_mix() is served.

    Adds turn (0, 1) and words (those served), under the prefix of the others; finish becomes that of the turn. Range-sorted
    by finish, ties by turn, id, size and a hash of the row.
    """
    p = mixed.columns[-1].removesuffix("taken")
    size, taken = F.col(p + "size"), F.col(p + "taken")
    turns = F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1)
    rows = mixed.where(taken > 0).withColumn(p + "turn", F.explode(turns))
    turn = F.col(p + "turn")
    rows = rows.withColumn(p + "words", F.least(size, taken - turn * size))
    rows = rows.withColumn(p + "finish", F.col(p + "finish") + turn * F.col(p + "source_size") / F.col(p + "weight"))
    return rows.orderBy(p + "finish", p + "turn", id_col, p + "size", F.xxhash64(*mixed.columns))


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "source", n_words(F.col("text")).alias("words"), F.md5(F.col("text").cast("binary")).alias("tie"))
    mixed = weighted_fair_mix(docs, size=F.col("words"), tie=F.col("tie"))
    return mixed.select(
        "doc_id", F.col("wfq_size").alias("size"), F.col("wfq_source_size").alias("source_size"), F.col("wfq_target").alias("target"), F.col("wfq_taken").alias("taken"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, coalesce(md5(text), 'null') AS tie,
         md5('mix:' || coalesce(doc_id::VARCHAR, 'null:' || coalesce(md5(text), 'null'))) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2 * source_size / weight AS ratio, (sum(source_size) OVER ()) * 1.5::DOUBLE AS total FROM s
), f AS (
  SELECT *, (total - 2 * coalesce(sum(source_size) OVER w, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM r WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, weight, floor(total)::BIGINT AS budget,
         least(2.0::DOUBLE * source_size, weight * (SELECT level FROM f WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1)) AS target
  FROM f
), c AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.weight, t.budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.tie, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT source, budget, weight, pos + turn * source_size + least(size, 256 * (k + 1)) AS until, least(size - 256 * k, 256) AS words
  FROM (SELECT c.*, unnest(range((size + 255) // 256)) AS k FROM c), (VALUES (0), (1)) AS turns(turn)
), o AS (
  SELECT source, budget, words, sum(words) OVER (ORDER BY until / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) AS done FROM p
), g AS (
  SELECT source, sum(greatest(0, least(words, budget - done + words)))::BIGINT AS served FROM o GROUP BY source
)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(size, coalesce(served, 0) - pos)) + greatest(0, least(size, coalesce(served, 0) - pos - source_size)))::BIGINT AS taken
FROM c LEFT JOIN g ON c.source IS NOT DISTINCT FROM g.source
"""

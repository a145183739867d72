"""Filter interaction audit: what filters remove together, alone and in every order, from one pass over the documents.

Copies are found by sorting: documents are range-sorted by a fingerprint of the text (SHA-256), the text and the id, so
copies are neighbours, a group of any size is cut over partitions by its ids, and each document is compared with the one
before it. The bounds of the ranges are fingerprints and ids, so the driver samples no text.
The same pass takes the text's other failures. A run of copies that goes on in later partitions is settled by one small
row a partition, which names its first and last text. What is left of a document is a mask of the filters it fails, so
the counters of a part are sums over at most 2^5 masks: they add up over partitions, and all orders are read from them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table

FILTERS = "ABCDE"
#: The filters' limits.
LEAST_WORDS, DISTINCT, CAPITALS, SIGNS = 100, 80, 10, re.compile(rb"[#$%&*|]")
UPPER = bytes(range(ord("A"), ord("Z") + 1))
COPY = 1 << FILTERS.index("E")


def text_mask(text: str) -> int:
    """The bits of the filters A to D that a text fails, in the order of FILTERS.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals A-Z > 10 * code points; D: a sign of SIGNS.
    """
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # at space and \t to \r, as the words are defined
    capitals = len(data) - len(data.translate(None, UPPER))
    fails = (len(words) < LEAST_WORDS, 100 * len(set(words)) < DISTINCT * len(words), 100 * capitals > CAPITALS * len(text), SIGNS.search(data) is not None)
    return sum(1 << k for k, x in enumerate(fails) if x)


MASKS = "id long, part string, mask int, place int, head boolean, first binary, last binary, last_id long"


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, part, text, print) of a sorted partition to MASKS, and one more row (mask null) that says how the partition begins and ends.

    head: the row is in the partition's first run of copies, so an earlier partition may hold a smaller id of it.
    """
    place, head, before, first_id = TaskContext.get().partitionId(), True, None, None
    first = last = None
    schema = pa.schema([("id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("place", pa.int32()), ("head", pa.bool_()), ("first", pa.binary()), ("last", pa.binary()), ("last_id", pa.int64())])
    for b in batches:
        if not len(b):
            continue
        rows, last = [], b.column(3)[-1].as_py()
        first = first or b.column(3)[0].as_py()
        for i, part, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            text = text.as_py()
            if text != before:
                head, first_id = before is None, None
                before, mask = text, text_mask(text)
            if first_id is None:
                first_id = i
            rows.append((i, part, mask | (COPY if i is not None and first_id < i else 0), place, head, None, None, None))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    if before is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((None, None, None, place, True, first, last, first_id), schema, strict=True)], schema=schema)


def failure_masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Every row's id, part and mask: the filters of FILTERS that it fails, from the lowest bit.

    E: the text is identical to any smaller id's, table-wide. Null texts count as empty, null parts as ''. Rows without an
    id copy nothing and nothing copies them; rows that repeat an id don't copy each other. Texts are compared and
    measured whole. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    ordered = rows.withColumn("print", F.unhex(F.sha2("text", 256))).repartitionByRange("print", "id").sortWithinPartitions("print", "text", "id")
    done = materialize(ordered.select("id", "part", "text", "print").mapInArrow(_masks, MASKS), "masks")
    # a run that begins before a partition: its first id is that of the earliest partition that ends in it
    ends = done.where("mask IS NULL")
    begun = ends.where("last_id IS NOT NULL").groupBy(F.col("last").alias("first")).agg(F.min("place").alias("since"), F.min_by("last_id", "place").alias("since_id"))
    carried = ends.join(begun, "first").where("since < place").select("place", "since_id")
    # a row a partition at most, so never more than the sort has partitions
    known = done.where("mask IS NOT NULL").join(F.broadcast(carried), "place", "left")
    copy = F.coalesce(F.col("head") & (F.col("since_id") < F.col("id")), F.lit(False))
    out = known.select("id", "part", F.col("mask").bitwiseOR(F.when(copy, COPY).otherwise(0)).alias("mask"))
    out._table_path = done._table_path  # so that release() finds it
    return out


def mask_counters(masks: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: additive counters, 32 rows a part at most.

    labels: id_col, quality, toxic; of an id that repeats a 1 counts. Documents without a label count in n alone.
    """
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    of = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return masks.join(of, "id", "left").groupBy("part", "mask").agg(F.count("*").cast("long").alias("n"), total("good"), total("toxic"))


def audit(counters: DataFrame) -> DataFrame:
    """Counters to a row per part, order of the filters and step, with what the step's filter does there.

    kept, removed; redundant: fail it but went before; unique_fails: fail it alone; good_lost and toxic_lost of the
    removed; shapley: its removed in all orders together. A mask's n is counted in 1 / (its failures) of the orders
    for each filter it fails.
    """
    cells = F.sort_array(F.collect_list(F.struct("mask", "n", "good", "toxic")))
    parts = counters.groupBy("part").agg(cells.alias("cells"))  # 32 at most
    steps = [(order, k) for order in map("".join, permutations(FILTERS)) for k in range(len(FILTERS))]
    bit = lambda f: 1 << FILTERS.index(f)
    given = [F.struct(F.lit(o).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit(o[k])).alias("own"), F.lit(sum(map(bit, o[:k]))).alias("before")) for o, k in steps]
    rows = parts.select("part", "cells", F.explode(F.array(*given)).alias("s")).select("part", "cells", "s.*")
    own, before = F.col("own"), F.col("before")
    fails = lambda c: c["mask"].bitwiseAND(own) != 0
    gone = lambda c: c["mask"].bitwiseAND(before) != 0
    total = lambda what, where: F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda s, c: s + what(c))
    n, removed, orders = (lambda c: c["n"]), (lambda c: fails(c) & ~gone(c)), len(list(permutations(FILTERS)))
    return rows.select(
        "part", "filter_order", "step", total(n, lambda c: ~fails(c) & ~gone(c)).alias("kept"), total(n, removed).alias("removed"), total(n, lambda c: fails(c) & gone(c)).alias("redundant"),
        total(n, lambda c: c["mask"] == own).alias("unique_fails"), total(lambda c: c["good"], removed).alias("good_lost"), total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * (F.lit(orders).cast("long") / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """The audit of all documents: failure_masks(), mask_counters() and audit(), which state nulls, ties and repeated rows.

    Other columns have no influence. An empty table gives an empty result.
    """
    masks = failure_masks(docs, id_col, text_col, part_col)
    counters = materialize(mask_counters(masks, labels, id_col), "counters")
    release(masks)
    return audit(counters)


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_interactions(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))


SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), f AS (
  SELECT doc_id, part, (CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END)
    + (CASE WHEN 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
    + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 16 ELSE 0 END) AS mask FROM t
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL
), o AS (
  SELECT '' AS filter_order UNION ALL SELECT filter_order || c FROM o, (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) v(c) WHERE strpos(filter_order, c) = 0
), s AS (
  SELECT filter_order, step, (1 << (strpos('ABCDE', filter_order[step]) - 1))::BIGINT AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (strpos('ABCDE', filter_order[i]) - 1))), 0)::BIGINT AS before
  FROM o, range(1, 6) r(step) WHERE length(filter_order) = 5
), r AS (
  SELECT part, filter_order, step::INT AS step, mask = own AS alone, mask & own <> 0 AS fails, mask & before <> 0 AS gone, n, good, toxic,
    120 // greatest(bit_count(mask::BIGINT), 1) AS orders FROM s, m
)
SELECT part, filter_order, step, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * orders) FILTER (fails), 0)::BIGINT AS shapley
FROM r GROUP BY part, filter_order, step
"""

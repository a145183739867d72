"""Exact top-k search by columnar branch-and-bound.

Vectors are packed in blocks whose components lie in vertical layout: one contiguous column a dimension. For a
block of queries the dimensions are visited in blocks, those with most of the queries' mass first; a block's inner
products are added to the candidates' scores, and candidates whose score plus the bound on what remains (for each
unvisited block of dimensions its masses' product, by Cauchy-Schwarz) stays below the query's k-th best so far are
dropped by compaction. A block none of whose vectors can reach a k-th best is left before its first product. Survivors
of all blocks have exact scores.

Query blocks meet candidate blocks in the cells of a grid: each side is copied along one axis of it only, and
a cell's pairs stream through one task. A cell's queries are bounded by CELL_BYTES, so more queries make more cells;
what a task remembers are the k-th best scores of its query blocks. Every pair gives at most k rows a query; the merge
ranks them with a limit before its shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Vectors of a candidate block and of a query block, and dimensions of a step.
CANDIDATES, QUERIES, DIMS = 4096, 512, 8
#: Candidates that give a block's first bound, and the share of live pairs below which they are compacted.
SEED, DENSE = 512, 0.25
#: Cells of the grid for each task slot, at least, and bytes of a cell's queries, at most.
CELLS_A_SLOT, CELL_BYTES = 2, 64 << 20

PACKED = "block long, dim int, ids binary, columns binary"
EXACT_FLOAT, EXACT_DOUBLE = 2.0**24, 2.0**53


def pack(block_rows: int):
    """Packs rows (id long, vector array<double> of integers) into PACKED rows of at most block_rows of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal seq
            rows = held.pop(dim)
            ids = np.array([r[0] for r in rows], dtype=np.int64)
            vectors = np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), dim)
            seq += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + seq], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([np.ascontiguousarray(vectors.T).tobytes()], pa.binary())],
                names=["block", "dim", "ids", "columns"],
            )

        for b in batches:
            values, offsets = b.column(1), b.column(1).offsets.to_numpy()
            flat = values.values.to_numpy(zero_copy_only=False)
            for i, n in zip(b.column(0).to_numpy(zero_copy_only=False), range(len(offsets) - 1), strict=True):
                v = flat[offsets[n] : offsets[n + 1]]
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) == block_rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)

    return run


def search_block(q_ids, q, c_ids, c, k: int, kth: np.ndarray, reach: float, dims: int = DIMS, work: list[int] | None = None):
    """The k best candidates of every query within a block: arrays (query index, candidate id, score).

    q, c: columns, dimension by dimension, of integers that the type holds exactly. kth: lower bounds of the queries'
    k-th best scores, raised in place. Candidates that tie with them are kept, since the smaller id wins.
    reach: no score is larger; its rounding in comparisons is allowed for by slack. work: gets the products computed.
    """
    real, slack = (np.float32 if c.dtype == np.float32 else np.float64), 1 + reach * 1e-6
    none = np.zeros(0, dtype=np.int64)
    did = (work if work is not None else []).append
    mass_q, mass_c = (np.square(x, dtype=np.float64) for x in (q, c))
    order = np.argsort(-mass_q.sum(axis=1), kind="stable")
    steps = [order[at : at + dims] for at in range(0, len(order), dims)]
    # a little more than the masses' roots, for rounding
    root_q, root_c = ([np.sqrt(m[some].sum(axis=0)).astype(real) * real(1 + 1e-4) for some in steps] for m in (mass_q, mass_c))
    rest = sum((a[:, None] * b[None, :] for a, b in zip(root_q, root_c, strict=True)), np.zeros((len(q_ids), len(c_ids)), dtype=real))
    own = np.isin(q_ids, c_ids)
    if np.isneginf(kth).any() and len(c_ids) > k + 1:  # a first bound, from some of the candidates
        did(len(q_ids) * min(SEED, len(c_ids)) * len(order))
        some = q.T @ c[:, :SEED]
        some = np.where(q_ids[:, None] == c_ids[None, :SEED], -np.inf, some)
        if some.shape[1] > k:
            np.maximum(kth, np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k], out=kth)
    least = (kth[:, None] - slack).astype(real)
    if not (rest >= least).any():
        return none, none, none.astype(c.dtype)
    score, at_q, at_c = np.zeros((len(q_ids), len(c_ids)), dtype=c.dtype), None, None
    for n, some in enumerate(steps):
        if at_q is None:
            did(score.size * len(some))
            score += q[some].T @ c[some]
            rest -= root_q[n][:, None] * root_c[n][None, :]
            if n + 1 < len(steps):
                live = score + rest >= least
                if np.count_nonzero(live) <= DENSE * live.size:
                    at_q, at_c = np.nonzero(live)
                    score, rest = score[at_q, at_c], rest[at_q, at_c]
        else:
            did(len(score) * len(some))
            for d in some:
                score += q[d, at_q] * c[d, at_c]
            rest = rest - root_q[n][at_q] * root_c[n][at_c]
            live = score + rest >= kth[at_q] - slack
            at_q, at_c, score, rest = at_q[live], at_c[live], score[live], rest[live]
    if at_q is None:
        at_q, at_c = np.nonzero(score >= least)
        score = score[at_q, at_c]
    keep = (score >= kth[at_q] - slack) & ~(own[at_q] & (q_ids[at_q] == c_ids[at_c]))
    at_q, ids, score = at_q[keep], c_ids[at_c[keep]], score[keep]
    by = np.lexsort((ids, -score, at_q))
    at_q, ids, score = at_q[by], ids[by], score[by]
    place = np.arange(len(at_q)) - np.searchsorted(at_q, at_q, side="left")
    last = place == k - 1
    kth[at_q[last]] = np.maximum(kth[at_q[last]], score[last])
    best = place < k
    return at_q[best], ids[best], score[best]


def search_pairs(k: int):
    """Rows (q_block, dim, q_ids, q_columns, ids, columns) to rows (query_id, vec_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for b in batches:
            for row in b.to_pylist():
                q_ids, c_ids = (np.frombuffer(row[x], dtype=np.int64) for x in ("q_ids", "ids"))
                q, c = (np.frombuffer(row[x], dtype=np.float64).reshape(row["dim"], len(n)) for x, n in (("q_columns", q_ids), ("columns", c_ids)))
                reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * row["dim"]
                if reach < EXACT_FLOAT:
                    q, c = q.astype(np.float32), c.astype(np.float32)
                elif reach >= EXACT_DOUBLE:
                    if reach >= 2.0**62:
                        raise OverflowError("inner products beyond 64-bit integers")
                    q, c = q.astype(np.int64), c.astype(np.int64)
                kth = best.setdefault(row["q_block"], np.full(len(q_ids), -np.inf))
                at, ids, score = search_block(q_ids, q, c_ids, c, k, kth, reach)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """Each query's k rows of highest integer inner product: query_id, rank (from 1), vec_id, score; ties to the smaller id.

    Components become floor(scale * x). Vectors that are null or hold null, NaN or infinity take no part, nor do
    rows without an id. A row whose id is the query's own is no candidate of it. Rows that repeat a query's id and vector are
    one query; different vectors under one id are ranked together, so a candidate can stand there once for each. Repeated
    candidate rows each count. Vectors of other dimensions than the query's are no candidates. An empty vector scores
    0. Other columns have no influence. Empty tables give an empty result.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    fit = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))
    rows = vectors.where(fit & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if("is_query"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_c, n_q = max(1, math.ceil(n / CANDIDATES)), max(1, math.ceil(n_queries / QUERIES))
    candidates = rows.select("id", "v").repartition(n_c).mapInArrow(pack(CANDIDATES), PACKED)
    queries = rows.where("is_query").dropDuplicates(["id", "v"]).select("id", "v").repartition(n_q).mapInArrow(pack(QUERIES), PACKED)
    cells = CELLS_A_SLOT * spark.sparkContext.defaultParallelism
    fewest = math.ceil(n_q * QUERIES * dims * 8 / CELL_BYTES)
    across = min(n_q, max(1, fewest, round(math.sqrt(cells * n_q / n_c))))
    down = min(n_c, math.ceil(cells / across))
    c_side = candidates.select("dim", "ids", "columns", F.pmod(F.xxhash64("block"), F.lit(down)).alias("c_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))).alias("q_cell"))
    q_side = queries.select("dim", F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("columns").alias("q_columns"), F.pmod(F.xxhash64("block"), F.lit(across)).alias("q_cell"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(down - 1).cast("long"))).alias("c_cell"))
    pairs = q_side.hint("shuffle_hash").join(c_side, ["dim", "q_cell", "c_cell"]).select("q_block", "dim", "q_ids", "q_columns", "ids", "columns")
    found = pairs.mapInArrow(search_pairs(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 20
"""

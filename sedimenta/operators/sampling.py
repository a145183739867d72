"""Selection under quotas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.session import materialize, release


def quota_per_group(rows: DataFrame, group: str, order: list[Column], quota: int) -> DataFrame:
    """The first `quota` rows of each group, with their turn (from 1)."""
    return rows.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= quota)


#: A key's rows are cut over so many salts before its first ones are taken.
SALTS = 64
#: Up to so many rows of a key are told before a shuffle (below Spark's spark.sql.optimizer.windowGroupLimitThreshold).
CUT = 500


def first_rows(df: DataFrame, keys: list[str], n: int | Column, order: list[Column], tie: str, name: str) -> DataFrame:
    """The first n rows of each key by `order` and `tie`, numbered from 1.

    A number n is applied by each task to its own rows before the shuffle, if it is at most CUT; otherwise to each salt of a
    key first, then to what is left of the key. So no task holds all rows of a key.
    """
    if isinstance(n, int) and n <= CUT:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order, tie))).where(F.col(name) <= n)
    cut = Window.partitionBy(*keys, F.pmod(F.xxhash64(tie), F.lit(SALTS))).orderBy(*order, tie)
    some = df.withColumn(name, F.row_number().over(cut)).where(F.col(name) <= n)
    return some.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order, tie))).where(F.col(name) <= n)


PICKS = "g string, who string, k string, turn int, short boolean"


def round_robin_quota(rows: DataFrame, group: str, observation: str, observer: str, key: str, rank: list[Column], per_group: int = 20, per_observer: int = 50, depth: int | None = None) -> DataFrame:
    """Select rows turn by turn over groups, an observer's rows up to a global cap, new observers first.

    First the best row of each observation by `rank`, ties to the smaller key. In each turn every group then picks the
    best row whose observer is below the cap, preferring observers that the group hasn't picked; groups in order of
    their name. Rows without an observer count against no cap and always as new ones; rows without a group are left out.

    A pick depends on those before it only through the moments at which observers reach the cap. So groups propose all
    their turns at once, as if these moments were known; the moments follow from the proposals; and groups that hold an
    observer whose moment changed propose again. Each round settles one more pick at least, most often nearly all, and when
    nothing changes the picks are those of the turns one by one. A group proposes from the rows of its best `depth`
    observers (2 * per_group), and from twice as many when all of those are taken, so no task holds a whole group.
    """
    own = F.coalesce(F.trim(F.col(observer).cast("string")), F.lit(""))
    few = rows.where(F.col(group).isNotNull()).withColumns({"__g": F.col(group).cast("string"), "__o": own, "__k": F.col(key).cast("string")})
    best = first_rows(few, ["__g", observation], 1, rank, "__k", "__n")
    # a row without an observer is an observer of its own
    best = best.withColumn("__who", F.when(F.col("__o") == "", F.concat(F.lit("\0"), "__k")).otherwise(F.col("__o")))
    use = materialize(first_rows(best, ["__g", "__who"], min(per_group, per_observer), rank, "__k", "__nth"), "usable")
    heads = use.where("__nth = 1")
    sizes = materialize(heads.groupBy("__g").agg(F.count("*").alias("observers")), "sizes")

    def pools(need: DataFrame) -> DataFrame:
        """Rows (g, who, k, place, more) of the best observers of groups, as many as need (__g, deep) says."""
        seats = first_rows(heads.join(need, "__g"), ["__g"], F.col("deep"), rank, "__k", "__seat").select("__g", "__who")
        place = F.row_number().over(Window.partitionBy("__g").orderBy(*rank, "__k"))
        held = use.join(seats, ["__g", "__who"], "left_semi").withColumn("place", place)
        held = held.join(sizes, "__g").join(need, "__g")
        return held.select(F.col("__g").alias("g"), F.col("__who").alias("who"), F.col("__k").alias("k"), "place", (F.col("observers") > F.col("deep")).alias("more"))

    def turns(g: str | None, more: bool, pool: list[tuple]) -> list[tuple]:
        """A group's picks from its rows (who, k, the last moment at which who is free), in their order."""
        seen: set[str] = set()
        out = []
        for turn in range(1, per_group + 1):
            free = [x for x in pool if x[2] is None or (turn, g) <= x[2]]
            pick = next((x for x in free if x[0] not in seen), None)
            if pick is None and more:
                return [(g, None, None, None, True)]
            pick = pick or (free[0] if free else None)
            if pick is None:
                break  # moments only pass: nothing will be free later
            pool.remove(pick)
            seen.add(pick[0])
            out.append((g, pick[0], pick[1], turn, False))
        return out

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (g, who, k, more, turn, at), sorted by group and place, to PICKS; a group is held at a time."""
        kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_())
        held: list[tuple] = []
        g, more, out = None, False, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], names=["g", "who", "k", "turn", "short"])

        for b in batches:
            for of, who, k, deeper, turn, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != g:
                    out += turns(g, more, held)
                    g, more, held = of, deeper, []
                held.append((who, k, None if turn is None else (turn, at)))
            yield batch()
            out = []
        out += turns(g, more, held)
        yield batch()

    deep = materialize(sizes.select("__g", F.lit(depth or 2 * per_group).cast("long").alias("deep")), "depths")
    pool = materialize(pools(deep), "pools")
    closed = materialize(pool.where("false").select("who", F.lit(0).alias("turn"), F.col("g").alias("at")), "closed")
    picks, redo = None, pool
    while True:
        asked = redo.join(closed, "who", "left").repartition("g").sortWithinPartitions("g", "place").select("g", "who", "k", "more", "turn", "at")
        fresh = asked.mapInArrow(propose, PICKS)
        again = redo.select("g").distinct()
        picks_now = materialize(fresh if picks is None else fresh.union(picks.join(again, "g", "left_anti").select(*fresh.columns)), "picks")
        at_cap = first_rows(picks_now.where("NOT short AND NOT startswith(who, '\\0')"), ["who"], per_observer, [F.col("turn")], "g", "__nth").where(F.col("__nth") == per_observer)
        closed_now = materialize(at_cap.select("who", "turn", F.col("g").alias("at")), "closed")
        old = closed.withColumnsRenamed({"turn": "old_turn", "at": "old_at"})
        moved = closed_now.join(old, "who", "full").where(~(F.col("turn").eqNullSafe(F.col("old_turn")) & F.col("at").eqNullSafe(F.col("old_at")))).select("who")
        moved = materialize(moved, "moved")
        short = picks_now.where("short").select(F.col("g").alias("__g")).distinct()
        if short.limit(1).count():
            marked = deep.join(short.withColumn("short", F.lit(True)), "__g", "left")
            deeper = materialize(marked.select("__g", F.when(F.col("short"), F.col("deep") * 2).otherwise(F.col("deep")).alias("deep")), "depths")
            new = pools(deeper.join(short, "__g", "left_semi"))
            pool_now = materialize(pool.join(short.select(F.col("__g").alias("g")), "g", "left_anti").union(new.select(*pool.columns)), "pools")
            release(deep)
            deep = deeper
        else:
            pool_now = pool
        hit = pool_now.join(moved, "who", "left_semi").select("g").union(short.select("__g")).distinct()
        redo = materialize(pool_now.join(hit, "g", "left_semi"), "redo")
        release(*[t for t in (closed, picks, moved) if t is not None])
        if pool_now is not pool:
            release(pool)
        picks, closed, pool = picks_now, closed_now, pool_now
        if not redo.limit(1).count():
            who = F.when(F.startswith("who", F.lit("\0")), "").otherwise(F.col("who"))
            return picks.where("NOT short").select(F.col("g").alias(group), who.alias(observer), F.col("k").alias(key), "turn")


def next_batch(rows: DataFrame, order: list[Column], k: int) -> DataFrame:
    """A top-k report by a total order."""
    return rows.orderBy(*order).limit(k)

"""Hour budgets, heartbeats and exactly-once work on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hour_budget(events: DataFrame, limits: dict[str, int], lane: Column, time_col: str = "ts") -> DataFrame:
    """Events to hour, lane, used, granted, refused, frozen, per UTC clock hour (T1). Lanes without a limit are refused whole."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("lane")], F.lit(0))
    used = events.groupBy(F.date_trunc("hour", time_col).alias("hour"), lane.alias("lane")).agg(F.count("*").alias("used"))
    return used.select("hour", "lane", "used", F.least("used", limit).alias("granted"), F.greatest(F.lit(0), F.col("used") - limit).alias("refused"), (F.col("used") > limit).alias("frozen"))


def stream_hour_budget(events: DataFrame, limits: dict[str, int], lane: Column, time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """The same as a streaming aggregate: an hour comes out once the watermark has passed it; later events don't change it."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])[F.col("lane")], F.lit(0))
    used = events.withColumn("lane", lane).withWatermark(time_col, late).groupBy(F.window(time_col, "1 hour"), "lane").agg(F.count("*").alias("used"))
    return used.select(F.col("window.start").alias("hour"), "lane", "used", F.least("used", limit).alias("granted"), F.greatest(F.lit(0), F.col("used") - limit).alias("refused"), (F.col("used") > limit).alias("frozen"))


def time_guard(event_s: Column, now_s: Column, past_s: int = 86400, future_s: int = 300) -> Column:
    """accepted, late or future."""
    return F.when(event_s > now_s + future_s, "future").when(event_s < now_s - past_s, "late").otherwise("accepted")


def heartbeat_state(beats: DataFrame, worker: str = "worker", seq: str = "seq", time_col: str = "ts") -> DataFrame:
    """The latest beat of each worker and whether its sequence ever stood still or fell back (T4)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(worker).orderBy(time_col, seq)
    rows = beats.withColumn("__fell", F.coalesce(F.col(seq) <= F.lag(seq).over(w), F.lit(False)))
    return rows.groupBy(worker).agg(F.max(time_col).alias("last_ts"), F.max(seq).alias("last_seq"), F.bool_or("__fell").alias("not_monotonic"))


def unique_work(work: DataFrame, id_col: str = "work_id", time_col: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each work id once within the watermark."""
    return work.withWatermark(time_col, late).dropDuplicatesWithinWatermark([id_col])


def journal_sink(path: str, id_col: str):
    """A foreachBatch function that appends rows whose id the Parquet journal at `path` doesn't hold.

    A replayed batch appends nothing, so at-least-once delivery gives each id once. An id that comes again with other
    values, in its batch or against the journal, is a ValueError, and nothing of its batch is appended. Of the journal
    only ids and hashes are read. Rows without an id are a ValueError.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = lambda df, name: df.select(F.col(id_col), F.xxhash64(*df.columns).alias(name))
        batch = batch.distinct().persist()
        try:
            odd = batch.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col(id_col).isNull() | (F.col("n") > 1))
            fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
            fresh = batch
            if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
                old = known(spark.read.schema(batch.schema).parquet(path), "__old")
                changed = known(batch, "__new").join(old, id_col).where("__old <> __new")
                odd = odd.select(id_col).union(changed.select(id_col))
                fresh = batch.join(old.select(id_col), id_col, "left_anti").select(*batch.columns)
            wrong = odd.select(id_col).first()
            if wrong:
                raise ValueError(f"{id_col} {wrong[0]} comes with different values")
            fresh.write.mode("append").parquet(path)
        finally:
            batch.unpersist()

    return append


def due(last_s: Column, ttl_s: int, as_of_s: Column) -> Column:
    """Is a revalidation due? Never checked is due (T5)."""
    return last_s.isNull() | (as_of_s - last_s >= ttl_s)

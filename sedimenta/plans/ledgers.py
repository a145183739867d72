"""The hour ledger and leases over events, as streams that run over all that has arrived."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.streaming.ledger import hour_ledger, lease_changes, once

from .registry import query, table

#: Limits of the query's hours, and seconds of silence before a worker is degraded and expired.
NORMAL, RESERVE, ENVELOPE = 6, 3, 8
DEGRADED, EXPIRED = 3600, 86400


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a file stream, with times in UTC. A pattern, as a stream takes a file for a folder otherwise."""
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def commands_of(events: DataFrame) -> DataFrame:
    """Each event reserves a request of its hour and settles it within ten minutes; signups and purchases use the reserve.

    Errors below 20 are uncertain, other errors and views aren't sent; every 50th request asks for the hour after its own.
    """
    asked = F.date_trunc("hour", F.col("ts") + F.make_dt_interval(hours=F.when(F.col("event_id") % 50 == 0, 1).otherwise(0)))
    lane = F.when(F.col("event_type").isin("signup", "purchase"), "reserve").otherwise("normal")
    outcome = F.when((F.col("event_type") == "error") & (F.col("value") < 20), "uncertain").when(F.col("event_type").isin("error", "view"), "not_sent").otherwise("consumed")
    step = lambda at, command, rank: F.struct(at.alias("at"), command.alias("command"), F.lit(rank).alias("rank"))
    steps = F.array(step(F.col("ts"), F.lit("reserve"), 0), step(F.col("ts") + F.make_dt_interval(secs=F.col("event_id") % 600), outcome, 1))
    return events.select(asked.alias("hour"), F.col("event_id").alias("request"), lane.alias("lane"), F.inline(steps))


@query(f"""
WITH RECURSIVE e AS (
  SELECT *, date_trunc('hour', ts + CASE WHEN event_id % 50 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END) AS hour, CASE WHEN event_type IN ('signup', 'purchase') THEN 'reserve' ELSE 'normal' END AS lane,
    CASE WHEN event_type = 'error' AND value < 20 THEN 'uncertain' WHEN event_type IN ('error', 'view') THEN 'not_sent' ELSE 'consumed' END AS outcome FROM events
), c AS (
  SELECT *, row_number() OVER (PARTITION BY hour ORDER BY "at", request, rank) AS k FROM (
    SELECT hour, event_id AS request, lane, ts AS "at", 'reserve' AS command, 0 AS rank FROM e UNION ALL SELECT hour, event_id, lane, ts + to_seconds(event_id % 600), outcome, 1 FROM e)
), s(hour, k, "at", request, command, refused, normal, reserve, frozen, known) AS (
  SELECT DISTINCT hour, 0::BIGINT, NULL::TIMESTAMP, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, FALSE, []::BIGINT[] FROM c
  UNION ALL
  SELECT hour, k, "at", request, command, refused, normal + CASE WHEN lane = 'normal' THEN change ELSE 0 END, reserve + CASE WHEN lane = 'reserve' THEN change ELSE 0 END, frozen OR (refused IS NULL AND command = 'uncertain'),
    CASE WHEN refused IS NULL AND command = 'reserve' THEN list_append(known, request) ELSE known END
  FROM (SELECT *, CASE WHEN refused IS NOT NULL THEN 0 WHEN command = 'reserve' THEN 1 WHEN command = 'not_sent' THEN -1 ELSE 0 END AS change FROM (
    SELECT c.*, s.normal, s.reserve, s.frozen, s.known, CASE WHEN c.command <> 'reserve' THEN CASE WHEN NOT list_contains(s.known, c.request) THEN 'unknown_request' END WHEN s.frozen THEN 'frozen'
      WHEN c."at" < c.hour OR c."at" >= c.hour + INTERVAL 1 HOUR THEN 'outside_hour' WHEN s.normal + s.reserve >= {ENVELOPE} THEN 'envelope_exhausted'
      WHEN c.lane = 'normal' AND s.normal >= {NORMAL} THEN 'normal_exhausted' WHEN c.lane = 'reserve' AND s.reserve >= {RESERVE} THEN 'reserve_exhausted' END AS refused
    FROM s JOIN c ON c.hour = s.hour AND c.k = s.k + 1))
)
SELECT hour, "at", request, command, refused, normal, reserve, frozen FROM s WHERE k > 0
""")
def q_hour_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of every hour's ledger, from keyed state over a stream of events."""
    log = once(hour_ledger(commands_of(event_stream(spark, sf_dir)), NORMAL, RESERVE, ENVELOPE), "ledger")
    return log.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("hour", "at")})


@query(f"""
WITH b AS (SELECT DISTINCT user_id AS worker, date_trunc('millisecond', ts) AS "at" FROM events),
n AS (SELECT *, lag("at") OVER w AS before, coalesce(lead("at") OVER w, (SELECT max("at") FROM b) + INTERVAL 1 MILLISECOND) AS until FROM b WINDOW w AS (PARTITION BY worker ORDER BY "at"))
SELECT worker, "at", 'online' AS state FROM n WHERE before IS NULL OR before + to_seconds({DEGRADED}) < "at"
UNION ALL SELECT worker, "at" + to_seconds({DEGRADED}), 'degraded' FROM n WHERE "at" + to_seconds({DEGRADED}) < until
UNION ALL SELECT worker, "at" + to_seconds({EXPIRED}), 'expired' FROM n WHERE "at" + to_seconds({EXPIRED}) < until
""")
def q_lease_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: users as workers, each event a beat; when each is online, degraded and expired, by timers where nothing comes."""
    beats = event_stream(spark, sf_dir).select(F.col("user_id").alias("worker"), F.date_trunc("millisecond", "ts").alias("at"))
    return once(lease_changes(beats, DEGRADED, EXPIRED), "leases").withColumn("at", F.col("at").cast("timestamp_ntz"))

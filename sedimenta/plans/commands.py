"""Moderation commands replayed over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators.replay import MODERATION_ACTIONS, replay_moderation

from .registry import query, table

ACTION = "CASE WHEN event_id % 97 = 0 THEN 'case_closed' ELSE {array}[(event_id + length(event_type)) % 9 + {base}] END"
NAMES = ", ".join(f"'{a}'" for a in MODERATION_ACTIONS)


@query(f"""
WITH RECURSIVE c AS (
  SELECT user_id, ts, event_id, {ACTION.format(array=f"[{NAMES}]", base=1)} AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events
), s(user_id, k, event_id, action, legal, visibility, membership, audit, appeal, closed) AS (
  SELECT DISTINCT user_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, TRUE, 'shown', 'active', 'none', 'none', 'no' FROM c
  UNION ALL
  SELECT user_id, k, event_id, action, legal,
    CASE WHEN legal AND action = 'content_hidden' THEN 'hidden' WHEN legal AND action IN ('content_restored', 'appeal_upheld') THEN 'shown' ELSE visibility END,
    CASE WHEN legal AND action = 'reviewer_suspended' THEN 'paused' WHEN legal AND action IN ('reviewer_reinstated', 'appeal_upheld') THEN 'active' ELSE membership END,
    CASE WHEN legal AND action = 'review_audit_opened' THEN 'open' WHEN legal AND action = 'review_audit_completed' THEN 'completed' ELSE audit END,
    CASE WHEN legal AND action = 'appeal_filed' THEN 'filed' WHEN legal AND action IN ('appeal_upheld', 'appeal_denied') THEN 'decided' ELSE appeal END,
    CASE WHEN legal AND action = 'case_closed' THEN 'yes' ELSE closed END
  FROM (SELECT c.user_id, c.k, c.event_id, c.action, s.visibility, s.membership, s.audit, s.appeal, s.closed, s.closed = 'no' AND CASE c.action
      WHEN 'content_hidden' THEN s.visibility = 'shown' WHEN 'content_restored' THEN s.visibility = 'hidden' WHEN 'reviewer_suspended' THEN s.membership = 'active' WHEN 'reviewer_reinstated' THEN s.membership = 'paused'
      WHEN 'review_audit_opened' THEN s.audit = 'none' WHEN 'review_audit_completed' THEN s.audit = 'open' WHEN 'appeal_filed' THEN s.appeal = 'none' AND (s.visibility = 'hidden' OR s.membership = 'paused')
      WHEN 'case_closed' THEN TRUE ELSE s.appeal = 'filed' END AS legal
    FROM s JOIN c ON c.user_id = s.user_id AND c.k = s.k + 1)
)
SELECT user_id, event_id, action, NOT legal AS refused, visibility, membership, audit, appeal, closed FROM s WHERE k > 0
""")
def q_moderation_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moderation case for each user, every command legal or refused, and the state after it, as a parallel prefix."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(ACTION.format(array=f"array({NAMES})", base=0)).alias("action"))
    return replay_moderation(events, "user_id", ["ts", "event_id"], "action").drop("ts")

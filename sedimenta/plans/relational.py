"""Join, window, top-k, set and recursive queries (J, W, L, U, G, D rows of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import query, table


@query("""
SELECT CASE WHEN p_size % 7 = 0 THEN 'missing_id' WHEN s_suppkey IS NULL THEN 'unmatched' ELSE 'matched' END AS match_state, count(*) AS part_count,
       count(s_nationkey) AS with_nation, round(sum(p_retailprice), 2) AS price
FROM part LEFT JOIN supplier ON CASE WHEN p_size % 7 <> 0 THEN p_partkey END = s_suppkey GROUP BY 1
""")
def q_lookup_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left lookup on an exact id that says how it matched."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    key = F.when(F.col("p_size") % 7 != 0, F.col("p_partkey"))
    rows = parts.withColumn("key", key).join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("key") == F.col("s_suppkey"), "left")
    state = F.when(F.col("key").isNull(), "missing_id").when(F.col("s_suppkey").isNull(), "unmatched").otherwise("matched")
    return rows.groupBy(state.alias("match_state")).agg(F.count("*").alias("part_count"), F.count("s_nationkey").alias("with_nation"), F.round(F.sum("p_retailprice"), 2).alias("price"))


@query("""
SELECT 'orders_without_customer' AS check_name, count(*) AS violations FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'customers_without_order', count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)
UNION ALL SELECT 'lines_without_order', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE l_orderkey = o_orderkey)
UNION ALL SELECT 'lines_without_part', count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE l_partkey = p_partkey)
UNION ALL SELECT 'repeated_order_keys', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'documents_without_label', count(*) FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)
""")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key coverage both ways, uniqueness; one row a check."""
    t = lambda name, *cols: table(spark, sf_dir, name).select(*cols)
    count = lambda name, df: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    missing = lambda a, x, b, y: a.join(b, F.col(x) == F.col(y), "left_anti")
    orders, customers, lines = t("orders", "o_orderkey", "o_custkey"), t("customer", "c_custkey"), t("lineitem", "l_orderkey", "l_partkey")
    checks = [
        count("orders_without_customer", missing(orders, "o_custkey", customers, "c_custkey")),
        count("customers_without_order", missing(customers, "c_custkey", orders, "o_custkey")),
        count("lines_without_order", missing(lines, "l_orderkey", orders, "o_orderkey")),
        count("lines_without_part", missing(lines, "l_partkey", t("part", "p_partkey"), "p_partkey")),
        count("repeated_order_keys", orders.groupBy("o_orderkey").count().where("count > 1")),
        count("documents_without_label", t("documents", "doc_id").join(t("labels", "doc_id"), "doc_id", "left_anti")),
    ]
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


@query("""
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus, o_orderdate::DATE AS order_date, (count(*) OVER (PARTITION BY o_custkey))::BIGINT AS n_orders
FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC
""")
def q_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each key as an aggregate (partial on the map side), not a window."""
    latest = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderdate"), F.struct("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(latest.alias("o"), F.count("*").alias("n_orders"))
    return rows.select("o_custkey", "o.o_orderkey", "o.o_orderstatus", F.col("o.o_orderdate").cast("date").alias("order_date"), "n_orders")


@query("""
SELECT c_custkey, l.o_orderkey, l.o_totalprice FROM customer LEFT JOIN LATERAL (
  SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) l ON true
""")
def q_lateral_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lateral left join with a limit, as SQL; a customer without orders keeps its row."""
    table(spark, sf_dir, "customer").select("c_custkey").createOrReplaceTempView("lat_customer")
    table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice").createOrReplaceTempView("lat_orders")
    return spark.sql("""
        SELECT c_custkey, l.o_orderkey, l.o_totalprice FROM lat_customer LEFT JOIN LATERAL (
          SELECT o_orderkey, o_totalprice FROM lat_orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) l ON true
    """)


@query("""
SELECT o_orderkey, o_custkey, (row_number() OVER w)::INT AS revision, lead(o_orderkey) OVER w IS NOT NULL AS superseded, lag(o_orderkey) OVER w AS supersedes
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def q_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revisions of a key, what each supersedes and whether a later one exists."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.row_number().over(w).alias("revision"), F.lead("o_orderkey").over(w).isNotNull().alias("superseded"), F.lag("o_orderkey").over(w).alias("supersedes"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events)
SELECT event_id, user_id, event_type, supersedes FROM e WHERE event_id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL)
""")
def q_effective_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no later one supersedes, from a supersession pointer."""
    from sedimenta.operators.ledger import effective

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.lag("event_id").over(w).alias("supersedes"))
    return effective(rows, "event_id", "supersedes")


@query("""
SELECT date_trunc('hour', ts) AS hour, count(*) AS event_count, count(DISTINCT user_id) AS user_count, count(DISTINCT event_type) AS decision_count,
       count(DISTINCT (user_id, event_type)) AS pair_count FROM events GROUP BY 1
HAVING count(*) >= 2 AND count(DISTINCT user_id) >= 2 AND count(DISTINCT event_type) >= 2
""")
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts need two events, two reviewers and two decisions."""
    rows = table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("event_count"), F.countDistinct("user_id").alias("user_count"), F.countDistinct("event_type").alias("decision_count"), F.countDistinct(F.struct("user_id", "event_type")).alias("pair_count"),
    )
    return rows.where("event_count >= 2 AND user_count >= 2 AND decision_count >= 2").withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""
SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')
""")
def q_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that have rows, and none without the wanted property."""
    orders = table(spark, sf_dir, "orders")
    states = orders.groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "P").alias("pending")).where("NOT pending")
    return table(spark, sf_dir, "customer").join(states, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("""
SELECT n_name, o_orderkey, r::INT AS place FROM (
  SELECT n_name, o_orderkey, row_number() OVER (PARTITION BY n_name ORDER BY o_orderkey) AS r
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) WHERE r <= 2
""")
def q_first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two records of each cell; the rank limit runs before the shuffle."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy("o_orderkey")
    return rows.select("n_name", "o_orderkey", F.row_number().over(w).alias("place")).where("place <= 2")


@query("""
SELECT l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, sha256(l_orderkey || ':' || l_linenumber), l_linenumber) AS r FROM lineitem) WHERE r = 1
""")
def q_best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best row of each group by (-value, hash tie, key), as an aggregate."""
    tie = F.sha2(F.concat_ws(":", "l_orderkey", "l_linenumber"), 256)
    best = F.min_by(F.struct("l_linenumber", "l_extendedprice"), F.struct(-F.col("l_extendedprice"), tie, F.col("l_linenumber")))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(best.alias("b")).select("l_orderkey", "b.l_linenumber", "b.l_extendedprice")


@query("""
WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_size % 5 <> 0 THEN p_size / 50.0::DOUBLE END AS a, CASE WHEN p_size % 3 <> 0 THEN p_retailprice / 2000 END AS b FROM part),
c AS (SELECT p_partkey, p_brand, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN
  (coalesce(a * 0.6::DOUBLE, 0) + coalesce(b * 0.4::DOUBLE, 0)) / (CASE WHEN a IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN b IS NOT NULL THEN 0.4::DOUBLE ELSE 0 END) END AS score FROM s)
SELECT p_brand, p_partkey, round(score, 6) AS score, r::INT AS schedule_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC NULLS LAST, p_partkey) AS r FROM c) WHERE r <= 5
""")
def q_topk_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score over the observed components and the best five of every lane."""
    from sedimenta.operators.planning import lane_top_k, weighted_score

    a, b = F.when(F.col("p_size") % 5 != 0, F.col("p_size") / 50.0), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") / 2000)
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", weighted_score([(0.6, a), (0.4, b)]).alias("score"))
    return lane_top_k(rows, "p_brand", "score", "p_partkey", F.lit(5)).withColumn("score", F.round("score", 6))


@query("SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS d FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 12")
def q_top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global top-k report."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("date").alias("d")).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(12)


@query("""
SELECT c_custkey, 'ordered_and_rich' AS kind FROM customer WHERE c_acctbal > 5000 AND c_custkey IN (SELECT o_custkey FROM orders)
UNION ALL (SELECT c_custkey, 'never_ordered' FROM customer EXCEPT SELECT o_custkey, 'never_ordered' FROM orders)
UNION ALL (SELECT c_custkey, 'both_kinds' FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey, 'both_kinds' FROM orders WHERE o_orderstatus = 'P')
""")
def q_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi join, difference and intersection of id sets."""
    c, o = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus")
    ids = o.select(F.col("o_custkey").alias("c_custkey"))
    kind = lambda df, name: df.select("c_custkey", F.lit(name).alias("kind"))
    pending = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return (
        kind(c.where("c_acctbal > 5000").join(ids, "c_custkey", "left_semi"), "ordered_and_rich")
        .unionByName(kind(c.select("c_custkey").subtract(ids), "never_ordered"))
        .unionByName(kind(c.where("c_acctbal < 0").select("c_custkey").intersect(pending), "both_kinds"))
    )


@query("""
WITH a AS (SELECT o_custkey % 7 AS k, CASE WHEN o_custkey % 5 <> 0 THEN o_orderpriority END AS p, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT x.k, x.p, x.n, y.n AS n_next FROM a x JOIN a y ON x.p IS NOT DISTINCT FROM y.p AND y.k = x.k + 1
""")
def q_null_safe_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null keys match null keys."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("k"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("p")).groupBy("k", "p").agg(F.count("*").alias("n"))
    x, y = rows.alias("x"), rows.alias("y")
    return x.join(y, F.col("x.p").eqNullSafe(F.col("y.p")) & (F.col("y.k") == F.col("x.k") + 1)).select("x.k", "x.p", "x.n", F.col("y.n").alias("n_next"))


@query("""
WITH s AS (SELECT s_suppkey, [s_nationkey, (s_nationkey + 1) % 25] AS nations FROM supplier)
SELECT n_name, count(*) AS supplier_count, bool_or(s_suppkey % 2 = 0) AS any_even FROM s JOIN nation ON list_contains(nations, n_nationkey) GROUP BY 1
""")
def q_array_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership in an array, as an exploded equi-join."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array_distinct(F.array("s_nationkey", (F.col("s_nationkey") + 1) % 25))).alias("n_nationkey"))
    return s.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey").groupBy("n_name").agg(F.count("*").alias("supplier_count"), F.bool_or(F.col("s_suppkey") % 2 == 0).alias("any_even"))


@query("""
WITH RECURSIVE a AS (
  SELECT 'R' || r_regionkey AS node, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
), t AS (SELECT node, 0 AS depth, node AS path FROM a WHERE parent IS NULL UNION ALL SELECT a.node, t.depth + 1, t.path || '/' || a.node FROM a JOIN t ON a.parent = t.node)
SELECT node, depth, path FROM t
""")
def q_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Materialised paths of a hierarchy, by a recursive query that guards against cycles."""
    t = lambda name: table(spark, sf_dir, name)
    node = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    adjacency = (
        t("region").select(node("R", "r_regionkey").alias("node"), F.lit(None).cast("string").alias("parent"))
        .union(t("nation").select(node("N", "n_nationkey"), node("R", "n_regionkey"))).union(t("supplier").select(node("S", "s_suppkey"), node("N", "s_nationkey")))
    )
    from sedimenta.operators.graph import lineages

    return lineages(adjacency).where("state = 'rooted'").select("node", F.col("depth").cast("int"), F.array_join("path", "/").alias("path"))


@query("""
WITH n AS (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'),
c AS (SELECT c_custkey FROM customer WHERE c_nationkey IN (FROM n)), s AS (SELECT s_suppkey FROM supplier WHERE s_nationkey IN (FROM n)),
o AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM c))
SELECT 'customer' AS kind, count(*) AS n, min(c_custkey) AS first_id FROM c UNION ALL SELECT 'supplier', count(*), min(s_suppkey) FROM s
UNION ALL SELECT 'order', count(*), min(o_orderkey) FROM o UNION ALL SELECT 'line', count(*), min(l_orderkey) FROM lineitem WHERE l_orderkey IN (FROM o)
""")
def q_takedown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that depends on a node, by kind, as chained semi joins."""
    t = lambda name, *c: table(spark, sf_dir, name).select(*c)
    under = lambda df, key, of, parent: df.join(of, F.col(key) == F.col(parent), "left_semi")
    nations = under(t("nation", "n_nationkey", "n_regionkey"), "n_regionkey", table(spark, sf_dir, "region").where("r_name = 'ASIA'").select("r_regionkey"), "r_regionkey")
    customers = under(t("customer", "c_custkey", "c_nationkey"), "c_nationkey", nations, "n_nationkey")
    suppliers = under(t("supplier", "s_suppkey", "s_nationkey"), "s_nationkey", nations, "n_nationkey")
    orders = under(t("orders", "o_orderkey", "o_custkey"), "o_custkey", customers, "c_custkey")
    lines = under(t("lineitem", "l_orderkey"), "l_orderkey", orders, "o_orderkey")
    kind = lambda name, df, key: df.agg(F.count("*").alias("n"), F.min(key).alias("first_id")).select(F.lit(name).alias("kind"), "n", "first_id")
    return kind("customer", customers, "c_custkey").union(kind("supplier", suppliers, "s_suppkey")).union(kind("order", orders, "o_orderkey")).union(kind("line", lines, "l_orderkey"))


@query("""
WITH RECURSIVE e AS (
  SELECT d.doc_id AS a, m AS b FROM documents d JOIN (SELECT n_chars, min(doc_id) AS m FROM documents GROUP BY 1) USING (n_chars)
  UNION SELECT d.doc_id, m FROM documents d JOIN (SELECT sha256(text) AS k, min(doc_id) AS m FROM documents GROUP BY 1) ON sha256(text) = k
), b AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS x, a AS y FROM b UNION SELECT r.x, b.b FROM r JOIN b ON r.y = b.a)
SELECT x AS doc_id, min(y) AS component FROM r GROUP BY 1
""")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share a length or a text; keys link to their smallest document."""
    from sedimenta.operators.graph import components

    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.sha2("text", 256).alias("digest"))
    star = lambda key: docs.join(docs.groupBy(key).agg(F.min("doc_id").alias("b")), key).select(F.col("doc_id").alias("a"), "b")
    found = components(star("n_chars").union(star("digest")))
    return docs.select("doc_id").join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


@query("""
WITH g AS (SELECT o_orderkey, bool_and(l_returnflag <> 'R') AS g1, bool_and(l_linestatus = 'F') AS g2, sum(l_quantity) <= 200 AS g3, count(*) >= 2 AS g4 FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
b AS (SELECT o_orderkey, list_filter([CASE WHEN NOT g1 THEN 'returned' END, CASE WHEN NOT g2 THEN 'open_line' END, CASE WHEN NOT g3 THEN 'too_large' END, CASE WHEN NOT g4 THEN 'single_line' END], lambda x: x IS NOT NULL) AS bl FROM g)
SELECT o_orderkey, CASE WHEN len(bl) = 0 THEN 'release' ELSE 'blocked' END AS decision, array_to_string(bl, ',') AS blockers FROM b
""")
def q_release_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A release needs all gates; what blocks it is listed."""
    from sedimenta.operators.decisions import gate_decision

    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_quantity").join(table(spark, sf_dir, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    g = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.bool_and(F.col("l_returnflag") != "R").alias("returned"), F.bool_and(F.col("l_linestatus") == "F").alias("open_line"), (F.sum("l_quantity") <= 200).alias("too_large"), (F.count("*") >= 2).alias("single_line"),
    )
    d = gate_decision({n: F.col(n) for n in ("returned", "open_line", "too_large", "single_line")})
    return g.select("o_orderkey", d["decision"].alias("decision"), F.array_join(d["blockers"], ",").alias("blockers"))


@query("""
WITH m AS (SELECT c_custkey, min(CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 ELSE 4 END) AS ceiling, count(o_orderkey) AS n
           FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'blocked' WHEN ceiling <= 1 THEN 'withhold' WHEN ceiling <= 2 THEN 'generalise' ELSE 'publish' END AS decision, count(*) AS n, min(ceiling)::INT AS strictest FROM m GROUP BY 1
""")
def q_location_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest ceiling decides; nothing known blocks. The rules of D8 are decisions.location_decisions()."""
    level = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).otherwise(4)
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(level).alias("ceiling"))
    rows = table(spark, sf_dir, "customer").select("c_custkey").join(per, F.col("c_custkey") == F.col("o_custkey"), "left")
    decision = F.when(F.col("ceiling").isNull(), "blocked").when(F.col("ceiling") <= 1, "withhold").when(F.col("ceiling") <= 2, "generalise").otherwise("publish")
    # a customer without orders has no order row, whose priority counts as the mildest ceiling
    return rows.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"), F.min(F.coalesce("ceiling", F.lit(4))).alias("strictest"))


@query("""
WITH h AS (SELECT date_trunc('hour', ts) AS hour, CASE WHEN event_type = 'purchase' THEN 'reserve' ELSE 'normal' END AS lane, count(*) AS used FROM events GROUP BY 1, 2)
SELECT hour, lane, used, least(used, CASE lane WHEN 'normal' THEN 10 ELSE 2 END) AS granted, greatest(0, used - CASE lane WHEN 'normal' THEN 10 ELSE 2 END) AS refused,
       used > CASE lane WHEN 'normal' THEN 10 ELSE 2 END AS frozen FROM h
""")
def q_hour_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget for each clock hour and lane; what is over it is refused."""
    from sedimenta.streaming.budget import hour_budget

    return hour_budget(table(spark, sf_dir, "events"), {"normal": 10, "reserve": 2}, F.when(F.col("event_type") == "purchase", "reserve").otherwise("normal")).withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@query("""
SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(lower(concat_ws(' ', c_name, c_mktsegment, c_custkey)), lower(trim(' 00001 ')))
""")
def q_directory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality on one column and a substring of the joined names; the equality reaches the scan."""
    hay = F.lower(F.concat_ws(" ", "c_name", "c_mktsegment", F.col("c_custkey").cast("string")))
    return table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & F.contains(hay, F.lower(F.trim(F.lit(" 00001 "))))).select("c_custkey", "c_name", "c_mktsegment")


@query("""
WITH m AS (SELECT n_nationkey AS nation, CASE WHEN n_regionkey = 1 THEN 'viewer' WHEN n_regionkey = 2 THEN 'curator' END AS role FROM nation)
SELECT c_custkey, CASE WHEN role = 'curator' THEN c_acctbal END AS c_acctbal, role FROM customer JOIN m ON c_nationkey = nation WHERE role IN ('viewer', 'curator')
""")
def q_secure_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for members only, a column for one role only."""
    role = F.when(F.col("n_regionkey") == 1, "viewer").when(F.col("n_regionkey") == 2, "curator")
    members = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), role.alias("role")).where("role IS NOT NULL")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal").join(members, "c_nationkey")
    return rows.select("c_custkey", F.when(F.col("role") == "curator", F.col("c_acctbal")).alias("c_acctbal"), "role")


@query("""
WITH c AS (SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer)
SELECT c_nationkey, c_custkey, r::INT AS turn FROM c WHERE r <= 4
""")
def q_quota_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W8 (its per-group quota): the first four of each group in the order of turns. The cross-group cap is in operators.sampling."""
    from sedimenta.operators.sampling import quota_per_group

    return quota_per_group(table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), "c_nationkey", [F.col("c_acctbal").desc(), F.col("c_custkey")], 4).select("c_nationkey", "c_custkey", "turn")


@query("""
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT user_id, coalesce(sum(n) FILTER (WHERE event_type IN ('purchase', 'signup')), 0) AS supports, coalesce(sum(n) FILTER (WHERE event_type = 'error'), 0) AS opposes, sum(n) AS total FROM e GROUP BY 1)
SELECT user_id, supports::BIGINT AS supports, opposes::BIGINT AS opposes, least(supports, opposes)::BIGINT AS dissent,
       CASE WHEN total < 2 THEN 'insufficient' WHEN supports > 0 AND opposes > 0 AND least(supports, opposes) * 3 >= total THEN 'conflict' WHEN supports > opposes THEN 'supported' WHEN opposes > supports THEN 'opposed' ELSE 'uncertain' END AS status FROM s
""")
def q_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Support, opposition, dissent and a status by ordered rules. The rules of D1 are consensus.layers()."""
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type").isin("purchase", "signup")).alias("supports"), F.count_if(F.col("event_type") == "error").alias("opposes"), F.count("*").alias("total"),
    )
    s, o = F.col("supports"), F.col("opposes")
    dissent = F.least(s, o)
    status = F.when(F.col("total") < 2, "insufficient").when((s > 0) & (o > 0) & (dissent * 3 >= F.col("total")), "conflict").when(s > o, "supported").when(o > s, "opposed").otherwise("uncertain")
    return e.select("user_id", "supports", "opposes", dissent.alias("dissent"), status.alias("status"))


@query("""
SELECT cell, count(*) AS n, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM (
  SELECT (c_custkey % 180) - 90 + 0.25::DOUBLE AS lat, 'g1:' || (floor(((c_custkey % 180) - 90 + 0.25 + 90) / 1)::BIGINT) || ':' || (floor(((c_custkey * 7 % 360) - 180 + 0.75 + 180) / 1)::BIGINT) AS cell FROM customer) GROUP BY 1
""")
def q_grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells of a latitude-longitude grid."""
    from sedimenta.functions.geo import cell

    lat, lon = (F.col("c_custkey") % 180) - 90 + 0.25, (F.col("c_custkey") * 7 % 360) - 180 + 0.75
    return table(spark, sf_dir, "customer").select(lat.alias("lat"), cell(lat, lon, 1).alias("cell")).groupBy("cell").agg(F.count("*").alias("n"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"))

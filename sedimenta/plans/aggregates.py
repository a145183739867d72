"""Aggregation queries over the star tables, events and documents; each names the rows of the inventory that it covers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .registry import query, table


@query("""
SELECT l_linestatus, count(*) AS record_count, count(*) FILTER (WHERE l_returnflag = 'A') AS count_a,
       count(*) FILTER (WHERE l_returnflag = 'N') AS count_n, count(*) FILTER (WHERE l_returnflag = 'R') AS count_r,
       min(CASE WHEN year(l_shipdate) BETWEEN 1993 AND 1997 THEN year(l_shipdate) END)::INT AS min_year,
       max(CASE WHEN year(l_shipdate) BETWEEN 1993 AND 1997 THEN year(l_shipdate) END)::INT AS max_year,
       count(*) FILTER (WHERE year(l_shipdate) NOT BETWEEN 1993 AND 1997) AS out_of_band,
       max(l_discount) AS max_discount, count(*) - count(l_tax) AS null_tax
FROM lineitem GROUP BY 1
""")
def q_category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category counts as columns; extremes that ignore values outside a band."""
    year = F.year("l_shipdate")
    band = F.when(year.between(1993, 1997), year)
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(
        F.count("*").alias("record_count"), *[F.count_if(F.col("l_returnflag") == f).alias(f"count_{f.lower()}") for f in "ANR"],
        F.min(band).alias("min_year"), F.max(band).alias("max_year"), F.count_if(~year.between(1993, 1997)).alias("out_of_band"),
        F.max("l_discount").alias("max_discount"), F.count_if(F.col("l_tax").isNull()).alias("null_tax"),
    )


#: A digest's fan-in, and its levels before the last: keys up to FAN ** (LEVELS + 1) leave at most FAN parts to it.
FAN, LEVELS = 1000, 4
DIGEST_SQL = """
WITH d0 AS (SELECT n_name, o_orderkey AS k, 1 AS n, sha256(concat_ws('|', o_orderkey, o_orderstatus, o_orderpriority)) AS d
            FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""" + "".join(f""",
d{i + 1} AS (SELECT n_name, k // {FAN} AS k, sum(n) AS n, sha256(string_agg(d || chr(10), '' ORDER BY k)) AS d FROM d{i} GROUP BY 1, 2)""" for i in range(LEVELS)) + f"""
SELECT n_name, sum(n)::BIGINT AS record_count, sha256(string_agg(d || chr(10), '' ORDER BY k)) AS digest FROM d{LEVELS} GROUP BY 1
"""


@query(DIGEST_SQL)
def q_scope_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, A10: a digest of a scope's row hashes in key order, level by level, so that no list has more than FAN parts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fp = F.sha2(F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority"), 256)
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.select("n_name", F.col("o_orderkey").alias("k"), F.lit(1).alias("n"), fp.alias("d"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda s: F.concat(s["d"], F.lit("\n")))
    digest = F.sha2(F.array_join(parts, ""), 256)
    for _ in range(LEVELS):
        rows = rows.groupBy("n_name", F.floor(F.col("k") / FAN).alias("up")).agg(F.sum("n").alias("n"), digest.alias("d")).withColumnRenamed("up", "k")
    return rows.groupBy("n_name").agg(F.sum("n").alias("record_count"), digest.alias("digest"))


@query("""
SELECT l_returnflag, count(*) AS total_count, count(*) FILTER (WHERE s_acctbal < 0) AS excluded_count,
       count(*) FILTER (WHERE s_acctbal >= 0) AS included_count, count(DISTINCT l_suppkey) FILTER (WHERE s_acctbal >= 0) AS included_suppliers
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1
""")
def q_rights_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of blocked suppliers are screened out; both buckets are counted and add up."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag")
    # one row a flag and supplier before the join: the join sees no hot supplier
    per = lines.groupBy("l_returnflag", "l_suppkey").agg(F.count("*").alias("n"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_acctbal") < 0).alias("blocked"))
    n = F.col("n")
    return per.join(suppliers, "l_suppkey").groupBy("l_returnflag").agg(
        F.sum("n").alias("total_count"), F.sum(F.when(F.col("blocked"), n).otherwise(0)).alias("excluded_count"), F.sum(F.when(~F.col("blocked"), n).otherwise(0)).alias("included_count"),
        F.count_if(~F.col("blocked")).alias("included_suppliers"),
    )


@query("""
SELECT identity, count(*) AS doc_count, count(DISTINCT source) AS source_count, count(DISTINCT lang) AS lang_count, min(doc_id) AS canonical_id, max(doc_id) AS last_id,
       count(DISTINCT lang) > 1 AS conflict, 'mirror:v1:' || substr(identity, 1, 24) AS group_id
FROM (SELECT *, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))) AS identity FROM documents) GROUP BY 1 HAVING count(DISTINCT source) >= 2
""".replace("\\\\", "\\"))
def q_mirror_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are comparable as a whole, held by two sources or more, with a conflict flag."""
    identity = F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\t\\n\\r]+", " "))), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", identity.alias("identity"))
    groups = docs.groupBy("identity").agg(F.count("*").alias("doc_count"), F.countDistinct("source").alias("source_count"), F.countDistinct("lang").alias("lang_count"), F.min("doc_id").alias("canonical_id"), F.max("doc_id").alias("last_id"))
    return groups.where("source_count >= 2").withColumns({"conflict": F.col("lang_count") > 1, "group_id": F.concat(F.lit("mirror:v1:"), F.substring("identity", 1, 24))})


@query("""
SELECT token, count(*) AS use_count, count(DISTINCT p_brand) AS brand_count, count(DISTINCT p_brand) > 1 AS collision
FROM (SELECT p_brand, unnest(string_split(lower(p_name), ' ')) AS token FROM part) GROUP BY 1
""")
def q_homonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name tokens that more than one brand uses."""
    tokens = table(spark, sf_dir, "part").select("p_brand", F.explode(F.split(F.lower("p_name"), " ")).alias("token"))
    return tokens.groupBy("token").agg(F.count("*").alias("use_count"), F.countDistinct("p_brand").alias("brand_count")).withColumn("collision", F.col("brand_count") > 1)


@query("""
SELECT flag, count(*) AS line_count, count(DISTINCT l_orderkey) AS order_count FROM (
  SELECT l_orderkey, unnest(list_filter([CASE WHEN l_discount > 0.05 THEN 'discounted' END, CASE WHEN l_quantity > 40 THEN 'bulk' END,
    CASE WHEN l_returnflag = 'R' THEN 'returned' END, CASE WHEN l_linestatus = 'O' THEN 'open' END], lambda x: x IS NOT NULL)) AS flag FROM lineitem)
GROUP BY 1
""")
def q_array_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons as an array of flags, and how often each occurs."""
    flags = F.array_compact(F.array(F.when(F.col("l_discount") > 0.05, "discounted"), F.when(F.col("l_quantity") > 40, "bulk"), F.when(F.col("l_returnflag") == "R", "returned"), F.when(F.col("l_linestatus") == "O", "open")))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.explode(flags).alias("flag"))
    return rows.groupBy("flag").agg(F.count("*").alias("line_count"), F.countDistinct("l_orderkey").alias("order_count"))


@query("""
SELECT event_type, count(*) AS event_count, count(props->>'k') AS with_k, sum((props->>'k')::INT)::BIGINT AS sum_k, max((props->>'k')::INT) AS max_k,
       count(*) FILTER (WHERE json_type(props) = 'OBJECT') AS object_count, count(*) FILTER (WHERE json_exists(props, '$.missing')) AS missing_count
FROM events GROUP BY 1
""")
def q_json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reading, typing and testing JSON members."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("event_count"), F.count(k).alias("with_k"), F.sum(k).alias("sum_k"), F.max(k).alias("max_k"),
        F.count_if(F.json_object_keys("props").isNotNull()).alias("object_count"), F.count_if(F.get_json_object("props", "$.missing").isNotNull()).alias("missing_count"),
    )


@query("""
SELECT c_mktsegment, count(*) AS order_count, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, count(*) FILTER (WHERE o_orderstatus = 'O') AS open,
       greatest(0, 1000 - count(*)) AS remaining, bool_or(o_orderpriority = '1-URGENT') AS any_urgent, round(avg(o_totalprice), 2) AS avg_price,
       count(DISTINCT (o_custkey, o_orderstatus)) AS pair_count
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def q_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered counts, distinct pairs (nulls included), a floor at zero."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("c_mktsegment").agg(
        F.count("*").alias("order_count"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_orderstatus") == "O").alias("open"),
        F.greatest(F.lit(0), 1000 - F.count("*")).alias("remaining"), F.bool_or(F.col("o_orderpriority") == "1-URGENT").alias("any_urgent"), F.round(F.avg("o_totalprice"), 2).alias("avg_price"),
        F.countDistinct(F.struct("o_custkey", "o_orderstatus")).alias("pair_count"),
    )


@query("""
WITH tiers AS (SELECT unnest(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW', '6-NONE']) AS tier)
SELECT tier, count(o_orderkey) AS order_count, coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END), 0)::BIGINT AS pending
FROM tiers LEFT JOIN orders ON o_orderpriority = tier GROUP BY 1
""")
def q_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by tier with all tiers present; missing ones are 0."""
    tiers = spark.range(1).select(F.explode(F.array(*map(F.lit, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]))).alias("tier"))
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("tier")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return tiers.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0).cast("long")).alias("order_count"), F.coalesce("p", F.lit(0).cast("long")).alias("pending"))


@query("""
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, min(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS least_finished,
       count(DISTINCT o_orderpriority) = 1 AS single_priority, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS priority
FROM orders GROUP BY 1
""")
def q_ordered_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted distinct sets, single value or null, filtered minimum. The sets hold at most three values."""
    single = F.min("o_orderpriority") == F.max("o_orderpriority")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("least_finished"),
        single.alias("single_priority"), F.when(single, F.min("o_orderpriority")).alias("priority"),
    )


@query("""
WITH r AS (SELECT user_id AS item, event_type AS code, count(*) AS n FROM events GROUP BY 1, 2),
i AS (SELECT item, sum(n) AS m, sum(n * n) AS sq FROM r GROUP BY 1 HAVING sum(n) >= 2),
c AS (SELECT code, sum(n) AS t FROM r JOIN i USING (item) GROUP BY 1),
s AS (SELECT (SELECT sum((m * m - sq) / (m - 1)::DOUBLE) FROM i) AS d, (SELECT sum(m) FROM i) AS total, (SELECT sum(t * t) FROM c) AS csq, (SELECT count(*) FROM i) AS items)
SELECT items AS item_count, total::BIGINT AS rating_count, round(1 - (d / total) / ((total * total - csq) / (total * (total - 1))::DOUBLE), 6) AS alpha FROM s
""")
def q_alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nominal Krippendorff alpha; users are items, their events' types the ratings."""
    from sedimenta.operators.estimators import krippendorff_alpha

    return krippendorff_alpha(table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.col("event_type").alias("code"))).select("item_count", "rating_count", F.round("alpha", 6).alias("alpha"))


@query("""
WITH frame AS (SELECT lang AS stratum, count(*) AS n FROM documents GROUP BY 1),
s AS (SELECT lang AS stratum, quality FROM labels JOIN documents USING (doc_id)),
p AS (SELECT stratum, quality, (count(*) OVER (PARTITION BY stratum))::DOUBLE / n AS p, n::DOUBLE / (SELECT sum(n) FROM frame) AS share FROM s JOIN frame USING (stratum)),
w AS (SELECT quality, share * (1 / p) / sum(1 / p) OVER (PARTITION BY stratum) AS w FROM p)
SELECT count(*) AS n_records, round(sum(w * quality) / sum(w), 6) AS estimate, round(sum(w) * sum(w) / sum(w * w), 4) AS ess FROM w
""")
def q_quality_hajek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stratified Hajek precision and effective sample size; strata are languages."""
    from sedimenta.operators.estimators import hajek

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("stratum"))
    frame = docs.groupBy("stratum").agg(F.count("*").alias("n"))
    sampled = table(spark, sf_dir, "labels").select("doc_id", "quality").join(docs, "doc_id")
    taken = sampled.groupBy("stratum").agg(F.count("*").alias("taken"))
    whole = frame.agg(F.sum("n").alias("whole"))
    strata = frame.join(taken, "stratum").join(whole).select("stratum", (F.col("taken") / F.col("n")).alias("p"), (F.col("n") / F.col("whole")).alias("share"))
    rows = sampled.join(strata, "stratum").select("stratum", "share", "p", (F.col("quality") == 1).alias("supported"))
    return hajek(rows).select("n_records", F.round("estimate", 6).alias("estimate"), F.round("ess", 4).alias("ess"))


@query("""
WITH g AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, sum(quality) AS good, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY source),
n AS (SELECT count(*) AS k FROM g),
d AS (SELECT r.range AS rep, ('0x' || substr(sha256('seed-1' || chr(0) || r.range || chr(0) || 'all' || chr(0) || j.range), 1, 16))::UBIGINT % k AS i
      FROM range(200) r, n, range(1000) j WHERE j.range < k),
e AS (SELECT rep, sum(good)::DOUBLE / sum(n) AS estimate FROM d JOIN g USING (i) GROUP BY 1)
SELECT round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, round(avg(estimate), 6) AS mean FROM e
""")
def q_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grouped bootstrap whose draws are hashes; sources are the groups."""
    from sedimenta.operators.estimators import bootstrap_groups

    groups = table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("unit")).agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    return bootstrap_groups(groups.withColumn("stratum", F.lit("all")), "seed-1", 200).agg(F.round(F.percentile("estimate", 0.025), 6).alias("low"), F.round(F.percentile("estimate", 0.975), 6).alias("high"), F.round(F.avg("estimate"), 6).alias("mean"))


@query("""
WITH t AS (SELECT c_custkey, count(o_orderkey) * 100 AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT c_custkey, total, unnest(range(1, ceil(total / 250)::INT + 1)) AS page FROM t)
SELECT c_custkey, count(*) AS page_count, max(total) AS total, sum(least(250, total - (page - 1) * 250))::BIGINT AS returned, bool_and(total < 4000) AS fits,
       sum(least(250, total - (page - 1) * 250)) = max(total) AS reconciled FROM p GROUP BY 1
""")
def q_page_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 250 up to a cap of 4000, and their reconciliation with the total."""
    from sedimenta.operators.planning import page_plan

    totals = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") * 100).alias("total"))
    pages = page_plan(totals, "c_custkey", "total")
    return pages.groupBy("c_custkey").agg(F.count("*").alias("page_count"), F.max("total").alias("total"), F.sum("expected").alias("returned"), F.bool_and("fits").alias("fits")).withColumn("reconciled", F.col("returned") == F.col("total"))


@query("""
SELECT count(*) AS row_count, min(v) AS low, max(v) AS high, round(quantile_cont(v, 0.25), 6) AS q25, round(median(v), 6) AS q50, round(quantile_cont(v, 0.9), 6) AS q90,
       round(log10(max(v) + 1), 6) AS log_scale, round(sqrt(max(v)), 6) AS root_scale FROM (SELECT o_totalprice AS v FROM orders)
""")
def q_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact linear quantiles and visual scales."""
    from sedimenta.operators.estimators import exact_quantiles

    orders = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("v"))
    found = exact_quantiles(orders, "v", {"q25": 0.25, "q50": 0.5, "q90": 0.9})
    ends = orders.agg(F.count("*").alias("row_count"), F.min("v").alias("low"), F.max("v").alias("high"))
    rounded = [F.round(q, 6).alias(q) for q in ("q25", "q50", "q90")]
    return ends.join(found).select("row_count", "low", "high", *rounded, F.round(F.log10(F.col("high") + 1), 6).alias("log_scale"), F.round(F.sqrt("high"), 6).alias("root_scale"))


@query("""
SELECT scope, o_orderkey, o_totalprice FROM (
  SELECT o_orderstatus AS scope, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1
""")
def q_arg_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of the highest value, ties to the smallest key."""
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_totalprice", -F.col("o_orderkey")))
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("scope")).agg(best.alias("b")).select("scope", "b.o_orderkey", "b.o_totalprice")


@query("""
WITH g AS (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT least(n // 10, 9) AS band, count(*) AS suppliers, sum(n)::BIGINT AS lines FROM g GROUP BY 1)
SELECT band, suppliers, lines, (sum(lines) OVER (ORDER BY band))::BIGINT AS running, round(lines / (sum(lines) OVER ())::DOUBLE, 6) AS share FROM b
""")
def q_group_of_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate of an aggregate, then a running sum over its ten bands at most."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    bands = per.groupBy(F.least(F.floor(F.col("n") / 10), F.lit(9)).alias("band")).agg(F.count("*").alias("suppliers"), F.sum("n").alias("lines"))
    return bands.select("band", "suppliers", "lines", F.sum("lines").over(Window.orderBy("band")).alias("running"), F.round(F.col("lines") / F.sum("lines").over(Window.partitionBy()), 6).alias("share"))

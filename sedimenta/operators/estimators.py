"""Survey and agreement estimators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.session import materialize

#: The normal quantile of a 95 % interval, the prior of an accuracy, the least counts for an estimate.
Z95 = 1.959963984540054
PRIOR_RIGHT, PRIOR_WRONG = 15.0, 5.0
LEAST = {"control_attempts": 20, "positive_controls": 5, "negative_controls": 5, "overlap_items": 10, "adjudicated_overlap": 5}
#: Fixed value: controls of a class from which on sensitivity and specificity are given.
CLASS = 10
#: Probability designs of an audit, and the method of its inclusion probabilities.
DESIGNS, INCLUSION = ("simple_random", "stratified_random", "clustered_random"), "hajek_inverse_inclusion_probability_v1"


def krippendorff_alpha(ratings: DataFrame) -> DataFrame:
    """Ratings (item, code) to one row (item_count, rating_count, alpha); alpha is null for under two items or no variation.

    Sums of squares per item and per code give both disagreements, so no pair of ratings is made. Items with one
    rating and null codes don't count.
    """
    n = ratings.where(F.col("item").isNotNull() & F.col("code").isNotNull()).groupBy("item", "code").agg(F.count("*").alias("n"))
    items = n.groupBy("item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m >= 2")
    observed = items.agg(F.count("*").alias("item_count"), F.sum("m").alias("rating_count"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    codes = n.join(items.select("item"), "item", "left_semi").groupBy("code").agg(F.sum("n").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("csq"))
    total = F.col("rating_count").cast("double")
    expected = (total * total - F.col("csq")) / (total * (total - 1))
    alpha = F.when((F.col("item_count") >= 2) & (expected > 2.220446049250313e-16), 1 - (F.col("d") / total) / expected)
    return observed.join(codes).select("item_count", F.coalesce("rating_count", F.lit(0).cast("long")).alias("rating_count"), alpha.alias("alpha"))


def hajek(rows: DataFrame) -> DataFrame:
    """Decisive records (stratum, share, p, supported) to n_records, estimate, ess. Null with no record.

    The weight of a record is its stratum's share, spread by 1 / p within the stratum. The stratum's sum comes from an
    aggregate and a join, so a large stratum isn't one window.
    """
    sums = rows.groupBy("stratum").agg(F.sum(1 / F.col("p")).alias("inverse"))
    w = rows.join(sums, "stratum").select("supported", (F.col("share") / F.col("p") / F.col("inverse")).alias("w"))
    total, hit = F.sum("w"), F.sum(F.when(F.col("supported"), F.col("w")).otherwise(0.0))
    return w.agg(F.count("*").alias("n_records"), F.try_divide(hit, total).alias("estimate"), F.try_divide(total * total, F.sum(F.col("w") * F.col("w"))).alias("ess"))


def exact_quantiles(rows: DataFrame, value: str, at: dict[str, float]) -> DataFrame:
    """One row with linearly interpolated quantiles of a numeric column, by name (F36); null for no value.

    The values are range-partitioned; counts of the parts tell which parts hold the ranks asked for, and only these are
    numbered. Nulls don't count.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL")
    v = materialize(v.repartitionByRange(parts, "v").withColumn("part", F.spark_partition_id()), "values")
    counts = v.groupBy("part").agg(F.count("*").alias("n"))  # a row for each part
    counts = counts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).withColumn("total", F.sum("n").over(Window.partitionBy()))
    place = {n: (F.col("total") - 1) * F.lit(float(p)) for n, p in at.items()}
    within = lambda k: (k >= F.col("before")) & (k < F.col("before") + F.col("n"))
    wanted = F.lit(False)
    for k in place.values():
        wanted = wanted | within(F.floor(k)) | within(F.ceil(k))
    few = v.join(counts.where(wanted), "part")
    few = few.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    low, high = {n: pick(F.floor(k)) for n, k in place.items()}, {n: pick(F.ceil(k)) for n, k in place.items()}
    share = {n: F.max(k - F.floor(k)) for n, k in place.items()}
    return few.agg(*[(low[n] + (high[n] - low[n]) * share[n]).alias(n) for n in at])


def hash_index(parts: list[Column], n: Column) -> Column:
    """The first 8 bytes of SHA-256 over NUL-joined parts, as an unsigned number modulo n."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    return (F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)") % n).cast("long")


def unit_hash(parts: list[Column]) -> Column:
    """A deterministic number from 0 to 1."""
    digest = F.sha2(F.concat_ws("\0", *parts), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1))


def bootstrap_groups(groups: DataFrame, seed: str, replicates: int = 2000) -> DataFrame:
    """Sampling units (stratum, unit, good, n) to rep, estimate: each replicate draws as many units as a stratum has.

    Draws are hashes of seed, replicate, stratum and draw, so reruns agree. Units are few (groups, not records); a
    replicate's draws are made beside the unit list and joined to it by index.
    """
    order = Window.partitionBy("stratum").orderBy("unit")
    units = groups.withColumn("i", F.row_number().over(order) - 1)
    sizes = units.groupBy("stratum").agg(F.count("*").alias("k"))
    draws = sizes.select("stratum", "k", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).select("stratum", "k", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("draw"))
    index = hash_index([F.lit(seed), F.col("rep").cast("string"), F.col("stratum"), F.col("draw").cast("string")], F.col("k"))
    return draws.select("stratum", "rep", index.alias("i")).join(units, ["stratum", "i"]).groupBy("rep").agg((F.sum("good") / F.sum("n")).alias("estimate"))


def accuracy(right: Column, total: Column) -> Column:
    """Posterior mean, interval and weight of an accuracy (F35): struct(mean, low, high, weight)."""
    a, b = right + PRIOR_RIGHT, total - right + PRIOR_WRONG
    mean = a / (a + b)
    sd = F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    weight = F.greatest(F.lit(0.5), F.least(F.lit(2.0), 1 + (mean - 0.75) / 0.25))
    return F.struct(mean.alias("mean"), F.greatest(F.lit(0.0), mean - Z95 * sd).alias("low"), F.least(F.lit(1.0), mean + Z95 * sd).alias("high"), weight.alias("weight"))


def alpha_by(ratings: DataFrame, by: str) -> DataFrame:
    """Nominal Krippendorff's alpha of each group: ratings (by, item, code) to by, alpha; null as in krippendorff_alpha()."""
    n = ratings.where("item IS NOT NULL AND code IS NOT NULL").groupBy(by, "item", "code").agg(F.count("*").alias("n"))
    items = n.groupBy(by, "item").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.col("n")).alias("sq")).where("m >= 2")
    observed = items.groupBy(by).agg(F.count("*").alias("items"), F.sum("m").alias("total"), F.sum((F.col("m") * F.col("m") - F.col("sq")) / (F.col("m") - 1)).alias("d"))
    codes = n.join(items.select(by, "item"), [by, "item"], "left_semi").groupBy(by, "code").agg(F.sum("n").alias("t"))
    squares = codes.groupBy(by).agg(F.sum(F.col("t") * F.col("t")).alias("csq"))
    total = F.col("total").cast("double")
    expected = (total * total - F.col("csq")) / (total * (total - 1))
    alpha = F.when((F.col("items") >= 2) & (expected > 2.220446049250313e-16), 1 - (F.col("d") / total) / expected)
    return observed.join(squares, by).select(by, alpha.alias("alpha"))


def reliability(controls: DataFrame, overlaps: DataFrame) -> DataFrame:
    """Reviewer metrics (A20, D6) from controls (reviewer, expected, actual) and overlaps (reviewer, item, label, peers array, adjudicated or null).

    A metric is null where its denominator is 0, sensitivity and specificity below CLASS controls of their class. The
    estimate, its interval and the weight are null until every count of LEAST is reached; blockers names those below.
    """
    yes, no, right = F.col("expected") == "yes", F.col("expected") == "no", F.col("expected") == F.col("actual")
    c = controls.groupBy("reviewer").agg(
        F.count("*").alias("control_attempts"), F.count_if(yes).alias("positive_controls"), F.count_if(no).alias("negative_controls"), F.count_if(right).alias("c_right"),
        F.count_if(yes & right).alias("tp"), F.count_if(no & right).alias("tn"),
    )
    settled = F.col("adjudicated").isNotNull()
    agree = F.size(F.filter("peers", lambda p: p == F.col("label")))
    o = overlaps.groupBy("reviewer").agg(
        F.count("*").alias("overlap_items"), F.sum(F.size("peers")).alias("pairs"), F.sum(agree).alias("agreeing"), F.count_if(settled).alias("adjudicated_overlap"),
        F.count_if(settled & (F.col("adjudicated") == F.col("label"))).alias("a_right"),
    )
    ratings = overlaps.select("reviewer", "item", F.explode(F.concat(F.array("label"), "peers")).alias("code"))
    counts = ["control_attempts", "positive_controls", "negative_controls", "c_right", "tp", "tn", "overlap_items", "pairs", "agreeing", "adjudicated_overlap", "a_right"]
    rows = c.join(o, "reviewer", "full").na.fill(0, counts).join(alpha_by(ratings, "reviewer"), "reviewer", "left")
    blockers = F.array_sort(F.array_compact(F.array(*[F.when(F.col(n) < least, F.lit(f"{n}_below_minimum")) for n, least in LEAST.items()])))
    posterior = accuracy(F.col("c_right") + F.col("a_right"), F.col("control_attempts") + F.col("adjudicated_overlap"))
    rows = rows.withColumn("blockers", blockers).withColumn("posterior", F.when(F.size("blockers") == 0, posterior))
    return rows.select(
        "reviewer", *LEAST, F.try_divide("c_right", "control_attempts").alias("control_accuracy"), F.try_divide("agreeing", "pairs").alias("pairwise_agreement"),
        F.try_divide("a_right", "adjudicated_overlap").alias("adjudicated_accuracy"), F.when(F.col("positive_controls") >= CLASS, F.col("tp") / F.col("positive_controls")).alias("sensitivity"),
        F.when(F.col("negative_controls") >= CLASS, F.col("tn") / F.col("negative_controls")).alias("specificity"), "alpha", "blockers",
        F.col("posterior.mean").alias("estimate"), F.col("posterior.low").alias("low"), F.col("posterior.high").alias("high"), F.col("posterior.weight").alias("weight"),
    )


def audit_blockers(plans: DataFrame, strata: DataFrame, records: DataFrame) -> DataFrame:
    """plan, blockers: what keeps an audit from estimating a population (D7, G7); empty if nothing does.

    Plans: plan, kind, design, representative, blind, method, grouping_keys. Strata: plan, stratum, weight, population.
    Records: plan, record, stratum, p, owner, observation, outcome. A targeted plan has that one blocker. Records that
    share an owner or an observation are one group, which must not cross strata: here neighbours by either key
    are compared, which finds a crossing in every group that has one.
    """
    fault = lambda name, rule: F.when(rule, F.lit(name))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    of_plan = plans.select("plan", F.explode(F.array_compact(F.array(
        fault("sampling_design_is_not_probability_based", no(F.col("design").isin(*DESIGNS))), fault("sampling_plan_not_representative", no(F.col("representative"))),
        fault("audit_not_blind", no(F.col("blind"))), fault("inclusion_probability_method_missing_or_unsupported", no(F.col("method") == INCLUSION)),
        fault("owner_grouping_key_missing", no(F.array_contains("grouping_keys", "owner_id"))), fault("observation_grouping_key_missing", no(F.array_contains("grouping_keys", "observation_id"))),
    ))).alias("blocker"))
    named = lambda name: F.concat(F.lit(f"{name}:"), "record")
    of_record = records.select("plan", F.explode(F.array_compact(F.array(
        F.when(no((F.col("p") > 0) & (F.col("p") <= 1)), named("invalid_inclusion_probability")), F.when(F.col("owner").isNull(), named("owner_group_missing")),
        F.when(F.col("observation").isNull(), named("observation_group_missing")),
    ))).alias("blocker"))
    decisive = records.where(F.col("outcome").isin("supported", "not_supported")).select("plan", "stratum").distinct()
    empty = strata.join(decisive, ["plan", "stratum"], "left_anti").select("plan", F.concat(F.lit("stratum_without_decisive_reviews:"), "stratum").alias("blocker"))
    crossing = None
    for key in ("owner", "observation"):
        some = records.where(F.col(key).isNotNull()).groupBy("plan", key).agg(F.countDistinct("stratum").alias("n")).where("n > 1").select("plan", F.lit("owner_observation_group_crosses_strata").alias("blocker"))
        crossing = some if crossing is None else crossing.union(some)
    w = strata.groupBy("plan").agg(F.count("*").alias("n"), F.count("weight").alias("n_weights"), F.sum("weight").alias("total"), F.count("population").alias("n_sizes"))
    weights = (
        F.when((F.col("n_weights") == F.col("n")) & (F.abs(F.col("total") - 1) > 1e-9), "stratum_population_weights_do_not_sum_to_one")
        .when((F.col("n_weights") > 0) & (F.col("n_weights") < F.col("n")), "stratum_population_weights_partially_declared")
        .when((F.col("n_weights") == 0) & (F.col("n_sizes") < F.col("n")), "stratum_population_sizes_missing")
    )
    weighed = w.select("plan", weights.alias("blocker")).where("blocker IS NOT NULL")
    faults = of_plan.union(of_record).union(empty).union(crossing).union(weighed).groupBy("plan").agg(F.array_sort(F.collect_set("blocker")).alias("blockers"))
    targeted = F.array(F.lit("targeted_failure_discovery_is_not_population_representative"))
    found = plans.select("plan", "kind").join(faults, "plan", "left")
    return found.select("plan", F.when(F.col("kind") == "targeted_failure_discovery", targeted).otherwise(F.coalesce("blockers", F.array().cast("array<string>"))).alias("blockers"))

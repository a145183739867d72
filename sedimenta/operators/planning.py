"""Request planning (L3, L4, T9, F24-F29, D11, D14, A32): pages, partitions, lanes, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.session import materialize

#: Rows of a page, results that one query can page through.
PAGE, CAP = 250, 4000
#: Degrees of a box that is cut no further.
SMALLEST = 0.000001


def page_plan(totals: DataFrame, key: str, total: str, page: int = PAGE, cap: int = CAP) -> DataFrame:
    """A row for each page (from 1) with the rows expected on it; fits: the total stays below the cap (F26). Totals of 0 or null plan none."""
    n = F.col(total)
    pages = totals.where(n > 0).select(key, n.alias("total"), F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(n / page))).alias("page"))
    return pages.withColumns({"expected": F.least(F.lit(page), F.col("total") - (F.col("page") - 1) * page), "fits": F.col("total") < cap})


def bisect(parts: DataFrame) -> DataFrame:
    """Partitions (id, west, south, east, north, from_s, to_s; seconds inclusive) to two halves each.

    Time splits first: from..mid and mid+1..to, so that no second is counted twice. One second splits by the longer side
    of its box, whose halves share their border. A box of SMALLEST degrees is an error.
    """
    by_time = F.col("from_s") < F.col("to_s")
    width, height = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    by_x = ~by_time & (width >= height)
    by_y = ~by_time & (width < height)
    small = ~by_time & (F.greatest(width, height) <= SMALLEST)
    name = F.when(small, F.raise_error(F.concat(F.lit("no smaller partition: "), "id")).cast("string")).otherwise(F.col("id"))
    t = F.col("from_s") + F.floor((F.col("to_s") - F.col("from_s")) / 2)
    x, y = (F.col("west") + F.col("east")) / 2, (F.col("south") + F.col("north")) / 2
    cut = lambda column, where, value: F.when(where, value).otherwise(F.col(column)).alias(column)
    first = F.struct(F.concat_ws("/", name, F.lit("0")).alias("id"), "west", "south", cut("east", by_x, x), cut("north", by_y, y), "from_s", cut("to_s", by_time, t))
    second = F.struct(F.concat_ws("/", name, F.lit("1")).alias("id"), cut("west", by_x, x), cut("south", by_y, y), "east", "north", cut("from_s", by_time, t + 1), "to_s")
    return parts.select(F.inline(F.array(first, second)))


def adaptive_partitions(parts: DataFrame, count, cap: int = CAP) -> DataFrame:
    """Split partitions until each counts below the cap (T9). count(parts) gives parts with a column total.

    For counts that only a provider can tell; halving ends at the smallest box, with bisect()'s error. Where the points are
    at hand, pyramid_partitions() counts them once.
    """
    done, open_ = None, parts
    while True:
        counted = materialize(count(open_), "partitions")
        fit = counted.where(F.col("total") < cap)
        done = fit if done is None else done.union(fit)
        open_ = bisect(counted.where(F.col("total") >= cap).drop("total"))
        if not open_.limit(1).count():
            return done


def pyramid_partitions(points: DataFrame, second: str, value: str, seconds: tuple[int, int], values: tuple[float, float], halvings: int = 12, cap: int = CAP) -> DataFrame:
    """Points to partitions below the cap: path, n, from_s, to_s, low, high and state.

    A path is the halves that lead to a partition: time first, from..mid and mid+1..to, down to a second, then the value's
    range, where a point at the middle lies in the lower half, `halvings` times. Points are counted once, in the smallest
    boxes; their counts add up to those of all boxes above, and a box below the cap whose parent isn't is a
    partition. So nothing is counted again, however deep it goes. state: fits, or saturated for a smallest box that still
    isn't below the cap. Boxes without points don't come out. Points without a time or value, or outside the ranges, are in no
    partition.
    """
    (first, last), (low, high) = seconds, values
    depth = max(0, last - first).bit_length()
    start = F.struct(F.lit("").alias("path"), F.lit(first).cast("long").alias("a"), F.lit(last).cast("long").alias("b"), F.lit(low).cast("double").alias("c"), F.lit(high).cast("double").alias("d"))

    def descend(by_time: bool):  # noqa: ANN202
        def step(s, right):  # noqa: ANN001, ANN202
            t, v = s["a"] + F.floor((s["b"] - s["a"]) / 2), (s["c"] + s["d"]) / 2
            put = lambda here, x, old: F.when(here, x).otherwise(old)
            if by_time:
                out = F.struct(F.concat(s["path"], F.when(right, "1").otherwise("0")).alias("path"), put(right, t + 1, s["a"]).alias("a"), put(right, s["b"], t).alias("b"), s["c"].alias("c"), s["d"].alias("d"))
                return F.when(s["a"] < s["b"], out).otherwise(s)
            return F.struct(F.concat(s["path"], F.when(right, "1").otherwise("0")).alias("path"), s["a"].alias("a"), s["b"].alias("b"), put(right, v, s["c"]).alias("c"), put(right, s["d"], v).alias("d"))

        return step

    time_step, value_step = descend(True), descend(False)
    at, x = F.col(second).cast("long"), F.col(value).cast("double")
    of_time = F.aggregate(F.sequence(F.lit(1), F.lit(max(depth, 1))), start, lambda s, _: time_step(s, at > s["a"] + F.floor((s["b"] - s["a"]) / 2)))
    of_value = F.aggregate(F.sequence(F.lit(1), F.lit(max(halvings, 1))), F.col("__t"), lambda s, _: value_step(s, x > (s["c"] + s["d"]) / 2)) if halvings else F.col("__t")
    inside = points.where(at.between(first, last) & x.between(low, high))
    finest = inside.select(of_time.alias("__t"), F.col(value)).select(F.col("__t.path").alias("of_time"), of_value["path"].alias("path")).groupBy("path", "of_time").agg(F.count("*").alias("n"))
    # a time path is shorter than others where its second comes sooner, so a smallest box is known by its time's length
    up = F.transform(F.sequence(F.lit(0), F.length("path")), lambda k: F.struct(F.substring("path", F.lit(1), k).alias("path"), (k == F.length("path")).alias("smallest"), F.least(k, F.length("of_time")).alias("of_time")))
    boxes = finest.select(F.explode(up).alias("b"), "n").groupBy("b.path", "b.smallest", "b.of_time").agg(F.sum("n").alias("n"))
    boxes = materialize(boxes, "pyramid")
    full = boxes.where(F.col("n") >= cap).select(F.col("path").alias("parent"))
    beneath = F.when(F.length("path") > 0, F.substring("path", F.lit(1), F.length("path") - 1))
    fits = boxes.where(F.col("n") < cap).withColumn("parent", beneath)
    fits = fits.where("parent IS NULL").drop("parent").union(fits.join(full, "parent", "left_semi").drop("parent")).withColumn("state", F.lit("fits"))
    out = fits.union(boxes.where(F.col("smallest") & (F.col("n") >= cap)).withColumn("state", F.lit("saturated")))
    halves = F.split(F.substring("path", F.lit(1), F.col("of_time")), ""), F.split(F.substring("path", F.col("of_time") + 1, F.length("path")), "")
    box = F.aggregate(F.filter(halves[0], lambda c: c != ""), start, lambda s, c: time_step(s, c == "1"))
    out = out.withColumn("__box", box).withColumn("__box", F.aggregate(F.filter(halves[1], lambda c: c != ""), F.col("__box"), lambda s, c: value_step(s, c == "1")))
    return out.select("path", "n", F.col("__box.a").alias("from_s"), F.col("__box.b").alias("to_s"), F.col("__box.c").alias("low"), F.col("__box.d").alias("high"), "state")


def weighted_score(parts: list[tuple[float, Column]]) -> Column:
    """A weighted mean over the observed components; null if none is observed."""
    seen = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for w, x in parts), F.lit(0.0))
    total = sum((F.coalesce(x * w, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    return F.when(seen > 0, total / seen)


def age_score(age_s: Column, horizon_s: float) -> Column:
    """1 at age 0, 0 from the horizon on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age_s / horizon_s))


def lane_top_k(rows: DataFrame, lane: str, score: str, key: str, slots: Column) -> DataFrame:
    """The best rows of each lane by score, ties to the smaller key; slots may depend on the lane."""
    order = Window.partitionBy(lane).orderBy(F.col(score).desc_nulls_last(), key)
    return rows.withColumn("schedule_rank", F.row_number().over(order)).where(F.col("schedule_rank") <= slots)


def candidate_state(
    calls: Column, unique_per_call: Column, positive_yield: Column, low_windows: Column, last_s: Column, now_s: Column,
    least_calls: int, low_unique: float, low_positive: float, stop_windows: int, cooldown_h: float,
) -> Column:
    """struct(state, next_s) of a candidate (D11, T6): eligible, cooldown_low_yield or stopped_low_yield.

    Low yield is proven by enough calls, few unique media a call (known) and few positives (or none known). Enough low
    windows in a row stop it; else it cools down from its last query on.
    """
    low = (calls >= least_calls) & F.coalesce(unique_per_call <= low_unique, F.lit(False)) & F.coalesce(positive_yield <= low_positive, F.lit(True))
    until = last_s + F.lit(int(cooldown_h * 3600))
    state = F.when(low & (low_windows >= stop_windows), "stopped_low_yield").when(low & (now_s < until), "cooldown_low_yield").otherwise("eligible")
    return F.struct(state.alias("state"), F.when(state == "cooldown_low_yield", until).alias("next_s"))


def age_need(last_s: Column, now_s: Column, horizon_h: float) -> Column:
    """How long ago a candidate was queried, as a share of a horizon from 0 to 1; 1 if it never was."""
    return F.when(last_s.isNull(), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (now_s - last_s) / 3600 / horizon_h)))


def retry_jitter(execution: Column, attempt: Column) -> Column:
    """From 0.5 to 1, by a hash of the execution and the attempt."""
    digest = F.sha2(F.concat(execution, F.lit(":"), attempt.cast("string")), 256)
    return 0.5 + F.conv(F.substring(digest, 1, 16), 16, 10).cast("double") / F.lit(float(2**64 - 1)) * 0.5


def retry(
    budget: Column, status: Column, attempt: Column, execution: Column, retry_after: Column, most: int = 3, base_s: int = 2, longest_s: int = 300,
    again: tuple[int, ...] = (429, 500, 502, 503, 504),
) -> Column:
    """struct(status, reason, next_attempt, delay_s) of a failed attempt, counted from 0.

    A send whose outcome is uncertain blocks until its accounting is reconciled; one that didn't use the budget isn't
    retried; the last attempt is exhausted. The delay is the larger of a jittered 2^attempt and Retry-After.
    """
    exponential = F.least(base_s * F.pow(F.lit(2.0), attempt.cast("double")), F.lit(float(longest_s)))
    delay = F.greatest(F.ceil(exponential * retry_jitter(execution, attempt + 1)), F.coalesce(retry_after.cast("long"), F.lit(0)))
    what = (
        F.when(budget == "uncertain", F.array(F.lit("blocked_accounting_reconciliation"), F.lit("uncertain_send_may_have_reached_provider")))
        .when(~budget.eqNullSafe(F.lit("consumed")), F.array(F.lit("not_retryable"), F.lit("no_consumed_provider_attempt")))
        .when(attempt >= most, F.array(F.lit("exhausted"), F.lit("maximum_retry_attempts_reached")))
        .when(F.coalesce(status.isin(*again), F.lit(False)), F.array(F.lit("scheduled"), F.lit("retryable_http_status")))
        .otherwise(F.array(F.lit("not_retryable"), F.lit("response_not_retryable")))
    )
    scheduled = what[0] == "scheduled"
    return F.struct(what[0].alias("status"), what[1].alias("reason"), F.when(scheduled, attempt + 1).alias("next_attempt"), F.when(scheduled, delay).alias("delay_s"))

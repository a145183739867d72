"""Recursive and graph operators (G1-G10, J11, J22): components, chains, tree orders and intervals, cycles, descendants.

Loops keep their state in tables and stop when nothing changes; the driver sees counts only. Tables of a few bytes a row look
small enough to broadcast when they aren't, so joins of two large ones are told to sort ("merge").
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import materialize, release

from .ordering import placed, running_totals


def components(edges: DataFrame) -> DataFrame:
    """Edges (a long, b long) to rows (node, component): the smallest node that each node of an edge reaches.

    A round gives every node the least label of its neighbours and then its label's own label, so the rounds grow with
    the logarithm of a component's diameter at best and with the diameter at worst. A hub's edges are one row a task
    in the aggregate, and its join can be split. Null ends and edges of a node to itself give no links; an empty table
    gives an empty result.
    """
    ends = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull()).select("a", "b")
    both = materialize(ends.union(ends.select("b", "a")).toDF("u", "v").where("u <> v").distinct(), "edges")
    table = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("next")), "labels")
    while True:
        labels = table.select("node", F.col("next").alias("label"))
        heard = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("label").alias("heard"))
        near = labels.join(heard, F.col("node") == F.col("u"), "left").select("node", "label", F.least("label", "heard").alias("near"))
        jump = labels.select(F.col("node").alias("of"), F.col("label").alias("further"))
        moved = near.join(jump, F.col("near") == F.col("of"), "left").select("node", "label", F.least("near", "further").alias("next"))
        last, table = table, materialize(moved, "labels")
        release(last)
        if not table.where("label <> next").limit(1).count():
            release(both)
            found = table.select("node", F.col("next").alias("component"))
            found._table_path = table._table_path  # so that release() finds it
            return found


def chains(nodes: DataFrame, with_path: bool = False) -> DataFrame:
    """Rows (node, parent; null at roots), each node once, to node, root, depth and state.

    state: rooted, missing_parent (root is the topmost ancestor, whose parent isn't a node) or cycle (no ancestor without a
    parent: root and depth are null). with_path adds the nodes from the root down, null in cycles. Each round doubles how
    far a node has climbed, so a chain of any length takes as many rounds as its logarithm; without paths a node's state
    is a few values. A parent of many nodes is one row of the join, whose other side can be split. Only nodes that still climb
    are joined in a round, as those at their end would share the key null, and with it a task.
    """
    link = nodes.select("node", "parent")
    known = link.select(F.col("node").alias("known"))
    below = link.where("parent IS NOT NULL").join(known.hint("merge"), F.col("parent") == F.col("known"), "left")
    first = below.union(link.where("parent IS NULL").select("node", "parent", F.col("parent").alias("known")))
    there = F.col("known").isNotNull()
    rows = first.select(
        "node", F.when(there, F.col("parent")).alias("up"), F.when(there, 1).otherwise(0).cast("long").alias("depth"), F.when(~there, F.col("node")).alias("root"),
        F.when(F.col("parent").isNull(), "rooted").when(~there, "missing_parent").alias("state"), *([F.array("node").alias("path")] if with_path else []),
    )
    rows, reach = materialize(rows, "chains"), 1
    total = rows.count()
    while rows.where("up IS NOT NULL").limit(1).count():
        if reach > total:  # whoever climbs on has met a node twice
            open_ = F.col("up").isNotNull()
            own = lambda c: F.when(~open_, F.col(c)).alias(c)
            kept = [own("root"), own("depth"), F.when(open_, "cycle").otherwise(F.col("state")).alias("state"), *([own("path")] if with_path else [])]
            return rows.select("node", *kept)
        above = rows.select(F.col("node").alias("of"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("root").alias("top"), F.col("state").alias("end"), *([F.col("path").alias("head")] if with_path else []))
        moved = rows.where("up IS NOT NULL").join(above.hint("merge"), F.col("up") == F.col("of")).select(
            "node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), F.col("top").alias("root"), F.col("end").alias("state"), *([F.concat("head", "path").alias("path")] if with_path else [])
        )
        last, rows, reach = rows, materialize(moved.union(rows.where("up IS NULL")), "chains"), 2 * reach
        release(last)
    return rows.select("node", "root", "depth", "state", *(["path"] if with_path else []))


def lineages(nodes: DataFrame) -> DataFrame:
    """Adjacency (node, parent; null at roots) to node, depth, path (root first) and state, by chains()."""
    return chains(nodes, with_path=True).select("node", "depth", "path", "state")


def tree_faults(nodes: DataFrame) -> DataFrame:
    """fault, n: what keeps (node, parent) from being one tree (G2): missing_parent and cycle count nodes, other roots than one count them."""
    found = chains(nodes)
    wrong = found.where("state <> 'rooted'").groupBy(F.col("state").alias("fault")).agg(F.count("*").alias("n"))
    roots = found.where("state = 'rooted' AND depth = 0").agg(F.count("*").alias("n")).where("n <> 1").select(F.when(F.col("n") == 0, "no_root").otherwise("several_roots").alias("fault"), "n")
    return wrong.union(roots)


def preorder(nodes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Rows (node, parent) of trees to node, parent, pre (from 0, parents first, siblings by `order` and node), size (of the subtree) and depth.

    The descendants of a node are those with pre in [pre + 1, pre + size). Every node is entered and left once on a tour;
    a step knows the next, and the steps' sums to the end of the tour are found by doubling (list ranking), in as many
    rounds as the logarithm of the tour. Siblings are neighbours in a range-sorted order, so a node may have any number of
    them. Several roots follow each other. Nodes that no root reaches (cycles, missing parents) have no row.
    """
    order = order or []
    good = chains(nodes).where("state = 'rooted'").select("node")
    rows = nodes.select("node", "parent", *[F.col(c).alias(f"__{c}") for c in order]).join(good.hint("merge"), "node", "left_semi")
    keys = ["parent", *[f"__{c}" for c in order], "node"]
    rows = materialize(placed(rows, keys).select("node", "parent", "place"), "siblings")
    after = rows.select(F.col("node").alias("sibling"), F.col("parent").alias("of"), (F.col("place") - 1).alias("place"))
    first = rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("of_parent")).agg(F.min_by("node", "place").alias("child"))
    known = rows.join(after.hint("merge"), (rows.place == after.place) & rows.parent.eqNullSafe(after.of), "left").select("node", "parent", "sibling")
    known = known.join(first.hint("merge"), F.col("node") == F.col("of_parent"), "left").select("node", "parent", "sibling", "child")
    total = rows.count()
    step = lambda leaves, to, to_leaves, enters: F.struct(F.lit(leaves).alias("leaves"), to.alias("to"), to_leaves.alias("to_leaves"), F.lit(enters).cast("long").alias("enters"), F.lit(1 if enters else -1).cast("long").alias("climbs"))
    into = step(False, F.coalesce("child", "node"), F.col("child").isNull(), 1)
    out = step(True, F.coalesce("sibling", "parent"), F.col("sibling").isNull(), 0)
    tour, reach = materialize(known.select("node", F.inline(F.array(into, out))), "tour"), 1
    while reach < 2 * total:  # steps that have come to the end are left as they are, as in chains()
        ahead = tour.select(F.col("node").alias("to"), F.col("leaves").alias("to_leaves"), F.col("to").alias("next"), F.col("to_leaves").alias("next_leaves"), F.col("enters").alias("more"), F.col("climbs").alias("rise"))
        add = lambda a, b: (F.col(a) + F.col(b)).alias(a)
        moved = tour.where("to IS NOT NULL").join(ahead.hint("merge"), ["to", "to_leaves"]).select("node", "leaves", F.col("next").alias("to"), F.col("next_leaves").alias("to_leaves"), add("enters", "more"), add("climbs", "rise"))
        last, tour, reach = tour, materialize(moved.union(tour.where("to IS NULL")), "tour"), 2 * reach
        release(last)
    sums = tour.groupBy("node").agg(F.max(F.when(~F.col("leaves"), F.col("enters"))).alias("from_in"), F.max(F.when(F.col("leaves"), F.col("enters"))).alias("from_out"), (-F.max(F.when(~F.col("leaves"), F.col("climbs")))).alias("depth"))
    return rows.select("node", "parent").join(sums.hint("merge"), "node").select("node", "parent", (total - F.col("from_in")).alias("pre"), (F.col("from_in") - F.col("from_out")).alias("size"), "depth")


def totals_below(tree: DataFrame, facts: DataFrame, values: list[str]) -> DataFrame:
    """Rows of preorder() and facts (node, values) to node and values: their sums over the node and all below it.

    Facts add up along pre once, and a subtree is the difference of two places of that sum: no path is unfolded.
    """
    own = facts.groupBy("node").agg(*[F.sum(v).alias(v) for v in values])
    rows = tree.join(own.hint("merge"), "node", "left").select("node", "pre", "size", *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
    sums = materialize(running_totals(rows, ["pre"], values), "running")
    ends = sums.select(F.col("pre").alias("last"), *[F.col(f"total_{v}").alias(f"end_{v}") for v in values])
    return sums.join(ends.hint("merge"), F.col("pre") + F.col("size") - 1 == F.col("last")).select("node", *[(F.col(f"end_{v}") - F.col(f"total_{v}") + F.col(v)).alias(v) for v in values])


#: So many intervals, with some 50 blocks each at most, are sent to every task.
FEW = 1000


def contained(intervals: DataFrame, points: DataFrame, low: str = "low", high: str = "high", at: str = "at") -> DataFrame:
    """Pairs of intervals [low, high) and points within them (J11, G4): the columns of both, whose names differ.

    A range join on equal keys: an interval is cut into at most two blocks of each power of two, and a point lies in one
    block of each. Bounds and points are whole numbers from 0; nulls and empty intervals meet nothing. A point comes once for
    each power of two up to the largest bound, so points are never broadcast: up to FEW intervals are, and more are sorted with them.
    """
    top, n = intervals.agg(F.max(high), F.count("*")).first()
    top = top or 0
    levels = max(1, int(top).bit_length() + 1)
    block = "array<struct<level:int,block:bigint>>"

    def cut(s, level):  # noqa: ANN001, ANN202
        a, b = s["a"], s["b"]
        odd_a, odd_b = (a < b) & (a % 2 == 1), (a < b) & (b % 2 == 1)
        some = F.array_compact(F.array(F.when(odd_a, F.struct(level.alias("level"), a.alias("block"))), F.when(odd_b, F.struct(level.alias("level"), (b - 1).alias("block")))))
        return F.struct(F.shiftright(a + odd_a.cast("long"), 1).alias("a"), F.shiftright(b - odd_b.cast("long"), 1).alias("b"), F.concat(s["out"], some).alias("out"))

    start = F.struct(F.col(low).cast("long").alias("a"), F.col(high).cast("long").alias("b"), F.array().cast(block).alias("out"))
    blocks = F.aggregate(F.sequence(F.lit(0), F.lit(levels)), start, cut, lambda s: F.array_distinct(s["out"]))
    left = intervals.where(F.col(low) < F.col(high)).select("*", F.explode(blocks).alias("__b")).select("*", "__b.level", "__b.block").drop("__b")
    places = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright(F.col(at).cast("long"), k).alias("block")) for k in range(levels + 1)])
    right = points.where(F.col(at).isNotNull()).select("*", F.explode(places).alias("__b")).select("*", "__b.level", "__b.block").drop("__b")
    left = F.broadcast(left) if n <= FEW else left.hint("merge")
    return left.join(right, ["level", "block"]).drop("level", "block")


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Edges (parent, child) and roots (node) to node, depth: all that the roots reach, nearest depth.

    A frontier loop: each round joins the frontier with the edges and drops what was seen, so cycles end. A round writes
    its own nodes only.
    """
    fronts = [materialize(roots.select("node").distinct().withColumn("depth", F.lit(0)), "frontier")]
    while fronts[-1].limit(1).count():
        seen = reduce(DataFrame.union, fronts).select("node")
        fresh = fronts[-1].join(edges, F.col("node") == F.col("parent")).select(F.col("child").alias("node")).distinct()
        fronts.append(materialize(fresh.join(seen, "node", "left_anti").withColumn("depth", F.lit(len(fronts))), "frontier"))
    found = materialize(reduce(DataFrame.union, fronts), "descendants")
    release(*fronts)
    return found


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes on or behind a cycle: leaves (no child left) are removed until none is."""
    rows = materialize(edges.select("parent", "child").distinct(), "edges")
    n = rows.count()
    while True:
        kept = materialize(rows.join(rows.select(F.col("parent").alias("child")).distinct(), "child", "left_semi").select("parent", "child"), "edges")
        release(rows)
        last, n = n, kept.count()
        if n == last:
            return kept.select(F.col("parent").alias("node")).distinct()
        rows = kept


def quarantine(table: DataFrame, edges: DataFrame, roots: DataFrame, id_col: str = "node") -> DataFrame:
    """A new version of a table whose state is `quarantined` for the roots and all that descends from them."""
    hit = descendants(edges, roots).select(F.col("node").alias("__hit"))
    return table.join(hit, F.col(id_col) == F.col("__hit"), "left").withColumn("state", F.when(F.col("__hit").isNotNull(), "quarantined").otherwise(F.col("state"))).drop("__hit")


def topological_order(edges: DataFrame) -> DataFrame:
    """node, level: the longest path from a source; ordering by (level, node) is a valid order (G5). ValueError on cycles."""
    if cyclic_nodes(edges).limit(1).count():
        raise ValueError("the graph has a cycle")
    nodes = edges.select(F.col("parent").alias("node")).union(edges.select("child")).distinct()
    table = materialize(nodes.select("node", F.lit(0).alias("level"), F.lit(0).alias("next")), "levels")
    while True:
        level = table.select("node", F.col("next").alias("level"))
        up = edges.join(level, F.col("parent") == F.col("node")).groupBy(F.col("child").alias("c")).agg((F.max("level") + 1).alias("least"))
        moved = materialize(level.join(up, F.col("node") == F.col("c"), "left").select("node", "level", F.greatest("level", "least").alias("next")), "levels")
        release(table)
        table = moved
        if not table.where("next <> level").limit(1).count():
            return table.select("node", F.col("next").alias("level"))

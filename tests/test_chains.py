"""Chains, tree orders, ranges, replays and partitions against loops."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from sedimenta.functions.text import json_number
from sedimenta.operators import graph, ordering, planning, replay


@pytest.fixture
def rounds(monkeypatch):
    """Tables that graph.py writes, by tag."""
    seen = {}
    old = graph.materialize

    def counted(df, tag):
        seen[tag] = seen.get(tag, 0) + 1
        return old(df, tag)

    monkeypatch.setattr(graph, "materialize", counted)
    return seen


def test_a_chain_of_a_hundred_thousand_takes_few_rounds(spark, rounds):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    got = graph.chains(df).agg(F.count_if((F.col("depth") == F.col("node")) & (F.col("root") == 0) & (F.col("state") == "rooted")).alias("right"), F.count("*").alias("n")).first()
    assert (got.right, got.n) == (n, n)
    assert rounds["chains"] <= 20


def test_chains_tell_cycles_and_missing_parents(spark):
    links = {"r": None, "a": "r", "b": "a", "x": "y", "y": "z", "z": "x", "tail": "x", "self": "self", "m": "gone", "n": "m", "deep0": "b"} | {f"deep{i}": f"deep{i - 1}" for i in range(1, 90)}
    df = spark.createDataFrame(list(links.items()), "node string, parent string")
    got = {r.node: (r.root, r.depth, r.state) for r in graph.chains(df).collect()}
    paths = {r.node: r.path for r in graph.lineages(df).collect()}
    for node in links:
        path, state = [node], None
        while state is None:
            up = links[path[0]]
            state = "rooted" if up is None else "missing_parent" if up not in links else "cycle" if up in path else None
            if state is None:
                path.insert(0, up)
        want = (None, None, "cycle") if state == "cycle" else (path[0], len(path) - 1, state)
        assert got[node] == want and paths[node] == (None if state == "cycle" else path)
    assert {(r.fault, r.n) for r in graph.tree_faults(df).collect()} == {("cycle", 5), ("missing_parent", 2)}
    none = spark.createDataFrame([], df.schema)
    assert graph.chains(none).collect() == [] and {(r.fault, r.n) for r in graph.tree_faults(none).collect()} == {("no_root", 0)}


def forest(n, seed):
    r = random.Random(seed)
    return {i: (None if i < 2 else r.randrange(max(0, i - 6), i) if i < n // 2 else 1, r.randrange(3)) for i in range(n)}


@pytest.mark.parametrize("n", [1, 2, 60])
def test_preorder_is_a_walk(spark, n):
    links = forest(n, n)
    df = spark.createDataFrame([(i, p, o) for i, (p, o) in links.items()] + [(100, 101, 0), (101, 100, 0), (102, 999, 0)], "node long, parent long, ordinal int")
    want, pre = {}, 0

    def walk(node, depth):
        nonlocal pre
        at, pre = pre, pre + 1
        for child in sorted((i for i, (p, _) in links.items() if p == node), key=lambda i: (links[i][1], i)):
            walk(child, depth + 1)
        want[node] = (links[node][0], at, pre - at, depth)

    for root in sorted((i for i, (p, _) in links.items() if p is None), key=lambda i: (links[i][1], i)):
        walk(root, 0)
    tree = graph.preorder(df, ["ordinal"])
    assert {r.node: (r.parent, r.pre, r.size, r.depth) for r in tree.collect()} == want
    facts = spark.createDataFrame([(i, i * 10) for i in links] + [(0, 1), (7777, 5)], "node long, n long")
    below = {r.node: r.n for r in graph.totals_below(tree, facts, ["n"]).collect()}
    assert below == {i: sum(10 * j for j in want if want[i][1] <= want[j][1] < want[i][1] + want[i][2]) + (want[i][1] <= want[0][1] < want[i][1] + want[i][2]) for i in want}


def test_preorder_of_nothing(spark):
    assert graph.preorder(spark.createDataFrame([], "node long, parent long")).collect() == []


def test_contained_is_the_nested_loop(spark):
    r = random.Random(2)
    intervals = [(i, a, a + r.randrange(0, 90)) for i, a in enumerate(r.randrange(0, 500) for _ in range(60))] + [(90, 0, 1024), (91, None, 5), (92, 7, 7), (93, 1023, 1024)]
    points = [(i, r.randrange(0, 700)) for i in range(200)] + [(900, None), (901, 1023), (902, 0)]
    left, right = spark.createDataFrame(intervals, "i long, low long, high long"), spark.createDataFrame(points, "p long, at long")
    pairs = graph.contained(left, right)
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()
    got = [(x.i, x.p) for x in pairs.collect()]
    assert sorted(got) == sorted((i, p) for (i, a, b), (p, x) in product(intervals, points) if None not in (a, b, x) and a <= x < b)
    assert graph.contained(left.where("false"), right).collect() == []


@pytest.mark.parametrize("parts", [1, 7])
def test_places_and_totals_over_partitions(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice([None, "a", "b"]), i, r.randrange(10)) for i in range(300)]
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        df = spark.createDataFrame(rows, "k string, i long, v long")
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or "", x[1]))
        assert {x.i: x.place for x in ordering.placed(df, ["k", "i"]).collect()} == {x[1]: n + 1 for n, x in enumerate(order)}
        totals = {x.i: x.total_v for x in ordering.running_totals(df, ["i"], ["v"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert totals == {i: sum(x[2] for x in rows if x[1] <= i) for _, i, _ in rows}


@pytest.mark.parametrize("block", [2, 5, 256])
def test_replay_is_the_fold(spark, block):
    r = random.Random(block)
    actions = [*replay.MODERATION_ACTIONS[:-1]] * 3 + ["case_closed", "unknown", None]
    rows = [(r.choice(["a", "b", "hot", "hot", None]), i, r.choice(actions)) for i in range(300)]
    rows += [("hot", 1000 + i, r.choice(replay.MODERATION_ACTIONS[:9])) for i in range(100)]
    df = spark.createDataFrame(rows, "case string, seq long, what string").withColumns({"at": F.lit("x"), "group": F.lit(1), "code": F.lit(1)})
    got = {x.seq: (x.refused, x.visibility, x.membership, x.audit, x.appeal, x.closed) for x in replay.replay_moderation(df, "case", ["seq"], "what", block=block).collect()}
    state, want = {}, {}
    for case, seq, what in sorted(rows, key=lambda x: x[1]):
        now = state.get(case, replay.MODERATION_STATES[0])
        to = replay.moderate(now, what) if what in replay.MODERATION_ACTIONS else None
        state[case] = to or now
        want[seq] = (to is None, *state[case])
    assert got == want
    assert replay.replay_moderation(df.where("false"), "case", ["seq"], "what").collect() == []


def test_states_are_never_broadcast(spark):
    df = spark.range(50).select(F.lit("one").alias("case"), "id", F.lit(0).alias("code"))
    done = replay.replay(df, "case", ["id"], "code", [[1, replay.REFUSED]])
    assert done.count() == 50 and "BroadcastHashJoin" not in done._jdf.queryExecution().executedPlan().toString()


def test_a_case_of_a_million_commands(spark):
    n = 1_000_000
    tables = [[1, replay.REFUSED], [replay.REFUSED, 0]]  # on, off
    df = spark.range(n).select(F.lit("one").alias("case"), F.col("id").alias("seq"), (F.col("id") * 7 % 10 % 2).alias("code"))
    got = replay.replay(df, "case", ["seq"], "code", tables).agg(F.count("*").alias("n"), F.count_if("refused").alias("refused"), F.max_by("after", "seq").alias("last")).first()
    on = refused = 0
    for i in range(n):
        code = i * 7 % 10 % 2
        refused += code == 1 - on
        on = 1 - code
    # code 0 turns on, code 1 turns off
    assert (got.n, got.last) == (n, on)
    state = bad = 0
    for i in range(n):
        to = tables[i * 7 % 10 % 2][state]
        bad += to == replay.REFUSED
        state = state if to == replay.REFUSED else to
    assert (got.refused, got.last) == (bad, state)


def test_pyramid_partitions_are_halvings(spark):
    r = random.Random(6)
    points = [(r.choice([r.randrange(0, 100), 50]), r.choice([r.random() * 8, 4.0])) for _ in range(400)] + [(50, 1.0)] * 30 + [(500, 1.0), (None, 1.0), (3, None)]
    df = spark.createDataFrame(points, "t long, v double")

    def cut(path, a, b, c, d, inside, halvings):
        if len(inside) < 9 or (a == b and halvings == 3):
            return [(path, len(inside), a, b, c, d, "fits" if len(inside) < 9 else "saturated")] if inside else []
        if a < b:
            m = a + (b - a) // 2
            return cut(path + "0", a, m, c, d, [p for p in inside if p[0] <= m], 0) + cut(path + "1", m + 1, b, c, d, [p for p in inside if p[0] > m], 0)
        h = (c + d) / 2
        return cut(path + "0", a, b, c, h, [p for p in inside if p[1] <= h], halvings + 1) + cut(path + "1", a, b, h, d, [p for p in inside if p[1] > h], halvings + 1)

    good = [p for p in points if None not in p and p[0] <= 99]
    want = cut("", 0, 99, 0.0, 8.0, good, 0)
    got = planning.pyramid_partitions(df, "t", "v", (0, 99), (0.0, 8.0), 3, 9).collect()
    assert sorted(tuple(x) for x in got) == sorted(want) and sum(x.n for x in got) == len(good)
    assert {x.state for x in got} == {"fits", "saturated"}
    whole = planning.pyramid_partitions(df, "t", "v", (0, 99), (0.0, 8.0), 3, 10**6).collect()
    assert [(x.path, x.n, x.from_s, x.to_s) for x in whole] == [("", len(good), 0, 99)]


def test_deeper_than_32_halvings(spark):
    parts = spark.createDataFrame([("p", 0.0, 0.0, 1.0, 1.0, 0, 2**40)], "id string, west double, south double, east double, north double, from_s long, to_s long")
    times = [2**39 + 5, 2**39 + 6]

    def count(df):
        return df.withColumn("total", sum((F.lit(t).between(F.col("from_s"), F.col("to_s")).cast("long") for t in times), F.lit(0).cast("long")))

    done = planning.adaptive_partitions(parts, count, cap=2).where("total > 0").collect()
    assert sorted((x.from_s <= times[0] <= x.to_s, x.from_s <= times[1] <= x.to_s) for x in done) == [(False, True), (True, False)]


def test_numbers_have_the_fewest_digits(spark):
    import struct

    r = random.Random(1)
    values = [v for v in (struct.unpack("<d", struct.pack("<Q", r.getrandbits(64)))[0] for _ in range(100_000)) if v == v and abs(v) != float("inf")]
    values += [k * 5e-324 for k in range(1, 500)] + [10.0**k for k in range(-323, 309)] + [2.0**k for k in range(-1074, 1024)] + [r.randint(1, 10**9) / 100 for _ in range(5000)]
    got = [x[0] for x in spark.createDataFrame([(v,) for v in values], "x double").select(json_number(F.col("x"))).collect()]
    for v, text in zip(values, got, strict=True):
        digits = lambda s: s.lower().lstrip("-").split("e")[0].replace(".", "").strip("0")
        assert float(text) == v and digits(text) == digits(repr(v)), (v, text)


def test_points_are_never_broadcast(spark):
    """However small their table looks: each is a row for every power of two."""
    few = spark.createDataFrame([(i, i, i + 5) for i in range(10)], "i long, low long, high long")
    many = spark.range(graph.FEW + 1).select(F.col("id").alias("i"), F.col("id").alias("low"), (F.col("id") + 5).alias("high"))
    points = spark.range(50).select(F.col("id").alias("p"), F.col("id").alias("at"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [level" in plan(graph.contained(few, points)) and "BuildLeft" in plan(graph.contained(few, points))
    assert "SortMergeJoin [level" in plan(graph.contained(many, points)) and "Broadcast" not in plan(graph.contained(many, points))


def test_nodes_at_their_end_take_no_part_in_a_round(spark, monkeypatch):
    """They would share the key null, and with it a task."""
    plans = {}
    old = graph.materialize

    def seen(df, tag):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return old(df, tag)

    monkeypatch.setattr(graph, "materialize", seen)
    df = spark.range(40).select(F.col("id").alias("node"), F.when(F.col("id") % 4 > 0, F.col("id") - 1).alias("parent"))
    assert graph.chains(df).where("depth = node % 4 AND root = node - node % 4 AND state = 'rooted'").count() == 40
    assert graph.preorder(df).where("pre = node AND size = 4 - node % 4 AND depth = node % 4").count() == 40
    for plan in plans["chains"][1:3] + plans["tour"][1:]:
        assert "Join Inner" in plan and "Join LeftOuter" not in plan


def test_first_rows_shuffle_once(spark):
    from sedimenta.operators.sampling import CUT, first_rows

    df = spark.range(3000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 3000).alias("v"), F.col("id").cast("string").alias("tie"))
    plan = lambda n: first_rows(df, ["k"], n, [F.col("v").desc()], "tie", "nth")._jdf.queryExecution().executedPlan().toString()
    assert plan(5).count("Exchange hash") == 1 and "WindowGroupLimit" in plan(5).split("Exchange hash")[1]
    assert plan(CUT + 1).count("Exchange hash") == 2
    assert sorted(tuple(x) for x in first_rows(df, ["k"], 2, [F.col("v").desc()], "tie", "nth").select("k", "nth", "v").collect()) == sorted(
        (k, n + 1, v) for k in range(3) for n, v in enumerate(sorted((i * 7919 % 3000 for i in range(k, 3000, 3)), reverse=True)[:2])
    )


def test_shared_requests_broadcast_nothing(spark):
    from sedimenta.plans.views import q_shared_requests

    plan = q_shared_requests(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan

"""Operators on small hand-written inputs."""

import io
import json
import random
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from sedimenta.functions import geo, text
from sedimenta.operators import decisions, estimators, graph, ledger, planning, sampling
from sedimenta.plans import load_all
from sedimenta.plans.registry import RULES
from sedimenta.plans.rules import PICKS
from sedimenta.sources import files, sinks
from sedimenta.streaming import budget

load_all()

def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_text_functions(spark):
    r = one(
        spark, blank=text.optional_text(F.lit("  \t")), kept=text.optional_text(F.lit(" a ")), nan=text.optional_float(F.lit("NaN")), inf=text.optional_float(F.lit("inf")), num=text.optional_float(F.lit(" 1.5 ")),
        year=text.leading_year(F.lit("2001-02")), no_year=text.leading_year(F.lit("2001/02")), enc=text.percent_encode(F.lit("a b~*é")), by=text.licence_code(F.lit("http://creativecommons.org/licenses/by-nc/4.0/")),
        zero=text.licence_code(F.lit("CC0")), named=text.licence_code(F.lit("CC-BY 4.0")), other=text.licence_code(F.lit("mine")), slug=text.slug(F.lit(" A b/C ")), json=text.canonical_json(b=F.lit(1), a=F.lit(None).cast("string")),
        flag=text.strict_bool(F.lit("True")), parts=text.split_list(F.lit(" a || b ")), tz=text.utc_time(F.lit("2024-01-01T00:00:00")).isNull(), jpg=text.media_type(F.unhex(F.lit("FFD8FFE0"))),
        ext=text.external_id(F.lit("https://www.example.org/photos/123?x=1"), "example.org", "photos"), after=text.retry_after_s(F.lit("Thu, 01 Jan 1970 00:01:00 GMT"), F.lit(10)),
    )
    assert (r.blank, r.kept, r.nan, r.inf, r.num, r.year, r.no_year) == (None, "a", None, None, 1.5, 2001, None)
    assert (r.enc, r.by, r.zero, r.named, r.other, r.slug) == ("a%20b~%2A%C3%A9", "cc-by-nc-4.0", "cc0-1.0", "cc-by-4.0", None, "a-b-c")
    assert (r.json, r.flag, r.parts, r.tz, r.jpg, r.ext, r.after) == ('{"a":null,"b":1}', True, ["a", "b"], True, "image/jpeg", "123", 50)
    for bad in (text.strict_bool(F.lit("maybe")), text.split_list(F.lit("a|a"))):
        with pytest.raises(Exception, match="no boolean|repeated part"):
            one(spark, x=bad)


def test_grid(spark):
    r = one(spark, c=geo.cell(F.lit(90.0), F.lit(180.0), 1), p=geo.parent(F.lit("g1:95:10"), 1, 5), out=geo.cell(F.lit(91.0), F.lit(0.0), 1), box=geo.bbox_text(F.lit(1.5), F.lit(-2.0), F.lit(3.0), F.lit(0.0)), mid=geo.centre(F.lit("g1:90:180"), 1))
    assert (r.c, r.p, r.out, r.box, tuple(r.mid)) == ("g1:179:359", "g5:19:2", None, "1.5,-2,3,0", (0.5, 0.5))


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6), (7, 7), (None, 9)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5)}
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r.component for r in graph.components(path).collect()} == {0}
    n = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("x", "y"), ("y", "x"), ("m", "gone")], "node string, parent string")
    assert {r.node: (r.depth, r.state) for r in graph.lineages(n).where("node <> 'y'").collect()} == {"r": (0, "rooted"), "a": (1, "rooted"), "b": (2, "rooted"), "x": (None, "cycle"), "m": (0, "missing_parent")}
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")], "parent string, child string")
    assert {(r.node, r.depth) for r in graph.descendants(d, spark.createDataFrame([("a",)], "node string")).collect()} == {("a", 0), ("b", 1), ("d", 1), ("c", 2)}
    assert {r.node for r in graph.cyclic_nodes(d).collect()} == {"a", "b", "c"}
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "parent string, child string")
    assert {r.node: r.level for r in graph.topological_order(dag).collect()} == {"a": 0, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="cycle"):
        graph.topological_order(d)


def test_estimators(spark):
    ratings = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b"), (3, "b"), (4, "x")], "item long, code string")
    assert estimators.krippendorff_alpha(ratings).first().alpha == pytest.approx(1 - (2 / 6) / ((36 - 18) / 30))
    assert estimators.krippendorff_alpha(ratings.where("item = 1")).first().alpha is None
    rows = spark.createDataFrame([("s", 0.5, 0.1, True), ("s", 0.5, 0.1, False), ("t", 0.5, 0.2, True)], "stratum string, share double, p double, supported boolean")
    h = estimators.hajek(rows).first()
    assert (h.estimate, h.ess) == (pytest.approx(0.75), pytest.approx(1 / (2 * 0.25**2 + 0.5**2)))
    a = one(spark, x=estimators.accuracy(F.lit(10.0), F.lit(10.0))).x
    assert (a.mean, a.weight) == (pytest.approx(25 / 30), pytest.approx(1 + (25 / 30 - 0.75) / 0.25))


def test_planning(spark):
    parts = spark.createDataFrame([("p", 0.0, 0.0, 4.0, 2.0, 0, 1000)], "id string, west double, south double, east double, north double, from_s long, to_s long")
    found = planning.adaptive_partitions(parts, lambda p: p.withColumn("total", (F.col("to_s") - F.col("from_s") + 1) * 10)).collect()
    spans = sorted((r.from_s, r.to_s) for r in found)
    assert spans[0][0] == 0 and spans[-1][1] == 1000 and all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905
    dot = spark.createDataFrame([("p", 0.0, 0.0, 1e-7, 1e-7, 5, 5)], parts.schema)
    with pytest.raises(Exception, match="no smaller partition"):
        planning.bisect(dot).collect()
    assert one(spark, s=planning.weighted_score([(0.5, F.lit(1.0)), (0.5, F.lit(None).cast("double"))])).s == 1.0


def test_decisions(spark):
    g = spark.createDataFrame([("a", "x", "pass"), ("a", "y", "pass"), ("b", "x", "pass"), ("c", "x", "pass"), ("c", "y", "fail"), ("c", "z", "pass")], "s string, gate string, state string")
    got = {r.s: (r.decision, r.blockers) for r in decisions.complete_gates(g, "s", "gate", "state", ("x", "y")).collect()}
    assert got == {"a": ("release", []), "b": ("blocked", ["missing:y"]), "c": ("blocked", ["unknown:z", "y"])}
    v = spark.createDataFrame([(1,), (None,)], "x long").select(decisions.available(F.col("x"), "not measured").alias("x"))
    assert decisions.shape_violations(v, "x").count() == 0
    m = spark.createDataFrame([("draft", "submit", 1, 1), ("draft", "submit", 2, 1), ("done", "submit", 1, 1)], "state string, action string, rev long, seen long")
    out = decisions.next_state(m, "state", "action", "rev", "seen", [("draft", "submit", "review")]).collect()
    assert sorted((r.next_state, r.refused or "") for r in out) == [("done", "illegal"), ("draft", "stale"), ("review", "")]


def test_ledger(spark):
    e = spark.createDataFrame([(1, None, "k"), (2, 1, "k"), (3, 9, "k"), (4, 2, "j")], "id long, old long, who string")
    assert {r.id for r in ledger.effective(e, "id", "old").collect()} == {3, 4}
    assert {(r.id, r.violation) for r in ledger.supersession_violations(e, "id", "old", ["who"]).collect()} == {(3, "target_missing"), (4, "identity_changed")}
    assert {r.id for r in ledger.append_idempotent(e.where("id < 3"), e, "id").collect()} == {3, 4}
    s = spark.createDataFrame([("a", 1), ("a", 3), ("b", 2)], "g string, seq long")
    assert {(r.g, r.seq) for r in ledger.sequence_gaps(s, "g", "seq").collect()} == {("a", 3), ("b", 2)}


def brute_quota(rows, per_group, per_observer):
    """The turns one by one: rows (group, media, observation, observer, score)."""
    pools = {}
    for g, m, o, who, score in rows:
        old = pools.setdefault(g, {}).get(o)
        if old is None or (-score, m) < (-old[2], old[0]):
            pools[g][o] = (m, (who or "").strip(), score)
    used, seen, taken, out = {}, {g: set() for g in pools}, set(), []
    for turn in range(1, per_group + 1):
        for g in sorted(pools):
            free = [r for r in pools[g].values() if (g, r[0]) not in taken and not (r[1] and used.get(r[1], 0) >= per_observer)]
            best = min([r for r in free if r[1] not in seen[g]] or free, key=lambda r: (-r[2], r[0]), default=None)
            if best:
                taken.add((g, best[0]))
                if best[1]:
                    seen[g].add(best[1])
                    used[best[1]] = used.get(best[1], 0) + 1
                out.append((g, best[0], turn))
    return out


def test_round_robin_quota(spark):
    r = random.Random(3)
    for _ in range(2):
        rows = [(f"g{r.randrange(4)}", f"m{i:03d}", f"o{r.randrange(60)}", r.choice(["a", "b", "c", " ", None]), float(r.randrange(5))) for i in range(120)]
        df = spark.createDataFrame(rows, "g string, m string, o string, who string, score double")
        for depth in (1, None):  # from one observer on, with more when they are taken
            got = sampling.round_robin_quota(df, "g", "o", "who", "m", [F.col("score").desc()], per_group=6, per_observer=4, depth=depth).collect()
            assert sorted((x.g, x.m, x.turn) for x in got) == sorted(brute_quota(rows, 6, 4))
    assert RULES["q_rule_quota"](spark, "").count() == len(brute_quota([(t, m, o, who, s) for t, m, o, who, s in PICKS.rows], 5, 4))


def test_sources_and_sinks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", '﻿id,"Common name"\n1,"a, ""b"""\n2,\n')
        z.writestr("headings.csv", "name,heading\nname,Common name\n")
    assert [tuple(r)[1:] for r in files.read_zip_csv(spark, f"file://{tmp_path}/a.zip", ["id", "name"]).collect()] == [(1, "1", 'a, "b"'), (2, "2", None)]
    with tarfile.open(tmp_path / "s.tar.gz", "w:gz") as t:
        body = json.dumps({"pages": [{"returned": 3}, {"returned": 4}]}).encode()
        info = tarfile.TarInfo("x/state.json")
        info.size = len(body)
        t.addfile(info, io.BytesIO(body))
    assert files.read_states(spark, f"file://{tmp_path}/s.tar.gz").first().returned == 7
    (tmp_path / "r.txt").write_text("Dataset: A\nother\nRights as supplied: free\nDataset: B\nRights as supplied: none\n")
    assert {tuple(r) for r in files.read_pairs(spark, f"file://{tmp_path}/r.txt").collect()} == {("A", "free"), ("B", "none")}
    (tmp_path / "t.tsv").write_text('a\tb\tc\n1\t"x\t\n')
    assert tuple(files.read_tsv(spark, f"file://{tmp_path}/t.tsv", ["a", "b", "c"], ["b", "c"]).first()) == ('"x', None)
    (tmp_path / "e.xml").write_text("<eml><dataset><alternateIdentifier>u</alternateIdentifier><alternateIdentifier>10.1/x</alternateIdentifier><title> T </title></dataset></eml>")
    e = files.read_eml(spark, f"file://{tmp_path}/e.xml").first()
    assert (e.title, e.doi, e.licence) == ("T", "10.1/x", None)
    df = spark.range(100).select("id", (F.col("id") % 3).cast("string").alias("v"))
    sinks.write_sorted(df, f"file://{tmp_path}/out", "id", rows=10)
    assert files.read_checked(spark, f"file://{tmp_path}/out", ["id"], 100).count() == 100
    with pytest.raises(ValueError, match="manifest"):
        files.read_checked(spark, f"file://{tmp_path}/out", ["id"], 99)
    assert sinks.archive_bytes({"b": "1", "a": "2"}) == sinks.archive_bytes({"a": "2", "b": "1"})


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:20:00", "a"), (3, "2024-01-01 00:30:00", "b"), (4, "2024-01-01 05:00:00", "a")], "work_id long, ts string, lane_name string")
    events.withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = lambda: spark.readStream.schema("work_id long, ts timestamp, lane_name string").parquet(f"file://{tmp_path}/in")
    q = budget.stream_hour_budget(stream(), {"a": 1}, F.col("lane_name")).writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.lane, r.used, r.granted, r.frozen) for r in spark.table("budget").collect()} == {("a", 2, 1, True), ("b", 1, 0, True)}
    for run in range(2):  # a replay appends nothing
        q = stream().writeStream.foreachBatch(budget.journal_sink(f"file://{tmp_path}/journal", "work_id")).option("checkpointLocation", f"file://{tmp_path}/c{run}").trigger(availableNow=True).start()
        q.awaitTermination(60)
    journal = lambda: spark.read.parquet(f"file://{tmp_path}/journal")
    assert journal().count() == 4
    sink = budget.journal_sink(f"file://{tmp_path}/journal", "work_id")
    first = journal().first()
    other = journal().where(F.col("work_id") == first.work_id).limit(1).withColumn("lane_name", F.lit("changed"))
    for bad in (other, journal().limit(1).withColumn("work_id", F.lit(77).cast("long")).union(other.withColumn("work_id", F.lit(77).cast("long"))), journal().limit(1).withColumn("work_id", F.lit(None).cast("long"))):
        with pytest.raises(ValueError):
            sink(bad, 9)
    assert journal().count() == 4


def test_tools(spark):
    from sedimenta.operators import tools

    a, b = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "k string, v int"), spark.createDataFrame([("y", 3), ("z", None), ("w", 1)], "k string, v int")
    assert {r.k: r.state for r in tools.compare_sources(a, b, "k", "v").collect()} == {"x": "only_a", "y": "differ", "z": "agree", "w": "only_b"}
    s = tools.species(a.select("k"), spark.createDataFrame([("x", 5)], "k string, n long"), "k", "y").first().records
    assert (s.status, s.value, s.reason) == ("unavailable", None, "no count for this species")
    n = spark.createDataFrame([("r", None), ("a", "r")], "node string, parent string")
    assert [(r.place, r.ancestor) for r in tools.trace(n, "a").collect()] == [(0, "r"), (1, "a")]
    beats = spark.createDataFrame([("w1", 100), ("w2", 900)], "worker string, observed_s long")
    assert {r.worker: r.presence for r in tools.worker_status(beats, 1000).collect()} == {"w1": "offline", "w2": "online"}
    e = spark.createDataFrame([("me", "s1", "sp", ["c1", "c2"]), ("me", "s1", "sp", ["c2"]), ("you", "s2", "sp", ["c3"])], "reviewer string, subject string, species string, cells array<string>")
    assert tuple(tools.contribution(e, "me").first()) == (2, 1, 1, 2)
    assert one(spark, x=text.normalised(F.lit("Ａß")), y=text.normalised(F.lit("AB"))) == ("ass", "ab")


def test_read_tools_by_identity(spark):
    from sedimenta.operators import tools

    n = spark.createDataFrame([("r", None), ("a", "r"), ("x", "y"), ("y", "x"), ("z", "gone")], "node string, parent string")
    assert {k: (r.state, r.depth) for k in "axz" for r in [tools.trace(n, k).first()]} == {"a": ("rooted", 1), "x": ("cycle", 1), "z": ("missing_parent", 0)}
    c = spark.createDataFrame([("k", True, None), ("j", True, True)], "candidate string, rights boolean, date boolean")
    assert tools.candidate(c, "k").first().blockers == ["date"] and tools.candidate(c, "j").first().blockers == []
    m = spark.createDataFrame([("m", "a", "old", 0.1, 1), ("m", "a", "new", None, 2)], "media string, model string, label string, score double, recorded_s long")
    got = tools.classification(m, "m").first()
    assert (got.label, got.score.status) == ("new", "unavailable")
    s = spark.createDataFrame([("p", "committed"), ("p", "failed"), ("q", "waiting")], "stage string, state string")
    assert [(r.stage, r["items"], r.failed) for r in tools.pipeline_status(s).collect()] == [("p", 2, 1), ("q", 1, 0)]
    e = tools.envelope(s, "pipeline_status")
    assert json.loads(e.first().result)[0] == {"stage": "p", "state": "committed"} and e.first().fingerprint == tools.envelope(s.repartition(3), "pipeline_status").first().fingerprint
    with pytest.raises(ValueError, match="limit"):
        tools.envelope(s, "pipeline_status", limit=50)


def test_quantiles_and_tables_that_go(spark):
    import numpy as np

    from sedimenta import session

    values = [float(x) for x in np.random.default_rng(1).integers(0, 50, 333)]
    df = spark.createDataFrame([(x,) for x in [*values, None]], "x double")
    got = estimators.exact_quantiles(df, "x", {"a": 0.0, "b": 0.123, "c": 0.5, "d": 1.0}).first()
    assert list(got) == pytest.approx([np.quantile(values, q) for q in (0.0, 0.123, 0.5, 1.0)])
    assert list(estimators.exact_quantiles(df.where("false"), "x", {"a": 0.5}).first()) == [None]
    t = session.materialize(df, "t")
    assert t.count() == 334
    session.release(t, df)
    with pytest.raises(Exception, match="(?i)not exist|no such file|PATH_NOT_FOUND|FILE"):
        spark.read.schema("x double").parquet(t._table_path).count()

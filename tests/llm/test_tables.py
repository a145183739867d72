"""Operators 5, 7, 8, 10 and the pipeline: brute force, round trips, edges."""

import base64
import gzip
import hashlib
import importlib.util
import io
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import common, mixing, near_dedup, topk, warc


# --- exact top-k


def brute_top_k(rows, queries, k):
    fit = {i: [int(x) for x in np.floor(64 * np.array(v, dtype=float))] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = set()
    for q in queries:
        if q in fit:
            best = sorted((-sum(a * b for a, b in zip(fit[q], v, strict=True)), i) for i, v in fit.items() if i != q and len(v) == len(fit[q]))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    return out


@pytest.mark.parametrize("scale", [1, 2e4, 1e6])
def test_top_k_is_brute_force(spark, scale):
    r = np.random.default_rng(5)
    rows = [(i, [float(x) for x in np.round(r.normal(size=16) * scale, 1)]) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(40)]  # ties
    rows += [(3000, None), (3001, [None] * 16), (3002, [float("nan")] * 16), (3003, [float("inf")] * 16), (3004, [1.0, 2.0]), (3006, [2.0, 1.0]), (3007, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(1), "block": F.lit(1)})
    got = topk.top_k(df, F.col("vec_id") % 100 == 4, 20).collect()
    assert {tuple(x) for x in got} == brute_top_k(rows, [i for i, _ in rows if i is not None and i % 100 == 4], 20)
    assert topk.top_k(df.where("false"), F.lit(True), 5).collect() == []


def test_branch_and_bound_computes_less_than_all_products():
    r = np.random.default_rng(6)
    dims, k = 64, 20
    # embeddings as models give them: most of their mass in few directions
    spread = 2.0 ** -np.arange(0, 16, 0.25)
    c = np.floor(64 * r.normal(size=(4096, dims)) * spread).T.astype(np.float32)
    q = c[:, :256].copy()
    work, kth = [], np.full(256, -np.inf)
    at, ids, score = topk.search_block(np.arange(256) + 10**6, q, np.arange(4096), c, k, kth, 1e7, work=work)
    exact = q.T @ c
    for i in range(256):
        order = np.lexsort((np.arange(4096), -exact[i]))[:k]
        assert ids[at == i].tolist() == order.tolist() and score[at == i].tolist() == exact[i][order].tolist()
    assert sum(work) < 0.5 * 256 * 4096 * dims
    # a block that can't reach the k-th best costs nothing
    work = []
    assert len(topk.search_block(np.arange(256) + 10**6, q, np.arange(4096), c / 1024, k, kth, 1e7, work=work)[0]) == 0 and sum(work) == 0


def test_vectors_under_one_query_id_are_ranked_together(spark):
    rows = [(4, [1.0, 0.0]), (4, [0.0, 2.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("vec_id") == 4, 3, scale=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(6, 2), (5, 1), (5, 0)]


# --- near duplicates


def brute_components(docs):
    sets = {}
    for i, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[i] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    of = {i: i for i in docs}

    def top(i):
        while of[i] != i:
            i = of[i]
        return i

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                of[y] = x
    return {i: (len(sets[i]), top(i)) for i in docs}


def near_copies(n=160, words=60):
    r = np.random.default_rng(11)
    word = lambda: "".join(r.choice(list("abcdefgh"), 5))
    base = [word() for _ in range(words)]
    docs = {}
    for i in range(n):
        w = list(base)
        for _ in range(int(r.integers(0, 4))):
            w[int(r.integers(words))] = word()
        docs[1000 + i] = " ".join(w)
    chain = [word() for _ in range(80)]
    for i in range(12):  # each like the next, the ends unlike each other
        docs[2000 + i] = " ".join(chain[i * 4 : i * 4 + 50])
    for i in range(60):  # half of each is a shared passage
        docs[3000 + i] = " ".join(base[:30] + [word() for _ in range(30)])
    return docs


def test_salted_join_deals_hot_keys(spark):
    # a third of all rows is one key's, some keys are over a thousandth, others rare, and some are on one side only
    rows = spark.range(9000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.floor(F.sqrt(F.col("id")))).cast("long").alias("a"), (F.col("id") % 2).alias("b"))
    rows = rows.union(spark.createDataFrame([(-1, None, 0)], rows.schema))
    values = spark.createDataFrame([(a, b, 100 * a + b) for a in range(200) for b in (0, 1)], "a long, b long, value long")
    for keys in (["a"], ["a", "b"]):
        side = values.groupBy(*keys).agg(F.min("value").alias("value"))
        counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
        hot = common.hot_keys(counts, keys, "n", 9001)
        assert 3 <= sum(len(hashes) for _, hashes in hot) < common.SHARE
        assert sum(n * len(hashes) for n, hashes in hot) < 2 * common.SHARE
        got = common.salted_join(rows, side, keys, hot, "row").select("row", "value").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, rows.join(side, keys).select("row", "value").collect()))
    assert common.hot_keys(counts.where("false"), keys, "n", 0) == []
    assert sorted(map(tuple, common.salted_join(rows, side, keys, [], "row").select("row", "value").collect())) == sorted(map(tuple, got))


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_are_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "CROWD", block)
    docs = near_copies()
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(docs)


def test_edges_of_near_duplicates(edge_docs, no_docs, edge_texts):
    rows = near_dedup.near_duplicates(edge_docs).collect()
    assert len(rows) == len(edge_texts) + 1
    expected = brute_components(edge_texts)
    for r in rows:
        assert (r.n_shingles, r.component_id) == expected[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert near_dedup.near_duplicates(no_docs).collect() == []


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "z y x w v u"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    assert got == sorted([(None, 3, False), (3, 3, True), (None, None, False), (None, None, False)], key=repr)


def test_ids_that_name_several_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "h i j k l m n"), (2, "h i j k l m n"), (2, "h i j k l m n"), (None, "o p q r s t u"), (None, "o p q r s t u v"), (None, None), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("x"))
    got = sorted(((r.doc_id, r.text) for r in near_dedup.distinct_documents(df).collect()), key=repr)
    assert got in [sorted([(1, "a b c d e f g"), (1, "h i j k l m n"), (None, t), (None, None), (5, "")], key=repr) for _, t in rows[4:6]]
    found = {(r.doc_id, r.component_id, r.n_shingles) for r in near_dedup.near_duplicates(df).collect()}
    assert found == {(1, 1, 3), (2, 1, 3), (None, None, 3), (None, None, 4), (None, None, 0), (5, 5, 0)}
    # the links of a row without an id join others
    words = [f"w{i}" for i in range(40)]
    chain = [(7, " ".join(words[:30])), (None, " ".join(words[2:32])), (9, " ".join(words[4:34]))]
    assert {r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(chain, "doc_id long, text string")).collect()} == {7}


def test_texts_of_one_template_are_not_all_compared(spark, monkeypatch):
    r = np.random.default_rng(5)
    n = 20_000
    template = [f"t{i}" for i in range(60)]
    # ten words of the template are replaced in one place: pairs have a similarity of about 0.6
    docs = {i: " ".join(template[: 40] + [f"u{i}x{k}" for k in range(11)] + template[51:]) for i in range(n)}
    for i in range(0, 200, 2):  # and some are copies but for one word
        docs[n + i] = docs[i].replace("t59", "other")
    compared = []
    links = near_dedup._links_of_groups

    def counted(groups, *rest):
        sizes = groups.groupBy("group").agg(F.count_if("first").alias("f"), F.count("*").alias("n"), F.min("component").alias("a"), F.max("component").alias("b"))
        compared.append(sizes.where("n > 1 AND a <> b").agg(F.sum(F.col("f") * F.col("n"))).first()[0])
        return links(groups, *rest)

    monkeypatch.setattr(near_dedup, "_links_of_groups", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df).collect()}
    assert {i for i, c in got.items() if c != i} == {n + i for i in range(0, 200, 2)} and all(got[n + i] == i for i in range(0, 200, 2))
    assert (compared[0] or 0) < 400 * n


def rows_of_joins(spark, keys, run):
    """Output rows of the inner joins on `keys` while run() ran, by join."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, found = store.executionsList().size(), []
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = store.executionsList()
    for k in range(before, runs.size()):
        execution = runs.apply(k).executionId()
        values = dict(x.split(" -> ") for x in store.executionMetrics(execution).mkString(";").split(";") if " -> " in x)
        nodes = store.planGraph(execution).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if "Join" in node.name() and f"{keys}, {keys}, Inner" in re.sub(r"#\d+L?", "", node.desc()):
                metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
                found += [int(values.get(str(m.accumulatorId()), "0").replace(",", "")) for m in metrics if m.name() == "number of output rows"]
    return found


def test_a_large_group_is_compared_by_its_main_component(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    n, words = 600, [f"w{i}" for i in range(200)]
    # copies but for a word are linked with each other; the first row, the centre of its buckets, with none of them
    docs = {0: " ".join(f"x{i}" if i % 30 == 7 else w for i, w in enumerate(words))}
    docs |= {k: " ".join([*words[: k % 200], f"c{k}", *words[k % 200 + 1 :]]) for k in range(1, n + 1)}
    compared = []
    links = near_dedup._links_of_groups

    def counted(groups, *rest):
        sizes = groups.groupBy("group").agg(F.count_if("first").alias("f"), F.count("*").alias("n"))
        compared.append(sizes.agg(F.sum(F.col("f") * F.col("n")), F.count("*"), F.sum("n")).first())
        return links(groups, *rest)

    monkeypatch.setattr(near_dedup, "_links_of_groups", counted)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").coalesce(1)
    got = {}
    joins = rows_of_joins(spark, "[node]", lambda: got.update((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()))
    assert got == {0: 0} | dict.fromkeys(range(1, n + 1), 1)
    [(pairs, groups, rows)] = compared
    assert groups > 2 and rows > 2 * n and pairs == rows  # one class of a group outside its main component
    assert joins and max(joins) <= n + 1  # of a class in several groups and cells one row


def test_prefixes_of_linked_sets_meet():
    r = np.random.default_rng(3)
    for _ in range(2000):
        n = int(r.integers(1, 60))
        pool = r.permutation(np.arange(1, 3 * n + 9, dtype=np.uint64))
        a = np.sort(pool[:n])
        b = np.sort(np.concatenate([a[: int(r.integers(n // 2, n + 1))], pool[n : n + int(r.integers(0, n + 1))]]))
        centre = np.sort(r.choice(pool, n, replace=False))
        if near_dedup.linked(a, b):
            small, large = sorted((a, b), key=len)
            (x, first), (y, _) = near_dedup.prefixes(small, centre, -5), near_dedup.prefixes(large, centre, -5)
            assert set(x[first]) & set(y)


def test_banding_misses_no_pair_at_the_threshold():
    r = np.random.default_rng(2)
    for n in (3, 4, 8, 40, 300, 2000):
        for _ in range(300):
            inter = int(np.ceil(0.75 * n))
            x = r.integers(0, 2**64, n, dtype=np.uint64)
            a, b = np.sort(x[: inter + (n - inter) // 2]), np.sort(np.concatenate([x[:inter], x[inter + (n - inter) // 2 :]]))
            assert set(near_dedup.bands(near_dedup.registers(a))) & set(near_dedup.bands(near_dedup.registers(b)))
            assert near_dedup.estimates(near_dedup.registers(a), near_dedup.registers(b))[1]


# --- WARC


def pages(spark):
    rows = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://a/4\r\nX: y", ""), (5, "http://a/5", "é\r\n\r\nWARC/1.1"), (6, "u", "y" * 300_000), (2, "http://a/2", "<p>x</p>"), (None, "n", "only")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("d"), "last_id": F.lit(1), "payload": F.lit("p")})


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    got = warc.read_archive(warc.archive(df)).collect()
    assert len(got) == len(rows)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in got:
        body = html[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())
        assert bytes(r.body) == (body if r.record_type == "response" else b"")
    assert sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got) == sorted([(0, "response", None), (1, "revisit", 2), (2, "response", None), (2, "response", None), (3, "revisit", 4), (4, "response", None), (5, "response", None), (6, "response", None)], key=lambda x: x[0])
    assert {r.record_type for r in warc.read_archive(warc.archive(df, min_bytes=9)).collect()} == {"response"}
    assert warc.read_archive(warc.archive(df.where("false"))).collect() == []


@pytest.mark.parametrize("wide", [False, True])
def test_packages_are_zip_files_that_are_range_read(wide):
    out = io.BytesIO()
    w = warc.PackageWriter(out, wide=wide)
    raw = [warc.write_record("response", i, f"http://x/{i}", b"p" * (i * 200), None)[0] for i in range(50)]
    for i, record in enumerate(raw):
        w.add(record, i)
    w.close()
    data = out.getvalue()
    assert gzip.decompress(zipfile.ZipFile(io.BytesIO(data)).read(warc.WARC)) == b"".join(raw)
    asked = []

    def read(at, n):
        asked.append(n)
        return data[at : at + n]

    assert list(warc.records(read, len(data))) == raw
    assert max(asked[1:]) <= max(map(len, raw))  # after the end of the file, a directory or a record


def test_archives_are_zip_files_of_the_shared_folder(spark):
    _, df = pages(spark)
    for r in warc.archive(df).collect():
        store, path = warc.opened(r.path)
        with store.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            assert z.namelist() == [warc.WARC, warc.INDEX] and f.size() == r.bytes
            assert z.read(warc.INDEX).count(b"\n") == r.records


def test_an_index_is_read_in_pieces(monkeypatch):
    monkeypatch.setattr(warc, "INDEX_BYTES", 7)
    data = b"xx" + b"".join(b"%d\n" % i for i in range(0, 5000, 37))
    asked = []
    got = list(warc.lines(lambda at, n: asked.append(n) or data[at : at + n], 2, len(data) - 2))
    assert got == [str(i) for i in range(0, 5000, 37)] and max(asked) == 7


def test_zip64_directories():
    # an archive of more members than 16 bits count has a ZIP64 end record
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for i in range(66_000):
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"hello")
    data = out.getvalue()
    found = warc.members(lambda at, n: data[at : at + n], len(data))
    assert len(found) == 66_001
    at = warc.data_offset(lambda at, n: data[at : at + n], found["last"])
    assert data[at : at + found["last"].size] == b"hello"


def test_broken_packages_are_refused():
    with pytest.raises(ValueError, match="central directory"):
        warc.members(lambda at, n: b"x" * n, 100)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(warc.WARC, b"x" * 100)
    data = out.getvalue()
    with pytest.raises(ValueError, match="compressed"):
        warc.data_offset(lambda at, n: data[at : at + n], warc.members(lambda at, n: data[at : at + n], len(data))[warc.WARC])


# --- mixing


def brute_targets(sizes, budget=1.5):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, open_, target = budget * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def brute_mix(rows):
    """Packets of all sources through a queue by virtual finish, until the budget is spent; rows: (id, source, size, tie)."""
    queue = []
    order = sorted({s for _, s, _, _ in rows if s is not None}) + [None] * any(s is None for _, s, _, _ in rows)
    total = {s: sum(n for _, g, n, _ in rows if g == s) for s in order}
    for at, s in enumerate(order):
        key = lambda r: (hashlib.md5(f"mix:{r[0] if r[0] is not None else 'null:' + r[3]}".encode()).hexdigest(), r[3], r[2])
        own, end = sorted((r for r in rows if r[1] == s), key=key), 0
        for turn in range(2):
            for r in own:
                for k in range(0, r[2], mixing.QUANTUM):
                    words = min(mixing.QUANTUM, r[2] - k)
                    end += words
                    queue.append((end / mixing.WEIGHTS[at % 3], at, turn, words, r))
    left, taken = int(1.5 * sum(total.values())), {}
    for _, _, _, words, r in sorted(queue, key=lambda x: x[:2]):
        got = min(words, left)
        left -= got
        taken[r] = taken.get(r, 0) + got
    return taken


def test_mix_is_a_queue_by_virtual_finish(spark):
    r = np.random.default_rng(1)
    rows = [(i, ["hot", "b", "c", None, "e"][int(r.choice(5, p=[0.6, 0.2, 0.1, 0.05, 0.05]))], int(r.integers(0, 900)), f"t{i % 7}") for i in range(2000)]
    rows += [(None, "b", 40 + i, f"n{i}") for i in range(30)] + [(5, "c", 33, "other text")]
    df = spark.createDataFrame(rows, "doc_id long, source string, words long, tie string").withColumns({"wfq_note": F.lit("kept"), "text": F.lit("")})
    mix = lambda df: mixing.weighted_fair_mix(df, size=F.col("words"), tie=F.col("tie"))
    mixed = mix(df)
    got = mixed.collect()
    assert mixed.columns[: len(df.columns)] == df.columns and {x.wfq_note for x in got} == {"kept"}
    sizes = {}
    for _, s, n, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    target, expected = brute_targets(sizes), brute_mix(rows)
    taken = dict.fromkeys(sizes, 0)
    for x in got:
        assert x["_wfq_target"] == pytest.approx(target[x.source]) and x["_wfq_source_size"] == sizes[x.source]
        assert x["_wfq_taken"] == expected.get((x.doc_id, x.source, x.words, x.tie), 0) <= 2 * x["_wfq_size"]
        taken[x.source] += x["_wfq_taken"]
    assert all(abs(taken[s] - target[s]) <= mixing.QUANTUM * len(sizes) for s in sizes) and sum(taken.values()) == int(1.5 * sum(sizes.values()))
    assert sorted(map(str, mix(df.repartition(7)).collect())) == sorted(map(str, got))
    served = mixing.mixed_rows(mixed).collect()
    finish = [x["_wfq_finish"] for x in served]
    assert finish == sorted(finish) and sum(x["_wfq_words"] for x in served) == sum(taken.values())


def test_edges_of_mixing(edge_docs, no_docs, edge_texts):
    out = mixing.weighted_fair_mix(edge_docs)
    assert out.count() == len(edge_texts) + 1
    assert out.columns[: len(edge_docs.columns)] == edge_docs.columns
    assert out.select("_wfq_taken").count() == len(edge_texts) + 1
    assert mixing.weighted_fair_mix(no_docs).collect() == []
    assert all(r["_wfq_taken"] == 0 for r in mixing.weighted_fair_mix(edge_docs.where("doc_id = 0")).collect())


# --- the pipeline


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="corpus_pipeline.py is absent")
def test_pipeline_stages(spark, edge_docs, no_docs):
    import corpus_pipeline as c

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before, rows = None, docs
    for n, (name, stage) in enumerate(c.STAGES):
        before, rows = rows, stage(spark, rows, d).cache()
        if n < len(c.STAGES) - 1:
            assert rows.columns == docs.columns, name
        if name == "language ID":
            assert rows.count() >= 0.98 * before.count()
        if name == "MinHash near-dedup":
            expected = brute_components({r.doc_id: r.text for r in before.collect()})
            assert {r.doc_id for r in rows.collect()} == {i for i, (_, top) in expected.items() if i == top}
        if name == "secret scans":
            assert {r.doc_id for r in rows.collect()} == {r.doc_id for r in before.collect()}
        if name == "mixing sources":
            words = lambda df: sum(len((r.text or "").encode().split()) for r in df.collect())
            assert words(rows) == int(1.5 * words(before))
    assert rows.count() == before.count()
    for docs in (edge_docs, no_docs):
        names = ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.select(names)
        for _, stage in c.STAGES:
            rows = stage(spark, rows, d).cache()
            rows.count()

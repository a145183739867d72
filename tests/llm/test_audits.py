"""Operators 11, 12 and 13: brute force, edges, groups cut over partitions."""

import random
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from sedimenta.llm import filter_audit, spelling, url_filter

# --- spelling variants


def one_error(a, b):
    """Does exactly one inserted, deleted or replaced code point lead from a to b?"""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def brute_variants(words):
    out = {}
    for w, n in words.items():
        near = [v for v in words if abs(len(v) - len(w)) < 2 and one_error(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (best, n, len(near), words[best]) if best and words[best] >= 5 * n else (None, n, len(near), None)

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {(w, form, root(w), n, near, form_n) for w, (form, n, near, form_n) in out.items()}


def some_words(seed, n, letters="abé", least=1, most=9):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(least, most))) for _ in range(n)})


@pytest.mark.parametrize("seed", range(4))
def test_automaton_numbers_and_completes(seed):
    words = some_words(seed, 300)
    a = spelling.Automaton(words)
    assert [a.number(w) for w in words] == list(range(len(words)))
    asked = some_words(seed + 100, 200)
    assert all((a.number(w) >= 0) == (w in words) for w in asked)
    for w in asked:
        for exact in range(len(w) + 1):
            want = {k for k, v in enumerate(words) if v[:exact] == w[:exact] and len(v) >= exact and one_error(w[exact:], v[exact:])}
            assert a.near(w, exact) == want, (w, exact)


def test_automaton_is_minimal():
    # all words of ten letters over ab: a chain of eleven states
    words = [""]
    for _ in range(10):
        words = [w + c for w in words for c in "ab"]
    a = spelling.Automaton(sorted(words))
    reached, todo = set(), [0]
    while todo:
        s = todo.pop()
        if s not in reached:
            reached.add(s)
            todo += a.edges[s].values()
    assert len(reached) == 11 and a.number("b" * 10) == 1023
    empty = spelling.Automaton([])
    assert empty.number("x") == -1 and empty.near("x", 0) == set()


@pytest.mark.parametrize("block", [2, 7, 20_000])
def test_near_words_is_brute_force_with_halves_cut_and_whole(spark, block):
    words = {w: 1 + zlib.crc32(w.encode()) % 50 for w in some_words(5, 500, letters="ab", least=6, most=11) + some_words(6, 200)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {tuple(r) for r in spelling.near_words(df, share=10**9, block=block).select("word", "n_near", "form", "form_n").collect()}
    want = set()
    for w in words:
        near = [v for v in words if one_error(w, v)]
        if near:
            best = min(near, key=lambda v: (-words[v], v))
            want.add((w, len(near), best, words[best]))
    assert got == want


def test_spelling_variants_of_planted_texts(spark):
    r = random.Random(3)
    base = ["straße", "garçonne", "planets", "orbiter", "telescope", "galaxies"]
    rows = [(i, " ".join(r.choice(base) for _ in range(60)).title() + " -" + r.choice(["planet", "planetss", "plänets", "orbitor", "x", "aplanets"]) + "- ") for i in range(400)]
    rows += [(None, "Galaxie " * 7 + "galaxi " * 5), (None, None), (900, ""), (901, "\U0001f600 ẞtraße ñandúes " * 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit(1), "n": F.lit(1), "key": F.lit(1)})
    got = {tuple(x) for x in spelling.spelling_variants(df).collect()}
    assert got == brute_variants(brute_words(rows))
    by = {x[0]: x for x in got}
    assert by["plänets"][1] == "planets" and by["galaxi"][2] in ("galaxies", "galaxi")
    assert spelling.spelling_variants(df.where("false")).collect() == []


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    got = dict(tuple(r) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect())
    assert got == {f"w{i}": "w37" for i in range(37)}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).collect() == []


def test_op11_over_the_table(spark, sf, docs_001):
    got = {tuple(r) for r in spelling.op11_spelling_variants(spark, sf).collect()}
    assert got == brute_variants(brute_words(docs_001.items()))


# --- filter audit


def brute_audit(rows, labels):
    ids = {}
    for i, t, _ in rows:
        if i is not None:
            ids.setdefault(t or "", []).append(i)
    docs = []
    for i, t, part in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(w) < 100) + "B" * (100 * len(set(w)) < 80 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)) + "D" * bool(set(t) & set("#$%&*|"))
        fails += "E" * (i is not None and any(j < i for j in ids.get(t, [])))
        good, toxic = (max((x[k] or 0 for x in labels if x[0] == i and i is not None), default=0) == 1 for k in (1, 2))
        docs.append((part or "", set(fails), good, toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                left = [d for d in own if not d[1] & set(order[:k])]
                hit = [d for d in left if f in d[1]]
                shapley[part, f] += len(hit)
                out[part, order, k + 1] = (len(left) - len(hit), len(hit), sum(f in d[1] for d in own) - len(hit), sum(d[1] == {f} for d in own), sum(d[2] for d in hit), sum(d[3] for d in hit))
    return {(*key, *v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audit_rows():
    r = random.Random(9)
    rows = [(i, " ".join(r.choice(["Alpha", "beta", "GAMMA", "delta#", "eps", str(i)]) for _ in range(r.choice([3, 30, 150]))), r.choice(["en", "de", None, ""])) for i in range(60)]
    rows += [(i, "one text that many share", "en") for i in range(1000, 1400)]  # cut over partitions
    rows += [(5, "one text that many share", "de"), (5, "one text that many share", "de"), (None, "one text that many share", "de"), (None, None, None), (2000, "", "fr"), (2001, None, "fr"), (2001, None, "fr")]
    rows += [(3000, "É" * 50 + "A" * 5, "fr"), (3001, "word " * 120_000, "fr"), (3002, " \t\r\n\x0b\x0c ", "fr"), (3003, "a\x1cb\x85c\u00a0d " * 100, "fr")]
    labels = [(i, r.randint(0, 1), r.randint(0, 1)) for i in range(40)] + [(5, 1, None), (5, 0, 1), (None, 1, 1), (1001, 1, 1), (2001, None, None)]
    return rows, labels


@pytest.mark.parametrize("parts", [1, 3, 64])
def test_filter_audit_is_brute_force(spark, parts):
    rows, labels = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("id", "part", "mask", "place", "head", "print")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("x"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        masks = filter_audit.failure_masks(docs)
        assert sum(1 for r in masks.collect() if r.mask & filter_audit.COPY) == 400 + 2 + len(rows[:60]) - len({t for _, t, _ in rows[:60]})
        got = {tuple(r) for r in filter_audit.filter_interactions(docs, marks).collect()}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute_audit(rows, labels) and len(got) == 4 * 600


def test_filter_audit_of_nothing(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_interactions(docs, labels).collect() == []
    one = spark.createDataFrame([(1, "x", None)], docs.schema)
    assert {r.shapley for r in filter_audit.filter_interactions(one, labels).collect()} == {0, 120}


# --- URL filters

CASES = [
    ("http://a.net/x", "", "net/", "block"), ("https://Sub.Example.NET/en/1", "", "example.net/en/", "allow"), ("https://example.net/de/1", "", "net/", "block"), ("https://www.example.com/de/", "", "example.com/de/", "block"),
    ("https://example.com/de", "", None, "allow"), ("http://example.org/fr/9?x#y", "", "org/fr/", "allow"), ("http://net/", "", "net/", "block"), ("http://anet/", "", None, "allow"), ("http://a.net", "", None, "allow"),
    # aliases: a canonical link, a refresh, a chain over both, a target that has no page, and an allow that stands
    ("https://alias.com/1", '<head><LINK href="https://a.net/x" rel="canonical"></head>', None, "block"), ("https://alias.com/2", "<meta http-equiv='refresh' content='0; URL=/1'>", None, "block"),
    ("https://alias.com/3", '<meta http-equiv=refresh content="3;url=2#top">', None, "block"), ("https://alias.com/4", '<link rel="shortlink canonical" href="//gone.net/q?a=1&amp;b=2">', None, "block"),
    ("https://alias.org/fr/5", '<link rel=canonical href=http://alias.com/1>', "org/fr/", "allow"), ("https://fine.com/6", '<link rel="canonical" href="https://fine.com/7"><link rel="canonical" href="http://a.net/x">', None, "allow"),
    ("https://fine.com/8", '<!-- <link rel="canonical" href="http://a.net/x"> --><script>"<link rel=canonical href=http://a.net/x>"</script>', None, "allow"), ("https://fine.com/9", '<link rel="stylesheet" href="http://a.net/x"><meta name="refresh" content="0;url=http://a.net/x">', None, "allow"),
    ("https://alias.com/10", '<link rel="canonical" href="https://alias.org/fr/5">', None, "block"), ("https://fine.com/11", '<link rel="canonical" href="http://[bad">', None, "allow"), ("no address", '<link rel="canonical" href="http://a.net/x">', None, "allow"),
    (None, '<link rel="canonical" href="http://a.net/x">', None, "allow"), ("https://fine.com/12", None, None, "allow"), ("", "", None, "allow"), ("http://" + "l." * 5000 + "net/" + "p" * 100_000, "", "net/", "block"),
]


def test_url_filter_cases(spark):
    rows = [(i, u, h) for i, (u, h, _, _) in enumerate(CASES)] + [(0, CASES[0][0], None), (None, CASES[9][0], "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("host", "path", "rule", "node", "verdict", "spread", "own", "target")})
    rules = url_filter.rule_list(spark, url_filter.JUDGED_BY)
    got = url_filter.judge(pages, rules).collect()
    assert len(got) == len(rows)
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert {i: by[i] for i in range(len(CASES))} == {i: c[2:] for i, c in enumerate(CASES)}
    assert by[None] == (None, "block")  # repeated urls share aliases
    assert {(r.host, r.path) for r in got if r.page_id in (1, 4, 8, 20)} == {("sub.example.net", "/en/1"), ("example.com", "/de"), ("a.net", ""), ("", "")}
    assert url_filter.judge(pages.where("false"), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(pages, rules.where("false")).collect()} == {"allow"}
    given = spark.createDataFrame([("http://fine.com/12", "https://A.net/x#frag"), (None, "https://a.net/x"), ("https://fine.com/9", None)], "url string, target string")
    assert {r.page_id for r in url_filter.judge(pages, rules, given).collect() if r.verdict == "block"} - {r.page_id for r in got if r.verdict == "block"} == {21}


def test_longest_rule_wins(spark):
    rules = spark.createDataFrame([("b.c", "/", "block"), ("a.b.c", "/", "allow"), ("b.c", "/xx", "block"), ("B.C", "/yy/", "allow"), ("b.c", "/yy/", "block"), ("c", "/yy/zz", "block"), (None, "/", "block"), ("c", None, "block"), ("d", "/", None)], url_filter.RULES)
    urls = ["a.b.c/", "a.b.c/xx", "a.b.c/x", "b.c/xx", "b.c/yy/", "b.c/yy/zz", "x.c/yy/z", "x.c/yy/zz/", "d/", "x.d/"]
    pages = spark.createDataFrame([(i, "x://" + u, None) for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    want = [("a.b.c/", "allow"), ("a.b.c/", "allow"), ("a.b.c/", "allow"), ("b.c/xx", "block"), ("b.c/yy/", "allow"), ("b.c/yy/", "allow"), (None, "allow"), ("c/yy/zz", "block"), (None, "allow"), (None, "allow")]
    assert [got[i] for i in range(len(urls))] == want

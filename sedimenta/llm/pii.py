"""Personal data: base patterns, and candidates that boosted trees select.

Generators with high recall propose spans (numbers in any grouping as card or phone, spelt-out e-mail addresses,
defanged addresses), which may overlap each other: of numbers in a row every piece of whole groups is one. Each candidate's format and context are features; boosted trees
score it for its kind, and it is selected above a threshold that is calibrated, by kind, to PRECISION on rows that
fitting didn't see. Of kinds proposed for one span, and of numbers that overlap, the surest stays. Base spans always stay; a candidate that
overlaps one is dropped. The trees learn from a small synthetic set, written by invented rules below and cut into candidates by the
same expressions; its size is EXAMPLES. Everything on the path of the data is a DataFrame function.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .common import table
from .spans import CONTEXT, add_matches, digits, joined, let, luhn, of_kind, running, without_overlaps

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
SPAN = "struct<start:int,kind:int,end:int>"
SCORED = "struct<start:int,kind:int,end:int,over:double>"
#: The base patterns, in a form that reads no run twice.
LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidate generators.
SPELT = r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]++\x20?(?:\(at\)|\[at\]|\{at\}|\x20at\x20|@)\x20?[A-Z0-9-]++(?:\x20?(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20)\x20?[A-Z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z_])[+(]?[0-9](?:[\x20()./-]{0,2}[0-9])++"
DEFANGED = r"(?<![0-9])[0-9]{1,3}+(?:\x20?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))\x20?[0-9]{1,3}+){3}"

FEATURES = ("is_email", "is_ip", "is_card", "is_phone", "n_digits", "luhn", "n_separators", "parens", "n_groups", "last_group", "first_digit", "slashes", "dots", "context_phone", "context_card", "context_mail", "context_ip", "context_other", "left_joined", "right_joined", "small_parts", "first_group", "spaces", "hyphens", "left_gap", "right_gap")
#: Context words of a kind.
WORDS = {
    "context_phone": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|dial|ring|telefon|téléphone|teléfono)\b",
    "context_card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta)\b",
    "context_mail": r"(?i)\b(?:mail|e-?mail|contact|write|reach|correo|courriel)\b",
    "context_ip": r"(?i)\b(?:ip|host|server|address|ping|login)\b",
    "context_other": r"(?i)\b(?:order|invoice|isbn|version|date|page|section|no|id|serial|part|total|price|année|jahr)\b|[$€£#]\s*$",
}
#: Texts that are written, and the precision of each kind's threshold: phones have the most formats, and a digit run without context is often none.
EXAMPLES, PRECISION = 3600, (0.99, 0.99, 0.98, 0.97)
#: Digits of a card or phone.
DIGITS = (7, 19)


def features(kind: Column, m: Column) -> list[Column]:
    """FEATURES of a match as a kind, as doubles."""
    d, text = digits(m["text"]), m["text"]
    groups = F.filter(F.split(text, "[^0-9]+"), lambda g: g != "")
    near = F.concat(m["left"], F.lit(" "))
    flag = lambda c: c.cast("double")
    count = lambda p: F.regexp_count(text, F.lit(p)).cast("double")
    return [
        *[flag(kind == k) for k in range(4)], F.length(d).cast("double"), flag((F.length(d) >= 12) & luhn(F.concat(d, F.lit(""))).eqNullSafe(True)), count("[^0-9]"), count("[()]"),
        F.size(groups).cast("double"), F.coalesce(F.length(F.try_element_at(groups, F.lit(-1))), F.lit(0)).cast("double"), F.coalesce(F.substring(d, 1, 1).try_cast("double"), F.lit(-1.0)), count("/"), count(r"\."),
        *[flag(F.rlike(near, F.lit(WORDS[w]))) for w in FEATURES[13:18]],
        flag(F.rlike(m["left"], F.lit(r"[\p{L}0-9_@.,/:-]$"))), flag(F.rlike(m["right"], F.lit(r"^[\p{L}0-9_@/:%°]"))), flag(F.forall(groups, lambda g: (F.length(g) <= 3) & (g.try_cast("int") <= 255))),
        F.coalesce(F.length(F.try_element_at(groups, F.lit(1))), F.lit(0)).cast("double"), count(r"\x20"), count("-"),
        # 1 where another group of the same run is next to it, 2 where a space is between
        flag(F.rlike(m["left"], F.lit(r"[0-9][\x20()./-]{1,2}$"))) + flag(F.rlike(m["left"], F.lit(r"[0-9][()./-]?\x20[()./-]?$"))),
        flag(F.rlike(m["right"], F.lit(r"^[\x20()./-]{1,2}[0-9]"))) + flag(F.rlike(m["right"], F.lit(r"^[()./-]?\x20[()./-]?[0-9]"))),
    ]


def pieces(runs: Column) -> Column:
    """Matches of NUMBER to all their pieces of whole groups with DIGITS digits, at least two a group on average, which overlap.

    So a run of n groups has at most 13 n, and one of single digits (a table, a count) none. A piece begins with the opening
    bracket or plus directly before its first digit.
    """
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)
    # every part is a group with what stands before it; a transform for each step, as a lambda's terms are computed anew at each use
    cut = F.transform(runs, lambda m: F.struct(m.alias("m"), F.regexp_extract_all(m["text"], F.lit("[^0-9]*[0-9]+"), F.lit(0)).alias("parts")))
    lengths = lambda c: F.transform(c["parts"], F.length)
    sizes = lambda c: F.transform(c["parts"], lambda p: F.length(digits(p)))
    cut = F.transform(cut, lambda c: F.struct(c["m"].alias("m"), c["parts"].alias("parts"), sizes(c).alias("sizes"), running(lengths(c), lambda a, x: a + x, 0).alias("ats")))

    def of_group(c: Column, i: Column) -> Column:
        at = F.element_at(c["ats"], i + 1)
        before = F.concat(c["m"]["left"], F.array_join(F.slice(c["parts"], F.greatest(F.lit(1), i - CONTEXT + 1), F.least(i, F.lit(CONTEXT))), ""))
        ends = F.sequence(F.lit(1), F.least(F.lit(DIGITS[1]), F.size(c["parts"]) - i))
        ends = F.filter(ends, lambda k: total(F.slice(c["sizes"], i + 1, k)).between(F.greatest(F.lit(DIGITS[0]), 2 * k), F.lit(DIGITS[1])))
        some = F.transform(ends, lambda k: F.struct(k.alias("k"), F.array_join(F.slice(c["parts"], i + 1, k), "").alias("whole")))
        some = F.transform(some, lambda x: F.struct(x["k"].alias("k"), x["whole"].alias("whole"), F.regexp_replace(x["whole"], r"^[^0-9+]*?(?=\(?[0-9])", "").alias("text")))
        skipped = lambda x: F.length(x["whole"]) - F.length(x["text"])
        return F.transform(some, lambda x: F.struct(
            (c["m"]["start"] + at + skipped(x)).alias("start"), (c["m"]["start"] + at + F.length(x["whole"])).alias("end"), x["text"].alias("text"),
            F.substring(F.concat(before, F.substring(x["whole"], F.lit(1), skipped(x))), -CONTEXT, CONTEXT).alias("left"),
            F.substring(F.concat(F.array_join(F.slice(c["parts"], i + x["k"] + 1, CONTEXT), ""), c["m"]["right"]), 1, CONTEXT).alias("right"),
        ))

    return F.flatten(F.flatten(F.transform(cut, lambda c: F.transform(F.sequence(F.lit(0), F.size(c["parts"]) - 1), lambda i: of_group(c, i)))))


def surest(spans: Column) -> Column:
    """Of SCORED spans those that overlap no surer one that stays; ties go to the longer, then the first.

    In order of their starts a span begins a cluster if none before it reaches it; clusters don't overlap. Within one the
    surest go first, which takes the square of the cluster's size, not of all spans.
    """
    none = F.array().cast(f"array<{SCORED}>")
    size = lambda s: s["end"] - s["start"]
    tie = lambda a, b: F.coalesce(F.nullif(size(b) - size(a), F.lit(0)), a["start"] - b["start"])
    order = lambda a, b: F.when(a["over"] > b["over"], -1).when(a["over"] < b["over"], 1).otherwise(tie(a, b))
    free = lambda acc, x: ~F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"]))
    best = lambda xs: F.aggregate(F.array_sort(xs, order), none, lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))

    def of(xs: Column) -> Column:
        reach = running(F.transform(xs, lambda x: x["end"]), F.greatest, -1)
        opens = let(reach, lambda r: F.filter(F.transform(xs, lambda x, i: F.when(x["start"] >= F.element_at(r, i + 1), i + 1)), lambda i: i.isNotNull()))
        until = lambda o, n: F.coalesce(F.get(o, n + 1), F.size(xs) + 1)
        return let(opens, lambda o: F.flatten(F.transform(o, lambda i, n: best(F.slice(xs, i, until(o, n) - i)))))

    return let(F.array_sort(spans), of)


def candidates(df: DataFrame) -> DataFrame:
    """df (with a text column) and column proposed: matches of the generators with the kinds they propose."""
    df = add_matches(df, "number", "text", NUMBER)
    df = add_matches(df, "spelt", "text", SPELT, F.rlike("text", F.lit("(?i)dot")))
    df = add_matches(df, "defanged", "text", DEFANGED, F.rlike("text", F.lit(r"[0-9]\x20?[\[(]")))
    number = pieces(F.filter("number", lambda m: F.length(digits(m["text"])) >= DIGITS[0]))
    as_kinds = lambda spans, *kinds: F.transform(spans, lambda m: F.struct(F.array(*map(F.lit, kinds)).alias("kinds"), m.alias("m")))
    proposed = F.concat(as_kinds(number, CARD, PHONE), as_kinds(F.col("spelt"), EMAIL), as_kinds(F.col("defanged"), IP))
    return df.withColumn("proposed", proposed).drop("number", "spelt", "defanged")


def examples(seed: int = 4) -> list[dict]:
    """Synthetic texts with their spans (start, kind, end). Some numbers have others beside them."""
    r = random.Random(seed)
    digit = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 8)))

    def card(right: bool) -> str:
        body = r.choice("3456") + digit(r.choice([11, 13, 14, 14, 14, 15]))
        total = sum(int(c) if i % 2 else int(c) * 2 % 10 + int(c) // 5 for i, c in enumerate(reversed(body)))
        n = body + str((10 - total % 10) % 10 if right else (11 - total % 10 + r.randint(0, 7)) % 10)
        sep = r.choice([".", "/", " . "[0:2], ""])
        return sep.join(n[i : i + 4] for i in range(0, len(n), 4)) if sep.strip() or not sep else n

    def phone() -> str:
        a, b, c = digit(3), digit(3), digit(4)
        pairs = " ".join(digit(2) for _ in range(4))
        return r.choice([
            f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{digit(2)} {digit(4)} {digit(4)}", f"0{digit(3)}/{digit(6)}", f"{a} {b} {c}",
            f"0{digit(1)} {pairs}", f"0{digit(2)} / {b} {digit(5)}", f"00{digit(2)} {digit(2)} {digit(6)}", f"{digit(2)} {b} {c}", f"0{digit(9)}",
        ])

    def spelt() -> str:
        at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" at ", " dot ")])
        return f"{word()}{r.choice(['', '.' + word(), digit(2)])}{at}{word()}{dot}{r.choice(['com', 'org', 'net', 'de'])}"

    def other() -> str:
        return r.choice([
            f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)} {r.randint(10, 23)}", f"{digit(7)}", f"{digit(8)}", f"{digit(10)}",
            f"978-{digit(1)}-{digit(4)}-{digit(4)}-{digit(1)}", f"{digit(3)}.{digit(3)}.{digit(3)}.{digit(3)}.{digit(2)}", f"{digit(2)}.{digit(2)}.{digit(2)} {digit(3)}", f"{digit(12)}", f"{digit(16)}", f"{digit(5)}-{digit(2)}", f"{digit(4)} {digit(4)}", f"{digit(1)} {digit(3)} {digit(3)}", f"{digit(2)}/{digit(2)}/{digit(4)}",
        ])

    def row() -> str:
        sizes = r.choice([(1, 1, 2, 3), (1, 1, 2, 3), (2,), (3,), (1, 2, 3, 4)])
        return r.choice("   -./").join(digit(r.choice(sizes)) for _ in range(r.randint(5, 40)))

    out = []
    for n in range(EXAMPLES):
        kind = (PHONE, CARD, EMAIL, IP, -1, -1)[n % 6]
        hint = {PHONE: ["tel ", "call ", "phone: ", "fax "], CARD: ["card ", "visa ", "credit card: "], EMAIL: ["mail ", "contact "], IP: ["host ", "ip "], -1: ["order ", "isbn ", "date ", "version ", "$", "id ", "no "]}[kind]
        hinted = r.random() < 0.6
        body = {PHONE: phone, CARD: lambda: card(True), EMAIL: spelt, IP: lambda: r.choice(["[.]", "(.)", "[dot]"]).join(str(r.randint(0, 255)) for _ in range(4)), -1: other}[kind]()
        if kind == -1 and r.random() < 0.3:
            body = r.choice([card(False), f"{word()} at {word()} dot {word()}", "[.]".join(str(r.randint(300, 999)) for _ in range(4)), row(), row()])
        if kind == PHONE and not hinted and "(" not in body and body.count("-") != 2:
            kind = -1  # bare digits without context stay
        left = f"{word()} {word()} {r.choice(hint) if hinted else ''}"
        out.append({"left": left, "bodies": [(body, kind)], "right": r.choice(["", ".", ",", " " + word()]), "phones": kind == PHONE and hinted, "part": r.randrange(3)})
    for x in out:
        while x["bodies"][0][0][-1].isdigit() and r.random() < 0.4:
            kind = r.choice((PHONE, PHONE, CARD, -1))
            body = {PHONE: phone, CARD: lambda: card(True), -1: r.choice((other, row))}[kind]()
            if kind == PHONE and not x["phones"] and "(" not in body and body.count("-") != 2:
                kind = -1  # as above
            x["bodies"].insert(r.randint(0, len(x["bodies"])), (body, kind))
    texts = []
    for x in out:
        text, spans = x["left"], []
        for n, (body, kind) in enumerate(x["bodies"]):
            text += r.choice([" ", " ", ". ", "  "]) if n else ""
            if kind >= 0:
                spans.append({"start": len(text), "kind": kind, "end": len(text) + len(body)})
            text += body
        texts.append({"text": text + x["right"], "spans": spans, "part": x["part"]})
    return texts


class Model:
    """Trees and a threshold for each kind."""

    def __init__(self, trees: boosting.Trees, thresholds: list[float]) -> None:
        self.trees, self.thresholds = trees, thresholds

    def selected(self, proposed: Column) -> Column:
        """Structs (start, kind, end, over) of the candidates above their kind's threshold, and by how much."""
        lowest = F.array(*[F.lit(t) for t in self.thresholds])
        # a row for each kind of a match, the features once, then the trees over them
        seen = F.transform(proposed, lambda p: F.transform(p["kinds"], lambda k: F.struct(p["m"]["start"].alias("start"), k.alias("kind"), p["m"]["end"].alias("end"), F.array(*features(k, p["m"])).alias("x"))))
        margin = lambda s: self.trees.column([s["x"][i] for i in range(len(FEATURES))])
        over = lambda s: margin(s) - F.element_at(lowest, s["kind"] + 1)
        # of a span's kinds the surest, ties the one listed first
        best = F.transform(seen, lambda kinds: F.array_max(F.transform(kinds, lambda s: F.struct(over(s).alias("over"), (-s["kind"]).alias("before"), s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))))
        return F.array_distinct(F.transform(F.filter(best, lambda s: s["over"] >= 0), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["over"].alias("over"))))


def fit(spark: SparkSession) -> Model:
    """Fit on EXAMPLES synthetic texts, cut into candidates by the expressions that the data go through."""
    rows = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps(examples())), "array<struct<text:string,spans:array<struct<start:int,kind:int,end:int>>,part:int>>")))
    cut = candidates(rows).select("spans", "part", F.explode("proposed").alias("p")).select("spans", "part", "p.m", F.explode("p.kinds").alias("kind"))
    right = F.exists("spans", lambda s: (s["start"] == F.col("m.start")) & (s["end"] == F.col("m.end")) & (s["kind"] == F.col("kind")))
    got = cut.select(right.alias("right"), "part", "kind", F.array(*features(F.col("kind"), F.col("m"))).alias("x")).collect()
    x, part = np.array([g["x"] for g in got]), np.array([g["part"] for g in got])
    kind = np.array([g["kind"] for g in got])
    y = np.array([g["right"] for g in got]).astype(float)
    trees = boosting.fit(x[part != 0], y[part != 0])
    margin = trees.margin(x)
    held = part == 0
    return Model(trees, [min(1e9, boosting.threshold(margin[held & (kind == k)], y[held & (kind == k)], PRECISION[k])) for k in range(4)])


def find(docs: DataFrame, model: Model, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """Every row's id_cols with base and added: arrays of structs (start, kind, end), kind an index of KINDS.

    Null texts count as empty and have no spans. Very long texts are searched whole, in time that grows with the text and its
    matches. Rows may repeat, null ids are kept, other columns have no influence. An empty table gives an empty result.
    """
    df = docs.select(F.struct(*id_cols).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = add_matches(df, "email", "text", BASE["email"], F.contains("text", F.lit("@")))
    df = add_matches(df, "ip", "text", BASE["ip"], F.rlike("text", F.lit(r"[0-9]\.[0-9]")))
    df = add_matches(df, "card", "text", BASE["card"])
    df = add_matches(df, "phone", "text", BASE["phone"], F.contains("text", F.lit("+")))
    n = lambda m: F.length(digits(m["text"]))
    part = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 9)).cast("int") <= 255)
    base = F.concat(
        of_kind(F.col("email"), EMAIL, lambda m: F.lit(True)), of_kind(F.col("ip"), IP, lambda m: F.forall(F.split(m["text"], r"\."), part)),
        of_kind(F.col("card"), CARD, lambda m: n(m).between(12, 19) & luhn(digits(m["text"]))), of_kind(F.col("phone"), PHONE, lambda m: n(m).between(9, 15)),
    )
    df = df.withColumn("base", base).drop("email", "ip", "card", "phone")
    df = candidates(df)
    df = df.withColumn("picked", F.when(F.size("proposed") > 0, model.selected(F.col("proposed"))).otherwise(F.array().cast(f"array<{SCORED}>")))
    free = F.when(F.size("picked") > 0, without_overlaps(F.col("picked"), F.col("base"), SCORED)).otherwise(F.col("picked"))
    df = df.withColumn("free", free)
    is_number = lambda s: s["kind"].isin(CARD, PHONE)
    chosen = F.when(F.size("free") > 1, F.concat(F.filter("free", lambda s: ~is_number(s)), surest(F.filter("free", is_number)))).otherwise(F.col("free"))
    added = F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    return df.select("key.*", "base", added.alias("added"))


def op4_pii(spark, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"), fit(spark), ["doc_id"])
    count = lambda c, k: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"), joined(F.concat("base", "added"), KINDS).alias("spans"),
        *[count("added", k).alias(f"n_added_{name}") for k, name in enumerate(KINDS)], (F.size("base") + F.size("added") > 0).alias("has_personal_data"),
    )

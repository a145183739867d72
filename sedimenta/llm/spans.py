"""Spans of regular expressions in texts, with DataFrame functions only.

A pattern's matches come from regexp_extract_all and the texts between them from split; their lengths add up to the
positions (code points, end exclusive). Patterns are written so that no match attempt reads a run of characters
twice: possessive quantifiers, and a look-behind that lets a match begin only where a run or the last match ends.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A match: its place, its text, and up to CONTEXT characters on either side.
CONTEXT = 24
FOUND = "array<struct<start:int,end:int,text:string,left:string,right:string>>"
#: Numbers that a running total adds up at once.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda's outer terms are computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(numbers: Column, plus: Callable[[Column, Column], Column], zero: int) -> Column:
    """Of an array of integers what plus() gives over the elements before each, from zero on: an array of the same size.

    Blocks are summed first, then the elements of one's own block, so an array grows by one element a block only.
    """
    whole = lambda xs: F.aggregate(xs, F.lit(zero), lambda a, x: plus(a, x))
    block_of = lambda i: F.floor(i / BLOCK).cast("int")

    def step(acc: Column, b: Column, xs: Column) -> Column:
        return F.struct(plus(acc["at"], whole(F.slice(xs, b * BLOCK + 1, BLOCK))).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def of(xs: Column) -> Column:
        empty = F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
        blocks = F.aggregate(F.sequence(F.lit(0), block_of(F.size(xs) - 1)), empty, lambda acc, b: step(acc, b, xs), lambda acc: acc["out"])
        own = lambda i: whole(F.slice(xs, block_of(i) * BLOCK + 1, i - block_of(i) * BLOCK))
        return let(blocks, lambda o: F.transform(xs, lambda x, i: plus(F.element_at(o, block_of(i) + 1), own(i))))

    return let(numbers, lambda xs: F.when(F.size(xs) > 0, of(xs)).otherwise(F.array().cast("array<int>")))


def add_matches(df: DataFrame, name: str, text: str, pattern: str, where: Column | None = None) -> DataFrame:
    """df with a column `name` of the pattern's leftmost non-overlapping matches (FOUND). where: skips rows without any."""
    hits, gaps = f"{name}_hits", f"{name}_gaps"
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    none = F.array().cast("array<string>")
    df = df.withColumn(hits, found if where is None else F.when(where, found).otherwise(none))
    df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.split(F.col(text), pattern, -1)).otherwise(none))
    size = F.size(hits)
    pieces = F.arrays_zip(F.slice(gaps, 1, size).alias("gap"), F.col(hits).alias("hit"), F.slice(gaps, 2, size).alias("next"))

    def one(x: Column, before: Column) -> Column:
        start = before + F.length(x["gap"])
        left, right = F.substring(x["gap"], -CONTEXT, CONTEXT), F.substring(x["next"], 1, CONTEXT)
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["hit"].alias("text"), left.alias("left"), right.alias("right"))

    def of(p: Column) -> Column:
        at = running(F.transform(p, lambda x: F.length(x["gap"]) + F.length(x["hit"])), lambda a, x: a + x, 0)
        return let(at, lambda at: F.transform(p, lambda x, i: one(x, F.element_at(at, i + 1))))

    spans = F.when(size > 0, let(pieces, of)).otherwise(F.array().cast(FOUND))
    return df.withColumn(name, spans).drop(hits, gaps)


def of_kind(spans: Column, kind: int, keep: Callable[[Column], Column]) -> Column:
    """Matches that pass `keep` as structs (start, kind, end), which sort as asked for."""
    return F.transform(F.filter(spans, keep), lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """kind:start:end of structs (start, kind, end), in order, joined by commas."""
    names = F.array(*map(F.lit, kinds))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def without_overlaps(some: Column, base: Column, element: str) -> Column:
    """The elements of `some` (structs of type `element` with start and end) that overlap none of base (structs with both too).

    In one order, base spans by their start and the others by their end: an element overlaps if a base span before it
    in that order, so one that starts before the element's end, ends after the element's start.
    """
    blank = F.lit(None).cast(element)
    tagged = F.concat(
        F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("tag"), b["end"].alias("till"), blank.alias("it"))),
        F.transform(some, lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("tag"), F.lit(-1).alias("till"), x.alias("it"))),
    )

    def of(spans: Column) -> Column:
        reach = running(F.transform(spans, lambda x: x["till"]), F.greatest, -1)
        kept = let(reach, lambda r: F.filter(spans, lambda x, i: (x["tag"] == 0) & (F.element_at(r, i + 1) <= x["it"]["start"])))
        return F.transform(kept, lambda x: x["it"])

    return let(F.array_sort(tagged), of)


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with spans (structs start, end in code points, which may overlap) replaced by a mark, adjacent ones by one each.

    Cut from four bytes a code point, so a piece is found without reading what stands before it.
    """
    wide, blank = F.encode(text, "UTF-32"), F.encode(F.lit(" "), "UTF-32")
    # a blank before each piece, since decoding drops a byte order mark at the start
    piece = lambda w, a, b: F.substring(F.decode(F.concat(blank, F.substring(w, a * 4 + 1, (b - a) * 4)), "UTF-32"), F.lit(2), b - a)

    def of(w: Column, s: Column) -> Column:
        reach = running(F.transform(s, lambda x: x["end"]), F.greatest, 0)
        fresh = lambda r: F.filter(F.transform(s, lambda x, i: F.struct(F.element_at(r, i + 1).alias("a"), x["start"].alias("b"))), lambda x: x["b"] >= x["a"])
        before = let(reach, lambda r: F.transform(fresh(r), lambda x: F.concat(piece(w, x["a"], x["b"]), F.lit(mark))))
        end = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(F.array_join(before, ""), piece(w, end, F.floor(F.octet_length(w) / 4).cast("int")))

    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    return F.when(F.size(spans) > 0, let(wide, lambda w: let(ordered, lambda s: of(w, s)))).otherwise(text)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Does a string of digits have a right check digit?"""
    of = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.floor(c.cast("int") / 5).cast("int")))
    return F.aggregate(of, F.lit(0), lambda a, x: a + x) % 10 == 0

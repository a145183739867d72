"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte 3- and 4-grams of its words, with a border mark at both ends of a word; each is
hashed to a bucket with an embedding. A text is the mean of its subwords' embeddings, and a linear softmax over it
gives the languages. Embeddings and softmax are trained together by stochastic gradient descent in numpy on the
driver, on a sample of at most SAMPLE rows a language and MOST rows in all, drawn by a hash of the id; executors send
bucket counts of the sampled texts, not texts.

Rejection is calibrated on a part of the sample that training doesn't see and on junk made from its texts (letters
shuffled, drawn at random, or replaced one by one). A prediction's evidence is its score times the share of the text's
subwords that training saw; the threshold is the least evidence from which on PRECISION of that part and its junk
are right, so at most 1 - PRECISION of what is accepted there is wrong or junk.

For prediction, embeddings times softmax fold into one table of integers (bucket by language), so a text's score
is a sum of table rows, exact and independent of how rows are batched.
"""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .boosting import threshold
from .bpe import by_slices, unload
from .common import table

#: Most rows of each language that the sample holds, most rows in all, and most distinct subwords (the commonest) of a row in training.
SAMPLE, MOST, WIDEST = 500, 4000, 8192
BITS, DIM, EPOCHS, BATCH, RATE = 16, 16, 6, 16, 0.5
#: The share of accepted predictions that are to be right.
PRECISION = 0.99
SCALE = 1 << 16
#: Bytes whose subwords a prediction holds at once; they take about a hundred times as many.
PIECE = 1 << 16
LETTER = regex.compile(r"\p{L}")
GRAMS = (3, 4)


def _classes() -> np.ndarray:
    """Bytes to bytes: capital letters to small ones, bytes that aren't letters to 0."""
    to = np.zeros(256, dtype=np.uint8)
    for b in [*range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]:
        to[b] = b
    to[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
    return to


CLASSES = _classes()


def subwords(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and position of the subwords of UTF-8 bytes. Those with a border mark inside don't count."""
    c = np.zeros(len(data) + 2, dtype=np.uint8)
    c[1:-1] = CLASSES[data]
    letter = c != 0
    wide = c.astype(np.uint32)
    buckets, positions = [], []
    for n in GRAMS:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        ok = letter[1 : 1 + m].copy()
        for k in range(2, n - 1):
            ok &= letter[k : k + m]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, dtype=np.uint32)
        for k in range(n):
            h = h * np.uint32(0x01000193) + wide[at + k]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        buckets.append((h >> np.uint32(32 - BITS)).astype(np.int64))
        positions.append(at)
    if not buckets:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate(buckets), np.concatenate(positions)


class Model(NamedTuple):
    langs: list[str]
    #: bucket by language, times SCALE and divided by the temperature
    folded: np.ndarray
    bias: np.ndarray
    #: buckets that training saw
    seen: np.ndarray
    #: evidence below is rejected
    threshold: float


class Example(NamedTuple):
    """A text as training sees it: distinct buckets and their counts; lang is None for junk."""

    lang: str | None
    held: bool
    buckets: np.ndarray
    counts: np.ndarray


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def junk(text: str) -> list[str]:
    """Three texts of no language that look like this one: its letters shuffled, drawn at random, and shifted by a code."""
    r = random.Random(zlib.crc32(text.encode()))
    text = text[: r.randint(40, 2000)]  # as long as some texts are
    letters = [c for c in text if c.isalpha()]
    r.shuffle(letters)
    shuffled = iter(letters)
    code = dict(zip("abcdefghijklmnopqrstuvwxyz", r.sample("abcdefghijklmnopqrstuvwxyz", 26), strict=True))
    return [
        "".join(next(shuffled) if c.isalpha() else c for c in text),
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() else c for c in text),
        "".join(code.get(c, c) for c in text.lower()),
    ]


def examples(text: str, lang: str) -> list[Example]:
    """A row's example, and those of the junk made from it if it is of the fifth that calibrates (by a hash of its text)."""
    held = zlib.crc32(text.encode()) % 5 == 0
    out = []
    for t, g in [(text, lang), *((j, None) for j in (junk(text) if held else []))]:
        buckets, counts = np.unique(subwords(np.frombuffer(t.encode(), dtype=np.uint8))[0], return_counts=True)
        if len(buckets) > WIDEST:
            most = np.sort(np.argsort(-counts, kind="stable")[:WIDEST])
            buckets, counts = buckets[most], counts[most]
        if len(buckets) and LETTER.search(t):
            out.append(Example(g, held, buckets, counts))
    return out


def train(rows: list[Example], seed: int = 1) -> Model | None:
    """Fit a model; None if there is nothing to learn from."""
    real = [r for r in rows if r.lang is not None]
    if not real:
        return None
    names = sorted({r.lang for r in real})
    at = {g: i for i, g in enumerate(names)}
    rng = np.random.default_rng(seed)
    e = (rng.standard_normal((1 << BITS, DIM)) * 0.1).astype(np.float32)
    w, b = (rng.standard_normal((DIM, len(names))) * 0.1).astype(np.float32), np.zeros(len(names), dtype=np.float32)
    fit = [r for r in real if not r.held] or real
    held = [r for r in real if r.held] or real
    seen = np.zeros(1 << BITS, dtype=bool)
    for r in fit:
        seen[r.buckets] = True
    steps, step = EPOCHS * -(-len(fit) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(fit))
        for i in range(0, len(order), BATCH):
            some = [fit[j] for j in order[i : i + BATCH]]
            rate = RATE * (1 - step / steps)
            step += 1
            mean = np.stack([(r.counts[:, None] * e[r.buckets]).sum(axis=0) / r.counts.sum() for r in some])
            p = softmax(mean @ w + b)
            p[np.arange(len(some)), [at[r.lang] for r in some]] -= 1
            back = p @ w.T
            w -= rate * mean.T @ p / len(some) * 8
            b -= rate * p.mean(axis=0) * 0.1
            for r, g in zip(some, back, strict=True):
                e[r.buckets] -= (rate * 64 * r.counts / r.counts.sum())[:, None] * g
    raw_of = lambda some: np.stack([(r.counts[:, None] * (e[r.buckets] @ w)).sum(axis=0) / r.counts.sum() + b for r in some]).astype(np.float64)
    raw, truth = raw_of(held), np.array([at[r.lang] for r in held])
    loss = {t: -np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in 2.0 ** np.arange(-3, 4, 0.25)}
    best = min(loss, key=loss.get)
    judged = held + [r for r in rows if r.lang is None]
    score = softmax(raw_of(judged) / best)
    known = np.array([r.counts[seen[r.buckets]].sum() / r.counts.sum() for r in judged])
    right = np.array([r.lang is not None and names[k] == r.lang for r, k in zip(judged, score.argmax(axis=1), strict=True)])
    least = threshold(score.max(axis=1) * known, right.astype(float), PRECISION)
    return Model(names, np.round(e @ w / best * SCALE).astype(np.int32), (b / best).astype(np.float64), seen, least)


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is accepted, for each text."""
    data = [(t or "").encode() for t in texts]
    joined = np.frombuffer(b" ".join(data), dtype=np.uint8)
    ends = np.cumsum([len(d) + 1 for d in data])
    sums, counts, known = np.zeros((len(data), len(model.langs)), dtype=np.int64), np.zeros(len(data), dtype=np.int64), np.zeros(len(data), dtype=np.int64)
    for begin in range(0, len(joined), PIECE):
        # one more byte before and four after, so that subwords across pieces count once, where they begin
        low, high = max(0, begin - 1), min(len(joined), begin + PIECE + 4)
        bucket, at = subwords(joined[low:high])
        at = at + low - 1  # of the mark before the word or the first byte
        mine = (at >= begin - 1) & (at < begin + PIECE - 1) if low else at < begin + PIECE - 1
        bucket, row = bucket[mine], np.searchsorted(ends, at[mine] + 1, side="right")
        counts += np.bincount(row, minlength=len(data))
        known += np.bincount(row[model.seen[bucket]], minlength=len(data))
        for g in range(len(model.langs)):
            sums[:, g] += np.bincount(row, weights=model.folded[:, g][bucket], minlength=len(data)).astype(np.int64)
    share = known / np.maximum(counts, 1)
    score = softmax(sums / (np.maximum(counts, 1)[:, None] * SCALE) + model.bias)
    top, sure = score.argmax(axis=1), score.max(axis=1)
    lettered = [bool(t and LETTER.search(t)) for t in texts]
    lang = [model.langs[i] if k else "und" for i, k in zip(top, lettered, strict=True)]
    accepted = [bool(k and x >= model.threshold) for x, k in zip(sure * share, lettered, strict=True)]
    return lang, [float(s) if k else 0.0 for s, k in zip(sure, lettered, strict=True)], accepted


LEARNT = "lang string, place double, text_hash long, held boolean, buckets array<int>, counts array<int>"


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, place, text_hash, text) to examples."""
    unload()
    kinds = pa.schema([("lang", pa.string()), ("place", pa.float64()), ("text_hash", pa.int64()), ("held", pa.bool_()), ("buckets", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))])
    for b in batches:
        for lang, place, text_hash, text in zip(*b.columns, strict=True):
            made = examples(text.as_py(), lang.as_py())
            if made:
                rows = [(x.lang, place.as_py(), text_hash.as_py(), x.held, x.buckets.astype(np.int32), x.counts.astype(np.int32)) for x in made]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)


def sample(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[Example]:
    """Examples of at most MOST rows, those of each language whose id hashes lowest, and of junk made from them.

    Every language has the same quota, at most SAMPLE; one with fewer rows gives all it has, and what it leaves is dealt
    to the others. Only of more than MOST languages those with the fewest rows have none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), may_learn.alias("may")).where(F.col("may") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST).collect()  # languages, not rows
    if not counts:
        return []
    quota, left = SAMPLE, MOST
    for n, r in enumerate(reversed(counts)):  # what the smaller ones leave is dealt to the larger
        quota = min(SAMPLE, left // (len(counts) - n))
        if r["count"] > quota:
            break
        left -= r["count"]
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col("id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # twice the quota and some more pass, so that a language practically never falls short of it
    limits = docs.sparkSession.createDataFrame([(r["lang"], (2 * quota + 30) / r["count"]) for r in counts], "lang string, below double")
    near = rows.select("text", "lang", place.alias("place")).join(F.broadcast(limits), "lang").where(F.col("place") < F.col("below"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text_hash"))
    chosen = near.select("lang", "place", F.xxhash64("text").alias("text_hash")).withColumn("rank", rank).where(F.col("rank") <= quota).select("lang", "place", "text_hash").distinct()
    # at most MOST rows: the lists are bounded by WIDEST
    wanted = near.withColumn("text_hash", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "place", "text_hash"])
    got = wanted.select("lang", "place", "text_hash", "text").mapInArrow(_learn, LEARNT).toArrow().combine_chunks()
    # slices of two arrays, not lists of Python's integers
    values = [pa.chunked_array(got.column(n).chunks, pa.list_(pa.int32())).combine_chunks() for n in ("buckets", "counts")]
    offsets, (buckets, counts) = values[0].offsets.to_numpy(), (v.values.to_numpy() for v in values)
    keys = list(zip(*(got.column(n).to_pylist() for n in ("lang", "place", "text_hash", "held")), strict=True))
    order = sorted(range(len(keys)), key=lambda i: (keys[i][0] or "", *keys[i][1:3], int(offsets[i + 1] - offsets[i])))
    return [Example(keys[i][0], keys[i][3], buckets[offsets[i] : offsets[i + 1]], counts[offsets[i] : offsets[i + 1]]) for i in order]


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    return train(sample(docs, may_learn, id_col, text_col, lang_col))


PREDICTED = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("accepted", pa.bool_())])


def identified(text: Column, model: Model | None) -> Column:
    """struct(lang_pred, score, accepted) of a text. Only the text goes to Python, in bounded slices."""

    @F.arrow_udf("lang_pred string, score double, accepted boolean")
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        unload()

        def of(part: list) -> pa.Array:
            columns = predict(model, part) if model else (["und"] * len(part), [0.0] * len(part), [False] * len(part))
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PREDICTED, strict=True)], fields=list(PREDICTED))

        return by_slices(texts, PREDICTED, of)

    return run.asNondeterministic()(text)  # so that it is computed once


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (0 to 1) and accepted, for every row.

    Texts that are null or have no letter are `und` with score 0 and not accepted, and so is every row if model is
    None (nothing was learnt). Very long texts are read whole, in pieces. Ties go to the language that sorts first.
    Rows may repeat, null ids are kept, other columns have no influence; an empty table gives an empty result.
    """
    return docs.select(F.col(id_col), identified(F.col(text_col), model).alias("found")).select(id_col, "found.*")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    # a null id has no remainder: such a document is never learnt from
    model = fit(docs, F.col("doc_id").isNotNull() & ~held_out())
    rows = docs.select(F.struct("doc_id", held_out().alias("held_out")).alias("key"), "text")
    return identify(rows, model, id_col="key").select("key.doc_id", "key.held_out", "lang_pred", "score", "accepted")

"""Exact token counts of every prefix of a text, by dynamic programming.

For every end position in a piece exactly one token can be the last of the prefix's encoding: the one that is
compatible with the last token of the prefix before it. So the count at a position is one more than the count
where that token begins, and one pass over the Aho-Corasick matches fills the row. A text's table is the
difference of the counts from character to character, one byte each (two where a difference needs them); running
sums answer how many tokens a truncation leaves, and how long a prefix a budget allows, without encoding again.

A prefix that ends in white space is one piece with all of the run it ends in, while the whole text splits off the
run's last character; the chunks below keep such a run and what follows it together, so a chunk's differences
depend on the chunk alone.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import NOT_LATIN, ODD, Bpe, L, Memory, N, S, by_slices, load
from .common import table

#: White space runs with the piece after them: contractions, letters, numbers, others; or a run at the end.
CONTRACTION = "'(?:s|t|re|ve|m|ll|d)"
LATIN_CHUNKS = re.compile(f" ?[{L}]+|{CONTRACTION}|[{S}]*(?! )[{S}]{CONTRACTION}|[{S}]*[{L}]+|[{S}]*[{N}]+|[{S}]*[^{S}{L}{N}]+|[{S}]+")
CHUNKS = regex.compile(rf"{CONTRACTION}|\s*(?! )\s{CONTRACTION}|\s*\p{{L}}+|\s*\p{{N}}+|\s*[^\s\p{{L}}\p{{N}}]+|\s+")
RUN = regex.compile(r"\s*")
IS_CONTRACTION = re.compile(f"{CONTRACTION}$")


class PrefixCounter:
    def __init__(self, bpe: Bpe) -> None:
        self.bpe, self.memory = bpe, Memory(self.differences)

    def piece(self, text: str) -> list[int]:
        """Token counts of a piece's prefixes, by characters, from 0 on."""
        data, bpe = text.encode(), self.bpe
        n = len(data)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        fits, at, done = bpe.fits, 0, 0
        for end, (size, i) in bpe.automaton.iter(data.decode("latin-1")):
            if end < done:  # the first match of an end that fits is the one
                continue
            begin = end + 1 - size
            if begin == 0 or fits[last[begin], i]:
                done = end + 1
                last[done], count[done] = i, count[begin] + 1
        if n == len(text):
            return count
        out = [0]
        for c in text:
            at += len(c.encode())
            out.append(count[at])
        return out

    def chunk(self, text: str) -> list[int]:
        """Token counts of a chunk's prefixes, by characters, from 0 on, each prefix split as it would be alone."""
        if not text[0].isspace() or text[0] == " " and text[1:] and not text[1].isspace():  # the commonest cases, without a search
            run, rest = int(text[0] == " "), text
        else:
            run = RUN.match(text).end()
            rest = text[run:]
        if not rest or text[:run] in ("", " "):
            out = self.piece(text)
            if len(text) == 3 and IS_CONTRACTION.match(text):  # 're and the like: its first two characters are two pieces
                out[2] = out[1] + self.piece(text[1])[1]
            return out
        spaces = self.piece(text[:run])
        before = spaces[run - 1]
        if text[run - 1] == " ":
            return spaces + [before + x for x in self.piece(" " + rest)[2:]]
        return spaces + [before + self.piece(text[run - 1])[1] + x for x in self.chunk(rest)[1:]]

    def differences(self, text: str) -> bytes | tuple[np.ndarray]:
        """A chunk's differences, a byte each; an int16 array in a tuple where a byte can't hold one."""
        counts = self.chunk(text)
        d = [b - a for a, b in zip(counts, counts[1:])]  # noqa: B905
        try:
            return array("b", d).tobytes()
        except OverflowError:
            return (np.array(array("h", d), dtype="<i2"),)

    def chunks(self, text: str) -> list[str]:
        if text.isascii() or not NOT_LATIN.search(text):
            return LATIN_CHUNKS.findall(text)
        if not ODD.search(text):
            return CHUNKS.findall(text)
        out, held = [], ""
        for _, (a, b) in self.bpe.library.pre_tokenizer.pre_tokenize_str(text):
            held += text[a:b]
            if not held.isspace():
                out.append(held)
                held = ""
        return [*out, held] if held else out

    def plain(self, text: str) -> np.ndarray:
        found = list(map(self.memory.__getitem__, self.chunks(text)))
        try:
            return np.frombuffer(b"".join(found), dtype=np.int8)
        except TypeError:  # a wide chunk is among them
            return np.concatenate([np.frombuffer(x, dtype=np.int8) if isinstance(x, bytes) else x[0] for x in found])

    def text(self, text: str) -> np.ndarray:
        """The differences of the counts of a text's prefixes, a number for each character; int8 or int16."""
        if not any(s in text for s in self.bpe.special):
            return self.plain(text)
        out = []
        for part, special in self.bpe.segments(text):
            if special is None:
                out.append(self.plain(part))
            else:  # up to its last character a special string is ordinary text
                begun, whole = self.plain(part + special[:-1]), self.plain(part).sum(dtype=np.int64)
                out += [begun, np.array([whole + 1 - begun.sum(dtype=np.int64)], dtype="<i2")]
        joined = np.concatenate(out)
        return joined.astype(np.int8) if len(joined) == 0 or (joined.max() <= 127 and joined.min() >= -128) else joined


def _stored(table_bytes, width: int) -> np.ndarray:
    return np.frombuffer(table_bytes, dtype=np.int8 if width == 1 else "<i2")


def prefix_counts(table_bytes, width: int) -> np.ndarray:
    """Token counts of the prefixes of 1, 2, ... characters from a stored table."""
    return np.cumsum(_stored(table_bytes, width), dtype=np.int64)


def longest_prefix(table_bytes, width: int, budget: int) -> int:
    """Characters of the longest prefix of at most `budget` tokens."""
    below = np.flatnonzero(prefix_counts(table_bytes, width) <= budget)
    return int(below[-1]) + 1 if len(below) else 0


KIND = pa.struct([("n_tokens", pa.int64()), ("width", pa.int32()), ("prefix_table", pa.binary())])


def counted(path: str, text: Column) -> Column:
    """struct(n_tokens, width, prefix_table) of a text; null counts as empty. Only the text goes to Python."""

    @F.arrow_udf("n_tokens long, width int, prefix_table binary")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = PrefixCounter(load(path))

        def run(part: list) -> pa.Array:
            tables = [counter.text(t or "") for t in part]
            columns = [int(t.sum(dtype=np.int64)) for t in tables], [t.itemsize for t in tables], [t.tobytes() for t in tables]
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, KIND, strict=True)], fields=list(KIND))

        yield from by_slices(texts, KIND, run)

    return count.asNondeterministic()(text)  # so that it is computed once


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's token count and prefix table: id_col, n_tokens, width (bytes of an entry), prefix_table.

    A null text counts as empty: no tokens, an empty table. Very long texts are counted whole, one at a time. Rows may
    repeat, null ids are kept, other columns have no influence. An empty input gives an empty result.
    """
    return docs.select(F.col(id_col), counted(path, F.col(text_col)).alias("counted")).select(id_col, "counted.*")


def _asked(what: Callable[[bytes, int, int], int], tables: Column, width: Column, asked: Column) -> Column:
    @F.arrow_udf("long")
    def answer(stored: pa.Array, width: pa.Array, asked: pa.Array) -> pa.Array:
        return pa.array([what(t.as_buffer(), w.as_py(), max(n.as_py() or 0, 0)) for t, w, n in zip(stored, width, asked, strict=True)], pa.int64())

    return answer(tables, width, asked.cast("long"))


def count_within(chars: Column | int) -> Column:
    """From stored columns prefix_table and width: tokens of the text cut to its first `chars` characters (null: 0)."""
    return _asked(lambda t, w, n: int(_stored(t, w)[:n].sum(dtype=np.int64)), F.col("prefix_table"), F.col("width"), chars if isinstance(chars, Column) else F.lit(chars))


def longest_within(budget: Column | int) -> Column:
    """From stored columns prefix_table and width: characters of the text's longest prefix of at most `budget` tokens (null: 0)."""
    return _asked(longest_prefix, F.col("prefix_table"), F.col("width"), budget if isinstance(budget, Column) else F.lit(budget))


def tokens_within(tables: DataFrame, chars: Column, id_col: str = "doc_id") -> DataFrame:
    """From stored tables: tokens of each text cut to its first `chars` characters (id_col, n_tokens)."""
    return tables.select(id_col, count_within(chars).alias("n_tokens"))


def chars_within(tables: DataFrame, budget: Column, id_col: str = "doc_id") -> DataFrame:
    """From stored tables: characters of each text's longest prefix of at most `budget` tokens (id_col, n_chars)."""
    return tables.select(id_col, longest_within(budget).alias("n_chars"))


LIMIT = 512


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").withColumn("key", F.struct("doc_id", n_bytes.alias("n_bytes")))
    stored = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), id_col="key")
    return stored.select("key.doc_id", "key.n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), longest_within(LIMIT).alias("chars_within_limit"))

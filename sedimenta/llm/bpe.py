"""BPE encoding and decoding with a byte-level vocabulary, by backtracking over Aho-Corasick matches.

A pair of adjacent tokens is compatible if the merges, applied to the pair's bytes alone, give that pair back. A
sequence of pairwise compatible tokens is the one that the merges give for the whole text, so an encoder may try
the longest match first, fall back to shorter ones while the pair doesn't fit, and step back where none does;
every position is marked dead once, which keeps it linear. Decoding gathers byte ranges of the concatenated
vocabulary through an offset table.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import json
import re
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, utf8

#: Fixed values of the byte-level pre-tokenizer: contractions, then runs of letters, numbers and others with at most one
#: space before, then white space.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Characters whose class is the same in every Unicode version since 2015; texts with others are split by the library.
ODD = regex.compile(r"[^\u0000-՗‐-⁤₠-₿←-⏿぀-ゖァ-ヺ㐀-䶵一-鿪가-힣️\U0001f300-\U0001f64f]")
#: The same for texts of Latin letters and general punctuation only, with the classes spelt out and the commonest case first.
L, N, S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
LATIN = re.compile(f" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+")
NOT_LATIN = re.compile("[^\0-\u024f\u2000-\u2064]")
#: Bytes that each of a worker's memories holds before it starts anew, and the longest piece that one keeps.
MEMORY, KEPT = 32 << 20, 64
#: Bytes of an entry besides its key and value: their objects' heads and the table's slot.
ENTRY = 200


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + n): b for n, b in enumerate(others)}


class Memory(dict):
    """A map from keys to what make() gives, bounded by bytes; it begins anew when it is full and keeps no long keys."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.held = make, 0

    def __missing__(self, key):
        got = self.make(key)
        size = len(key) + len(got) if isinstance(key, str) else 0
        if size > KEPT * 8:
            return got
        if self.held >= MEMORY:
            self.forget()
        self.held += size + ENTRY
        self[key] = got
        return got

    def forget(self) -> None:
        self.clear()
        self.held = 0


class Bpe:
    """Tables of a tokenizers file: token bytes by id, the two parts of each token, merges by pair, the automaton."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbols, model = byte_symbols(), spec["model"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.bytes[i] = bytes(symbols[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.ids = {self.bytes[i]: i for i in model["vocab"].values()}
        self.sizes = list(map(len, self.bytes))
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y, z = (model["vocab"][t] for t in (a, b, a + b))
            self.parts[z], self.merged[x, y] = (x, y), z
        self.automaton = ahocorasick.Automaton()
        for key, i in self.ids.items():
            self.automaton.add_word(key.decode("latin-1"), (len(key), i))
        self.automaton.make_automaton()
        self.fits = Memory(lambda pair: self.compatible(*pair))
        self.memory = Memory(lambda piece: array("I", self.encode_piece(piece.encode())).tobytes())  # a piece's ids as below
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    @functools.cached_property
    def library(self):
        """The library's tokenizer, for texts that it has to split: most workers meet none."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def compatible(self, left: int, right: int) -> bool:
        """Would the merges leave this pair as it is? Undoes the later of the two tokens' merges, step by step, and looks
        for an earlier merge across the border. Ids grow in the order of merges."""
        bound = len(self.bytes)
        while True:
            if self.merged.get((left, right), bound) < bound:
                return False
            if left > right:
                inner = self.parts.get(left)
                if inner is not None:
                    bound, left = left, inner[1]
                    continue
                inner = self.parts.get(right)
                if inner is None:
                    return True
                bound, right = right + 1, inner[0]
            else:
                inner = self.parts.get(right)
                if inner is not None:
                    bound, right = right + 1, inner[0]
                    continue
                inner = self.parts.get(left)
                if inner is None:
                    return True
                bound, left = left, inner[1]

    @functools.cached_property
    def shorter(self) -> list[int]:
        """Of each token the longest other one that it begins with, or -1."""
        ids = self.ids
        return [next((ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ids), -1) for t in self.bytes]

    def encode_piece(self, piece: bytes) -> list[int]:
        """The token ids of one piece."""
        whole = self.ids.get(piece)
        if whole is not None:  # a token's own bytes merge to it
            return [whole]
        n = len(piece)
        longest = [-1] * n
        for end, (size, i) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i  # later ends are longer matches
        ids: list[int] = []
        sizes, shorter, fits = self.sizes, self.shorter, self.fits
        at, dead, left, i = 0, bytearray(n + 1), -1, longest[0]
        while at < n:
            while i >= 0 and (dead[at + sizes[i]] or left >= 0 and not fits[left, i]):
                i = shorter[i]
            if i >= 0:
                ids.append(i)
                left = i
                at += sizes[i]
                i = longest[at] if at < n else -1
            else:  # no token fits here: step back and try a shorter one there
                dead[at] = 1
                i = ids.pop()
                at -= sizes[i]
                left = ids[-1] if ids else -1
                i = shorter[i]
        return ids

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or not NOT_LATIN.search(text):
            return LATIN.findall(text)
        if not ODD.search(text):
            return PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[tuple[str, str | None]]:
        """(ordinary text, the special token after it or None at the end)."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers; special strings become special tokens."""
        if not any(s in text for s in self.special):
            return b"".join(map(self.memory.__getitem__, self.pieces(text)))
        out = []
        for part, special in self.segments(text):
            out += map(self.memory.__getitem__, self.pieces(part))
            if special is not None:
                out.append(self.special[special].to_bytes(4, "little"))
        return b"".join(out)

    @functools.cached_property
    def offsets(self) -> tuple[np.ndarray, np.ndarray]:
        """The concatenated vocabulary and where each id's bytes begin in it."""
        return np.frombuffer(b"".join(self.bytes), dtype=np.uint8), np.cumsum([0, *map(len, self.bytes)]).astype(np.int64)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids. Ids outside the vocabulary raise IndexError."""
        blob, offset = self.offsets
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        sizes = offset[i + 1] - offset[i]
        ends = np.cumsum(sizes)
        return blob[np.arange(ends[-1] if len(ends) else 0) + np.repeat(offset[i] - (ends - sizes), sizes)].tobytes()


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    """A worker's tables, read once."""
    return Bpe(path)


def unload() -> None:
    """A worker that goes on to another step gives the tables back; their parts refer to each other, and the allocator keeps what is free."""
    if load.cache_info().currsize:
        load.cache_clear()
        gc.collect()
        with contextlib.suppress(AttributeError, OSError):  # glibc has it
            ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """Parts of an array whose values come to about `most` bytes, or one value."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends, at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def by_slices(texts: Iterator[pa.Array], kind: pa.DataType, run: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """run() on the values of slices of each array, its results put together to one array of that kind again."""
    for t in texts:
        yield pa.chunked_array([run(part.to_pylist()) for part in slices(t)], kind).combine_chunks()
    pa.default_memory_pool().release_unused()  # a worker outlives its task


def encoded(path: str, text: Column) -> Column:
    """The text's ids as little-endian unsigned 32-bit integers; a null text counts as empty. Only the text goes to Python."""

    @F.arrow_udf("binary")
    def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        yield from by_slices(texts, pa.binary(), lambda part: pa.array([bpe.encode(t or "") for t in part], pa.binary()))

    return encode.asNondeterministic()(text)  # so that it is computed once


def decoded(path: str, ids: Column) -> Column:
    """The text of ids; bytes that aren't UTF-8 are replaced, as the library's decoder does. Null ids give a null text."""

    @F.arrow_udf("string")
    def decode(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        yield from by_slices(column, pa.string(), lambda part: pa.array([None if x is None else bpe.decode(x).decode("utf-8", "replace") for x in part], pa.string()))

    return decode.asNondeterministic()(ids)


def encoded_decoded(path: str, text: Column) -> Column:
    """A struct of encoded() and decoded() in one function: two would be two workers a task, each with its own tables."""
    kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])

    @F.arrow_udf("ids binary, decoded string")
    def both(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)

        def run(part: list) -> pa.Array:
            ids = [bpe.encode(t or "") for t in part]
            return pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array([bpe.decode(x).decode("utf-8", "replace") for x in ids], pa.string())], names=["ids", "decoded"])

        yield from by_slices(texts, kind, run)

    return both.asNondeterministic()(text)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's token ids and the text decoded from them: id_col, ids (binary, little-endian unsigned 32-bit), decoded.

    A null text counts as empty; empty texts have no ids and decode to "". Very long texts are encoded whole, one at a
    time. Rows may repeat, null ids are kept, other columns have no influence. Special strings in texts become their
    special tokens, as the library's default has it. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col), encoded_decoded(path, F.col(text_col)).alias("both"))
    return rows.select(id_col, "both.ids", "both.decoded")


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(utf8(F.col("decoded")), 256).alias("decoded_sha256"))

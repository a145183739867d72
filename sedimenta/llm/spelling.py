"""Spelling variants: words of a corpus and the words one error away, by forward and backward minimal acyclic automata.

One inserted, deleted or replaced code point leaves half of a word intact. So a word is looked up twice: in an automaton
of words, where its first half is matched exactly and the rest with one error, and in one of reversed words, where its
last half is. Automata are minimal and count the words below each state, so a walk ends with a word's number, a perfect
hash, by which its count and spelling are read from plain arrays. What both directions find is dropped in the second.

Words that share a half meet in cells: a word of n code points is stored for lookups of words of n - 1, n and n + 1, under
the half that such a word would match. A task builds automata of some whole cells. Halves with more than a ten-thousandth
of all words are cut into blocks, of words stored and of words looked up, which meet in a grid of cells, so a cell is
bounded and no pair of words is formed unless they are near.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, table

#: The words of the query and the rule that plants errors in them.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES, PLANTED = rb"(?:[a-z]++|\xc3[\x80-\xbf])++", 6, 5, 5, 199
#: Distinct words that a task counts before it passes them on, stored words of automata built together, and the share of all rows from which on a half is cut.
COUNTED, CHUNK, SHARE = 200_000, 20_000, 10_000
RUN = re.compile(LETTERS)


def planted(word: bytes, h: int) -> bytes:
    """The run with its code point h % length deleted."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id as text, text in UTF-8) to (word, n), words of LEAST_LENGTH code points or more; a word may come several times."""
    seen: Counter[bytes] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for i, text in zip(b.column(0), b.column(1), strict=True):
            data = (text.as_py() or b"").lower()  # bytes: A-Z only
            start = zlib.crc32((i.as_py() or "").encode() + b":")
            # a run's hash depends on its document alone, so once for all its occurrences there
            for run, n in Counter(RUN.findall(data)).items():
                h = zlib.crc32(run, start)
                if h % PLANTED == 0:
                    run = planted(run, h)
                if len(run) >= LEAST_LENGTH and (run.isascii() or len(run.decode()) >= LEAST_LENGTH):
                    seen[run] += n
            if len(seen) >= COUNTED:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """word, n: the words of whole texts with at least `least` occurrences. Null texts have none; a null id counts as empty."""
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted distinct words, with a number for each: its place in their order."""

    def __init__(self, words: list[str]):
        """Words are added in order; what no later word can change is replaced by an equal state that is known."""
        self.edges: list[dict[str, int]] = [{}]
        self.final: list[bool] = [False]
        known: dict[tuple, int] = {}
        open_: list[tuple[int, str]] = []  # the path of the last word: (state, letter taken there)
        free: list[int] = []
        last = ""

        def close(depth: int) -> None:
            while len(open_) > depth:
                at, letter = open_.pop()
                state = self.edges[at][letter]
                same = known.setdefault((self.final[state], *self.edges[state].items()), state)
                if same != state:
                    self.edges[at][letter] = same
                    free.append(state)

        for word in words:
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            close(shared)
            state = self.edges[open_[-1][0]][open_[-1][1]] if open_ else 0
            for letter in word[shared:]:
                if free:
                    new = free.pop()
                    self.edges[new], self.final[new] = {}, False
                else:
                    new = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                self.edges[state][letter] = new
                open_.append((state, letter))
                state = new
            self.final[state] = True
            last = word
        close(0)
        self._number()

    def _number(self) -> None:
        """skip[state][letter]: how many words of the state come before those that go on with the letter."""
        self.below = [0] * len(self.edges)
        self.skip: list[dict[str, int]] = [{} for _ in self.edges]
        done = [False] * len(self.edges)
        todo = [0]
        while todo:
            state = todo[-1]
            wait = [t for t in self.edges[state].values() if not done[t]]
            if wait and not done[state]:
                todo.extend(wait)
                continue
            todo.pop()
            if done[state]:
                continue
            n = int(self.final[state])
            for letter in self.edges[state]:  # sorted, as words came in order
                self.skip[state][letter] = n
                n += self.below[self.edges[state][letter]]
            self.below[state], done[state] = n, True

    def walk(self, state: int, number: int, rest: str) -> tuple[int, int]:
        """The state and number behind `rest`; state -1 where the words end."""
        for letter in rest:
            to = self.edges[state].get(letter)
            if to is None:
                return -1, number
            number += self.skip[state][letter]
            state = to
        return state, number

    def number(self, word: str) -> int:
        """A word's number, -1 if it isn't one of the words."""
        state, number = self.walk(0, 0, word)
        return number if state >= 0 and self.final[state] else -1

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that begin with word[:exact] and differ in the rest by exactly one code point."""
        found: set[int] = set()
        state, number = self.walk(0, 0, word[:exact])
        at = exact
        while state >= 0:
            edges, skip, tail = self.edges[state], self.skip[state], word[at + 1 :]
            ends = []
            if at < len(word):
                ends.append((state, number, tail))  # a code point too many
            for letter, to in edges.items():
                ends.append((to, number + skip[letter], word[at:]))  # one is missing
                if at < len(word) and letter != word[at]:
                    ends.append((to, number + skip[letter], tail))
            for s, k, rest in ends:
                s, k = self.walk(s, k, rest)
                if s >= 0 and self.final[s]:
                    found.add(k)
            if at >= len(word):
                break
            state, number = self.walk(state, number, word[at])
            at += 1
        return found


def _halves(stored: dict[str, int], asked: set[str], backward: bool) -> Iterator[tuple[str, str, int]]:
    """(word asked, near word, its n) of one direction. Backward, words whose first half agrees as well are left to the other."""
    turn = (lambda w: w[::-1]) if backward else (lambda w: w)
    words = sorted(map(turn, stored))
    automaton, counts = Automaton(words), [stored[turn(w)] for w in words]
    for word in asked:
        half = len(word) // 2
        for k in automaton.near(turn(word), len(word) - half if backward else half):
            other = turn(words[k])
            if not (backward and other[:half] == word[:half]):
                yield word, other, counts[k]


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, alone, backward, asks, word, n), sorted by cell, to (word, n_near, form, form_n), a row a word and chunk.

    Cells are put together up to CHUNK stored words; a cell of a half that was cut stays alone.
    """
    stored: tuple[dict[str, int], dict[str, int]] = ({}, {})
    asked: tuple[set[str], set[str]] = (set(), set())

    def run() -> pa.RecordBatch:
        near: dict[str, list] = {}
        for backward in (0, 1):
            for word, other, n in _halves(stored[backward], asked[backward], bool(backward)) if stored[backward] and asked[backward] else ():
                best = near.setdefault(word, [0, other, n])
                best[0] += 1
                if (-n, other) < (-best[2], best[1]):
                    best[1:] = other, n
            stored[backward].clear()
            asked[backward].clear()
        columns = [list(near), *([v[k] for v in near.values()] for k in range(3))]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["word", "n_near", "form", "form_n"])

    last, last_alone = None, False
    for b in batches:
        for cell, alone, backward, asks, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if cell != last and last is not None and (alone or last_alone or len(stored[0]) + len(stored[1]) >= CHUNK):
                yield run()
            last, last_alone = cell, alone
            if asks:
                asked[backward].add(word)
            else:
                stored[backward][word] = n
    if last is not None:
        yield run()


def near_words(words: DataFrame, share: int = SHARE, block: int = CHUNK) -> DataFrame:
    """Of words (distinct word, n; no null), those that have near ones: word, n_near, form (the near word of largest n, ties to the
    smallest), form_n.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. A half is cut into
    blocks if it has more than `block` rows and more than a `share`-th of all.
    """
    length = F.length("word")
    rows = words.where(length > 0).select("word", "n", F.explode(F.array(F.struct(F.lit(True).alias("asks"), length.alias("of")), *[F.struct(F.lit(False).alias("asks"), (length + d).alias("of")) for d in (-1, 0, 1)])).alias("s"))
    rows = rows.select("word", "n", "s.asks", "s.of", F.explode(F.array(F.lit(0), F.lit(1))).alias("backward")).where("of > 0")
    front = F.floor(F.col("of") / 2)
    # the half that a word of `of` code points matches exactly; a stored word shorter than that can't be near
    kept = F.when(F.col("backward") == 0, front).otherwise(F.col("of") - front).cast("int")
    half = F.when(F.col("backward") == 0, F.substring("word", F.lit(1), kept)).otherwise(F.when(kept > 0, F.substring("word", -kept, kept)).otherwise(""))
    rows = materialize(rows.where(kept <= length).withColumn("key", F.xxhash64("backward", "of", half)).drop("of"), "halves")
    total = rows.count()
    sizes = rows.groupBy("key").agg(F.count_if("asks").alias("n_asked"), F.count_if(~F.col("asks")).alias("n_stored"))
    limit = max(block, total // share)
    blocks = lambda c: F.ceil(F.col(c) / limit).alias(c)
    # more than a share-th of the rows each, so fewer than `share` of them
    hot = F.broadcast(sizes.where(F.col("n_asked") + F.col("n_stored") > limit).select("key", blocks("n_asked"), blocks("n_stored")))
    own = lambda n: F.pmod(F.xxhash64("word"), F.greatest(F.col(n), F.lit(1)))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1)
    spread = rows.join(hot, "key", "left").withColumn("alone", F.col("n_stored").isNotNull())
    grid = F.when(~F.col("alone"), F.array(F.col("key"))).when(F.col("asks"), F.transform(every("n_stored"), lambda i: F.xxhash64("key", i, own("n_asked")))).otherwise(F.transform(every("n_asked"), lambda j: F.xxhash64("key", own("n_stored"), j)))
    cells = spread.select(F.explode(grid).alias("cell"), "alone", "backward", "asks", "word", "n").repartition("cell").sortWithinPartitions("cell")
    found = cells.mapInArrow(_search, "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), "form"))
    done = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))
    return done.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """Rows (word, form), each word once and no cycle, to (word, root), following forms to the last.

    Each round doubles the steps that a row has taken, so there are as many as the logarithm of the longest chain.
    """
    at = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = at.select(F.col("word").alias("via"), F.col("root").alias("next"))
        moved = materialize(at.join(step, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        release(at)
        at = moved
        if not moved.where("moved").limit(1).count():
            return moved.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of word_counts().

    form: the near word of largest n (ties: the smallest in code-point order) if that n is at least `times` the
    word's, else null with form_n; root: where forms lead, the word itself without one. A form occurs `times` as often, so
    chains end. Rows that repeat count as often as they come; very long texts are read whole; other columns have no
    influence. An empty table gives an empty result.
    """
    words = materialize(word_counts(docs, id_col, text_col), "words")
    near = materialize(words.join(near_words(words), "word", "left"), "near_words")
    right = F.col("form_n") >= times * F.col("n")
    formed = near.where(right).select("word", "form")
    rows = near.join(roots(formed), "word", "left")
    done = lambda c: F.when(right, F.col(c)).alias(c)
    return rows.select("word", done("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), done("form_n"))


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range::BIGINT, 0, range::BIGINT FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8
), r AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents
), x AS (SELECT run, count(*) AS n, hex(encode(doc || run)) AS x FROM r GROUP BY doc, run
), b AS (
  SELECT run, n, list_transform(range(length(x) // 2), lambda k: (16 * (strpos('0123456789ABCDEF', x[2 * k + 1]) - 1) + strpos('0123456789ABCDEF', x[2 * k + 2]) - 1)::BIGINT) AS b FROM x
), h AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS h FROM b, crc
), w AS (
  SELECT CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM h
), words AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS short FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.short = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.short = b.word
), best AS (SELECT word, other, n AS form_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS k FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 5 * w.n THEN other END AS form, CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND k = 1
), led(word, root, form) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT l.word, f.word, f.form FROM led l JOIN formed f ON l.form = f.word
)
SELECT f.word, f.form, l.root, f.n, f.n_near, f.form_n FROM formed f JOIN led l ON f.word = l.word AND l.form IS NULL
"""

"""Near-duplicates by HyperMinHash: compressed registers, banding, estimates, and links confirmed on full sets.

A document's set is its distinct five-word shingles, hashed to 64 bits. The top bits deal a shingle to one of
REGISTERS buckets; a bucket keeps its least hash as a leading-zero count and MANTISSA further bits. For banding,
empty registers borrow from the first occupied one of a fixed random order of their own. The first ROWS * BANDS registers
give BANDS keys; estimates use all. A pair at a similarity of 0.75 meets in one with a probability of 1 - (1 - 0.75^4)^32 = 0.999995.

Texts that agree word by word are one class, whatever their ids, before anything is compared. Then:
1. In every bucket of classes, each is paired with the bucket's centre (a star, linear in the bucket).
2. Pairs whose estimate from the registers (corrected for collisions) leaves 0.75 possible are confirmed on the full
   sets, and links give components.
3. Buckets that still hold several components: each class outside the bucket's main component (the largest one, or the
   centre's if all are small) is compared with all classes of other components in the bucket, block by block on registers, and every pair
   that the estimate leaves possible is confirmed inside its block, likeliest first, unless links found there have joined
   its components. Pairs inside a component need no comparison, so a large group of copies costs its star only. A class's
   registers and text are joined to it once, whatever the number of blocks that it is compared with.
4. Where more than CROWD such classes stand in a bucket (texts of one template, say), they and what meets the same component
   are first cut into smaller groups in a way that loses no link: shingles are ordered, those that the component's first
   class has last, and two sets that are linked share one within the first part of both (the prefix filter of set
   similarity joins: of n shingles the first n - 6n/7 + 1 of the smaller and the first n - 3n/4 + 1 of the larger). So
   classes that share a template but little else don't meet, and step 3 runs on the groups of classes that share such a
   shingle. A class is compared with CROWD others in a bucket at most, or with those of its groups.
No bucket is capped, and pairs that aren't links leave no task. Keys with more than a thousandth of the rows (a large
group of copies has hot buckets and a hot centre) are dealt over salts in every join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedimenta.operators.graph import components

from .common import hot_keys, materialize, release, salted_join, table

WORDS, SIMILARITY = 5, 75
REGISTERS, MANTISSA, ROWS, BANDS = 256, 10, 4, 32
BUCKET_BITS = REGISTERS.bit_length() - 1
#: Standard errors below the threshold from which on an estimate rules a pair out, and how often two different
#: registers agree by chance: about a third (equal zero counts) of one in 2^MANTISSA.
ERRORS, COLLISION = 5.0, 1 / 3 / (1 << MANTISSA)
#: Classes of a block in step 3, and those outside the main component beyond which a bucket is crowded.
BLOCK, CROWD = 256, 1024
#: Of each register the order in which it looks for an occupied one, itself first.
PROBES = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)) + 1 - 2 * np.eye(REGISTERS), axis=1)
BANDED = PROBES[: BANDS * ROWS]
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles_of_words(words: list[bytes]) -> np.ndarray:
    """The sorted distinct shingle hashes; of fewer than WORDS words one, of the whole sequence."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=n)
    size = min(n, WORDS)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + w[k : n - size + 1 + k]
    return np.unique(mix(h))


def shingles_of_text(data: bytes | None) -> np.ndarray:
    return shingles_of_words((data or b"").lower().split())


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: 0 if empty, else 1 + (exponent, MANTISSA bits) of the bucket's least hash."""
    out = np.zeros(REGISTERS, dtype=np.uint16)
    buckets = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    # the float's exponent is the place of the highest bit, its mantissa the bits below
    least = (hashes[first] & np.uint64((1 << (64 - BUCKET_BITS)) - 1)).astype(np.float64) + 1.0
    bits = least.view(np.uint64)
    out[buckets[first]] = ((bits >> np.uint64(52 - MANTISSA)) - np.uint64(1023 << MANTISSA)).astype(np.uint16) + 1
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """A key for each band, of registers with the empty ones filled."""
    full = regs
    if not regs.all():
        full = regs[BANDED[np.arange(BANDS * ROWS), (regs != 0)[BANDED].argmax(axis=1)]]
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in full[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64).T:
        h = mix(h * MULTIPLIER + column)
    return h.view(np.int64)


def estimates(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of registers a and b (broadcast, the last axis REGISTERS): the similarity, and whether it could reach the threshold."""
    seen = ((a != 0) | (b != 0)).sum(axis=-1)
    equal = ((a == b) & (a != 0)).sum(axis=-1)
    t = SIMILARITY / 100
    estimate = (equal / np.maximum(seen, 1) - COLLISION) / (1 - COLLISION)
    return estimate, estimate >= t - ERRORS * np.sqrt(t * (1 - t) / np.maximum(seen, 1))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= SIMILARITY * union, on full sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < SIMILARITY * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= SIMILARITY * (small + large - both)


SKETCH = "id long, text_key long, h1 long, h2 long, n_shingles long, registers binary, bands array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text_key, text) to SKETCH."""
    for b in batches:
        for at in range(0, len(b), 1000):
            part, rows = b.slice(at, 1000), []
            for value in part.column(2):
                words = (value.as_py() or b"").lower().split()
                if not words:
                    rows.append((None, None, 0, None, None))
                    continue
                s = shingles_of_words(words)
                key = np.frombuffer(hashlib.md5(b" ".join(words)).digest(), dtype=np.int64)
                regs = registers(s)
                rows.append((int(key[0]), int(key[1]), len(s), regs.tobytes(), bands(regs)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], names=["id", "text_key", "h1", "h2", "n_shingles", "registers", "bands"])


def _as_registers(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, registers of x, of y) to the pairs (x, y) that are possible."""
    for b in batches:
        if len(b):
            keep = pa.array(estimates(_as_registers(b.column(2)), _as_registers(b.column(3)))[1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(keep)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, text of x, of y) to the links (x, y). Rows of one y come together; its set is made once."""
    last, last_set = None, None
    for b in batches:
        keep = []
        for x, y in zip(b.column(2), b.column(3), strict=True):
            y = y.as_py()
            if y != last:
                last, last_set = y, shingles_of_text(y)
            keep.append(linked(shingles_of_text(x.as_py()), last_set))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))


def _by_cell(batches: Iterator[pa.RecordBatch], run) -> Iterator[pa.RecordBatch]:
    """run() on tables of whole cells, from batches sorted by cell (column 0); a cell has about two blocks at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        cell = b.column(0).to_numpy()
        cut = int(np.searchsorted(cell, cell[-1], side="left"))
        if cut:
            yield from run(pa.Table.from_batches([*held, b.slice(0, cut)]).combine_chunks())
            held = []
        elif held and held[-1].column(0)[0].as_py() != cell[0]:
            yield from run(pa.Table.from_batches(held).combine_chunks())
            held = []
        held.append(b.slice(cut))
    if held:
        yield from run(pa.Table.from_batches(held).combine_chunks())


def _pairs_of_cells(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of each cell: rows of side 0, rows of side 1 in possible pairs of different components, and estimates.

    One row of a pair is a `smaller` one.
    """
    cell, side, comp = (t.column(k).to_numpy() for k in ("cell", "side", "component"))
    smaller = t.column("smaller").to_numpy(zero_copy_only=False)
    regs = np.frombuffer(b"".join(t.column("registers").to_pylist()), dtype=np.uint16).reshape(len(t), REGISTERS)
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, [len(cell)]])
    for a, e in zip(bounds[:-1], bounds[1:], strict=True):
        left, right = a + np.flatnonzero(side[a:e] == 0), a + np.flatnonzero(side[a:e] == 1)
        for k in range(0, len(left), 32):
            part = left[k : k + 32]
            estimate, able = estimates(regs[part][:, None, :], regs[right][None, :, :])
            able &= smaller[part][:, None] | smaller[right][None, :]
            i, j = np.nonzero(able & (comp[part][:, None] != comp[right][None, :]))
            if len(i):
                yield part[i], right[j], estimate[i, j]


def _select_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, node, component, smaller, registers) to those without registers that are part of a possible pair."""

    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(len(t), dtype=bool)
        for i, j, _ in _pairs_of_cells(t):
            wanted[i] = wanted[j] = True
        yield from t.drop_columns(["registers"]).filter(pa.array(wanted)).to_batches()

    return _by_cell(batches, run)


def _confirm_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, side, node, component, smaller, registers, text) to links (x, y), likeliest pairs first.

    A pair whose components a link of its part of the cell has joined already needs no set comparison.
    """
    def run(t: pa.Table) -> Iterator[pa.RecordBatch]:
        node, comp, texts = t.column("node").to_numpy(), t.column("component").to_numpy(), t.column("text")
        links: list[tuple[int, int]] = []
        last_cell, sets, above = None, {}, {}
        cell = t.column("cell").to_numpy()

        def top(c: int) -> int:
            while c in above:
                c = above[c]
            return c

        def of(r: int) -> np.ndarray:
            if r not in sets:
                sets[r] = shingles_of_text(texts[r].as_py())
            return sets[r]

        for i, j, estimate in _pairs_of_cells(t):
            if cell[i[0]] != last_cell:
                last_cell, sets, above = cell[i[0]], {}, {}
            for k in np.argsort(-estimate, kind="stable"):
                a, b = int(i[k]), int(j[k])
                x, y = top(int(comp[a])), top(int(comp[b]))
                if x != y and linked(of(a), of(b)):
                    above[max(x, y)] = min(x, y)
                    links.append((int(node[a]), int(node[b])))
        if links:
            x, y = zip(*links, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["x", "y"])

    return _by_cell(batches, run)


def prefixes(s: np.ndarray, centre: np.ndarray, main: int) -> tuple[np.ndarray, np.ndarray]:
    """Group keys of a set that meets the component `main`, and for which of them it can be the smaller set of a link."""
    n = len(s)
    known = np.isin(s, centre, assume_unique=True)
    ordered = np.concatenate([s[~known], s[known]])  # both parts are sorted by hash: one order for all sets that meet it
    smaller, larger = n + 1 + -2 * SIMILARITY * n // (100 + SIMILARITY), n + 1 + -SIMILARITY * n // 100
    keys = mix(ordered[:larger] * MULTIPLIER + np.uint64(main % (1 << 64)))
    return keys.view(np.int64), np.arange(larger) < smaller


def _prefix_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (main, node, component, text, text of main) to (group, node, component, first, smaller). Rows of one main come together."""
    last, centre = None, None
    for b in batches:
        for main, node, component, text, other in zip(*b.columns, strict=True):
            other = other.as_py()
            if last is None or other != last:
                last, centre = other, shingles_of_text(other)
            keys, smaller = prefixes(shingles_of_text(text.as_py()), centre, main.as_py())
            same = lambda x, kind: pa.array(np.full(len(keys), x, dtype=kind))  # noqa: B023, E731
            columns = [pa.array(keys), same(node.as_py(), np.int64), same(component.as_py(), np.int64), same(component.as_py() != main.as_py(), bool), pa.array(smaller)]
            yield pa.RecordBatch.from_arrays(columns, names=["group", "node", "component", "first", "smaller"])


def _with(pairs: DataFrame, values: DataFrame, value: str, hot: list) -> DataFrame:
    """Pairs (x, y) with a class's value on either side: x, y, x_value, y_value. Rows of one y are neighbours; hot y's are salted."""
    left = pairs.join(values.select(F.col("node").alias("x"), F.col(value).alias("x_value")), "x")
    both = salted_join(left, values.select(F.col("node").alias("y"), F.col(value).alias("y_value")), ["y"], hot, "x")
    return both.select("x", "y", "x_value", "y_value").sortWithinPartitions("y")


def _links_of_groups(groups: DataFrame, sketch: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (x, y) between different components among classes of one group, from rows (group, node, component, first, smaller).

    One class of a pair is a `first` one, and one (or the same) a `smaller` one. Blocks of the first meet blocks of all
    in cells, so a group of any size is spread over tasks. Registers select the classes of possible pairs; their texts
    come to the cells, and only links leave them. Joins have a row a class: its groups and cells are a list there.
    """
    sizes = groups.groupBy("group").agg(
        F.count_if("first").alias("n_first"), F.count("*").alias("n_all"), F.min("component").alias("low"), F.max("component").alias("high"), F.bool_or("smaller").alias("some")
    )
    sizes = materialize(sizes.where("n_first > 0 AND n_all > 1 AND low <> high AND some").select("group", "n_first", "n_all"), "groups")
    total = sizes.agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
    blocks = sizes.select("group", F.ceil(F.col("n_first") / BLOCK).alias("first_blocks"), F.ceil(F.col("n_all") / BLOCK).alias("all_blocks"))
    sized = salted_join(groups, blocks, ["group"], hot_keys(sizes, ["group"], "n_all", total), "node")
    of_node = lambda df, *columns: df.groupBy("node").agg(F.collect_list(F.struct(*columns)).alias("list"))
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    cell = lambda i, j, side: F.struct(F.xxhash64("group", i, j).alias("cell"), F.lit(side).alias("side"))
    one = F.transform(F.when(F.col("first"), upto("all_blocks")).otherwise(F.array().cast("array<long>")), lambda j: cell(place("first_blocks"), j, 0))
    other = F.transform(upto("first_blocks"), lambda i: cell(i, place("all_blocks"), 1))
    sorted_ = lambda df: df.repartition("cell").sortWithinPartitions("cell")
    kept = ["cell", "side", "node", "component", "smaller", "registers"]
    listed = of_node(sized, "group", "component", "first", "smaller", "first_blocks", "all_blocks").join(sketch, "node")
    cells = listed.select("node", "registers", F.inline("list")).select("node", "component", "smaller", "registers", F.inline(F.concat(one, other)))
    wanted = sorted_(cells.select(*kept)).mapInArrow(_select_members, "cell long, side int, node long, component long, smaller boolean")
    with_text = of_node(wanted, "cell", "side", "component", "smaller").join(sketch, "node").join(texts, "node")
    with_text = with_text.select("node", "registers", "text", F.inline("list")).select(*kept, "text")
    return sorted_(with_text).mapInArrow(_confirm_cells, "x long, y long").distinct()


def _groups(shared: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (group, node, component, first, smaller) of the buckets that hold several components.

    The classes outside a bucket's main component are its first ones. Main is the largest one (of several any) if it has a
    tenth of the classes, so their number doesn't hang on which class is the centre; else it is the centre's. Crowded buckets are put together by their main component and
    cut by prefixes.
    """
    labelled = materialize(shared.join(found, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component")), "labelled")
    parts = labelled.groupBy("band", "component").agg(F.count("*").alias("n_part"), F.min("node").alias("least"))
    bands = parts.groupBy("band").agg(
        F.max_by("component", "n_part").alias("largest"), F.max("n_part").alias("n_largest"), F.min_by("component", "least").alias("of_centre"), F.sum("n_part").alias("n"), F.count("*").alias("n_parts")
    ).where("n_parts > 1")
    # without a large component, buckets of one template have few centres, so they are put together
    main = F.when(F.col("n_largest") * 10 >= F.col("n"), F.col("largest")).otherwise(F.col("of_centre"))
    bands = materialize(bands.select("band", main.alias("main"), "n"), "mains")
    hot = hot_keys(bands, ["band"], "n", labelled.count())
    met = salted_join(labelled, bands.drop("n"), ["band"], hot, "node").withColumn("first", F.col("component") != F.col("main"))
    met = materialize(met, "met")
    crowded = materialize(met.where("first").groupBy("band").agg(F.count("*").alias("n_first")).where(F.col("n_first") > CROWD), "crowded")
    few = met.join(crowded, "band", "left_anti").select(F.col("band").alias("group"), "node", "component", "first", F.lit(True).alias("smaller"))
    many = materialize(salted_join(met, crowded, ["band"], hot, "node").select("main", "node", "component").distinct(), "many")
    hot = hot_keys(many.groupBy("main").agg(F.count("*").alias("n")), ["main"], "n", many.count())
    mains = texts.select(F.col("node").alias("main"), F.col("text").alias("main_text")).join(many.select("main").distinct(), "main", "left_semi")
    beside = salted_join(many.join(texts, "node"), mains, ["main"], hot, "node").sortWithinPartitions("main")
    cut = beside.select("main", "node", "component", "text", "main_text").mapInArrow(_prefix_groups, "group long, node long, component long, first boolean, smaller boolean")
    out = materialize(few.union(cut), "members")
    release(labelled, bands, met, crowded, many)
    return out


def labelled_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row's id, text_key (xxhash64 of the text), n_shingles, component (null without words) and component_id."""
    id_ = F.col(id_col).cast("long")
    rows = docs.select(id_.alias("id"), F.xxhash64(id_).alias("id_key"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    sketches = materialize(rows.drop("id_key").mapInArrow(_sketch, SKETCH).withColumn("row", F.monotonically_increasing_id()), "sketches")
    full = sketches.where("n_shingles > 0")
    classes = materialize(full.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("row").alias("node"), F.count("*").alias("n_rows")), "classes")
    reps = sketches.join(classes.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node")

    banded = reps.select("node", F.explode("bands").alias("band"))
    buckets = materialize(banded.groupBy("band").agg(F.min("node").alias("centre"), F.count("*").alias("n")).where("n > 1"), "buckets")
    total = BANDS * classes.count()
    shared = materialize(salted_join(banded, buckets, ["band"], hot_keys(buckets, ["band"], "n", total), "node"), "shared")
    members = shared.select("node").distinct()
    wanted = materialize(reps.join(members, "node").select("node", "id", "text_key", "registers"), "registers")
    sketch = wanted.select("node", "registers")
    named = wanted.select("node", F.xxhash64("id").alias("id_key"), "text_key")
    # one text of rows that repeat; grouped as joined, so without another shuffle
    texts = rows.select("id_key", "text_key", "text").join(named, ["id_key", "text_key"])
    texts = materialize(texts.groupBy("id_key", "text_key", "node").agg(F.first("text").alias("text")).select("node", "text"), "texts")

    star = materialize(shared.where("node <> centre").select(F.col("node").alias("x"), F.col("centre").alias("y")).distinct(), "star")
    hot = hot_keys(star.groupBy("y").agg(F.count("*").alias("n")), ["y"], "n", star.count())
    hopeful = _with(star, sketch, "registers", hot).mapInArrow(_estimate, "x long, y long")
    links = materialize(_with(hopeful, texts, "text", hot).mapInArrow(_confirm, "x long, y long").toDF("a", "b"), "links")
    found = components(links)

    groups = _groups(shared.where("n > 2"), found, texts)
    more = materialize(_links_of_groups(groups, sketch, texts).toDF("a", "b"), "links")
    if more.limit(1).count():
        release(found)
        found = components(links.union(more))
    of_class = materialize(classes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "components")
    release(buckets, shared, wanted, texts, star, links, groups, more, found)

    # a component of one class needs no join; the others' smallest ids go back to their classes
    least = of_class.groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("n"))
    n_classes = of_class.count()
    of_class = salted_join(of_class, least.drop("n"), ["component"], hot_keys(least, ["component"], "n", n_classes), "node")
    of_class = materialize(of_class.select("h1", "h2", "component", "component_id", "n_rows"), "components")
    keyed = salted_join(full.select("id", "text_key", "h1", "h2", "n_shingles", "row"), of_class.drop("n_rows"), ["h1", "h2"], hot_keys(of_class, ["h1", "h2"], "n_rows", sketches.count()), "row")
    nothing = sketches.where("n_shingles = 0").select("id", "text_key", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("id").alias("component_id"))
    return keyed.select(nothing.columns).union(nothing)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id_col, n_shingles, component_id (the smallest id reachable over links) and kept (it is that id).

    Ids are integers. Texts that are null or have no word have no shingles and are linked with nothing. Rows with a
    null id link others like any row: their component_id is the smallest id of their component, null if there is none,
    and they are not kept. Repeated rows are copies; of texts that share an id each is linked by itself. Very long texts
    are read whole. Other columns have no influence. An empty table gives an empty result.
    """
    rows = labelled_rows(docs, id_col, text_col)
    return rows.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: that with its smallest id (null where none has one), then the smallest hash
    of the text, then of the whole row. Rows without words are in no component; of those with one id and text one stays.
    """
    rows = materialize(labelled_rows(docs, id_col, text_col), "rows")
    first = rows.where(F.col("component").isNotNull() & F.col("id").eqNullSafe(F.col("component_id")))
    first = first.groupBy("component", "component_id").agg(F.min("text_key").alias("of_key"))
    alone = rows.where("component IS NULL").select(F.col("id").alias("component_id"), F.col("text_key").alias("of_key"))
    keep = first.select("component_id", "of_key").union(alone).distinct().select(F.xxhash64("component_id").alias("__id"), F.col("of_key").alias("__key"))
    keyed = docs.withColumns({"__id": F.xxhash64(F.col(id_col).cast("long")), "__key": F.xxhash64(text_col), "__tie": F.xxhash64(*docs.columns)})
    chosen = keyed.join(keep, ["__id", "__key"], "left_semi")
    rank = F.row_number().over(Window.partitionBy("__id", "__key").orderBy("__tie"))
    return chosen.withColumn("__rank", rank).where("__rank = 1").select(*docs.columns)


def op7_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x
), c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

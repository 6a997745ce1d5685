"""Near-duplicate detection: MinHash bands, odd sketches, exact confirmation.

A document's set is its distinct word shingles. Documents with one and the same
set form a class, so that copies cost one row each from then on. MinHash samples
of a class give its bands, and are folded into an odd sketch: a bitmap in which
every sample flips one bit. The population count of the exclusive or of two
sketches estimates a high similarity closely, which decides what band mates are
worth confirming. What passes is confirmed on the full sets.

Within a bucket of equal bands, every class is held against the bucket's smallest
class first, not against all. Only classes of buckets that still span several
components are held against each other, in cells: a bucket is cut into blocks of
about ``BLOCK`` classes, and a cell has the sketches of two blocks, each sent once. It puts
out only what passes the sketch. Confirmation goes by cells too: candidates that hang together
form a group, a group is cut into blocks of about ``BLOCK_SHINGLES`` shingles, and each set is
sent once to the cells that need it, not once for each pair. So no task holds more than two
blocks, whatever the size of a bucket or group.

With 32 bands of 5 samples, a link at a similarity of exactly 0.8 shares a bucket with
probability 1 - 3e-6, and passes the sketch with probability 1 - 1e-6.

Classes, not texts, are shuffled; texts of candidates are read again by id.
Defined results: texts that are null or have no word have an empty set and are
linked with nothing; very long texts are taken whole. Rows that share an id and a text are one document. A null id
can be in a class; the component's name is the smallest id that isn't null. Which of equal classes leads a bucket
doesn't change components. An empty table gives an empty result; extra columns are ignored, or kept by
``keep_one``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, filter_by_keys, heavy_safe_join
from corpusloom.llm.graph import components
from corpusloom.llm.words import Words, mix, runs, slices

BANDS, ROWS = 32, 5
#: Samples of a set; the bands use the first of them, the sketch all.
SAMPLES = 256
SKETCH_BITS = 1024
#: Pairs below this estimate aren't confirmed; a pair at 0.8 is below it with a probability of 1e-6.
SKETCH_FLOOR = 0.658
#: Classes of a bucket, and shingles of a group, that a block has on average.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: Ways into which the partners of one class are spread.
SALTS = 64

_rng = np.random.default_rng(20240229)
_ODD = (_rng.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, (SAMPLES, 1), dtype=np.uint64).astype(np.uint32)
_WORD = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(w: Words, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of so many words, for each row.

    A row of fewer words has its whole sequence as its only shingle.
    """
    all_runs = runs(w.hashes, words)
    for a, z in zip(w.first.tolist(), w.first[1:].tolist()):
        yield np.unique(all_runs[a : z - words + 1]) if z - a >= words else runs(w.hashes[a:z], z - a) if z > a else np.empty(0, np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of 32 bits, in blocks that fit a cache."""
    low = np.full(SAMPLES, np.iinfo(np.uint32).max, np.uint32)
    folded = (shingles >> np.uint64(32)).astype(np.uint32)
    room = np.empty((SAMPLES, min(256, len(folded))), np.uint32)
    for at in range(0, len(folded), 256):
        part = folded[at : at + 256]
        block = room[:, : len(part)]
        np.bitwise_xor(part, _XOR, out=block)
        np.multiply(block, _ODD, out=block)
        np.minimum(low, block.min(axis=1), out=low)
    return low


def bands(samples: np.ndarray) -> np.ndarray:
    total = _BAND.copy()
    for j, col in enumerate(samples[: BANDS * ROWS].astype(np.uint64).reshape(BANDS, ROWS).T):
        total = mix(total + col * _WORD[j])
    return total.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH_BITS bits as 64-bit words; bit i is the parity of the samples that hash to i."""
    at = mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    parity = np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8)).view(np.int64)


def most_flips(floor: float = SKETCH_FLOOR) -> int:
    """The population count that an estimate of ``floor`` stands for."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - floor) / SKETCH_BITS)))


def _signatures(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, n, digest (of the set), its beginning as a number, sketch and bands of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for b in batches:
            for at, w in slices(b.column(2), fold=True):
                n, digest, sketch, band = [], [], [], []
                for s in shingle_sets(w, words):
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    samples = minhash(s) if len(s) else None
                    sketch.append(odd_sketch(samples) if len(s) else None)
                    band.append(bands(samples) if len(s) else None)
                part = b.slice(at, len(n))
                short = np.frombuffer(b"".join(digest), ">i8")[::2].astype(np.int64)
                cols = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(short), pa.array(sketch, longs), pa.array(band, longs)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], names=names)

    names = ["doc_id", "text_key", "n", "digest", "short", "sketch", "bands"]
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, digest binary, short bigint, sketch array<bigint>, bands array<bigint>")


def _sets(docs: DataFrame, words: int, text_col: str) -> DataFrame:
    """digest and shingles of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, w in slices(b.column(0), fold=True):
                sets = list(shingle_sets(w, words))
                digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([digest, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["digest", "shingles"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "digest binary, shingles array<bigint>")


def _look_up(pairs: DataFrame, facts: DataFrame, end: str, other: str) -> DataFrame:
    """Join facts (digest, ...) to one end of pairs.

    A class that is in very many pairs is copied to the SALTS ways that its
    partners are spread over, as far as there are any.
    """
    spread = pairs.withColumn("salt", F.pmod(F.xxhash64(other), F.lit(SALTS)))
    copies = spread.select(end, "salt").distinct().join(facts.withColumnRenamed("digest", end), end)
    return spread.join(copies, [end, "salt"]).drop("salt")


def _star(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that pass by length and sketch."""
    side = lambda x: classes.select("digest", F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}"))
    both = _look_up(_look_up(pairs, side("a"), "a", "b"), side("b"), "b", "a")
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    flips = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return both.filter(fits & (flips <= most_flips())).select("a", "b", "n_a", "n_b")


def _blocks(sizes: Column, each: int) -> Column:
    return F.ceil(sizes / F.lit(each)).cast("int")


def _cells(rows: DataFrame) -> DataFrame:
    """Copies of rows with a block among ``blocks``, one for each block they are to meet: with lo and hi."""
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")


def _within_buckets(open_: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b, n_a, n_b) of classes of one bucket (band, digest, label, n, sketch), of different labels, that pass by length and sketch."""
    sizes = scratch.write("sizes", open_.groupBy("band").agg(F.count(F.lit(1)).alias("size")))
    placed = heavy_safe_join(open_, sizes, "band", "size", open_.count()).withColumn("blocks", _blocks(F.col("size"), BLOCK)).drop("size")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int"))
    most = most_flips()

    def pairs(group: list) -> tuple[list, list, list, list]:
        digest, label, n, block = ([r[i] for r in group] for i in (0, 1, 2, 4))
        sketch, size = np.array([r[3] for r in group], np.int64).view(np.uint64), np.array(n, np.int64)
        code = np.unique(np.array(label, object), return_inverse=True)[1]
        out: tuple[list, list, list, list] = ([], [], [], [])
        # rows come by block, so a cell of two blocks holds the first block's rows against the second's
        first = block.index(block[-1]) if block[0] != block[-1] else len(block)
        for i in range(first):
            begin = first if first < len(block) else i + 1
            small, big = np.minimum(size[i], size[begin:]), np.maximum(size[i], size[begin:])
            near = (small * 100 >= big * percent) & (code[begin:] != code[i])
            near &= np.bitwise_count(sketch[begin:] ^ sketch[i]).sum(axis=1) <= most
            for j in (np.flatnonzero(near) + begin).tolist():
                a, b = sorted((i, j), key=lambda k: digest[k])
                for column, x in zip(out, (digest[a], digest[b], n[a], n[b])):
                    column.append(x)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for cell, row in _grouped(batches, 3):
            if cell != now:
                yield batch(group)
                now, group = cell, []
            group.append(row)
        yield batch(group)

    def batch(group: list) -> pa.RecordBatch:
        cols = pairs(group) if len(group) > 1 else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["a", "b", "n_a", "n_b"])

    rows = _cells(placed).select("band", "lo", "hi", "digest", "label", "n", "sketch", "block")
    rows = rows.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "block", "digest")
    return rows.mapInArrow(run, "a binary, b binary, n_a bigint, n_b bigint").distinct()


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, tuple]]:
    """(key columns, the rest) of each row, in steps that bound what is held as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, 512):
            for row in zip(*(c.to_pylist() for c in b.slice(at, 512).columns)):
                yield row[:keys], row[keys:]


def _confirm(near: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """Of the pairs near (a, b, n_a, n_b), those whose full sets (digest, shingles) are linked."""
    groups = components(near, scratch)
    ends = near.select(F.col("a").alias("digest"), F.col("n_a").alias("n")).union(near.select("b", "n_b")).distinct()
    labelled = scratch.write(f"labelled-{tag}", ends.join(groups.withColumnRenamed("v", "digest"), "digest"))
    sizes = scratch.write(f"sizes-{tag}", labelled.groupBy("label").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")))
    placed = heavy_safe_join(labelled, sizes, "label", "size", labelled.count()).withColumn("blocks", F.least(F.col("size"), _blocks(F.col("total"), BLOCK_SHINGLES)).cast("int"))
    placed = scratch.write(f"placed-{tag}", placed.select("digest", "label", F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int").alias("block")))
    end = lambda x: placed.select(F.col("digest").alias(x), "label" if x == "a" else F.col("label").alias("label_b"), F.col("block").alias(f"block_{x}"))
    cells = _look_up_both(near, end("a"), end("b"))
    cells = scratch.write(f"cells-{tag}", cells.select("label", F.least("block_a", "block_b").alias("lo"), F.greatest("block_a", "block_b").alias("hi"), "a", "b", "n_a", "n_b"))
    key = ["label", "lo", "hi"]
    needed = cells.select(*key, F.col("a").alias("digest")).union(cells.select(*key, "b")).distinct()
    lent = needed.join(sets, "digest").select(*key, F.col("digest").alias("a"), F.lit(None).cast("binary").alias("b"), F.lit(None).cast("bigint").alias("n_a"), F.lit(None).cast("bigint").alias("n_b"), "shingles")
    asked = cells.select(*key, "a", "b", "n_a", "n_b", F.lit(None).cast("array<bigint>").alias("shingles"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for b in batches:
            links: tuple[list, list] = ([], [])
            shingles = b.column(7)
            for i, (*cell, a, other, n_a, n_b) in enumerate(zip(*(c.to_pylist() for c in b.columns[:7]))):
                if cell != now:
                    now, held = cell, {}
                if other is None:
                    held[a] = shingles[i].values.to_numpy()
                    continue
                x, y = held[a], held[other]
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                if common * 100 >= (n_a + n_b - common) * percent:
                    links[0].append(a)
                    links[1].append(other)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in links], names=["a", "b"])

    # sets are put in the order of signed numbers, so that a search finds its way
    rows = lent.withColumn("shingles", F.array_sort("shingles")).unionByName(asked).repartition(*key).sortWithinPartitions(*key, F.col("b").isNotNull())
    links = scratch.write(f"links-{tag}", rows.select(*key, "a", "b", "n_a", "n_b", "shingles").mapInArrow(run, "a binary, b binary"))
    scratch.drop(f"labelled-{tag}", f"sizes-{tag}", f"placed-{tag}", f"cells-{tag}")
    return links


def _look_up_both(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    return _look_up(_look_up(pairs, a.withColumnRenamed("a", "digest"), "a", "b"), b.withColumnRenamed("b", "digest"), "b", "a")


class _Sets:
    """Full sets of classes, read from their texts when they are first asked for."""

    def __init__(self, docs: DataFrame, classes: DataFrame, words: int, id_col: str, text_col: str, scratch: Scratch):
        self.docs, self.classes, self.words, self.id_col, self.text_col, self.scratch = docs, classes, words, id_col, text_col, scratch
        self.parts: list[DataFrame] = []

    def of(self, near: DataFrame) -> DataFrame:
        ends = near.select(F.col("a").alias("digest")).union(near.select("b")).distinct()
        for part in self.parts:
            ends = ends.join(part.select("digest"), "digest", "left_anti")
        k = len(self.parts)
        reps = self.scratch.write(f"reps-{k}", self.classes.select("digest", "rep").join(ends, "digest"))
        num = f"__id_{uuid.uuid4().hex[:8]}"
        texts = filter_by_keys(self.docs.withColumn(num, F.col(self.id_col).cast("bigint")), reps.select(F.col("rep").alias(num)).distinct(), [num], "left_semi")
        found = self.scratch.write(f"sets-{k}", _sets(texts, self.words, self.text_col))
        if found.count() > reps.count():  # ids that repeat bring further texts
            found = found.join(reps.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        self.parts.append(found)
        out = self.parts[0]
        for part in self.parts[1:]:
            out = out.unionByName(part)
        return out


def _resolve(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-dedup")
    sig = scratch.write("sig", _signatures(docs, words, id_col, text_col))
    firsts = [F.first(c).alias(c) for c in ("n", "short", "sketch", "bands")]
    classes = scratch.write("classes", sig.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("copies"), *firsts))
    sets = _Sets(docs, classes, words, id_col, text_col, scratch)
    buckets = classes.select("digest", "short", F.explode("bands").alias("band"))
    leaders = scratch.write("leaders", buckets.groupBy("band").agg(F.min("short").alias("leader"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    shared = scratch.write("shared", heavy_safe_join(buckets, leaders, "band", "size", classes.count() * BANDS).select("band", "digest", "short", "leader"))
    scratch.drop("leaders")
    # classes whose digests begin alike would both be leaders, which only adds candidates
    chosen = classes.select(F.col("short").alias("leader"), F.col("digest").alias("b"))
    pairs = shared.filter("short <> leader").select(F.col("digest").alias("a"), "leader").distinct()
    near = scratch.write("near-star", _star(pairs.join(chosen, "leader").select("a", "b"), classes, percent))
    links = _confirm(near, sets.of(near), percent, scratch, "star")
    labels = components(links, scratch)
    # buckets whose classes, leader aside, lie in more than one component
    placed = shared.filter("short <> leader").select("band", "digest").join(labels.withColumnRenamed("v", "digest"), "digest", "left")
    placed = scratch.write("placed", placed.select("band", "digest", F.coalesce("label", "digest").alias("label")))
    split = placed.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")).filter("low <> high").select("band", "size")
    split = scratch.write("split", split)
    open_ = heavy_safe_join(placed, split, "band", "size", placed.count()).select("band", "digest", "label")
    open_ = scratch.write("open", open_.join(classes.select("digest", "n", "sketch"), "digest"))
    near = scratch.write("near-rest", _within_buckets(open_, percent, scratch))
    scratch.drop("shared", "placed", "split", "open", "sizes")
    more = _confirm(near, sets.of(near), percent, scratch, "rest")
    if not more.isEmpty():
        labels = components(links.union(more), scratch)
    named = classes.select("digest", "rep", "best", "copies").join(labels.withColumnRenamed("v", "digest"), "digest", "left")
    named = scratch.write("named", named.withColumn("label", F.coalesce("label", "digest")))
    names = scratch.write("names", named.groupBy("label").agg(F.min("rep").alias("component_id"), F.min("best").alias("stays"), F.sum(F.lit(1)).alias("size")))
    placed = scratch.write("placed", heavy_safe_join(named, names, "label", "size", named.count()).select("digest", "copies", "component_id", "stays"))
    scratch.drop("classes", "named", "names", "links-star", "links-rest", "near-star", "near-rest", "reps-0", "reps-1", "sets-0", "sets-1")
    rows = sig.select("doc_id", "text_key", "n", "digest")
    known = heavy_safe_join(rows.filter("n > 0"), placed, "digest", "copies", rows.count())
    known = known.select("doc_id", "text_key", "n", "component_id", (F.col("stays") == _rank()).alias("stays"))
    return known.unionByName(rows.filter("n = 0").select("doc_id", "text_key", "n", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays")))


def _rank() -> Column:
    """The order in which documents of a component stay: by id, null ids last, then by a hash of the text."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), F.col("text_key").alias("text"))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row.

    Texts are linked if 100 * intersection >= percent * union of their sets of
    shingles of ``words`` words.
    """
    out = _resolve(docs, words, percent, id_col, text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one document of each component, with all their columns.

    It is the one of the smallest id; of several texts of that id, or where all ids are null, that of the smallest text hash.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup-out")
    gone = scratch.write("gone", _resolve(docs, words, percent, id_col, text_col).filter("NOT stays").select("doc_id", "text_key").distinct())
    num, key = f"__id_{uuid.uuid4().hex[:8]}", f"__key_{uuid.uuid4().hex[:8]}"
    keyed = docs.withColumns({num: F.col(id_col).cast("bigint"), key: F.xxhash64(F.col(text_col))})
    return filter_by_keys(keyed, gone.toDF(num, key), [num, key], "left_anti").drop(num, key)

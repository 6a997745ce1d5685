r"""Removal of repeated passages with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words of a document. Every word that lies in a window
whose words also stand in a document with a smaller id is removed; windows are judged on
the input. The steps:

1. Copies. Of rows with the same words, those of the smallest id stand for all; every word of the
   others is removed (if there is a window), and only the first go on.
2. Anchors. Every window names the smallest hash among its runs of ``ANCHOR`` words. Equal windows
   name equal anchors, and neighbours mostly share theirs, so a document has a quarter as many anchors
   as words. Only anchors that occur twice can belong to recurring windows.
3. Pieces. A stretch of neighbouring windows with one such anchor is a piece: its words and place.
4. Confirmation. The windows of pieces are counted by hash; one that occurs in two documents is a
   recurring phrase, and the smallest of them is its owner, which lends it its words.
5. Automata. Phrases are sharded by anchor, each shard's phrases are compiled into an Aho-Corasick automaton
   over words, and all pieces are streamed through the automaton of their shard, which
   locates every occurrence by its actual words.
6. The located stretches are cut from the texts.

A shard with many pieces is spread over several tasks, each with its own copy of the shard's
phrases; a shard with many phrases is split into parts, and its pieces go through all of them. So
neither a popular passage nor a popular anchor gathers in one task. Counting combines before each shuffle.

Defined results: null texts and texts without a word have no words; texts shorter than a window lose nothing;
very long texts and words are worked through whole.
A null id neither lends phrases nor loses words. Rows with one id never take words from one another;
each gets its row. Empty tables give empty results. Extra columns are ignored, or kept by
``remove_repeats``, which joins what is left with single spaces and leaves untouched texts as they are.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS, Scratch, filter_by_keys, heavy_safe_join
from corpusloom.llm.words import Words, mix, runs, slices

WINDOW, ANCHOR = 13, 7
#: Phrases in one automaton, and pieces of a shard in one task.
SHARD_PHRASES, SHARD_PIECES = 10_000, 200_000


def split_words(text: str | None) -> list[bytes]:
    r"""Words parted by ``[\x20\x09-\x0D]``, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: the word it begins at, its row and its anchor."""
    at = w.windows(WINDOW)
    grams = runs(w.hashes, ANCHOR)
    size = max(0, len(w.hashes) - WINDOW + 1)
    low = grams[:size].copy()
    for j in range(1, WINDOW - ANCHOR + 1):
        np.minimum(low, grams[j : j + size], out=low)
    return at, w.row()[at], low[at].view(np.int64)


def _stretches(row: np.ndarray, at: np.ndarray, kind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of neighbouring windows of a row, broken where ``kind`` changes."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    breaks = (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
    if kind is not None:
        breaks |= kind[1:] != kind[:-1]
    cuts = np.flatnonzero(breaks)
    return np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(at) - 1]))


def _listed(lists: pa.Array, row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each value is in its row's list (by a hash of both, so a rare chance hit is possible)."""
    of = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    pair = lambda i, x: mix(x.view(np.uint64)) + i.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.isin(pair(row, value), pair(of, lists.flatten().to_numpy()))


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _base(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_words, sha and the anchors of each row of doc_id, text_key, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, w in slices(b.column(2)):
                part = b.slice(at, len(w.first) - 1)
                sha = [hashlib.sha256(w.joined(a, z)).hexdigest() for a, z in zip(w.first.tolist(), w.first[1:].tolist())]
                start, row, anchor = _anchors(w)
                begins, _ = _stretches(row, start, anchor)
                places = np.concatenate(([0], np.cumsum(np.bincount(row[begins], minlength=part.num_rows)))).astype(np.int32)
                anchors = pa.ListArray.from_arrays(pa.array(places), pa.array(anchor[begins]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(w.first).astype(np.int64)), pa.array(sha, pa.string()), anchors], names=names)

    names = ["doc_id", "text_key", "n_words", "sha", "anchors"]
    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, n_words bigint, sha string, anchors array<bigint>")


def _copies(base: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id and text_key of the rows whose words, a window at least, are those of a row with a smaller id."""
    rows = base.filter(f"doc_id IS NOT NULL AND n_words >= {WINDOW}").select("doc_id", "text_key", "sha")
    groups = rows.groupBy("sha").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")).filter("low < high")
    groups = scratch.write("groups", groups.select("sha", "low", "n"))
    return scratch.write("copies", heavy_safe_join(rows, groups, "sha", "n", rows.count()).filter("doc_id > low").select("doc_id", "text_key").distinct())


def _pieces(docs: DataFrame) -> DataFrame:
    """The pieces of rows of doc_id, text_key, text and anchors (those that recur)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lead, w in slices(b.column(2)):
                part = b.slice(lead, len(w.first) - 1)
                at, row, anchor = _anchors(w)
                own = _listed(part.column(3), row, anchor)
                at, row, anchor = at[own], row[own], anchor[own]
                a, z = _stretches(row, at, anchor)
                text = [w.joined(i, j) for i, j in zip(at[a].tolist(), (at[z] + WINDOW).tolist())]
                where, start = pa.array(row[a]), (at[a] - w.first[row[a]]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(where), part.column(1).take(where), pa.array(anchor[a]), pa.array(start), pa.array(text, pa.binary())],
                    names=["doc_id", "text_key", "anchor", "start", "words"],
                )

    return docs.mapInArrow(run, "doc_id bigint, text_key bigint, anchor bigint, start int, words binary")


def _windows(pieces: DataFrame) -> DataFrame:
    """anchor, doc_id and window (its hash) of each window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lead, w in slices(b.column(2)):
                part, at = b.slice(lead, len(w.first) - 1), w.windows(WINDOW)
                where = pa.array(w.row()[at])
                window = runs(w.hashes, WINDOW)[at].view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(window)], names=["anchor", "doc_id", "window"])

    return pieces.select("anchor", "doc_id", "words").mapInArrow(run, "anchor bigint, doc_id bigint, window bigint")


def _phrases(lent: DataFrame) -> DataFrame:
    """anchor, owner, words and n of the passages that pieces (anchor, doc_id, words, wanted windows) lend: stretches of n wanted windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lead, w in slices(b.column(2)):
                part, at = b.slice(lead, len(w.first) - 1), w.windows(WINDOW)
                row = w.row()[at]
                own = _listed(part.column(3), row, runs(w.hashes, WINDOW)[at].view(np.int64))
                at, row = at[own], row[own]
                a, z = _stretches(row, at)
                where = pa.array(row[a])
                text = [w.joined(i, j) for i, j in zip(at[a].tolist(), (at[z] + WINDOW).tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array(text, pa.binary()), pa.array((z - a + 1).astype(np.int32))], names=["anchor", "owner", "words", "n"])

    return lent.select("anchor", "doc_id", "words", "wanted").mapInArrow(run, "anchor bigint, owner bigint, words binary, n int")


class Phrases:
    """An automaton over words; every phrase has its owner.

    A word is written as two characters of separate alphabets, so that a phrase matches only
    from a word's beginning, and no node of the automaton has more than some hundred successors,
    which it searches one by one.
    """

    _UNKNOWN = "\uf000\uf001"

    def __init__(self):
        self.codes: dict[bytes, str] = {}
        self.automaton = ahocorasick.Automaton()

    def _code(self, word: bytes) -> str:
        known = self.codes.get(word)
        if known is None:
            n = len(self.codes)
            known = self.codes[word] = chr(0x10000 + n // 256) + chr(0x4000 + n % 256)
        return known

    def add(self, words: bytes, owner: int) -> None:
        """All windows of a passage."""
        coded = "".join(map(self._code, words.split()))
        for k in range(0, len(coded) - 2 * WINDOW + 1, 2):
            self.automaton.add_word(coded[k : k + 2 * WINDOW], owner)

    def compile(self) -> None:
        self.automaton.make_automaton()

    def covered(self, words: bytes, doc_id: int) -> list[tuple[int, int]]:
        """Stretches of words that phrases of smaller documents cover."""
        get = self.codes.get
        out: list[tuple[int, int]] = []
        if not self.codes:  # a part that no passage fell to
            return out
        for last, owner in self.automaton.iter("".join([get(w, self._UNKNOWN) for w in words.split()])):
            end = last // 2
            if owner < doc_id:
                if out and end - WINDOW + 1 <= out[-1][1]:
                    out[-1] = (out[-1][0], end + 1)
                else:
                    out.append((end - WINDOW + 1, end + 1))
        return out


def _located(rows: DataFrame) -> DataFrame:
    """doc_id, text_key, first and last + 1 of covered words, from sorted rows of shard, part, salt, owner (null for a piece), ...

    The phrases of a shard come before its pieces; one automaton is held at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, phrases, ready = None, Phrases(), False
        for b in batches:
            out = []
            for shard, part, salt, owner, doc_id, key, start, words in zip(*(c.to_pylist() for c in b.columns)):
                if (shard, part, salt) != now:
                    now, phrases, ready = (shard, part, salt), Phrases(), False
                if owner is not None:
                    phrases.add(words, owner)
                    continue
                if not ready:
                    phrases.compile()
                    ready = True
                out += [(doc_id, key, start + a, start + z) for a, z in phrases.covered(words, doc_id)]
            cols = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["doc_id", "text_key", "first", "last"])

    return rows.select("shard", "part", "salt", "owner", "doc_id", "text_key", "start", "words").mapInArrow(run, "doc_id bigint, text_key bigint, first int, last int")


def keep_words(words: list[bytes], ranges: list[tuple[int, int]]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for a, z in ranges:
        gone[a:z] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def _with_text(docs: DataFrame, keyed: DataFrame) -> DataFrame:
    """Texts (doc_id, text_key, text) joined to rows of the same doc_id and text_key.

    A short list of ids first thins the texts out before they are shuffled.
    """
    ids = keyed.select("doc_id").distinct()
    if keyed.count() <= BROADCAST_ROWS:
        docs = docs.join(F.broadcast(ids), "doc_id", "left_semi")
    return docs.join(keyed.hint("merge"), ["doc_id", "text_key"])


def _ranges(given: DataFrame, base: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, text_key and ranges (covered stretches) of the rows, but for copies, that lose words."""
    first = filter_by_keys(base.filter("doc_id IS NOT NULL"), copies, ["doc_id", "text_key"], "left_anti")
    anchors = first.select("doc_id", "text_key", F.explode("anchors").alias("anchor"))
    recurring = scratch.write("recurring", anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    total = recurring.agg(F.sum("n")).first()[0] or 0
    lists = heavy_safe_join(anchors, recurring, "anchor", "n", total).groupBy("doc_id", "text_key").agg(F.collect_set("anchor").alias("anchors"))
    lists = scratch.write("lists", lists)
    pieces = scratch.write("pieces", _pieces(_with_text(given, lists).select("doc_id", "text_key", "text", "anchors")))
    scratch.drop("lists", "recurring")
    confirmed = _windows(pieces).groupBy("anchor", "window").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("high")).filter("owner < high")
    confirmed = scratch.write("confirmed", confirmed.select("anchor", "window", "owner"))
    wanted = confirmed.groupBy("anchor", F.col("owner").alias("doc_id")).agg(F.collect_list("window").alias("wanted"))
    phrases = _phrases(pieces.join(wanted, ["anchor", "doc_id"]))
    phrases = scratch.write("phrases", phrases)
    scratch.drop("confirmed")
    shards = max(1, -(-(phrases.agg(F.sum("n")).first()[0] or 0) // SHARD_PHRASES))
    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")
    # few rows, one for each shard: how many parts its phrases and ways its pieces are spread over
    per = phrases.groupBy(shard).agg(F.sum("n").alias("phrases"))
    ways = pieces.groupBy(shard).agg(F.count(F.lit(1)).alias("pieces"))
    plan = scratch.write("plan", per.join(ways, "shard").select("shard", F.ceil(F.col("phrases") / (4 * SHARD_PHRASES)).cast("int").alias("parts"), F.ceil(F.col("pieces") / SHARD_PIECES).cast("int").alias("ways")))
    held = F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    known = phrases.select(shard, "owner", "words").join(held, "shard")
    known = known.select("shard", F.pmod(F.xxhash64("words"), "parts").cast("int").alias("part"), upto("ways").alias("salt"), "owner", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("bigint").alias("text_key"), F.lit(None).cast("int").alias("start"), "words")
    sent = pieces.select(shard, "doc_id", "text_key", "start", "words").join(held, "shard")
    sent = sent.select("shard", upto("parts").alias("part"), F.pmod(F.xxhash64("doc_id", "start"), "ways").cast("int").alias("salt"), F.lit(None).cast("bigint").alias("owner"), "doc_id", "text_key", "start", "words")
    rows = known.unionByName(sent).repartition("shard", "part", "salt").sortWithinPartitions("shard", "part", "salt", F.col("owner").isNull())
    found = _located(rows).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    found = scratch.write("ranges", found)
    scratch.drop("pieces", "phrases", "plan")
    return found


def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))


def removals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and ranges (the removed words' places; null for none) of every row."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    given = _given(docs, id_col, text_col)
    base = scratch.write("base", _base(given))
    copies = _copies(base, scratch)
    ranges = _ranges(given, base, copies, scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, kept, sha = [], [], []
            for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = split_words(t)
                left = keep_words(words, [(x["first"], x["last"]) for x in r])
                n.append(len(words))
                kept.append(len(words) - len(left))
                sha.append(_digest(left))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(kept, pa.int64()), pa.array(sha, pa.string()), b.column(2)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "ranges"])

    cut = _with_text(given, ranges).select("doc_id", "text", "ranges")
    cut = cut.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, ranges array<struct<first:int,last:int>>")
    facts, keys = base.select("doc_id", "text_key", "n_words", "sha"), ["doc_id", "text_key"]
    whole = filter_by_keys(facts, copies, keys, "left_semi").select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.lit(_digest([])).alias("kept_sha256"), _all_words().alias("ranges"))
    rest = filter_by_keys(facts, copies.union(ranges.select(*keys)), keys, "left_anti")
    rest = rest.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.lit(None).cast(cut.schema["ranges"].dataType).alias("ranges"))
    return cut.unionByName(whole).unionByName(rest)


def _all_words() -> Column:
    return F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("last")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from the texts, with all columns."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    given = _given(docs, id_col, text_col)
    base = scratch.write("base", _base(given))
    copies = _copies(base, scratch)
    facts = base.select("doc_id", "text_key", "n_words").distinct()
    whole = filter_by_keys(facts, copies, ["doc_id", "text_key"], "left_semi").select("doc_id", "text_key", _all_words().alias("ranges"))
    ranges = _ranges(given, base, copies, scratch).unionByName(whole)
    num, key, cut = (f"__{x}_{uuid.uuid4().hex[:8]}" for x in ("id", "key", "cut"))
    keyed = docs.withColumns({num: F.col(id_col).cast("bigint"), key: F.xxhash64(text_col)})
    joined = keyed.join(ranges.toDF(num, key, cut), [num, key], "left")

    @F.pandas_udf("string")
    def left(texts, found):
        import pandas as pd

        return pd.Series([t if r is None else b" ".join(keep_words(split_words(t), [(x["first"], x["last"]) for x in r])).decode("utf-8") for t, r in zip(texts, found)])

    return joined.withColumn(text_col, left(F.col(text_col), F.col(cut))).select(*[F.col(f"`{c}`") for c in docs.columns])

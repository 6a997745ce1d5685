"""Boilerplate that a host repeats, by document frequency of character 5-grams.

Pages meet by host, in groups of about ``GROUP_BYTES`` so that a large host is spread over tasks; only
documents are shuffled, never their grams. A gram that half of all pages hold is held by half of the
pages of some group, so a group puts out no others. A host of one group is settled by that, and so are
a larger one's grams that its groups' counts tell enough of; only the rest are counted again in each group.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from corpusloom.functions.page import EDGES
from corpusloom.functions.page import TITLE_SPACE as SPACES
from corpusloom.functions.page import content_chars as plain_chars
from corpusloom.joins import BROADCAST_ROWS, spread
from corpusloom.storage import Scratch

N, MIN_SHARE, MIN_PAGES, MIN_SPAN = 5, 0.5, 3, 8
#: Bytes of a host's pages in one task; in Python they take some forty times that.
GROUP_BYTES = 4 << 20
#: Characters that are looked through at once.
SLICE_CHARS = 1 << 20
_MIX, _BITS = 0x9E3779B97F4A7C15, 20


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of texts, with a line end after each, and where each text begins."""
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=begin[1:])
    return np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32), begin


def _slices(texts: list[str]) -> Iterator[list[str]]:
    own: list[str] = []
    size = 0
    for t in texts:
        own.append(t)
        size += len(t) + 1
        if size >= SLICE_CHARS:
            yield own
            own, size = [], 0
    if own:
        yield own


class _Grams:
    """N-grams over an alphabet as numbers; a gram with another character has none."""

    def __init__(self, alphabet: np.ndarray):
        self.alphabet, self.base = alphabet, len(alphabet) + 1
        self.place = np.zeros(int(alphabet[-1]) + 2 if len(alphabet) else 1, np.uint64)
        self.place[alphabet] = np.arange(1, self.base, dtype=np.uint64)

    @property
    def fit(self) -> bool:
        """Whether a number has room for all of them."""
        return self.base**N < 1 << 64

    def numbers(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where grams of the alphabet alone start, and their numbers."""
        at = self.place[np.minimum(points, np.uint32(len(self.place) - 1))]
        size = max(0, len(at) - N + 1)
        gram, whole = np.zeros(size, np.uint64), np.ones(size, bool)
        for j in range(N):
            gram *= np.uint64(self.base)
            gram += at[j : j + size]
            whole &= at[j : j + size] > 0
        found = np.flatnonzero(whole)
        return found, gram[found]

    def text(self, number: int) -> str:
        out = []
        for _ in range(N):
            number, k = divmod(number, self.base)
            out.append(chr(self.alphabet[k - 1]))
        return "".join(reversed(out))


def _bucket(numbers: np.ndarray) -> np.ndarray:
    return ((numbers * np.uint64(_MIX)) >> np.uint64(64 - _BITS)).astype(np.int64)


def frequent_grams(texts: list[str], share: float) -> list[tuple[str, int]]:
    """Each gram that at least this share of the texts hold, and by how many.

    Characters and buckets of grams that are too rare are left out before grams are counted by text.
    """
    need = share * len(texts)
    slices = [_points(own) for own in _slices(texts)]
    if not slices:
        return []
    seen = np.zeros(1 + max(int(p.max()) for p, _ in slices), np.int64)
    for p, _ in slices:
        seen += np.bincount(p, minlength=len(seen))
    seen[ord("\n")] = 0  # between texts; a text that holds one is counted below
    if any("\n" in t for t in texts):
        return _frequent_plainly(texts, need)
    grams = _Grams(np.flatnonzero((seen >= need) & (seen > 0)))
    if not grams.fit:
        return _frequent_plainly(texts, need)
    often = np.zeros(1 << _BITS, np.int64)
    for p, _ in slices:
        often += np.bincount(_bucket(grams.numbers(p)[1]), minlength=len(often))
    usual = often >= need
    values, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
    for p, begin in slices:
        at, number = grams.numbers(p)
        kept = usual[_bucket(number)]
        at, number = at[kept], number[kept]
        kinds, kind = np.unique(number, return_inverse=True)
        pairs = np.unique((np.searchsorted(begin, at, "right") - 1) * np.int64(max(1, len(kinds))) + kind)
        own = np.bincount(pairs % max(1, len(kinds)), minlength=len(kinds))
        values, where = np.unique(np.concatenate([values, kinds]), return_inverse=True)
        counts = np.bincount(where, np.concatenate([counts, own]), len(values)).astype(np.int64)
    return [(grams.text(int(v)), int(n)) for v, n in zip(values[counts >= need], counts[counts >= need])]


def _frequent_plainly(texts: list[str], need: float) -> list[tuple[str, int]]:
    seen = Counter(g for t in texts for g in {t[i : i + N] for i in range(len(t) - N + 1)})
    return [(g, n) for g, n in seen.items() if n >= need]


class Finder:
    """Finds where given grams start in lines of texts."""

    def __init__(self, wanted: list[str]):
        self.wanted = sorted({g for g in wanted if len(g) == N and "\n" not in g})
        points, _ = _points(self.wanted)
        self.grams = _Grams(np.setdiff1d(points, [ord("\n")]))
        if not self.grams.fit:
            self.index = {g: i for i, g in enumerate(self.wanted)}
            return
        numbers = self.grams.numbers(points)[1]
        self.order = np.argsort(numbers)
        self.numbers = numbers[self.order]
        self.usual = np.zeros(1 << _BITS, bool)
        self.usual[_bucket(numbers)] = True

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each text begins in all of them with line ends between, where grams start in that, and which of the sorted grams."""
        points, begin = _points(texts)
        if not self.grams.fit:
            hits = [(b + i, self.index[t[i : i + N]]) for b, t in zip(begin.tolist(), texts) for i in range(len(t) - N + 1) if t[i : i + N] in self.index]
            return begin, np.array([i for i, _ in hits], np.int64), np.array([k for _, k in hits], np.int64)
        at, number = self.grams.numbers(points)
        kept = self.usual[_bucket(number)]
        at, number = at[kept], number[kept]
        place = np.minimum(np.searchsorted(self.numbers, number), max(0, len(self.numbers) - 1))
        same = self.numbers[place] == number if len(self.numbers) else np.zeros(0, bool)
        return begin, at[same], self.order[place[same]] if len(self.numbers) else at[same]

    def counts(self, texts: list[str]) -> list[tuple[str, int]]:
        """Of each wanted gram that texts hold, how many do."""
        total = np.zeros(len(self.wanted), np.int64)
        for own in _slices(texts):
            begin, at, which = self.find(own)
            pairs = np.unique((np.searchsorted(begin, at, "right") - 1) * np.int64(max(1, len(self.wanted))) + which)
            total += np.bincount(pairs % max(1, len(self.wanted)), minlength=len(self.wanted))
        return [(self.wanted[i], int(total[i])) for i in np.flatnonzero(total)]

    def cut(self, texts: list[str]) -> list[str]:
        """Texts without the runs of at least MIN_SPAN characters of a line that grams cover.

        A run of covered characters is a run of hits whose starts are less than N + 1 apart; hits of two
        lines are further apart, since a line end lies between them.
        """
        out: list[str] = []
        for own in _slices(texts):
            begin, at, _ = self.find(own)
            done = list(own)
            if len(at):
                last = np.append(np.diff(at) > N, True)
                a, z = at[np.append(True, last[:-1])], at[last] + N
                a, z = a[z - a >= MIN_SPAN], z[z - a >= MIN_SPAN]
                text = np.searchsorted(begin, a, "right") - 1
                parts: dict[int, list[tuple[int, int]]] = {}
                for k, x, y in zip(text.tolist(), (a - begin[text]).tolist(), (z - begin[text]).tolist()):
                    parts.setdefault(k, []).append((x, y))
                for k, runs in parts.items():
                    t, pieces, frm = own[k], [], 0
                    for x, y in runs:
                        pieces.append(t[frm:x])
                        frm = y
                    done[k] = "".join(pieces) + t[frm:]
            out += done
        return out


def _flat(rows: pa.Table) -> list[str]:
    """Texts without the white space of titles, of those that then hold a gram."""
    texts = rows.column("t").to_pylist()
    for c in SPACES:
        texts = [t.replace(c, "") for t in texts]
    return [t for t in texts if len(t) >= N]


def learn_templates(docs: DataFrame, host: str = "source", text: str = "text", key: str | None = None) -> DataFrame:
    """host and gram of every 5-gram that at least half of a host's pages hold.

    With a key, pages of equal text are spread over a host's groups too.
    """
    scratch = Scratch(docs.sparkSession, "templates")
    given = docs.select(F.col(host).cast("string").alias("host"), F.col(text).alias("t"), F.xxhash64(*[F.col(c) for c in ([text] if key is None else [text, key])]).alias("place"))
    pages = spread(given, "place").filter((F.length("t") >= N) & F.col("host").isNotNull())
    groups = F.ceil(F.sum(F.octet_length("t")) / F.lit(GROUP_BYTES)).cast("int").alias("groups")
    sizes = scratch.write("sizes", pages.groupBy("host").agg(F.count(F.lit(1)).alias("n"), groups).filter(F.col("n") >= MIN_PAGES).drop("n"))
    parted = pages.join(sizes, "host").select("host", F.pmod("place", "groups").cast("int").alias("part"), "t")

    def rows_of(key: tuple, counted: list[tuple[str | None, int]], less: int = 0) -> pa.Table:
        return pa.table({"host": pa.array([key[0].as_py()] * len(counted), pa.string()), "gram": pa.array([g for g, _ in counted], pa.string()), "df": pa.array([n for _, n in counted], pa.int64()), "less": pa.array([less] * len(counted), pa.int64())})

    def learn(key: tuple, rows: pa.Table) -> pa.Table:
        texts = _flat(rows)
        if not texts:
            return rows_of(key, [])
        # a row without a gram stands for the group; less: the most pages that hold a gram it doesn't put out
        return rows_of(key, [(None, len(texts)), *frequent_grams(texts, MIN_SHARE)], int(np.ceil(MIN_SHARE * len(texts))) - 1)

    schema = "host string, gram string, df bigint, less bigint"
    found = scratch.write("found", parted.groupBy("host", "part").applyInArrow(learn, schema))
    need = F.greatest(F.lit(2), F.ceil(F.lit(MIN_SHARE) * F.sum("df"))).alias("need")
    hosts = found.filter("gram IS NULL").groupBy("host").agg(F.sum("df").alias("pages"), need, F.sum("less").alias("all_less")).filter(F.col("pages") >= MIN_PAGES)
    hosts = scratch.write("hosts", hosts.join(sizes, "host"))
    settled = found.drop("less").join(hosts.filter("groups = 1"), "host").filter("gram IS NOT NULL AND df >= need").select("host", "gram")
    large = hosts.filter("groups > 1")
    if large.isEmpty():
        return settled
    sums = found.filter("gram IS NOT NULL").groupBy("host", "gram").agg(F.sum("df").alias("df"), F.sum("less").alias("less"))
    sums = sums.join(large, "host").withColumn("most", F.col("df") + F.col("all_less") - F.col("less"))
    sums = scratch.write("sums", sums.filter("most >= need").select("host", "gram", "groups", "need", (F.col("df") >= F.col("need")).alias("sure")))
    settled = settled.unionByName(sums.filter("sure").select("host", "gram"))
    open_ = sums.filter("NOT sure")
    if open_.isEmpty():
        return settled

    def recount(key: tuple, rows: pa.Table, asked: pa.Table) -> pa.Table:
        return rows_of(key, Finder(asked.column("gram").to_pylist()).counts(_flat(rows)))

    asked = open_.select("host", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), "gram")
    again = parted.join(open_.select("host").distinct(), "host", "left_semi").groupBy("host", "part").cogroup(asked.groupBy("host", "part")).applyInArrow(recount, schema)
    counted = again.groupBy("host", "gram").agg(F.sum("df").alias("df"))
    return settled.unionByName(scratch.write("large", counted.join(large, "host").filter("df >= need").select("host", "gram")))


def cut_runs(text: str, grams: set[str]) -> str:
    """A text without the runs of at least MIN_SPAN characters of a line that grams cover."""
    return Finder(list(grams)).cut([text])[0]


def _settled(text: str, cut: str) -> str:
    """A text as it was cut, its lines trimmed; the text itself where cutting took more than half of it."""
    trimmed = "\n".join(x.strip(EDGES) for x in cut.split("\n"))
    # trimming alone takes no characters that count
    return text if len(cut) < len(text) and plain_chars(trimmed) * 2 < plain_chars(text) else trimmed


def stripped(docs: DataFrame, templates: DataFrame, host: str = "source", text: str = "text", measured: bool = False) -> DataFrame:
    """``docs`` with a column ``stripped``: runs of at least 8 covered characters are cut from a text's lines, unless that would take more than half.

    Measured, there are the characters before and after instead of both texts. A host's grams are joined
    to its rows as one list, and rows are cut in one pass. Lists of few grams in all are broadcast, so that no text is shuffled.
    """
    lists = Scratch(docs.sparkSession, "lists").write("lists", templates.groupBy("host").agg(F.collect_set("gram").alias("_grams")))
    few = (lists.agg(F.sum(F.size("_grams"))).first()[0] or 0) <= BROADCAST_ROWS
    lists = lists.withColumnRenamed("host", "_host")
    rows = docs.withColumns({"_host": F.col(host).cast("string"), "_text": F.coalesce(F.col(text), F.lit(""))})
    rows = rows.drop(text) if measured else rows
    given = spread(rows, "_text").join(F.broadcast(lists) if few else lists, "_host", "left")
    own = [c for c in given.columns if c not in ("_host", "_text", "_grams")]
    given = given.select(*own, "_host", "_text", "_grams")
    k = len(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finders: dict = {}
        for b in batches:
            texts, grams = b.column(k + 1).to_pylist(), b.column(k + 2)
            by: dict = {}
            for i, (h, known) in enumerate(zip(b.column(k).to_pylist(), grams.is_valid().to_pylist())):
                if known and texts[i]:
                    by.setdefault(h, []).append(i)
            out = list(texts)
            for h, at in by.items():
                if h not in finders:
                    if len(finders) >= 30:
                        finders.clear()
                    finders[h] = Finder(grams[at[0]].as_py())
                for i, cut in zip(at, finders[h].cut([texts[i] for i in at])):
                    out[i] = _settled(texts[i], cut)
            if measured:
                more = {"before": pa.array(map(plain_chars, texts), pa.int64()), "after": pa.array(map(plain_chars, out), pa.int64())}
            else:
                more = {"stripped": pa.array(out, pa.string())}
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *more.values()], names=[*own, *more])

    more = [StructField("before", LongType()), StructField("after", LongType())] if measured else [StructField("stripped", StringType())]
    return given.mapInArrow(run, StructType([*given.select(*own).schema.fields, *more]))


def strip_templates(docs: DataFrame, templates: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """key, host and stripped text of every row."""
    return stripped(docs.select(*dict.fromkeys((key, host, text))), templates, host, text).select(key, host, "stripped")


def residue(docs: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """The share of characters that templates learned on the texts themselves would still cut: one row, or one for each value of ``by``."""
    templates = learn_templates(docs, host, text, key)
    hosts = templates.select(F.col("host").alias(host)).distinct()
    rows = docs.filter(F.col(key).isNotNull()).select(*dict.fromkeys((*by, host, text))).join(hosts, host, "left_semi")
    counted = stripped(rows, templates, host, text, measured=True)
    sums = counted.groupBy(*by).agg(F.coalesce(F.sum("before"), F.lit(0)).alias("b"), F.coalesce(F.sum("after"), F.lit(0)).alias("a"))
    return sums.select(*by, (F.col("b") - F.col("a")).alias("cut_chars"), F.col("b").alias("chars"), F.when(F.col("b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.col("b")).alias("residue"))

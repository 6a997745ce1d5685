"""Benchmark decontamination by pigeonhole pieces and Myers' distance.

Every benchmark item is allowed a budget of e edits, a share of its length. It is
split into e + 1 pieces; a passage within e edits of the item holds at least one
piece unchanged. All pieces form one Aho-Corasick automaton, which finds the exact
hits in a single pass over each text. Around every hit the item is verified with
Myers' bit-parallel algorithm, which gives the least edit distance of the item to any
stretch of the text that ends there, one machine operation per character and word
of the pattern. The search is complete: no passage within the budget is missed.

Items and texts are compared in lower case with every run of anything but
letters and digits as one space. The benchmark is a stated list of items; its size is
checked, and beyond ``MAX_ITEM_CHARS`` characters it is worked through in blocks, one pass over
the texts for each. The texts are never shuffled.

Defined results: null and empty texts hold nothing; items that are null or without a letter
or digit are in no text. Items shorter than ``MIN_CHARS`` whose budget is 0 have to stand at word
boundaries; in scripts without blanks every place is one. Item ids may be of any type. Very long texts are
searched whole; of equally near passages of an item the first counts. Items with the
same comparable text are searched once and reported for each item. Repeated rows each
get their rows. Extra columns are ignored, or kept by ``drop_contaminated``. Empty tables
give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Edits allowed for each character of an item.
EDIT_SHARE = 0.05
#: Shorter comparable items that allow no edit count only as whole words; they may be met by chance.
MIN_CHARS = 40
#: Characters of benchmark items whose automaton a task holds at once.
MAX_ITEM_CHARS = 20_000_000

_NOT_WORD = regex.compile(r"[^\p{L}\p{N}]+")
#: Scripts that don't part words by blanks.
_UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}]")


def comparable(text: str | None) -> str:
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut into budget + 1 pieces of nearly equal length: (offset, piece)."""
    n, k = len(item), budget + 1
    cuts = [n * i // k for i in range(k + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(pattern: str) -> dict[str, int]:
    """For each character, the bits at which it occurs in the pattern."""
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern of length m to a stretch of ``text``, and where the first such stretch ends."""
    full, top = (1 << m) - 1, 1 << m - 1
    vp, vn, score = full, 0, m
    best, at = m, 0
    get = peq.get
    for i, c in enumerate(text, 1):
        eq = get(c, 0)
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn = vp & d0
        hp = vn | (full & ~(vp | d0))
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = hp << 1 & full
        vn = hp & d0
        vp = (hn << 1 & full) | (full & ~(hp | d0))
        if score < best:
            best, at = score, i
    return best, at


class PassageFinder:
    """Finds items within their budget in texts."""

    def __init__(self, items: list[str], edit_share: float = EDIT_SHARE):
        self.items = [(t, int(len(t) * edit_share), masks(t)) for t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (t, budget, _) in enumerate(self.items):
            for at, piece in pieces(t, budget):
                found.setdefault(piece, []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()
        self.any = bool(found)

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, start of the stretch that was searched, end of the match) of each item that occurs, at its best."""
        t = comparable(text)
        if not self.any or not t:
            return []
        starts: dict[int, list[int]] = {}
        out, whole = [], set()
        for end, (size, where) in self.automaton.iter(t):
            for k, at in where:
                item, budget, _ = self.items[k]
                if budget or len(item) >= MIN_CHARS:
                    starts.setdefault(k, []).append(end + 1 - size - at)
                elif k not in whole and _boundary(t, end + 1 - size) and _boundary(t, end + 1):
                    whole.add(k)
                    out.append((k, 0, end + 1 - size, end + 1))
        for k, at in starts.items():
            item, budget, peq = self.items[k]
            best = (budget + 1, 0, 0)
            for a, b in _stretches(at, len(item), budget, len(t)):
                d, end = best_match(peq, len(item), t[a:b])
                best = min(best, (d, a, a + end))
                if best[0] == 0:
                    break
            if best[0] <= budget:
                out.append((k, *best))
        return out


def _boundary(t: str, at: int) -> bool:
    """Whether a word may begin or end at an offset of a comparable text."""
    return at == 0 or at == len(t) or " " in t[at - 1 : at + 1] or _UNSPACED.search(t, at - 1, at + 1) is not None


def _stretches(starts: list[int], size: int, budget: int, n: int) -> list[tuple[int, int]]:
    """Where to search, given where the item would start: joined where they overlap."""
    out: list[tuple[int, int]] = []
    for s in sorted(set(starts)):
        a, b = max(0, s - budget), min(n, s + size + budget)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple]]:
    """Distinct comparable items with their ids, in blocks of MAX_ITEM_CHARS characters."""
    block: dict[str, list] = {}
    held = 0
    for r in benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).orderBy("item_id", "text").toLocalIterator():
        t = comparable(r["text"])
        if not t:
            continue
        if held + len(t) > MAX_ITEM_CHARS and t not in block:
            yield list(block.items())
            block, held = {}, 0
        held += len(t) * (t not in block)
        block.setdefault(t, []).append(r["item_id"])
    yield list(block.items())


def find_passages(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance (the least), allowed and end (in the comparable text) of each passage found, one row for a document and item."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    types = f"doc_id {given.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, distance int, allowed int, end int"
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = PassageFinder([t for t, _ in shared.value], edit_share)
            ids = [i for _, i in shared.value]
            for b in batches:
                at, rest = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for k, d, _, end in finder.find(t):
                        for item in ids[k]:
                            at.append(i)
                            rest.append((item, d, finder.items[k][1], end))
                items, *numbers = zip(*rest) if rest else ((), (), (), ())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), *(pa.array(x, pa.int32()) for x in numbers)], names=["doc_id", "item_id", "distance", "allowed", "end"])

        item_type = to_arrow_type(benchmark.schema[item_col].dataType)
        parts.append(given.mapInArrow(run, types))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    out = docs
    at = docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast([t for t, _ in block])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = PassageFinder(shared.value, edit_share)
            for b in batches:
                yield b.filter(pa.array([not finder.find(t) for t in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out

"""Exact token counts at every prefix, by dynamic programming.

For a byte-level BPE, the encoding of a piece of text is unique, and so is the
last token of each of its prefixes: of the vocabulary's tokens that end there, it
is the one that stays a pair with the last token of the prefix before it. So one
pass over a piece gives the token count of each of its prefixes, from the counts
of shorter ones. Stretches from one blank to the next repeat: Arrow finds the distinct ones of
a slice of texts, they are cut into pieces, and the vectors of pieces are kept in a bounded
cache. A stretch's vector is its pieces' in a row, and a text's that of its stretches.

``write_store`` keeps the count of every prefix of every text in a table, as the
difference to the prefix before, a byte for a character (most are 0 or 1, and pack well). Whole
counts, budget and truncation questions are answered from that table; nothing is encoded again.

Texts are read once, in Arrow batches; nothing is shuffled. Defined results: a
null text is empty and has no tokens; very long texts are counted whole; rows that repeat each get their row; extra
columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces and stretches whose counts are kept by a worker before it starts over, and characters of the longest that is kept; so 100 MB at most.
CACHE_PIECES, CACHED_CHARS = 400_000, 48
#: Bytes of texts whose stretches are held at once (a longer text is held alone).
SLICE_BYTES = 8 << 20
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters by which such vocabularies write bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of the prefixes of texts, for a tokenizers .json file of byte-level BPE."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        spec = json.load(open(path, encoding="utf-8"))
        pre, model = spec["pre_tokenizer"], spec["model"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE: {path}")
        letters = _byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t.get(flag) for t in spec["added_tokens"] for flag in ("lstrip", "rstrip", "single_word")):
            raise ValueError(f"added tokens with conditions: {path}")
        # a token's number is its place in the order of merges, after the 256 bytes
        self.ids = {bytes([b]): b for b in range(256)}
        self.halves = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"], 256):
            a, b = map(as_bytes, m if isinstance(m, list) else m.split(" "))
            if a + b in self.ids:
                raise ValueError(f"a token of two merges: {a + b!r}")
            pair = (self.ids[a], self.ids[b])
            self.ids[a + b] = self.joined[pair] = rank
            self.halves.append(pair)
        words = ahocorasick.Automaton()
        for token, t in self.ids.items():
            words.add_word(token.decode("latin-1"), (len(token), t))
        words.make_automaton()
        self.ending = words.iter
        self.findall = regex.compile(_PATTERN).findall
        self.leading = regex.compile(r"\s*").match
        self.run_then_space = regex.compile(r"\s ").search
        self.at_blanks = regex.compile(r"(?<!\s) ").split
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache_pieces = cache_pieces
        self.run = regex.compile(r"\s\s").search
        # the same white space for Arrow, whose own \s is that of ASCII; NUL stands for a blank at which no piece starts
        as_class = lambda s: "".join(f"\\x{{{ord(c):x}}}" for c in s)
        w = f"[{as_class(filter(regex.compile(r'\s').match, map(chr, range(0x110000))))}\\x{{0}}]"
        self.odd_text = "|".join([r"\x{0}", *map(as_class, special)])
        self.inner_blank = f"({w}) "
        self.odd_unit = rf"\A\z|\A{w}|{w}\z|{w}{w}"
        #: Pieces that, cut short, are two.
        self.whole = frozenset(("'re", "'ve", "'ll"))
        self.totals: dict[str, int] = {}
        self.pieces: dict[str, bytes] = {}
        self.units: dict[str, tuple[int, bytes]] = {}
        self.pairs: dict[int, bool] = {}

    def _keep(self, cache: dict, key, value):
        if not isinstance(key, str) or len(key) <= CACHED_CHARS:
            if len(cache) >= self.cache_pieces:
                cache.clear()
            cache[key] = value
        return value

    def _stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b in a row are what their bytes encode to.

        They aren't if some pair of parts across their border merges before one
        of the two parts has been put together. The parts are followed from the
        tokens down, the later made first.
        """
        key, bar, halves, joined = a << 20 | b, 1 << 60, self.halves, self.joined
        while True:
            if joined.get((a, b), bar) < bar:
                return self._keep(self.pairs, key, False)
            if a < 256 and b < 256:
                return self._keep(self.pairs, key, True)
            # of equal rank, the left one is merged first, so the right one is undone first
            if a > b:
                bar, a = a, halves[a][1]
            else:
                bar, b = b + 1, halves[b][0]

    def piece_prefixes(self, piece: bytes) -> list[int]:
        """Token counts of piece[:0], piece[:1], ... piece."""
        counts, last = [0] * (len(piece) + 1), [-1] * (len(piece) + 1)
        pairs, stays = self.pairs, self._stays
        for end, (size, t) in self.ending(piece.decode("latin-1")):  # all tokens that end there, longest first
            end += 1
            if last[end] < 0:
                start = end - size
                if start:
                    a = last[start]
                    ok = pairs.get(a << 20 | t)
                    if not (stays(a, t) if ok is None else ok):
                        continue
                counts[end] = counts[start] + 1
                last[end] = t
        return counts

    def piece_total(self, piece: str) -> int:
        n = self.totals.get(piece)
        return self._keep(self.totals, piece, self.piece_prefixes(piece.encode())[-1]) if n is None else n

    def _segments(self, text: str) -> Iterator[tuple[str, str]]:
        """Ordinary stretches, each with the special string that follows it."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], m.group()
            at = m.end()
        yield text[at:], ""

    def _piece(self, piece: str) -> bytes:
        """The differences of the counts of a piece's prefixes, as signed bytes."""
        counts = self._ordinary(piece) if piece in self.whole else self._by_char(piece)
        # under 128 bytes, none can be out of range
        made = bytes([b - a & 255 for a, b in zip(counts, counts[1:])]) if len(piece) < 32 else _differences(np.array(counts))
        return self._keep(self.pieces, piece, made)

    def _unit(self, unit: str) -> tuple[int, bytes]:
        """The tokens and differences of a stretch: a blank, or none, and what follows up to the next."""
        if self.run(unit):
            counts = np.array(self._ordinary(unit))
            made = int(counts[-1]), _differences(counts)
        else:  # every prefix ends in a prefix of one piece, and the pieces before it stand
            get = self.pieces.get
            differences = b"".join([get(piece) or self._piece(piece) for piece in self.findall(unit)])
            made = int(np.frombuffer(differences, np.int8).sum(dtype=np.int64)), differences
        return self._keep(self.units, unit, made)

    def _plain_units(self, units: pa.StringArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """Tokens and differences of stretches that begin with a blank (not given) and have white space only inside, one character at a time."""
        # so they are a text whose pieces are theirs
        found = self.findall("".join([" " + x for x in units.to_pylist()]))
        steps, get = dict.fromkeys(found, b""), self.pieces.get
        for piece in steps:
            steps[piece] = get(piece) or self._piece(piece)
        differences = b"".join([steps[piece] for piece in found])
        ends = np.concatenate(([0], np.cumsum(pc.utf8_length(units).to_numpy() + 1, dtype=np.int64)))
        return np.diff(_counts(differences)[ends]), _binary(ends, pa.py_buffer(differences))

    def _plain_texts(self, texts: pa.StringArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """Tokens and differences of texts without special strings or NULs."""
        if not len(texts):
            return np.zeros(0, np.int64), pa.array([], pa.binary())
        # a piece starts at every blank that follows no white space, so counts add up over the stretches between these; the others are NULs meanwhile
        for _ in range(2):  # in a run, every other one each time
            if pc.any(pc.match_substring_regex(texts, self.inner_blank)).as_py():
                texts = pc.replace_substring_regex(texts, self.inner_blank, "\\1\0")
        lists = pc.split_pattern(texts, " ")
        starts, units = lists.offsets.to_numpy(), lists.values.dictionary_encode()
        n, steps = self._mixed(units.dictionary, self.odd_unit, self._plain_units, lambda x: self._unit(" " + x.replace("\0", " ")))
        first = [self._unit(x.replace("\0", " ")) for x in lists.values.take(lists.offsets[:-1]).to_pylist()]
        index = units.indices.to_numpy().copy()
        index[starts[:-1]] = np.arange(len(n), len(n) + len(first))
        n, steps = _joined(n, steps, first)
        put = steps.take(pa.array(index))
        ends = np.frombuffer(put.buffers()[1], np.int32)[put.offset :][starts]
        return np.add.reduceat(n[index], starts[:-1]), _binary(ends, put.buffers()[2])

    def _mixed(self, values: pa.StringArray, odd: str, plain, single) -> tuple[np.ndarray, pa.BinaryArray]:
        """Tokens and differences of all values: those that match ``odd`` one by one, the others together."""
        alone = pc.match_substring_regex(values, odd)
        rest = [single(x) for x in values.filter(alone).to_pylist()]
        n, steps = plain(values.filter(pc.invert(alone)) if rest else values)
        if not rest:
            return n, steps
        alone = alone.to_numpy(zero_copy_only=False)
        place = np.where(alone, len(n) - 1 + np.cumsum(alone), np.cumsum(~alone) - 1)
        n, steps = _joined(n, steps, rest)
        return n[place], steps.take(pa.array(place))

    def vectors(self, texts: pa.StringArray) -> tuple[np.ndarray, pa.BinaryArray]:
        """``vector`` of each of the texts, as two columns."""
        texts = pc.fill_null(texts, "")
        full = np.cumsum(pc.binary_length(texts).to_numpy(), dtype=np.int64)
        made, at = [], 0
        while at < len(texts) or not made:
            before = full[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(full, before + SLICE_BYTES, "right")))
            made.append(self._mixed(texts[at:end], self.odd_text, self._plain_texts, self.vector))
            at = end
        return np.concatenate([n for n, _ in made]), pa.concat_arrays([steps for _, steps in made])

    def vector(self, text: str | None) -> tuple[int, bytes]:
        """Tokens of a text, and the count of each prefix less that of the prefix before, as signed bytes."""
        n, out, get = 0, [], self.units.get
        for part, special in self._segments(text or ""):
            if special:
                # inside the special string, a prefix ends in ordinary characters
                whole = self._ordinary(part + special[:-1])
                counts = np.array([*whole, whole[len(part)] + 1])
                n += int(counts[-1])
                out.append(_differences(counts))
                continue
            # a piece starts at every blank that follows no white space, so counts add up over these stretches
            first, *rest = self.at_blanks(part) if self.run_then_space(part) else part.split(" ")
            for unit in (first, *(" " + x for x in rest)):
                k, differences = get(unit) or self._unit(unit)
                n += k
                out.append(differences)
        return n, b"".join(out)

    def total(self, text: str | None) -> int:
        """Tokens of a text: the count at its last prefix."""
        return self.vector(text)[0]

    def prefixes(self, text: str | None) -> list[int]:
        """Token counts of text[:0], text[:1], ... text, each as that prefix alone encodes."""
        return _counts(self.vector(text)[1]).tolist()

    def _ordinary(self, text: str) -> list[int]:
        """Prefix counts of a text without special strings.

        A prefix that ends in a run of white space has the run as its last
        piece, though the longer text cuts it elsewhere; other prefixes cut
        only their last piece short.
        """
        out, at, done = [0], 0, 0  # done: tokens of the pieces before `at`
        run_at, run_done = 0, 0  # where the present run of white space began, and the tokens before it
        for piece in self.findall(text):
            lead = self.leading(piece).end()
            if not (at and self.leading(text, at - 1).end() > at - 1):
                run_at, run_done = at, done
            if lead:
                run = self._by_char(text[run_at : at + lead])
                out += [run_done + n for n in run[at - run_at + 1 :]]
            if piece in self.whole:  # a quote and a letter
                quote = done + self.piece_total("'")
                out += [quote, quote + self.piece_total(piece[1]), done + self.piece_total(piece)]
            else:
                out += [done + n for n in self._by_char(piece)[lead + 1 :]]
            done += self.piece_total(piece)
            at += len(piece)
        return out

    def _by_char(self, piece: str) -> list[int]:
        raw = piece.encode()
        counts = self.piece_prefixes(raw)
        if len(raw) == len(piece):
            return counts
        at, out = 0, [0]
        for c in piece:
            at += len(c.encode())
            out.append(counts[at])
        return out


def _differences(counts: np.ndarray) -> bytes:
    steps = np.diff(counts)
    if len(steps) and np.abs(steps).max() > 127:
        raise ValueError("counts of neighbouring prefixes differ by more than a byte holds")
    return steps.astype(np.int8).tobytes()


def _binary(ends: np.ndarray, data: pa.Buffer) -> pa.BinaryArray:
    """The stretches of data between neighbouring ends."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def _joined(n: np.ndarray, steps: pa.BinaryArray, more: list[tuple[int, bytes]]) -> tuple[np.ndarray, pa.BinaryArray]:
    return np.concatenate((n, np.array([k for k, _ in more], np.int64))), pa.concat_arrays([steps, pa.array([x for _, x in more], pa.binary())])


def _counts(differences: bytes) -> np.ndarray:
    """Counts of all prefixes, from the empty one on."""
    return np.concatenate(([0], np.cumsum(np.frombuffer(differences, np.int8), dtype=np.int64)))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The process's counter for a vocabulary file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def _sizes(texts: pa.StringArray) -> pa.Array:
    return pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())


def _map(docs: DataFrame, id_col: str, text_col: str, schema: str, row) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), *row(b.column(1))], names=names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", *(x.split()[0] for x in schema.split(", "))]
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, {schema}")


def count(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row."""

    def row(texts):
        n, _ = counter(path).vectors(texts)
        return _sizes(texts), pa.array(n), pa.array(n > limit)

    return _map(docs, id_col, text_col, "n_bytes bigint, n_tokens bigint, over_limit boolean", row)


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts, whose item k (from 0) is the exact token count of the first k characters."""
    return _map(docs, id_col, text_col, "counts array<int>", lambda texts: [pa.array([counter(path).prefixes(t) for t in texts.to_pylist()], pa.list_(pa.int32()))])


def write_store(docs: DataFrame, path: str, where: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write doc_id, text_key, n_bytes, n_tokens and prefixes (a signed byte for each character) of every row to ``where``; the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            n, steps = c.vectors(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _sizes(b.column(2)), pa.array(n), steps], names=names)

    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    names = ["doc_id", "text_key", "n_bytes", "n_tokens", "prefixes"]
    kind = given.schema["doc_id"].dataType.simpleString()
    made = given.mapInArrow(run, f"doc_id {kind}, text_key bigint, n_bytes bigint, n_tokens bigint, prefixes binary")
    made.write.mode("overwrite").option("compression", "zstd").parquet(where)
    return docs.sparkSession.read.parquet(where)


def over_limit(store: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens (the count stored for the whole text) and over_limit (n_tokens > limit) of every row of a store."""
    return store.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def longest_prefixes(store: DataFrame, budget: int) -> DataFrame:
    """doc_id, text_key, end (characters of the longest prefix of at most ``budget`` tokens) and its n_tokens, from the stored counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends, n = [], []
            for steps in b.column(2).to_pylist():
                counts = _counts(steps)
                end = int(np.flatnonzero(counts <= budget)[-1]) if budget >= 0 else 0
                ends.append(end)
                n.append(int(counts[end]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ends, pa.int32()), pa.array(n, pa.int64())], names=["doc_id", "text_key", "end", "n_tokens"])

    kind = store.schema["doc_id"].dataType.simpleString()
    return store.select("doc_id", "text_key", "prefixes").mapInArrow(run, f"doc_id {kind}, text_key bigint, end int, n_tokens bigint")


def truncate(docs: DataFrame, store: DataFrame, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text cut to its longest prefix of at most ``budget`` tokens, and that prefix's n_tokens, of every row of ``docs`` that is in the store."""
    ends = longest_prefixes(store, budget).dropDuplicates(["doc_id", "text_key"])
    given = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    both = given.join(ends, given["doc_id"].eqNullSafe(ends["doc_id"]) & (given["text_key"] == ends["text_key"]))
    return both.select(given["doc_id"], F.substring(F.col("text"), F.lit(1), F.col("end")).alias("text"), "n_tokens")

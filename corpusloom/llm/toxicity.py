"""Toxicity scores by gradient-boosted trees over dense features.

Features of a whole text: densities of a learned lexicon, plain and behind obfuscation,
nearness of lexicon words to second-person words, rates of capitals, punctuation and
obfuscation, and length. The lexicon is learned from the labelled sample: words that are
far likelier in toxic texts. Trees are boosted on the logistic loss, with the lexicon
features of each half of the sample taken from the other half's lexicon, so that they are
as informative as on new texts. Isotonic regression on rows that the trees haven't seen
turns margins into probabilities; a small share of the plain probability keeps order within
its steps.

Only the fit is bounded: at most ``SAMPLE_PER_CLASS`` labelled texts of up to ``MAX_FIT_CHARS`` characters for each label, chosen by a hash
of the id and weighted back to the labels' true shares. Every whole text is scored, in Arrow
batches without a shuffle.

Defined results: null and empty texts are scored from their empty features; very long ones whole. A document with several
labels is toxic if one of them says so. Labels that are null, not
0 or 1, or of no document are ignored; with less than two labels of both kinds every score is
the share of toxic labels (0 without any). Repeated rows each get their row. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import filter_by_keys

SAMPLE_PER_CLASS = 3000
#: Characters of the longest text that the fit takes into its sample.
MAX_FIT_CHARS = 200_000
TREES, DEPTH, RATE, BINS, RIDGE = 120, 3, 0.1, 48, 5.0
#: A lexicon word: this much likelier (natural log) in toxic texts, and in so many of them at least,
#: and in such a share of them.
LOG_ODDS, MIN_TEXTS, MIN_SHARE, LEXICON_WORDS = 2.0, 3, 0.01, 2000
CALIBRATION_SHARE = 0.25
PLAIN_SHARE = 0.02

SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya thou thee thy du dich dir dein deine deinen deiner euch euer eure ihr sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros os vos".split()
)
_WORD = re.compile(r"[^\W\d_]+")
#: A sign or digit within or before letters, by which masked tokens are found.
_HINT = re.compile(r"[^\W\d_][0-9@$*!|+.\-_#€]+[^\W\d_]|[0-9@$][^\W\d_]")
_CAPITALS = re.compile(r"(?<![^\W\d_])[A-ZÀ-ÖØ-ÞΑ-ΩА-Я]{3,}(?![^\W\d_])")
_EDGE = re.compile(r"\s|$")
_PLAIN = str.maketrans("013457@$!|€", "oieastasiie")
_STRETCHED = re.compile(r"([^\W\d_])\1\1")
_SQUEEZE = re.compile(r"(.)\1+")
_STRIP = re.compile(r"[^\W\d_]")
_KIND: np.ndarray | None = None
NAMES = ["density", "hits", "heaviest", "weight_density", "local", "masked_hits", "masked_density", "near_second", "second_rate", "capitals", "caps_words", "exclaims", "questions", "punctuation", "symbols", "digits", "masked_rate", "stretched", "length", "word_length", "lines"]


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _kinds() -> np.ndarray:
    """0 other, 1 upper-case letter, 2 other letter, 3 punctuation, 4 symbol, 5 digit, 6 exclamation, 7 question, 8 line end."""
    global _KIND
    if _KIND is None:
        kind = np.zeros(0x110000, np.int8)
        for c in range(0x110000):
            cat = unicodedata.category(chr(c))
            kind[c] = 1 if cat == "Lu" else 2 if cat[0] == "L" else 3 if cat[0] == "P" else 4 if cat[0] == "S" else 5 if cat[0] == "N" else 0
        kind[ord("!")], kind[ord("?")], kind[10] = 6, 7, 8
        _KIND = kind
    return _KIND


def masked_tokens(text: str) -> list[str]:
    """Tokens with signs or digits among their letters."""
    out, last = [], 0
    for m in _HINT.finditer(text):
        if m.start() < last:
            continue
        start = m.start()
        while start > last and not text[start - 1].isspace():
            start -= 1
        last = _EDGE.search(text, m.end()).start()
        out.append(text[start:last].strip(".,;:!?()\"'"))
    return out


def unmask(token: str) -> list[str]:
    """Plain readings of a token that hides letters behind signs, digits or repeats."""
    low = token.lower()
    as_letters = low.translate(_PLAIN)
    letters = "".join(_STRIP.findall(as_letters))
    return list(dict.fromkeys([letters, _SQUEEZE.sub(r"\1", letters), "".join(_STRIP.findall(low))]))


def features(text: str | None, lexicon: dict[str, float], skeletons: dict[str, float]) -> list[float]:
    t = text or ""
    kinds = np.bincount(_kinds()[np.frombuffer(t.encode("utf-32-le", "replace"), np.uint32)], minlength=9) if t else np.zeros(9)
    chars, letters = max(1, len(t)), max(1, kinds[1] + kinds[2])
    words = _WORD.findall(t.lower())
    n = max(1, len(words))
    where = [i for i, w in enumerate(words) if w in lexicon]
    weights = [lexicon[words[i]] for i in where]
    local, first = 0, 0
    for k, i in enumerate(where):
        while i - where[first] > 20:
            first += 1
        local = max(local, k - first + 1)
    second = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    nearest, j = 1 << 20, 0
    for i in where:
        while j + 1 < len(second) and abs(second[j + 1] - i) <= abs(second[j] - i):
            j += 1
        if second:
            nearest = min(nearest, abs(second[j] - i))
    masked = masked_tokens(t)
    hidden = 0
    for token in masked:
        if token.lower() not in lexicon and (any(x in lexicon for x in unmask(token)) or _skeleton(token) in skeletons):
            hidden += 1
    stretched = _STRETCHED.findall(t.lower())
    caps = len(_CAPITALS.findall(t)) if kinds[1] > 2 else 0
    return [
        len(where) / n, math.log1p(len(where)), max(weights, default=0.0), sum(weights) / n, float(local), math.log1p(hidden), hidden / n,
        math.exp(-nearest / 5), len(second) / n, kinds[1] / letters, caps / n, kinds[6] / chars, kinds[7] / chars, (kinds[3] + kinds[6] + kinds[7]) / chars,
        kinds[4] / chars, kinds[5] / chars, len(masked) / n, len(stretched) / n, math.log1p(len(words)), letters / n, kinds[8] / chars,
    ]


def _skeleton(token: str) -> str:
    """A token with its starred letters as a pattern: consonant frame and length."""
    return re.sub(r"[^\W\d_]", lambda m: m.group(), token.lower()) if "*" in token else ""


def _skeletons(lexicon: dict[str, float]) -> dict[str, float]:
    """Lexicon words with one inner letter starred."""
    return {w[:i] + "*" + w[i + 1 :]: x for w, x in lexicon.items() if len(w) > 3 for i in range(1, len(w))}


def learn_lexicon(texts: list[str], labels: np.ndarray, weights: np.ndarray) -> dict[str, float]:
    """Words with the log odds by which they are likelier in toxic texts."""
    seen: tuple[Counter, Counter] = (Counter(), Counter())
    among: dict[str, set] = {}
    for t, y, w in zip(texts, labels.tolist(), weights.tolist()):
        words = _WORD.findall(t.lower())
        own = set(words)
        for token in masked_tokens(t):
            own.update(unmask(token))
        # near copies mostly agree in their least run of words, and then count as one text
        kin = min((xxhash.xxh3_64_intdigest("\0".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))), default=0)
        for x in own:
            seen[y][x] += w
            if y:
                among.setdefault(x, set()).add(kin)
    count = {x: len(k) for x, k in among.items()}
    clean, toxic = weights[labels == 0].sum(), weights[labels == 1].sum()
    out, least = {}, max(MIN_TEXTS, MIN_SHARE * labels.sum())  # of kinds of toxic texts
    for word, n in count.items():
        if n >= least and len(word) > 1:
            odds = math.log((seen[1][word] + 0.5) / (toxic + 1)) - math.log((seen[0][word] + 0.5) / (clean + 1))
            if odds >= LOG_ODDS:
                out[word] = odds
    top = sorted(out, key=lambda x: (-out[x] * math.log1p(count[x]), x))[:LEXICON_WORDS]
    return {w: out[w] for w in top}


class Trees:
    """Boosted regression trees on binned features, for the logistic loss."""

    def fit(self, x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(np.average(y, weights=weights), 1e-4, 1 - 1e-4)
        self.base = math.log(share / (1 - share))
        margin = np.full(len(y), self.base)
        self.trees: list[list] = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            tree: list = []
            margin += self._grow(tree, binned, weights * (y - p), weights * p * (1 - p), np.arange(len(y)), DEPTH, len(y))
            self.trees.append(tree)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def _grow(self, tree: list, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, n: int) -> np.ndarray:
        """Append this node and those under it to ``tree``; the change of each row's margin."""
        g, h = grad[rows].sum(), hess[rows].sum()
        at = len(tree)
        tree.append((-1, 0, 0, 0, RATE * g / (h + RIDGE)))
        best = (1e-6, -1, 0)
        for f in range(binned.shape[1] if depth else 0):
            size = len(self.edges[f]) + 1
            left_g = np.cumsum(np.bincount(binned[rows, f], grad[rows], size))[:-1]
            left_h = np.cumsum(np.bincount(binned[rows, f], hess[rows], size))[:-1]
            if len(left_g):
                gain = left_g**2 / (left_h + RIDGE) + (g - left_g) ** 2 / (h - left_h + RIDGE) - g**2 / (h + RIDGE)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), f, k))
        out = np.zeros(n)
        if best[1] < 0:
            out[rows] = tree[at][4]
            return out
        low = binned[rows, best[1]] <= best[2]
        out += self._grow(tree, binned, grad, hess, rows[low], depth - 1, n)
        right = len(tree)
        out += self._grow(tree, binned, grad, hess, rows[~low], depth - 1, n)
        tree[at] = (best[1], best[2], at + 1, right, 0.0)
        return out

    def margins(self, x: np.ndarray) -> np.ndarray:
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        every = np.arange(len(x))
        for tree in self.trees:
            feature, cut, left, right, value = (np.array(c) for c in zip(*tree))
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                inner = feature[node] >= 0
                goes = binned[every, np.maximum(feature[node], 0)] <= cut[node]
                node = np.where(inner, np.where(goes, left[node], right[node]), node)
            out += value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: margins and the non-decreasing shares that fit y best at them."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []
    for m, v, w in zip(margin[order], y[order].astype(float), weights[order]):
        blocks.append([v, w, m, m])
        while len(blocks) > 1 and (blocks[-2][0] >= blocks[-1][0] or blocks[-2][3] == blocks[-1][2]):
            v2, w2, _, high = blocks.pop()
            v1, w1, low, _ = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, low, high])
    points = [p for b in blocks for p in ((b[2], b[0]), (b[3], b[0]))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


class ToxicityModel:
    def __init__(self, texts: list[str], labels: list[int], weights: list[float]):
        """Fit on texts in a fixed order."""
        y, w = np.array(labels, np.int64), np.array(weights, float)
        self.lexicon: dict[str, float] = {}
        self.trees = None
        self.share = float(np.average(y, weights=w)) if len(y) else 0.0
        if min(np.bincount(y, minlength=2)) >= 2 if len(y) else False:
            self._fit(texts, y, w)
        self.skeletons = _skeletons(self.lexicon)

    def _fit(self, texts: list[str], y: np.ndarray, w: np.ndarray) -> None:
        fold = np.zeros(len(y), np.int64)
        for label in (0, 1):  # halves and calibration rows alike in both labels
            own = np.flatnonzero(y == label)
            fold[own] = np.arange(len(own)) % 2
        x = np.zeros((len(y), len(NAMES)))
        for half in (0, 1):
            own = np.flatnonzero(fold != half)
            lexicon = learn_lexicon([texts[i] for i in own], y[own], w[own])
            frames = _skeletons(lexicon)
            for i in np.flatnonzero(fold == half):
                x[i] = features(texts[i], lexicon, frames)
        self.lexicon = learn_lexicon(texts, y, w)
        step = round(1 / CALIBRATION_SHARE)
        kept = np.zeros(len(y), bool)
        for label in (0, 1):
            own = np.flatnonzero(y == label)
            kept[own[(np.arange(len(own)) // 2) % step == 0]] = True
        if min(np.bincount(y[~kept], minlength=2)) < 1:
            kept[:] = False
        self.trees = Trees().fit(x[~kept], y[~kept], w[~kept] / w.mean())
        rows = kept if kept.any() else ~kept
        self.steps = isotonic(self.trees.margins(x[rows]), y[rows], w[rows])

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.share)
        if not texts:
            return np.zeros(0)
        margin = self.trees.margins(np.array([features(t, self.lexicon, self.skeletons) for t in texts]))
        plain = 1 / (1 + np.exp(-margin))
        return np.clip((1 - PLAIN_SHARE) * np.interp(margin, *self.steps) + PLAIN_SHARE * plain, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from the labelled rows that aren't held out."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    marked = marked.filter(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    part = lambda y: marked.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS)
    ids = part(0).unionByName(part(1))
    given = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).filter(F.length("text") <= MAX_FIT_CHARS)
    texts = filter_by_keys(given, ids.select("doc_id"), ["doc_id"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    rows = sorted((str(r["doc_id"]), r["toxic"], r["text"]) for r in texts.join(F.broadcast(ids), "doc_id").collect())
    found = Counter(y for _, y, _ in rows)
    return ToxicityModel([t for *_, t in rows], [y for _, y, _ in rows], [totals[y] / found[y] for _, y, _ in rows])


def score(docs: DataFrame, labels: DataFrame | None = None, model: ToxicityModel | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                s = shared.value.scores(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {given.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")

"""Language identification by string kernels.

The kernel of two texts is the number of distinct letter n-grams, n = 1 to
``MAX_N``, that occur in both (a blended-spectrum presence kernel), over the
root of the product of their own numbers. Texts are lower-cased; a run of
anything but letters counts as one space. A bounded sample of labelled texts
gives landmarks; the Nystrom map through the landmarks turns the kernel into
features, on which one ridge regression per language is fitted against the
rest. Scoring is a product of the batch's sparse presence matrix with the
landmarks' presence matrix, and of the kernel values with the folded weights.
A text's score is its best margin, 0 to 1. There is no intercept, so a text that shares nothing
with the landmarks, or is as far from each language as from the rest, scores about 0; so does
one of whose n-grams less than ``MIN_KNOWN`` are in any landmark.

The sample is at most ``SAMPLE_PER_LANG`` whole texts of up to ``MAX_FIT_CHARS`` characters for each of at
most ``MAX_LANGS`` languages, the same whatever the layout of the table, plus as many short word windows of them, so that
short texts are known too. Only the fit is bounded: every whole text is scored,
in Arrow batches, without a shuffle.

Defined results: texts that are null or without a letter (marks, digits and signs are none) are ``und`` with score 0;
very long texts are scored whole; of languages with equal margins, the first by name is predicted;
so is every text if there is nothing to learn from. Rows with a null id count as
training rows if labelled; their id hashes as the empty string. Repeated rows each
get their row. Extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import filter_by_keys

MAX_N = 3
#: Labelled texts for each language that the fit sees, and how many of them are landmarks.
SAMPLE_PER_LANG = 240
LANDMARKS_PER_LANG = 40
#: Languages that the fit learns, those of most labelled texts, and characters of the longest text that it takes into its sample.
MAX_LANGS, MAX_FIT_CHARS = 400, 200_000
RIDGE = 1e-3
#: A text of which a smaller share of n-grams is known scores 0: with few languages, its margin would only say what it's less unlike.
MIN_KNOWN = 0.5
UNDETERMINED = "und"
_BLOCK = 32
_BITS = 21
_LETTER: np.ndarray | None = None


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text, mod 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, which count as part of a word but are no letters by themselves."""
    global _LETTER
    if _LETTER is None:
        kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _LETTER = np.fromiter(((k == "L") + 2 * (k == "M") for k in kinds), np.int8, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> np.ndarray:
    """The distinct n-grams of a text as sorted numbers; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    kind = _letters()[codes]
    if not (kind == 1).any():
        return np.empty(0, np.int64)
    is_letter = kind > 0
    codes = np.where(is_letter, codes, 32).astype(np.int64)
    keep = np.ones(len(codes), bool)
    keep[1:] = is_letter[1:] | is_letter[:-1]
    codes = np.concatenate(([32], codes[keep], [32]))
    found, grams = [np.unique(codes)], codes
    for n in range(2, MAX_N + 1):
        grams = grams[:-1] << _BITS | codes[n - 1 :]
        ordered = np.sort(grams)
        found.append(ordered[np.concatenate(([True], ordered[1:] != ordered[:-1]))])
    return np.concatenate(found)  # a longer n-gram is a larger number, since no code is 0


class KernelClassifier:
    """One-versus-rest kernel ridge regression on Nystrom features of the presence kernel."""

    def __init__(self, texts: list[str], langs: list[str]):
        """Fit on texts, sorted by the caller so that the result doesn't depend on their order of arrival."""
        self.langs = sorted(set(langs))
        given = [(ngrams(t), lang) for t, lang in zip(texts, langs)]
        landmarks: list[np.ndarray] = []
        for lang in self.langs:
            own = [g for g, x in given if x == lang and len(g)]
            landmarks += own[:LANDMARKS_PER_LANG]
        for t, lang in zip(texts, langs):
            given.append((ngrams(_window(t)), lang))
        given = [(g, lang) for g, lang in given if len(g)]
        self.vocabulary = np.unique(np.concatenate(landmarks)) if landmarks else np.empty(0, np.int64)
        self.presence = np.zeros((len(self.vocabulary), len(landmarks)), np.float32)
        for j, g in enumerate(landmarks):
            self.presence[np.searchsorted(self.vocabulary, g), j] = 1 / np.sqrt(len(g))
        if not landmarks:
            self.langs = []
            return
        between = self.kernel(landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh((between + between.T) / 2)
        kept = values > values[-1] * 1e-6
        root = vectors[:, kept] / np.sqrt(values[kept])
        features = self.kernel([g for g, _ in given]).astype(np.float64) @ root
        target = np.array([[1.0 if lang == x else -1.0 for x in self.langs] for _, lang in given])
        weights = np.linalg.solve(features.T @ features + RIDGE * len(given) * np.eye(features.shape[1]), features.T @ target)
        self.weights = (root @ weights).astype(np.float32)

    def kernel(self, grams: list[np.ndarray], known: np.ndarray | None = None) -> np.ndarray:
        """Kernel values of texts (rows) with landmarks: a sparse presence matrix times a dense one, in blocks.

        ``known``, if given, is filled with the share of each text's n-grams that some landmark has.
        """
        out = np.zeros((len(grams), self.presence.shape[1]), np.float32)
        for at in range(0, len(grams), _BLOCK):
            rows, cols = [], []
            for i, g in enumerate(grams[at : at + _BLOCK], at):
                where = np.searchsorted(self.vocabulary, g)
                where[where == len(self.vocabulary)] = 0
                hits = where[self.vocabulary[where] == g]
                if len(hits):
                    if known is not None:
                        known[i] = len(hits) / len(g)
                    rows.append(i)
                    cols.append(hits)
            if rows:
                starts = np.cumsum([0, *map(len, cols[:-1])])
                own = np.sqrt([len(grams[i]) for i in rows])[:, None]
                out[rows] = np.add.reduceat(self.presence[np.concatenate(cols)], starts, axis=0) / own
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score (0 to 1) of each text."""
        grams = [ngrams(t) for t in texts]
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = np.zeros(len(grams))
        margin = self.kernel(grams, known) @ self.weights
        best = margin.argmax(axis=1)
        score = np.clip(margin[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        score[known < MIN_KNOWN] = 0.0
        some = np.array([len(g) > 0 for g in grams], bool)
        return [self.langs[b] if s else UNDETERMINED for b, s in zip(best, some)], np.where(some, score, 0.0)


def _window(text: str) -> str:
    """Three to nine words from within a text, chosen by its length."""
    words = re.findall(r"\S+", text)
    n = 3 + len(text) % 7
    at = len(text) * 7919 % max(1, len(words) - n + 1)
    return " ".join(words[at : at + n])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> KernelClassifier:
    """Learn from the labelled rows that aren't held out."""
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = given.filter(~held_out() & F.col("lang").isNotNull() & (F.length("text") <= MAX_FIT_CHARS))
    langs = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MAX_LANGS)
    rows = rows.join(F.broadcast(langs.select("lang")), "lang", "left_semi")  # MAX_LANGS rows at most
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("r", F.row_number().over(first)).filter(F.col("r") <= SAMPLE_PER_LANG).select("doc_id", "lang").distinct()
    # repeated ids may bring more rows than the bound; one text each is enough
    sample = filter_by_keys(rows, ids, ["doc_id", "lang"], "left_semi").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = sorted((r["lang"], str(r["doc_id"]), r["text"]) for r in sample.collect())
    return KernelClassifier([t for _, _, t in found], [lang for lang, _, _ in found])


def predict(docs: DataFrame, model: KernelClassifier | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    given = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return _scored(given, model or fit(docs, id_col, text_col, lang_col), ["doc_id", "held_out"], "text")


def confident(docs: DataFrame, min_score: float, model: KernelClassifier | None = None, text_col: str = "text") -> DataFrame:
    """The rows whose language is determined with ``min_score`` at least, with all their columns."""
    lang, score = f"__lang_{uuid.uuid4().hex[:8]}", f"__score_{uuid.uuid4().hex[:8]}"
    scored = _scored(docs, model or fit(docs), docs.columns, text_col, lang_as=lang, score_as=score)
    return scored.filter((F.col(lang) != UNDETERMINED) & (F.col(score) >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])


def _scored(given: DataFrame, model: KernelClassifier, keep: list[str], text_col: str, lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    shared = given.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                langs, scores = shared.value.predict(part.column(given_columns.index(text_col)).to_pylist())
                kept = [part.column(given_columns.index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*keep, lang_as, score_as])

    given_columns = given.columns
    fields = [given.schema[c] for c in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return given.mapInArrow(run, f"{schema}, {lang_as} string, {score_as} double")

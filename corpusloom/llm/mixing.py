"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of token weights by cell: source, language and topic.
Raking scales the cells in turn so that each of the three margins meets its target,
until all do. No cell can give more than it holds, so raking has that ceiling as a
constraint: what a full cell lacks is made up within its own margins. The tokens kept are the
wanted share of the corpus, or as many fewer as it takes for the margins to be met: no
category can weigh more than it has. A document's probability of staying is its
cell's kept tokens over its tokens. Targets that contradict each other, so that no weights meet
them, are met as nearly as the rounds bring them. Whether a document
stays follows from a hash of its id, its text and a seed, so that a run can be
repeated.

Cells are counted by Spark over all documents, with partial sums before the shuffle.
Raking works on cells, never documents. Up to ``MAX_CELLS`` cells it runs in the driver;
a larger table is raked by the same steps as DataFrame aggregations.

A document's token weight is its number of words. Defined results: very long texts are weighed whole; nulls in source or language are a category of their own, as is the
topic of null texts; texts weigh one token at least, so that they can be drawn. Targets
that name categories without documents are left out and the rest scaled; categories
without a target share what the targets leave. Repeated rows are drawn alike. An empty
table gives an empty result. All columns are kept.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, heavy_safe_join

MARGINS = ("source", "lang", "topic")
#: Cells that the driver rakes itself; about 100 bytes each.
MAX_CELLS = 200_000
#: By default, a source or language weighs as its tokens to this power.
TEMPERATURE = 0.7
TOKEN_SHARE = 0.8
ROUNDS = 60
TOLERANCE = 1e-6
#: Margins that miss by less than this are met; and the step to fewer tokens where they aren't.
MET = 1e-4
STEP = 0.95
#: Topics by what a text holds, the first that fits; a table with a topic column goes by that.
#: Each has strings, one of which must be there, and a pattern that is tried only then.
TOPICS = [
    ("legal", ["icense", "icence", "opyright", "ights reserved"], r"[Ll]icen[sc]ed? |[Cc]opyright|[Aa]ll rights reserved"),
    ("contact", ["@"], r"[A-Za-z0-9_]@[A-Za-z0-9-]+\.[A-Za-z]"),
    ("tables", ["|"], r"\|[^|\n]*\|"),
    ("web", ["http://", "https://", "www."], None),
    ("numbers", list("0123456789"), r"[0-9]{4}"),
]


def topic_of(text: Column) -> Column:
    out = F.when(text.isNull(), F.lit("none"))
    for name, parts, pattern in TOPICS:
        found = reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in parts)) if len(parts) < 10 else F.lit(True)
        out = out.when(found & text.rlike(pattern) if pattern else found, F.lit(name))
    return out.otherwise(F.lit("prose"))


def token_weight(text: Column) -> Column:
    """Words of a text, parted by ASCII white space; one at least."""
    words = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.greatest(words, F.lit(1)).cast("bigint")


def targets(totals: dict, given: dict | None, temperature: float) -> dict:
    """Shares of a margin's categories, from given ones or by temperature; they sum to 1."""
    if given is None:
        raw = {k: v**temperature for k, v in totals.items()}
    else:
        raw = {k: given[k] for k in totals if k in given}
        rest = [k for k in totals if k not in given]
        left = max(0.0, 1 - sum(raw.values())) if rest else 0.0
        of = sum(totals[k] for k in rest)
        raw |= {k: left * totals[k] / of for k in rest}
    total = sum(raw.values())
    return {k: v / total for k, v in raw.items()} if total else dict.fromkeys(totals, 0.0)


def rake(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray]) -> np.ndarray:
    """Cell weights, with sum 1, whose margins meet ``shares``, as near to ``tokens`` as that allows."""
    w = tokens / tokens.sum()
    for _ in range(ROUNDS):
        for code, share in zip(codes, shares):
            now = np.bincount(code, w, len(share))
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        off = max(np.abs(np.bincount(code, w, len(share)) / w.sum() - share).max() for code, share in zip(codes, shares))
        if off < TOLERANCE:
            break
    return w / w.sum()


def rake_capped(tokens: np.ndarray, codes: list[np.ndarray], shares: list[np.ndarray], wanted: float) -> tuple[np.ndarray, float]:
    """Tokens kept of each cell, none beyond its own, with sum ``wanted`` and margins that meet ``shares``; and by how much they miss."""
    w, off = tokens * wanted / tokens.sum(), 0.0
    for _ in range(ROUNDS):
        for code, share in zip(codes, shares):
            now = np.bincount(code, np.minimum(tokens, w), len(share)) / wanted
            w = w * np.divide(share, now, out=np.zeros_like(share), where=now > 0)[code]
        off = max(np.abs(np.bincount(code, np.minimum(tokens, w), len(share)) / wanted - share).max() for code, share in zip(codes, shares))
        if off < TOLERANCE:
            break
    return np.minimum(tokens, w), off


def scale(weights: np.ndarray, tokens: np.ndarray, wanted: float) -> float:
    """The factor c at which cells kept with probability min(1, c * weight / tokens) have ``wanted`` tokens in expectation."""
    ratio = np.divide(weights, tokens, out=np.zeros_like(weights), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    r, t = ratio[order], tokens[order]
    whole = np.concatenate(([0.0], np.cumsum(t)))[:-1]  # tokens of cells before this one, all kept whole
    part = np.cumsum((r * t)[::-1])[::-1]  # what this and the later cells give for a unit of c
    for i in range(len(r)):
        if r[i] <= 0 or part[i] <= 0:
            break
        c = (wanted - whole[i]) / part[i]
        if c * r[i] <= 1:
            return max(c, 0.0)
    positive = r[r > 0]
    return 1 / positive.min() if len(positive) else 0.0


def _driver_rates(cells: list, given: dict, temperature: float, share: float) -> list[float]:
    tokens = np.array([c["tokens"] for c in cells], float)
    codes, shares = [], []
    for m in MARGINS:
        names = sorted({c[m] for c in cells}, key=lambda x: (x is not None, x))
        at = {x: i for i, x in enumerate(names)}
        code = np.array([at[c[m]] for c in cells])
        totals = dict(zip(names, np.bincount(code, tokens, len(names))))
        want = targets(totals, given.get(m), temperature if m != "topic" else 1.0)
        codes.append(code)
        shares.append(np.array([want[x] for x in names]))
    w = rake(tokens, codes, shares)
    met = max(np.abs(np.bincount(code, w, len(x)) - x).max() for code, x in zip(codes, shares)) < MET
    free = np.divide(tokens, w, out=np.full_like(w, np.inf), where=w > 0).min()
    most = min(np.divide(np.bincount(code, tokens, len(x)), x, out=np.full_like(x, np.inf), where=x > 0).min() for code, x in zip(codes, shares))
    wanted = min(share * tokens.sum(), most)
    while wanted > free:
        kept, off = rake_capped(tokens, codes, shares, wanted)
        if off < MET or not met:
            return (kept / tokens).tolist()
        wanted *= STEP
    return np.minimum(1.0, min(wanted, free) * w / tokens).tolist() if wanted > 0 else [0.0] * len(tokens)


def _spark_rates(cells: DataFrame, given: dict, temperature: float, share: float, scratch: Scratch) -> DataFrame:
    """The same for more cells than the driver takes."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens")).first()[0]
    wanted = []
    for m in MARGINS:
        sums = cells.groupBy(m).agg(F.sum("tokens").alias("t"))
        if given.get(m) is None:
            raw = sums.select(m, F.pow("t", F.lit(temperature if m != "topic" else 1.0)).alias("raw"))
        else:
            own = spark.createDataFrame(list(given[m].items()), f"{m} string, g double")
            both = sums.join(own, sums[m].eqNullSafe(own[m]), "left").select(sums[m], "t", "g")
            known, rest = both.agg(F.coalesce(F.sum("g"), F.lit(0.0)), F.sum(F.when(F.col("g").isNull(), F.col("t")))).first()
            left = max(0.0, 1 - known)
            raw = both.select(m, F.coalesce("g", F.lit(left) * F.col("t") / F.lit(float(rest or 1))).alias("raw"))
        all_raw = raw.agg(F.sum("raw")).first()[0] or 1.0
        wanted.append(scratch.write(f"target-{m}", raw.select(F.col(m).alias("k"), (F.col("raw") / F.lit(all_raw)).alias("share"))))
    most = min(cells.groupBy(F.col(m).alias("c")).agg(F.sum("tokens").alias("t")).join(want, F.col("c").eqNullSafe(F.col("k"))).agg(F.min(F.when(F.col("share") > 0, F.col("t") / F.col("share")))).first()[0] or 0.0 for m, want in zip(MARGINS, wanted))
    tokens = min(share * total, most)
    w, off = _spark_rake(cells, wanted, 1.0, total, False, scratch)
    met = off < MET
    free = w.agg(F.min(F.when(F.col("w") > 0, F.col("tokens") / F.col("w")))).first()[0] or 0.0
    while tokens > free:
        kept, off = _spark_rake(cells, wanted, tokens, total, True, scratch)
        if off < MET or not met:
            return kept.withColumn("rate", F.least(F.lit(1.0), F.col("w") / F.col("tokens"))).drop("w")
        tokens *= STEP
    return w.withColumn("rate", F.least(F.lit(1.0), F.lit(min(tokens, free)) * F.col("w") / F.col("tokens"))).drop("w")


def _spark_rake(cells: DataFrame, wanted: list[DataFrame], of: float, total: int, capped: bool, scratch: Scratch) -> tuple[DataFrame, float]:
    """``cells`` with weights w of sum ``of`` that meet the margins, and by how much they miss; capped: no weight counts beyond its tokens."""
    run = uuid.uuid4().hex[:8]
    counted = F.least(F.col("w"), F.col("tokens").cast("double")) if capped else F.col("w")
    w = scratch.write(f"{run}-w-0", cells.withColumn("w", F.col("tokens") * F.lit(of / total)))
    step, off = 0, 0.0
    for _ in range(ROUNDS):
        off = 0.0
        for m, want in zip(MARGINS, wanted):
            step += 1
            now = w.groupBy(F.col(m).alias("k")).agg((F.sum(counted) / F.lit(of)).alias("now"))
            factor = scratch.write(f"{run}-f-{step}", now.join(want, now["k"].eqNullSafe(want["k"])).select(now["k"], "now", "share", F.when(F.col("now") > 0, F.col("share") / F.col("now")).otherwise(0.0).alias("f")))
            off = max(off, factor.agg(F.max(F.abs(F.col("now") - F.col("share")))).first()[0] or 0.0)
            w2 = w.join(factor.select("k", "f"), w[m].eqNullSafe(factor["k"])).select(*[w[c] for c in w.columns if c != "w"], (w["w"] * F.col("f")).alias("w"))
            w = scratch.write(f"{run}-w-{step}", w2)
            scratch.drop(f"{run}-w-{step - 1}", f"{run}-f-{step}")
        if off < TOLERANCE:
            break
    return w, off


def cell_rates(docs: DataFrame, given: dict | None = None, temperature: float = TEMPERATURE, share: float = TOKEN_SHARE, text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """source, lang, topic, docs, tokens and rate (the probability that a document stays) of each cell."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    by = docs.select(*_margins(docs, text_col), token_weight(F.col(text_col)).alias("weight"))
    cells = scratch.write("cells", by.groupBy(*MARGINS).agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").alias("tokens")))
    if cells.count() > max_cells:
        return _spark_rates(cells, given or {}, temperature, share, scratch)
    rows = cells.collect()
    rates = _driver_rates(rows, given or {}, temperature, share) if rows else []
    # as an Arrow table: rows would start Python workers of another kind on the executors, which stay beside those of the operators
    columns = {m: pa.array([r[m] for r in rows], pa.string()) for m in MARGINS} | {c: pa.array([r[c] for r in rows], pa.int64()) for c in ("docs", "tokens")}
    return spark.createDataFrame(pa.table(columns | {"rate": pa.array(rates, pa.float64())}))


def _margins(docs: DataFrame, text_col: str) -> list[Column]:
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col(text_col))
    return [F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), topic.alias("topic")]


def draw(docs: DataFrame, given: dict | None = None, temperature: float = TEMPERATURE, share: float = TOKEN_SHARE, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", max_cells: int = MAX_CELLS) -> DataFrame:
    """The rows of ``docs`` that the calibrated probabilities let stay, with all their columns.

    ``given`` maps source, lang or topic to shares of its categories.
    """
    scratch = Scratch(docs.sparkSession, "mixing-rates")
    key = f"__cell_{uuid.uuid4().hex[:8]}"
    cell = lambda cols: F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    rates = scratch.write("rates", cell_rates(docs, given, temperature, share, text_col, max_cells).select(cell([F.col(m) for m in MARGINS]).alias(key), "docs", F.col("rate").alias(f"{key}r")))
    u = (F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col))).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).alias(f"{key}u")
    keyed = docs.withColumns({key: cell(_margins(docs, text_col)), f"{key}u": u})
    names = [F.col(f"`{c}`") for c in docs.columns]
    if rates.count() <= max_cells:
        joined = keyed.join(F.broadcast(rates.drop("docs")), key)
    else:
        wide = rates.withColumnRenamed("docs", f"{key}n")
        joined = heavy_safe_join(keyed, wide, key, f"{key}n", docs.count())
    return joined.filter(F.col(f"{key}u") < F.col(f"{key}r")).select(*names)

"""Every operator against a brute-force version, on rows with nulls, empty, long, tied and repeated texts."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact_dedup, lang_id, license_scan, mixing, near_dedup, prefix_tokens, substring_dedup, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, label string, __id string"
WORDS = [f"{a}{b}{c}" for a in "bdfgklmn" for b in "aeiou" for c in ["", "r", "st", "m"]]


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = [prose(rng, rng.randint(20, 120)) for _ in range(12)]
    shared = prose(rng, 30)
    out = [None, "", "   \n", "one", "One", "three short words", *base, base[0], base[0].upper(), base[1].replace(" ", "  "), base[2] + " tail", "lead " + base[3], base[4]]
    out += [f"{prose(rng, 15)} {shared} {prose(rng, 15)}" for _ in range(3)] + [f"{shared} {shared}", prose(rng, 6000)]
    near = base[5].split()
    for k in range(6):
        w = list(near)
        w[(7 * k) % len(w)] = "changed"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows(texts):
    found = [(i * 3 % 101, t, None if i % 7 == 0 else "aa", None if i % 5 == 0 else f"s{i % 3}", None, "clash", "clash", "clash") for i, t in enumerate(texts)]
    return [*found, found[8], (None, "a row without id", None, None, None, None, None, None), (None, texts[9], "bb", "s1", 3, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- exact dedup


def squeezed(t):
    return "".join(c for c in t or "" if c not in " \t\n\v\f\r")


def test_exact_dedup(docs, rows, nothing):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(squeezed(t), []).append((-len(t or ""), i is None, i, t))
    want = []
    for i, t, *_ in rows:
        g = sorted(groups[squeezed(t)], key=lambda x: (x[0], x[1], x[2] or 0))
        keep, size = g[0][2], g[0][0]
        want.append((i, keep, len(g), i == keep and -len(t or "") == size, hashlib.sha256(squeezed(t).encode()).hexdigest()))
    assert got(exact_dedup.decide(docs)) == sorted(want, key=repr)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(squeezed(r["text"]) for r in kept.collect()) == sorted(groups)
    assert exact_dedup.decide(nothing).count() == exact_dedup.keep_one(nothing).count() == 0


def test_exact_dedup_index_persists(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    where = f"file://{tmp_path}/index"
    first = exact_dedup.decide(make([(5, "a b"), (6, "c")]), exact_dedup.DigestIndex(spark, where, 3), "one")
    assert [r["kept"] for r in first.orderBy("doc_id").collect()] == [True, True]
    again = exact_dedup.DigestIndex(spark, where)  # opened anew, with its own number of buckets
    assert again.buckets == 3
    second = exact_dedup.decide(make([(1, "ab"), (2, "d"), (3, "d ")]), again, "two").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["keep_id"], r["kept"]) for r in second] == [(1, 5, False), (2, 3, False), (3, 3, True)]
    repeat = exact_dedup.decide(make([(1, "ab"), (2, "d"), (3, "d ")]), exact_dedup.DigestIndex(spark, where), "two").orderBy("doc_id").collect()
    assert [r["kept"] for r in repeat] == [False, False, True]


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.decide(docs)._jdf.queryExecution().toString() + license_scan.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_heavy_groups_join_whole(spark):
    from pyspark.sql import functions as F

    from corpusloom.llm.common import heavy_safe_join

    facts = spark.range(40_000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))).alias("k"), "id")
    groups = facts.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    out = heavy_safe_join(facts, groups, "k", "n", 40_000)
    assert out.count() == 40_000 and out.filter("k = 0 AND n = 13334").count() == 13334


# --- near duplicates


def shingles(t, n):
    w = [x for x in (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).replace("\v", " ").replace("\f", " ").split()]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = [(i, t, shingles(t, n)) for i, t, *_ in rows]
    label = list(range(len(sets)))
    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][2], sets[y][2]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                old, new = label[x], label[y]
                label = [new if v == old else v for v in label]
    out = []
    for k, (i, _, s) in enumerate(sets):
        ids = [sets[j][0] for j in range(len(sets)) if label[j] == label[k] and sets[j][0] is not None]
        own = i if not s else min(ids, default=None)
        out.append((i, len(s), own, i == own))
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates(docs, rows, n):
    assert got(near_dedup.near_duplicates(docs, words=n)) == brute_components(rows, n)


def test_near_keep_one_and_empty(docs, nothing):
    kept = near_dedup.keep_one(exact_dedup.keep_one(docs))
    assert kept.columns == docs.columns
    parts = brute_components([tuple(r) for r in exact_dedup.keep_one(docs).collect()], 5)
    assert kept.count() == sum(k for *_, k in parts)
    assert near_dedup.near_duplicates(nothing).count() == near_dedup.keep_one(nothing).count() == 0


def test_near_keep_one_of_null_and_repeated_ids(spark):
    rng = random.Random(13)
    w = prose(rng, 100).split()
    near = [" ".join([*w[:k], "changed", *w[k + 1 :]]) for k in range(3)]
    other = [" ".join(reversed(t.split())) for t in near]
    docs = spark.createDataFrame([*((None, t) for t in near), (5, other[0]), (5, other[1]), (7, other[2]), (8, "alone")], "doc_id bigint, text string")
    kept = got(near_dedup.keep_one(docs))
    assert len(kept) == 3 and sum(r[0] is None for r in kept) == 1 and sum(r[0] == 5 for r in kept) == 1 and (8, "alone") in kept


def test_chain_of_links_without_common_leader(spark):
    """Each text links to its neighbours only; the whole chain is one component."""
    rng = random.Random(3)
    w = [f"w{rng.random()}" for _ in range(400)]
    rows = [(100 - k, " ".join(w[k * 8 : k * 8 + 160])) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert got(near_dedup.near_duplicates(docs, words=4)) == brute_components(rows, 4)


def test_odd_sketch_estimates_high_similarity():
    import numpy as np

    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 1.0):
        both = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        n = int(4000 * (1 - share) / (1 + share))
        a, b = both[: 4000 - n], both[n:]
        sa, sb = near_dedup.odd_sketch(near_dedup.minhash(a)), near_dedup.odd_sketch(near_dedup.minhash(b))
        flips = sum(int(x).bit_count() for x in (sa ^ sb).view(np.uint64))
        m = near_dedup.SKETCH_BITS
        estimate = 1 + m / (4 * near_dedup.SAMPLES) * np.log(max(1e-9, 1 - 2 * flips / m))
        assert abs(estimate - len(set(a) & set(b)) / len(set(a) | set(b))) < 0.15
        assert flips <= near_dedup.most_flips()


def test_a_bucket_of_many_unlinked_classes_goes_by_cells(spark):
    """One bucket, thousands of classes of random sketches: only the planted pairs come out, each once."""
    import numpy as np

    from corpusloom.llm.common import Scratch

    rng = np.random.default_rng(5)
    n, words = 3000, near_dedup.SKETCH_BITS // 64
    sketch = rng.integers(-(1 << 63), 1 << 63, (n, words), dtype=np.int64)
    planted = {(int(a), int(b)) for a, b in rng.choice(n, (40, 2), replace=False)}
    for a, b in planted:
        sketch[b] = sketch[a]
        sketch[b][0] ^= 0xFFFF
    name = lambda i: i.to_bytes(16, "big")
    rows = [(7, bytearray(name(i)), bytearray(name(i)), 500 if i % 2 else 450, sketch[i].tolist()) for i in range(n)]
    same = [(8, bytearray(name(i)), bytearray(b"one component"), 500, sketch[0].tolist()) for i in range(20)]
    open_ = spark.createDataFrame([*rows, *same], "band bigint, digest binary, label binary, n bigint, sketch array<bigint>")
    out = near_dedup._within_buckets(open_, 80, Scratch(spark, "test-cells")).collect()
    assert sorted((int.from_bytes(r["a"], "big"), int.from_bytes(r["b"], "big")) for r in out) == sorted((min(p), max(p)) for p in planted)


# --- decontamination


def brute_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        last, row = row, [i]
        for j, y in enumerate(t, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[-1] + 1))
    return min(row)


def test_myers_against_dynamic_programming():
    rng = random.Random(2)
    for _ in range(300):
        p = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        t = "".join(rng.choice("abc") for _ in range(rng.randint(0, 90)))
        assert decontaminate.best_match(decontaminate.masks(p), len(p), t)[0] == brute_distance(p, t)


def test_decontamination(spark, rows, nothing):
    rng = random.Random(5)
    items = [(k, prose(rng, 24)) for k in range(4)] + [(4, None), (5, "too short"), (6, None), (7, "")]
    items.append((8, items[0][1].upper()))
    edited = items[1][1].replace("a", "", 1).replace("e", "oo", 1)
    broken = "".join(c + ("x" if i % 6 == 0 else "") for i, c in enumerate(items[2][1]))
    more = [(200, f"{prose(rng, 30)}, {items[0][1].title()}! {prose(rng, 9)}"), (201, f"{prose(rng, 9)} {edited} {prose(rng, 9)}"), (202, broken), (203, items[3][1]), (204, None), (205, ""), (203, items[3][1])]
    clean = [(r[0], r[1]) for r in rows]
    docs = spark.createDataFrame([*clean, *more], "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    out = decontaminate.find_passages(docs, bench)
    want = []
    for i, t in [*clean, *more]:
        for k, item in items:
            p = decontaminate.comparable(item)
            if len(p) >= decontaminate.MIN_CHARS and t:
                d = brute_distance(p, decontaminate.comparable(t)) if len(t) < 2000 else 99
                if d <= int(len(p) * decontaminate.EDIT_SHARE):
                    want.append((i, k, d))
    assert got(out.select("doc_id", "item_id", "distance")) == sorted(want, key=repr)
    assert {(i, k) for i, k, _ in want} == {(200, 0), (200, 8), (201, 1), (203, 3)}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.count() == len(clean) + 3 and kept.columns == docs.columns
    assert decontaminate.find_passages(nothing, bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == docs.count()


@pytest.mark.parametrize("kind", ["int", "smallint", "string", "double", "binary"])
def test_items_with_ids_of_any_type(spark, kind):
    rng = random.Random(8)
    item = prose(rng, 20)
    bench = spark.createDataFrame([("1", item), ("2", prose(rng, 20)), (None, item)], "item_id string, text string").select(F.col("item_id").cast(kind), "text")
    docs = spark.createDataFrame([("x", f"{prose(rng, 5)} {item} {'long ' * 50_000}"), ("y", prose(rng, 30))], "doc_id string, text string")
    out = decontaminate.find_passages(docs, bench)
    assert out.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert got(out.select("doc_id", F.col("item_id").cast("string"), "distance")) == [("x", "1", 0) if kind != "double" else ("x", "1.0", 0), ("x", None, 0)]
    assert decontaminate.find_passages(docs, bench.limit(0)).count() == 0


def test_short_items_are_searched_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is the capital of France?"), (2, "日本の首都はどこですか。"), (3, "Who am I?"), (4, "?!"), (5, "Où est-il?")], "item_id bigint, text string")
    rows = [(1, "Q: what is the  Capital of France -- Paris"), (2, "问题:日本の首都はどこですか東京です"), (3, "who am i"), (4, "Who am in there, awho am i"), (5, "awho am i; who am I"), (6, "?!"), (7, "what is the capitol of france"), (8, "what is the capital city of france")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = decontaminate.find_passages(docs, bench)
    assert got(out.select("doc_id", "item_id", "distance")) == [(1, 1, 0), (2, 2, 0), (3, 3, 0), (5, 3, 0), (7, 1, 1)]
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(docs, bench).collect()} == {4, 6, 8}


# --- mixing


def test_rake_meets_margins_and_scale_meets_tokens():
    import numpy as np

    rng = np.random.default_rng(0)
    codes = [np.repeat(np.arange(3), 4), np.tile(np.arange(4), 3)]
    tokens = rng.integers(10, 1000, 12).astype(float)
    shares = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])]
    w = mixing.rake(tokens, codes, shares)
    for c, s in zip(codes, shares):
        assert np.allclose(np.bincount(c, w), s, atol=1e-5)
    c = mixing.scale(w, tokens, 0.4 * tokens.sum())
    assert np.isclose((np.minimum(1, c * w / tokens) * tokens).sum(), 0.4 * tokens.sum())


def test_mixing(spark, docs, nothing):
    rng = random.Random(9)
    rows = [(i, prose(rng, 20), "aa" if i % 4 else "bb", f"s{i % 3}" if i % 10 else "hot") for i in range(4000)]
    big = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    given = {"lang": {"aa": 0.5, "bb": 0.5}}
    a, b = (got(mixing.cell_rates(big, given, share=0.4, max_cells=m).select("source", "lang", "topic", "rate")) for m in (1000, 1))
    assert len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) < 1e-3 for x, y in zip(a, b))
    drawn = mixing.draw(big, given, share=0.4)
    langs = {r["lang"]: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert abs(langs["aa"] / (langs["aa"] + langs["bb"]) - 0.5) < 0.05
    assert got(drawn) == got(mixing.draw(big.repartition(7), given, share=0.4))
    assert got(mixing.draw(big, given, share=0.4, max_cells=1)) == got(drawn) or abs(mixing.draw(big, given, share=0.4, max_cells=1).count() - drawn.count()) < 20
    assert mixing.draw(docs, share=1.0, temperature=1.0).count() == docs.count()
    assert mixing.draw(docs).columns == docs.columns and mixing.draw(nothing).count() == 0


def test_mixing_meets_targets_that_cells_cannot_give_at_the_wanted_share(spark):
    rng = random.Random(10)
    sizes = {("s0", "aa"): 2600, ("s0", "bb"): 120, ("s1", "aa"): 300, ("s1", "bb"): 300, ("s2", "aa"): 500, ("s2", "bb"): 180}
    rows = [(f"{s}{lang}{k}", prose(rng, 10), s, lang) for (s, lang), n in sizes.items() for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, lang string")
    cells = mixing.cell_rates(docs).collect()
    kept = sum(r["tokens"] * r["rate"] for r in cells)
    for m in ("source", "lang", "topic"):
        totals = {}
        for r in cells:
            totals[r[m]] = totals.get(r[m], 0) + r["tokens"]
        for k, share in mixing.targets(totals, None, mixing.TEMPERATURE if m != "topic" else 1.0).items():
            assert abs(sum(r["tokens"] * r["rate"] for r in cells if r[m] == k) / kept - share) < 1e-3
    assert 0.3 < kept / sum(r["tokens"] for r in cells) <= 0.8 and any(r["rate"] > 0.999 for r in cells)


def test_mixing_draws_by_the_rate_of_each_cell(spark):
    """The draw held against each row's own hash and its cell's rate, with nulls, empty and long texts, and repeated rows."""
    rng = random.Random(15)
    rows = [(i, prose(rng, rng.randint(1, 30)), rng.choice(["s0", "s1", None]), rng.choice(["aa", "bb", None])) for i in range(1500)]
    rows += [(2000, None, "s0", "aa"), (2001, "", "s1", "bb"), (2002, "w " * 50_000, "s1", "aa"), (None, "no id", "s0", "bb"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    rate = {(r["source"], r["lang"], r["topic"]): r["rate"] for r in mixing.cell_rates(docs).collect()}
    hashed = docs.select("doc_id", "text", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), F.xxhash64(F.lit(42), "doc_id", F.xxhash64("text")).alias("h")).collect()
    want = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in hashed if (r["h"] & (1 << 53) - 1) / float(1 << 53) < rate[r["source"], r["lang"], r["topic"]]]
    assert got(mixing.draw(docs)) == sorted(want, key=repr) and 100 < len(want) < 1500
    weights = [r[0] for r in docs.filter("doc_id >= 2000").orderBy("doc_id").select(mixing.token_weight(F.col("text"))).collect()]
    assert weights == [1, 1, 50_000]


# --- toxicity


def test_toxicity(spark, docs, nothing):
    import zlib

    rng = random.Random(4)
    bad = ["blarg", "snorf", "grumpf"]
    rows, labels = [], []
    for i in range(1200):
        w = prose(rng, 60).split()
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(60), rng.choice(bad))
            w.insert(3, "you")
        rows.append((i, " ".join(w)))
        labels.append((i, toxic if i % 50 else None))
    big = spark.createDataFrame([*rows, (5000, None), (5001, ""), (5002, "you gr*mpf sn0rf"), (3, rows[3][1])], "doc_id bigint, text string")
    marks = spark.createDataFrame(labels, "doc_id bigint, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score(big, marks).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for i, r in out.items())
    held = [(out[i]["predicted"], int(i % 6 == 0)) for i, _ in rows if out[i]["held_out"]]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert toxicity.score(docs, marks.limit(0)).filter("score = 0").count() == docs.count()
    assert toxicity.score(nothing, marks).count() == 0


def test_trees_and_isotonic():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(int)
    m = toxicity.Trees().fit(x, y, np.ones(800)).margins(x)
    assert ((m > 0) == y).mean() > 0.95
    points, shares = toxicity.isotonic(np.array([1.0, 2, 3, 4, 5, 5]), np.array([0, 1, 0, 1, 1, 0]), np.ones(6))
    assert (np.diff(points) >= 0).all() and (np.diff(shares) >= 0).all()
    assert np.interp(2.5, points, shares) == 0.5 and np.isclose(np.interp(5, points, shares), 2 / 3)


# --- token counts


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_prefix_counts_are_those_of_the_library(vocabulary):
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(vocabulary), prefix_tokens.PrefixCounter(vocabulary)
    count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'", "'re", "'s", "é", "中", "😀", "1", "23", "!", "?!", "the", " of", "<|endoftext|>", "<|end", "\t", "\x1c", "\x85", " ", "-" * 20, "\r\n"]
    for _ in range(400):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert own.prefixes(t) == [count(t[:i]) for i in range(len(t) + 1)]
        assert own.total(t) == count(t)
    long = prose(rng, 3000) + "x" * 5000
    assert own.total(long) == count(long) == own.prefixes(long)[-1]
    small = prefix_tokens.PrefixCounter(vocabulary, cache_pieces=10)
    assert small.total(long) == count(long)


def test_token_counts_of_many_texts_encode_each_piece_once(vocabulary, monkeypatch):
    from tokenizers import Tokenizer

    lib, rng = Tokenizer.from_file(vocabulary), random.Random(2)
    words = ["".join(rng.choice(["tion", "ä", "the", "er", "x"]) for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "'ll", ".\nA"]) for _ in range(60)) for _ in range(100)]
    odd = [None, "", " ", "a ", " a", "a  b", "  a", "a\n    b   ", "a\0  b", "a\n b", "\n", "a\n", "a \n", "a\n\nb c\u3000", "a <|endoftext|> b", "\u3000 \x85a\xa0b", "-" * 300, "x" * 3000]
    own = prefix_tokens.PrefixCounter(vocabulary, cache_pieces=10)
    encode, pieces = own.piece_prefixes, []
    monkeypatch.setattr(own, "piece_prefixes", lambda piece: pieces.append(piece) or encode(piece))
    own.vectors(pa.array(texts))
    # the pieces of texts, then those of their first words
    assert len(pieces) <= len({x for t in texts for x in own.findall(t)}) + 3 * len(texts)
    texts += odd
    rng.shuffle(texts)
    for size in (1, 500, 1 << 20):  # slices of a text, some texts and all
        monkeypatch.setattr(prefix_tokens, "SLICE_BYTES", size)
        n, steps = own.vectors(pa.array(["cut off", *texts])[1:])
        assert n.tolist() == [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
        assert list(zip(n.tolist(), steps.to_pylist())) == [own.vector(t) for t in texts]
    n, steps = own.vectors(pa.array([], pa.string()))
    assert len(n) == len(steps) == 0


def test_token_queries(docs, rows, nothing, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary)
    count = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert got(prefix_tokens.count(docs, vocabulary)) == sorted(((i, len((t or "").encode()), count(t), count(t) > 512) for i, t, *_ in rows), key=repr)
    store = prefix_tokens.write_store(docs, vocabulary, f"file://{tmp_path}/prefixes")
    assert got(prefix_tokens.over_limit(store)) == got(prefix_tokens.count(docs, vocabulary))
    cut = prefix_tokens.truncate(docs, store, 9).collect()
    assert len(cut) == len(rows) and all(r["n_tokens"] <= 9 and count(r["text"]) == r["n_tokens"] for r in cut)
    longest = {r["doc_id"]: r["end"] for r in prefix_tokens.longest_prefixes(store, 9).filter("doc_id IS NOT NULL").collect()}
    for i, t, *_ in rows[:12]:
        assert longest[i] == max(k for k in range(len(t or "") + 1) if k < 200 and count((t or "")[:k]) <= 9)
    assert prefix_tokens.write_store(nothing, vocabulary, f"file://{tmp_path}/none").count() == 0
    assert {r["doc_id"]: r["counts"][-1] for r in prefix_tokens.prefix_counts(docs, vocabulary).collect()}[9] == count("one")
    assert prefix_tokens.count(nothing, vocabulary).count() == 0


# --- repeated passages


def brute_removals(rows):
    first, words = {}, []
    for i, t, *_ in rows:
        w = (t or "").replace("\v", " ").split()
        words.append((i, w))
        for k in range(len(w) - 12) if i is not None else ():
            key = tuple(w[k : k + 13])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[k : k + 13])] < i:
                gone.update(range(k, k + 13))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_repeated_passages(docs, rows, nothing):
    out = substring_dedup.removals(docs).drop("ranges")
    assert got(out) == brute_removals(rows)
    assert sum(r[2] > 0 for r in brute_removals(rows)) >= 10
    cut = substring_dedup.remove_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert substring_dedup.removals(nothing).count() == substring_dedup.remove_repeats(nothing).count() == 0


def test_shards_parts_and_ways(docs, rows, monkeypatch):
    """Many small shards, each in parts and spread over tasks, find the same."""
    monkeypatch.setattr(substring_dedup, "SHARD_PHRASES", 3)
    monkeypatch.setattr(substring_dedup, "SHARD_PIECES", 2)
    assert got(substring_dedup.removals(docs).drop("ranges")) == brute_removals(rows)


# --- language


def test_language(spark, docs, nothing):
    rng = random.Random(6)
    kinds = {"xx": ["ka", "to", "mi", "ru"], "yy": ["schl", "acht", "ung", "ei"], "zz": ["oux", "elle", "ette", "ô"]}
    rows = []
    for i in range(900):
        lang = rng.choice(sorted(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(3)) for _ in range(rng.randint(2, 60))), lang if i % 9 else None))
    rows += [(5000, None, "xx"), (5001, "", "xx"), (5002, "123 !? 4", "yy"), (5003, rows[3][1], None), (None, rows[4][1], None)]
    big = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = lang_id.fit(big)
    out = lang_id.predict(big, model).collect()
    true = {i: lang for i, t, lang in rows[:900] if lang}
    right = [r["lang_pred"] == true[r["doc_id"]] for r in out if r["held_out"] and r["doc_id"] in true]
    assert sum(right) / len(right) > 0.97
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out if r["doc_id"] in (5000, 5001, 5002)}
    assert odd == dict.fromkeys((5000, 5001, 5002), ("und", 0.0))
    assert got(lang_id.predict(big.repartition(5))) == got(lang_id.predict(big, model))
    marks = spark.createDataFrame([(1, "\u2764\ufe0f"), (2, "\u0301\u0302 \u0941"), (3, "\u0661\u0662"), (4, "\U0001f600 \u200d")], "doc_id bigint, text string")
    assert {(r["lang_pred"], r["score"]) for r in lang_id.predict(marks, model).collect()} == {("und", 0.0)}
    clash = big.withColumns({"__lang_pred": F.lit(1), "__lang_score": F.lit("x"), "lang_pred": F.lit(None).cast("string"), "score": F.lit(2)})
    assert lang_id.confident(clash, 0.0, model).columns == clash.columns and lang_id.predict(clash, model).count() == big.count()
    kept = lang_id.confident(docs, 0.0, model)
    assert kept.columns == docs.columns and kept.count() == sum(any(c.isalpha() for c in r["text"] or "") for r in docs.collect())
    assert {r["lang_pred"] for r in lang_id.predict(docs, lang_id.KernelClassifier([], [])).collect()} == {"und"}
    assert lang_id.predict(nothing).count() == 0


def test_kernel_is_that_of_ngram_sets():
    def grams(t):
        t = " " + "".join(c if c.isalpha() else " " for c in t.lower()) + " "
        while "  " in t:
            t = t.replace("  ", " ")
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    a, b = "Hello, big World", "wörld of   hells"
    m = lang_id.KernelClassifier([a, b], ["x", "y"])
    ga, gb = grams(a), grams(b)
    assert abs(m.kernel([lang_id.ngrams(a)])[0][1] - len(ga & gb) / (len(ga) * len(gb)) ** 0.5) < 1e-6


# --- licences


def test_license_scan(spark, docs, nothing):
    mit = license_scan.LICENSES["MIT"]
    rows = [(1, mit), (2, mit.replace("(c) 2000 Somebody", "© 1999-2024 Some Body, Inc.").upper().replace("\n", "\r\n   ")), (3, mit + " extra"), (4, mit.replace("copy of this", "Copy, of this -")), (5, None), (6, ""), (7, "Licensed under the Apache Licence, Version 2.0"), (7, "Licensed under the Apache Licence, Version 2.0"), (8, "x" * 200_000)]
    out = got(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "license_id", "is_license"))
    assert out == sorted([(1, "MIT", True), (2, "MIT", True), (3, None, False), (4, "MIT", True), (5, None, False), (6, None, False), (7, "Apache-2.0-notice", True), (7, "Apache-2.0-notice", True), (8, None, False)], key=repr)
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(nothing).count() == 0


def test_long_licenses_by_digest(spark):
    """Whole public texts, as they stand, reflowed, and with other spellings and owners; a part or an addition is none."""
    from pathlib import Path

    where = Path("/usr/share/common-licenses")
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = {k: (where / v).read_text() for k, v in files.items() if (where / v).exists()}
    if not found:
        pytest.skip("no public licence texts on this machine")
    rows, want = [], []
    for i, (name, t) in enumerate(sorted(found.items())):
        rows += [(10 * i, t), (10 * i + 1, t.upper().replace("\n", "\r\n\t")), (10 * i + 2, "Copyright (c) 2024 Some Body\n\n" + t.replace(" license ", " licence ")), (10 * i + 3, t[: len(t) // 2]), (10 * i + 4, t + "\nand more")]
        want += [(10 * i, name), (10 * i + 1, name), (10 * i + 2, name), (10 * i + 3, None), (10 * i + 4, None)]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert got(out.select("doc_id", "license_id")) == sorted(want, key=repr)


def test_catalogue_has_no_two_ids_for_a_text(spark):
    known = license_scan.catalogue(spark)
    assert known.select("canonical_sha256").distinct().count() == known.count()


# --- WARC


@pytest.mark.parametrize("chunk", [200, 700, 1 << 20])
def test_warc_round_trip(spark, tmp_path, chunk):
    fake = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    big, small = "p" * 150 + "é中", "tiny"
    rows = [(9, "http://a/9", big), (2, "http://a/2", big), (5, None, big), (1, "http://a/ 1", small), (3, "http://a/3", small), (4, "u", None), (6, "u", ""), (7, "u", fake * 4), (8, "u", fake), (None, "u", big), (2, "http://a/2", big), (10, "u", "z" * 5000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id bigint, url string, html string, payload string").repartition(2)
    path = f"file://{tmp_path}/warc"
    warc.write_archives(pages, path)
    out = warc.read_archives(spark, path, chunk)
    want = []
    for i, _, html in rows:
        b = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None)
        again = len(b) >= 100 and i is not None and i > first
        want.append((i, "revisit" if again else "response", first if again else None, len(b), hashlib.sha256(b).hexdigest()))
    assert got(out.select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest")) == sorted(want, key=repr)
    assert out.filter("NOT intact").count() == 0
    assert {bytes(r["payload"]).decode() for r in out.filter("record_type = 'response'").collect()} == {h or "" for _, _, h in rows}
    assert warc.broken_chains(spark, path, chunk).count() == 0
    found = warc.candidates(spark, path, chunk)
    assert found.count() > out.count()  # magic inside of payloads was a candidate


@pytest.mark.parametrize("chunk", [1 << 20, warc.CHUNK_BYTES])
def test_warc_with_long_urls(spark, tmp_path, chunk):
    rows = [(i, "data:," + "x" * {3: 70_000, 5: 3_000_000}.get(i, 10), f"<p>{i}" + "y" * 300) for i in range(9)]
    path = f"file://{tmp_path}/long"
    warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    out = warc.read_archives(spark, path, chunk)
    assert sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in out.collect()) == rows
    assert warc.broken_chains(spark, path, chunk).count() == 0


def test_warc_empty_and_damaged(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0
    warc.write_archives(spark.createDataFrame([(i, "u", "y" * 300) for i in range(9)], "page_id bigint, url string, html string").coalesce(1), f"file://{tmp_path}/cut", min_revisit_bytes=1000)
    file = next((tmp_path / "cut").glob("part-*"))
    file.write_bytes(file.read_bytes()[:-700])
    for crc in (tmp_path / "cut").glob(".*.crc"):
        crc.unlink()
    assert warc.read_archives(spark, f"file://{tmp_path}/cut", 400).count() in (6, 7, 8)
    assert warc.broken_chains(spark, f"file://{tmp_path}/cut", 400).count() == 1

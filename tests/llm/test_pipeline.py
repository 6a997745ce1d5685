"""The pipeline against a brute-force version of its stages."""

import random

import corpus_pipeline
import pyarrow as pa
import pytest
from corpusloom.llm import decontaminate, lang_id, mixing
from corpusloom.shipping import BATCH_BYTES, BATCH_ROWS

from .test_operators import WORDS, prose, shingles, squeezed


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    other = [w[::-1] + "ü" for w in WORDS]
    bench = [(k, prose(rng, 15)) for k in range(3)]
    rows = []
    for i in range(160):
        words, lang = (WORDS, "aa") if i % 3 else (other, "bb")
        rows.append((i, prose(rng, 50, words), lang, f"s{i % 4}"))
    rows += [(200 + k, rows[k][1].replace(" ", "\n"), rows[k][2], "s0") for k in range(20)]
    rows += [(300 + k, rows[k][1] + " end", rows[k][2], "s1") for k in range(20, 30)]
    rows += [(400, f"{prose(rng, 20)} {bench[0][1]} {prose(rng, 20)}", "aa", "s2"), (401, None, "aa", "s2"), (402, "12 34", "aa", None), (403, "", None, "s1")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = lang_id.fit(docs)
    left = []
    for r in rows:
        (lang,), (score,) = model.predict([r[1]])
        if lang != "und" and score >= corpus_pipeline.MIN_LANGUAGE_SCORE:
            left.append(r)
    best = {}
    for r in left:
        k = squeezed(r[1])
        if k not in best or (-len(r[1]), r[0]) < (-len(best[k][1]), best[k][0]):
            best[k] = r
    left = sorted(best.values())
    label = {r[0]: r[0] for r in left}
    sets = {r[0]: shingles(r[1], 5) for r in left}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    left = [r for r in left if label[r[0]] == r[0]]
    finder = decontaminate.PassageFinder([decontaminate.comparable(t) for _, t in bench])
    left = [r for r in left if not finder.find(r[1])]
    want = mixing.draw(spark.createDataFrame([(*r, len(r[1])) for r in left], schema))

    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["doc_id"] for r in want.collect())
    assert not {400, 401, 402, 403} & {r["doc_id"] for r in out.collect()}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns, name


def test_language_stage_rejects_what_was_not_learned(spark, tmp_path):
    rng = random.Random(12)
    other = [w[::-1] + "ü" for w in WORDS]
    rows = [(i, prose(rng, 50, WORDS if i % 3 else other), "aa" if i % 3 else "bb") for i in range(200)]
    foreign = [
        "今天天气很好，我们一起去公园散步吧。孩子们在湖边放风筝。",
        "Сегодня хорошая погода, и мы пошли гулять в парк.",
        "الطقس جميل اليوم وذهبنا للتنزه في الحديقة",
        "Σήμερα ο καιρός είναι καλός και πήγαμε βόλτα στο πάρκο.",
        "Dzisiaj jest piękna pogoda, więc poszliśmy na spacer do parku. Dzieci bawiły się nad jeziorem.",
        "xq zvwy jhp qqx ywvz hjxp vvwq zzyx",
    ]
    unseen = [(1000 + k, t, None) for k, t in enumerate(foreign)]
    docs = spark.createDataFrame([*rows, *unseen], "doc_id bigint, text string, lang string")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, docs, str(tmp_path)).collect()}
    assert kept == {r[0] for r in rows}
    (_,), (score,) = lang_id.fit(docs).predict([foreign[1].replace(" ", "")])
    assert score < 0.05


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_run_by_itself_bounds_the_batches_of_python(spark, tmp_path, stage):
    spark.createDataFrame([(0, prose(random.Random(13), 30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    schema = "doc_id bigint, text string, lang string, source string"
    limits = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    before = [spark.conf.get(k) for k in limits]
    for k in limits:
        spark.conf.unset(k)
    try:
        dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame([(1, "a b c", "aa", "s0")], schema), str(tmp_path))
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"]) for b in batches)
        short = spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint, size bigint").collect()
        long = spark.range(0, 300, 1, 1).selectExpr("repeat('long text ', 10000) AS text").mapInArrow(sizes, "n bigint, size bigint").collect()
    finally:
        for k, v in zip(limits, before):
            spark.conf.set(k, v)
    assert sum(r["n"] for r in short) == 5000 and max(r["n"] for r in short) == BATCH_ROWS
    assert sum(r["n"] for r in long) == 300 and max(r["size"] for r in long) < BATCH_BYTES + 200_000


def test_rates_of_cells_need_no_python_on_executors(spark):
    schema = "doc_id bigint, text string, lang string, source string"
    docs = spark.createDataFrame([(i, f"word {'w ' * (i % 7)}", None if i % 5 == 0 else f"l{i % 3}", f"s{i % 2}") for i in range(60)], schema)
    rates = mixing.cell_rates(docs)
    assert "PythonRDD" not in rates._jdf.queryExecution().toRdd().toDebugString()
    assert rates.dtypes == [("source", "string"), ("lang", "string"), ("topic", "string"), ("docs", "bigint"), ("tokens", "bigint"), ("rate", "double")]
    assert sum(r["docs"] for r in rates.collect()) == 60 and rates.filter("lang IS NULL").count() > 0
    assert mixing.cell_rates(docs.limit(0)).collect() == []

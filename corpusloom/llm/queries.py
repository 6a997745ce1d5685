"""The queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, exact_dedup, lang_id, license_scan, mixing, near_dedup, prefix_tokens, substring_dedup, toxicity, warc
from corpusloom.llm.common import Scratch, read_table

TOKEN_LIMIT = 512


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Scratch(spark, 'op1').path}/archives"
    warc.write_archives(read_table(spark, sf_dir, "pages"), path)
    records = warc.read_archives(spark, path, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, payload_bytes >= 100 AND page_id > min(page_id) OVER (PARTITION BY payload_digest) AS again, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to
FROM f
"""


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)] END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)
), r AS (
  SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, l.y FROM r JOIN l ON l.x = r.u
), c AS (SELECT v, min(u) AS component_id FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.v = w.doc_id
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.draw(read_table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "source", "lang", mixing.topic_of(F.col("text")).alias("topic"), mixing.token_weight(F.col("text")).alias("n_words"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.predict(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    store = prefix_tokens.write_store(docs, public_tokenizers.path("byte_bpe_50k.json"), f"{Scratch(spark, 'op6').path}/prefixes")
    return prefix_tokens.over_limit(store, TOKEN_LIMIT)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.removals(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
m AS (SELECT win, min(doc_id) AS low FROM g GROUP BY win),
c AS (SELECT DISTINCT g.doc_id, unnest(range(g.i, g.i + 13)) AS i FROM g JOIN m ON g.win = m.win WHERE m.low < g.doc_id),
r AS (SELECT doc_id, list(i) AS gone FROM c GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [x FOR x, i IN ws IF NOT list_contains(gone, i)] END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN r USING (doc_id)
"""


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(read_table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS len
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def _op10_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.LICENSES.items())
    digests = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in license_scan.DIGESTS.items())
    return f"""
WITH known AS (SELECT license_id, sha256({license_scan.canonical_sql("text")}) AS h FROM (VALUES {known}) AS v(license_id, text) UNION ALL SELECT * FROM (VALUES {digests}) AS w(license_id, h)),
d AS (SELECT doc_id, sha256({license_scan.canonical_sql("text")}) AS canonical_sha256 FROM documents)
SELECT d.doc_id, d.canonical_sha256, known.license_id, known.license_id IS NOT NULL AS is_license
FROM d LEFT JOIN known ON known.h = d.canonical_sha256
"""


QUERIES = {
    "op1_warc": op1_warc,
    "op2_near_dedup": op2_near_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_toxicity": op5_toxicity,
    "op6_token_counts": op6_token_counts,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_license_scan": op10_license_scan,
}
SQL = {"op1_warc": OP1_SQL, "op2_near_dedup": OP2_SQL, "op7_substring_dedup": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op10_license_scan": _op10_sql()}

"""License scan by canonical digest (native).

A text is brought to a canonical form (copyright lines dropped, case folded,
equivalent spellings made one, everything but letters and digits turned into
single spaces), hashed, and looked up among the digests of known licences. The
whole text has to be the licence. The catalogue is a fixed list of a few rows, short
licences by their texts and long ones by their digests,
so it is broadcast; the texts are read once and nothing is shuffled.

Defined results: null, empty and letterless texts have the digest of the empty
form and match nothing; very long texts are hashed whole. Repeated rows each get their row. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import BROADCAST_ROWS
from corpusloom.llm.license_texts import DIGESTS, LICENSES

#: A line that says who holds the copyright, and a line that only reserves rights.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;>-]*((copyright[ \t]*)?(\(c\)|©)|copyright[ \t]+[0-9<\[{])[^\n]*"
RIGHTS_LINE = r"(^|\n)[ \t#*/;>-]*all rights reserved\.?[ \t\r]*(\n|$)"
NOT_WORD = r"[^\p{L}\p{N}]+"
#: Spellings that licence texts use for one another, in canonical words.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("favour", "favor"), ("organisation", "organization"),
    ("behaviour", "behavior"), ("authorised", "authorized"), ("fulfilment", "fulfillment"), ("per cent", "percent"), ("https ", "http "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    t = F.lower(F.coalesce(text, F.lit("")))
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, "\n"), RIGHTS_LINE, "\n")
    t = F.trim(F.regexp_replace(t, NOT_WORD, " "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def canonical_sql(text: str) -> str:
    """``canonical`` in DuckDB's SQL."""
    t = f"lower(coalesce({text}, ''))"
    for p in (COPYRIGHT_LINE, RIGHTS_LINE):
        t = f"regexp_replace({t}, '{p}', chr(10), 'g')"
    t = f"trim(regexp_replace({t}, '{NOT_WORD}', ' ', 'g'))"
    for a, b in SPELLINGS:
        t = f"replace({t}, '{a}', '{b}')"
    return t


def catalogue(spark, texts: dict[str, str] | None = None) -> DataFrame:
    """license_id and digest of each known licence text; of given ``texts`` or the built-in list."""
    rows = spark.createDataFrame(list((LICENSES if texts is None else texts).items()), "license_id string, text string")
    known = rows.select("license_id", F.sha2(canonical(F.col("text")), 256).alias("canonical_sha256"))
    return known if texts is not None else known.unionByName(spark.createDataFrame(list(DIGESTS.items()), "license_id string, canonical_sha256 string"))


def scan(docs: DataFrame, texts: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, canonical_sha256, license_id (null: none) and is_license of every row."""
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("canonical_sha256"))
    known = catalogue(docs.sparkSession, texts)
    # a catalogue is a list in the driver; one of more than BROADCAST_ROWS rows of a name and a digest is left to the planner
    few = texts is None or len(texts) <= BROADCAST_ROWS
    out = keyed.join(F.broadcast(known) if few else known, "canonical_sha256", "left")
    return out.select("doc_id", "canonical_sha256", "license_id", F.col("license_id").isNotNull().alias("is_license"))

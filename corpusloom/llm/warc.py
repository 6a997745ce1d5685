r"""WARC archives: writing, and reading by boundary-chain verification.

Writing is native: a record is a string, and records are written as text files
whose line separator is the blank line that ends a WARC record, under Spark's own
commit protocol. Of pages with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, the
smallest id becomes the response; the others become revisit records, which
refer to it and hold no payload. Digests, not payloads, are grouped for that.

Reading splits files into chunks that tasks search for the magic of a record at the
start of the file or after a blank line. Such a place is only a candidate, since a payload
may hold the same bytes. A candidate's header gives its successor's offset. Within a chunk
every candidate is followed to the first offset beyond the chunk; between chunks, pointer
jumping from the start of the file doubles its reach in each round, and keeps the offsets
that are reachable. So each chunk gets its one true entry, from which its records are
read in turn; candidates inside payloads are never reached.

Defined results: a null payload is empty. A null id is written as ``null``, never
referred to, and always a response. Rows that repeat the smallest id are all responses.
Control characters and blanks in a URL are written as %20, a null URL as the record's own
name. Payloads and headers of any length are read
whole; a record without a type has a null one. Empty files and tables give no records. A chain that breaks (a damaged or cut
file) ends there, and ``broken_chains`` names the file and offset. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, filter_by_keys, heavy_safe_join

MIN_REVISIT_BYTES = 100
CHUNK_BYTES = 8 << 20
#: What is read at once while a header is looked for.
_BUFFER = 1 << 20
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"
_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?=\r\n)", re.I)


def _http_head(n_bytes: Column) -> Column:
    return F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), n_bytes.cast("string"), F.lit(_END.decode()))


def _name(page_id: Column) -> Column:
    return F.concat(F.lit("urn:x-page:"), F.coalesce(page_id.cast("string"), F.lit("null")))


def _record(kind: str, payload: Column | None, refers_to: Column | None, date: str) -> Column:
    """A whole record but for the blank line after it, from the columns page_id, url, n_bytes and digest."""
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20"), _name(F.col("page_id")))
    head = [F.lit(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <"), _name(F.col("page_id")), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url]
    head += [F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest")]
    block = _http_head(F.col("n_bytes"))
    if refers_to is not None:
        head += [F.lit("\r\nWARC-Refers-To: <"), _name(refers_to), F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    if payload is not None:
        block = F.concat(block, payload)
    head += [F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(_END.decode())]
    return F.concat(*head, block)


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write a record for every row of ``pages`` into files under ``path``."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc-write")
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    full = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    full = full.withColumns({"n_bytes": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})
    rows = scratch.write("rows", full.filter(F.col("n_bytes") >= min_revisit_bytes).select("page_id", "url", "n_bytes", "digest"))
    groups = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = scratch.write("groups", groups)
    revisits = scratch.write("revisits", heavy_safe_join(rows, groups, "digest", "copies", rows.count()).filter("page_id > first"))
    responses = filter_by_keys(full, revisits.select("page_id", "digest").distinct(), ["page_id", "digest"], "left_anti")
    records = responses.select(_record("response", F.col("payload"), None, date).alias("value")).unionByName(revisits.select(_record("revisit", None, F.col("first"), date).alias("value")))
    records.write.option("lineSep", _END.decode()).text(path)
    scratch.drop("rows", "groups", "revisits")


class _File:
    """A file of any file system, read by offset."""

    def __init__(self, path: str):
        uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        uri = re.sub(r"^s3[an]://", "s3://", uri)
        fs, inner = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(inner)

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def header(self, at: int) -> bytes:
        """The header from an offset to the blank line after it; empty if there is none."""
        size = 4096
        while True:
            data = self.read(at, size)
            if not _MAGIC.match(data):
                return b""
            end = data.find(_END)
            if end >= 0:
                return data[: end + 4]
            if len(data) < size:
                return b""
            size *= 4  # a header may hold a URL of any length


def successor(at: int, header: bytes, length: int) -> int | None:
    """Where the record after this one begins (at the file's end for the last), or None."""
    found = _LENGTH.search(header)
    after = at + len(header) + int(found[1]) + 4 if found else length + 1
    return after if after <= length else None


def chunk_candidates(file: _File, start: int, end: int, length: int) -> list[tuple[int, int, int]]:
    """(offset, successor, first offset beyond the chunk) of each candidate of a chunk.

    A candidate whose chain breaks within the chunk has the offset of the break, which is below the chunk's end.
    """
    found: dict[int, int] = {}
    at = start
    while at < end:
        lead = min(4, at)  # a magic counts only after a blank line
        n = min(_BUFFER, end - at)
        data = file.read(at - lead, lead + n + 9)
        for m in _MAGIC.finditer(data):
            here = at - lead + m.start()
            if here < at or here >= at + n or (here and data[max(0, m.start() - 4) : m.start()] != _END):
                continue
            stop = data.find(_END, m.start())
            header = data[m.start() : stop + 4] if stop >= 0 else file.header(here)
            after = successor(here, header, length)
            if after is not None:
                found[here] = after
        at += n
    out: dict[int, tuple[int, int]] = {}
    for here in sorted(found, reverse=True):
        after = found[here]
        out[here] = (after, out[after][1] if after in out else after)
    return [(here, *x) for here, x in out.items()]


def read_records(file: _File, at: int, end: int, length: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, block) of the records from a true offset up to the chunk's end."""
    while at < end:
        header = file.header(at)
        after = successor(at, header, length)
        if after is None:
            return
        fields = dict(line.split(":", 1) for line in header.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
        begin = at + len(header)
        yield at, {k.strip().lower(): v.strip() for k, v in fields.items()}, file.read(begin, after - 4 - begin)
        at = after


def _chunks(spark: SparkSession, path: str, chunk_bytes: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "length").filter("length > 0")
    chunks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(chunk_bytes).cast("bigint"))).alias("start"))
    return chunks.select("path", "length", "start", F.least(F.col("start") + chunk_bytes, "length").alias("end"))


def candidates(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, length, offset, successor and beyond of every candidate, true or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                found = chunk_candidates(_File(r["path"]), r["start"], r["end"], r["length"])
                cols = zip(*found) if found else ((), (), ())
                same = [pa.array([r["path"]] * len(found), pa.string()), pa.array([r["length"]] * len(found), pa.int64())]
                yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, pa.int64()) for c in cols)], names=["path", "length", "offset", "successor", "beyond"])

    chunks = _chunks(spark, path, chunk_bytes)
    n = max(1, chunks.count())
    return chunks.repartition(n, "path", "start").mapInArrow(run, "path string, length bigint, offset bigint, successor bigint, beyond bigint")


def chunk_entries(found: DataFrame, scratch: Scratch, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path, length and offset of each chunk's first record: what pointer jumping reaches from offset 0."""
    targets = found.select("path", F.col("beyond").alias("offset")).distinct()
    nodes = found.filter("offset = 0").unionByName(found.filter("offset > 0").join(targets, ["path", "offset"], "left_semi"))
    jumps = scratch.write("jumps-0", nodes.select("path", "offset", F.col("beyond").alias("to")))
    reached = scratch.write("reached-0", nodes.filter("offset = 0").select("path", "offset"))
    longest = found.agg(F.max("length")).first()[0] or 0
    rounds = math.ceil(math.log2(max(2, math.ceil(longest / chunk_bytes))))
    for k in range(1, rounds + 1):
        further = reached.join(jumps, ["path", "offset"]).select("path", F.col("to").alias("offset"))
        reached = scratch.write(f"reached-{k}", reached.union(further).distinct())
        if k < rounds:
            after = jumps.select("path", F.col("offset").alias("to"), F.col("to").alias("twice"))
            jumps = scratch.write(f"jumps-{k}", jumps.join(after, ["path", "to"], "left").select("path", "offset", F.coalesce("twice", "to").alias("to")))
    lengths = found.select("path", "length").distinct()
    return reached.join(lengths, "path").filter("offset < length").select("path", "length", "offset")


def read_archives(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_payload: bool = True) -> DataFrame:
    """A row for each true record: path, offset, page_id, url, record_type, refers_to, payload_bytes, payload_digest, intact and payload.

    payload_bytes and payload_digest are those of the full payload; of a response they are taken
    from the payload itself, and ``intact`` says whether its header has the same digest. A revisit
    has no payload of its own and states them. Without ``with_payload`` the payload column is null.
    """
    scratch = Scratch(spark, "warc-read")
    entries = scratch.write("entries", chunk_entries(scratch.write("candidates", candidates(spark, path, chunk_bytes)), scratch, chunk_bytes))
    names = ["path", "offset", "page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact", "payload"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def parsed(path: str, at: int, fields: dict[str, str], block: bytes) -> tuple:
        head, _, payload = block.partition(_END)
        stated = fields.get("warc-payload-digest", "").removeprefix("sha256:")
        if fields.get("warc-type") == "revisit":
            length = re.search(rb"(?i)content-length:[ \t]*([0-9]+)", head)
            digest, size, intact, payload = stated, int(length[1]) if length else None, True, None
        else:
            digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
            intact = digest == stated
        return path, at, page_number(fields.get("warc-record-id")), fields.get("warc-target-uri"), fields.get("warc-type"), page_number(fields.get("warc-refers-to")), size, digest, intact, payload if with_payload else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                end = min(r["length"], (r["offset"] // chunk_bytes + 1) * chunk_bytes)
                rows, held = [], 0
                for at, fields, block in read_records(_File(r["path"]), r["offset"], end, r["length"]):
                    rows.append(parsed(r["path"], at, fields, block))
                    held += len(block) + len(fields.get("warc-target-uri", ""))
                    if held > _BUFFER * 4:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows) if rows else ([],) * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    schema = "path string, offset bigint, page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, intact boolean, payload binary"
    n = max(1, entries.count())
    return entries.repartition(n, "path", "offset").mapInArrow(run, schema)


def page_number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


def broken_chains(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """path and offset at which a file's chain ends before the file does."""
    scratch = Scratch(spark, "warc-broken")
    found = scratch.write("candidates", candidates(spark, path, chunk_bytes))
    files = _chunks(spark, path, chunk_bytes).select("path", "length").distinct()
    entries = chunk_entries(found, scratch, chunk_bytes).select("path", "offset")
    last = entries.join(found, ["path", "offset"], "left").groupBy("path").agg(F.max(F.coalesce("beyond", "offset")).alias("offset"))
    return files.join(last, "path", "left").select("path", "length", F.coalesce("offset", F.lit(0).cast("bigint")).alias("offset")).filter("offset < length").select("path", "offset")

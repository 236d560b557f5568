"""WARC archives whose records are compressed one by one with a shared Zstandard dictionary.

An archive is a series of frames: a skippable frame (magic 5D 2A 4D 18) that holds the dictionary, then one
Zstandard frame per record. Spark's text writer puts an archive's bytes as one row, a file for each; its separator is
an empty skippable frame, which every Zstandard reader passes over. So archives are written with the task commit of
Spark's writers, on any store that Spark can reach.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, trimmed

DICT_MAGIC = 0x184D2A5D
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
DICT_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_MAX_BYTES = 1000, 64 << 10
MIN_REVISIT_BYTES = 100
#: Payload per task, about: small partitions share a task. Compressed bytes at which a task begins another archive.
TASK_BYTES, ARCHIVE_BYTES = 8 << 20, 32 << 20
DATE = "2024-01-01T00:00:00Z"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _field(value: str) -> str:
    """A header's value on one line; other characters than printable ASCII are percent-encoded."""
    return "".join(c if " " <= c <= "~" and c != "%" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response, or a revisit without payload if first, the id of the page it equals, is given."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_field(url)}")
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += [f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """A record's fields, checked against its lengths and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    at = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(at["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length differs from its header")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.startswith(b"Content-Length:"))
    digest, kind = at["WARC-Payload-Digest"].removeprefix("sha256:"), at["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").rstrip(">")) else None
    return {"page_id": number(at["WARC-Record-ID"]), "url": at.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": number(at["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def train(samples: list[bytes]) -> bytes:
    """A dictionary from records: trained, or of their plain content where there are too few to train on."""
    if not samples:
        return b""
    try:
        return zstd.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


def _dictionary(data: bytes) -> zstd.ZstdCompressionDict | None:
    return zstd.ZstdCompressionDict(data) if data else None


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, by the dictionary in its first frame."""
    at, reader, view = 0, None, memoryview(data)
    while at < len(data):
        magic, n = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            if at == 0 and magic == DICT_MAGIC:
                reader = zstd.ZstdDecompressor(dict_data=_dictionary(data[8 : 8 + n])) if n else zstd.ZstdDecompressor()
            at += 8 + n
            continue
        if reader is None:
            raise ValueError("an archive starts with its dictionary")
        end, last = at + zstd.frame_header_size(view[at : at + 18]), 0
        while not last:  # from block to block, to the frame's end
            block = int.from_bytes(view[end : end + 3], "little")
            last, kind = block & 1, block >> 1 & 3
            end += 3 + (1 if kind == 1 else block >> 3)
        end += 4 * zstd.get_frame_parameters(view[at : at + 18]).has_checksum
        yield reader.decompress(view[at:end])
        at = end


def _packer(dictionary: bytes, most: int):
    """Archives of most bytes, or of one record more than that; each row is a whole one."""
    start = struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = zstd.ZstdCompressor(level=3, dict_data=_dictionary(dictionary), write_checksum=True) if dictionary else zstd.ZstdCompressor(level=3, write_checksum=True)
        held, size = [start], 0
        for b in batches:
            for page_id, url, payload, digest, same in zip(*(c.to_pylist() for c in b.columns)):
                held.append(made.compress(record(page_id, url, payload, digest, same)))
                size += len(held[-1])
                if size >= most:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [start], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    for b in batches:
        for content in b["content"]:
            rows, size = [], 0
            for data in frames(content.as_py()):
                rows.append(parse(data))
                size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record per row to the archives in the folder path; a task begins another archive when one has
    archive_bytes, so that readers, which take an archive whole, need memory for that much and one record.

    The payload is the body in UTF-8; a null body is empty. Of rows with equal payloads of at least
    MIN_REVISIT_BYTES, those with the smallest id are responses and the others, also those with a null id, revisit it;
    where all ids are null all are responses. Null ids and urls are written as such. Extra columns are ignored; an
    empty table gives no archive.

    The dictionary is trained on the records of at most SAMPLE_RECORDS pages of up to SAMPLE_MAX_BYTES each, those with
    the smallest hashes; it only changes sizes. The smallest ids per digest are pre-aggregated without payloads.
    Where their table isn't small, payloads are shuffled once, by digest, and a digest that many pages share is
    split by the adaptive skew join.
    """
    spark = pages.sparkSession
    rows = pages.select(pages[id_col].cast("long").alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(pages[body_col].cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("copy_key", F.when(F.octet_length("payload") >= MIN_REVISIT_BYTES, F.col("digest")))
    firsts = rows.where("copy_key is not null").groupBy("copy_key").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("payload")), F.lit(0))).first()
    share, chance = min(1.0, 2 * SAMPLE_RECORDS / max(1, n)), F.xxhash64("id", "url", "digest")
    some = rows.where((F.octet_length("payload") <= SAMPLE_MAX_BYTES) & (F.pmod(chance, F.lit(1 << 30)) < round(share * (1 << 30))))
    sample = some.orderBy(F.pmod(chance, F.lit(1 << 30)), "id", "digest").limit(SAMPLE_RECORDS)  # rows without ids and urls share a hash
    dictionary = train([record(r["id"], r["url"], bytes(r["payload"]), r["digest"], None) for r in sample.collect()])
    # one more key than was grouped by: the join then shuffles both sides, so that a hot digest can be split
    start = F.substring("copy_key", 1, 8).alias("start")
    rows = rows.select("*", start).join(firsts.select("*", start), ["copy_key", "start"], "left")
    rows = rows.select("id", "url", "payload", "digest", F.when(F.coalesce(F.col("id") != F.col("first"), F.lit(True)), F.col("first")).alias("first"))
    rows = rows.coalesce(size // TASK_BYTES + 1)  # merges small partitions, moves nothing
    out = rows.mapInArrow(trimmed(_packer(dictionary, archive_bytes)), "archive binary").select(F.col("archive").cast("string"))
    out.write.option("lineSep", SEPARATOR.decode("ascii")).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of the archives in a folder: page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload (null for revisits). Lengths and digests are checked. A task takes an archive whole: write_archives bounds
    its size. An archive that doesn't begin with its dictionary's frame, or is cut short, is an error."""
    return spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(path).select("content").mapInArrow(trimmed(_unpack), READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""

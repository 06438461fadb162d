"""WARC archives: one gzip member a record, written by Spark and read back sequentially.

Writing: rows become members (headers, payload, digests) in the tasks that hold them, and Spark's
text writer puts them into files on any file system it can write. The writer ends every row with
a separator; every member ends with a zero byte (the high byte of the uncompressed size, see
``member``), so that byte is cut off and the separator is that byte: files are plain ``.warc.gz`` content.

Reading: every archive is one row of bytes, which the size of files bounds; it is decompressed piece by piece,
records are framed by their Content-Length, and digests are verified.

Sizes: a task counts the bytes that it has put into a file and begins the next one when the following record
would pass the bound, so a file is larger than that only if it holds a single record.

Deduplication: of records with equal payloads of ``least`` bytes or more, the one of the largest id
is the response, others are revisits that refer to it. Equal are payloads of equal length, SHA-1 and SHA-256.

Defined results: a null payload is an empty one; records with a null id are responses; rows that repeat
the largest id of a payload are responses each; ids may be of any type that can be read from its text, and are compared as that
type; an empty table gives no archive and no record.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from typing import Any
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.scratch import Scratch

CHUNK = 1 << 16
HELD = 8_000_000
#: equal payloads that one task looks at
EQUAL = 50_000
RECORD = "page_id string, url string, record_type string, refers_to string, payload_bytes long, payload_digest string, payload binary, verified boolean"


def member(data: bytes, level: int = 3) -> bytes:
    """A gzip member, or two, that end with a zero byte.

    The last byte of a member is the highest of its uncompressed size. For a record of 16 MB or
    more it may differ from zero; an empty member then follows, which adds no data.
    """
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        out += packer.compress(b"") + packer.flush()
    return out


def _urn(page_id: object) -> str:
    return "<urn:x-none>" if page_id is None else f"<urn:x-page:{quote(str(page_id), safe='')}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    b32 = lambda x: base64.b32encode(x).decode()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Target-URI: {' '.join((url or '').split())}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{b32(bytes.fromhex(digest))}",
        f"WARC-Block-Digest: sha1:{b32(hashlib.sha1(block).digest())}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000, per_file: int = 4000, file_bytes: int = 1 << 26) -> None:
    """Writes a record a row below ``path``; a file holds at most ``per_file`` records and ``file_bytes`` bytes, or one record.

    Files are numbered by task and stand in a folder each, ``file=task-number``.
    """
    payload = F.coalesce(F.col(html_col).cast("string").cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    scratch = Scratch(pages.sparkSession, "warc")
    keys = scratch.keep(rows.select("page_id", F.sha1("payload").alias("digest"), F.sha2("payload", 256).alias("sha256"), F.octet_length("payload").alias("n")), "keys")
    # only payloads that occur twice need a look: a narrow table, combined before its shuffle
    same = ["digest", "sha256", "n"]
    large = keys.where((F.col("n") >= least) & F.col("page_id").isNotNull())
    twice = large.groupBy(*same).agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("low"), F.count(F.lit(1)).alias("rows")).where("low < refers_to")
    twice = scratch.keep(twice.withColumn("salts", F.ceil(F.col("rows") / EQUAL).cast("int")), "twice")
    # a payload that a third of all pages have is dealt to as many tasks as it asks for; such payloads are few
    hot = twice.where("salts > 1").select(*same, "salts")
    large = large.join(hot, same, "left").withColumn("salt", F.pmod(F.xxhash64("page_id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    spread = twice.select(*same, "refers_to", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    again = large.join(spread, [*same, "salt"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    rows = rows.withColumn("digest", F.sha1("payload")).join(again, ["page_id", "digest"], "left")
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, records, size = TaskContext.get().partitionId(), 0, 0, 0

        def table(made: list[bytes], files: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array(files, pa.string())], ["value", "file"])

        for batch in batches:
            made, files, held = [], [], 0
            for at in range(batch.num_rows):  # one page at a time: it may be very long
                data = member(record(*(c[0].as_py() for c in batch.slice(at, 1).columns)))
                if records and (records == per_file or size + len(data) > file_bytes):
                    number, records, size = number + 1, 0, 0
                records, size = records + 1, size + len(data)
                made.append(data[:-1])
                files.append(f"{task:06}-{number:06}")
                held += len(data)
                if held >= HELD:
                    yield table(made, files)
                    made, files, held = [], [], 0
            if made:
                yield table(made, files)

    members = rows.mapInArrow(run, "value binary, file string").select(F.col("value").cast("string").alias("value"), "file")  # the bytes as they are
    members.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path)
    scratch.drop("keys", "twice")


def members_of(archive: bytes) -> Iterator[bytes]:
    """Uncompressed content of each gzip member, decompressed piece by piece."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            if at >= len(view):
                raise ValueError("an archive ends within a member")
            parts.append(unpacker.decompress(view[at : at + CHUNK]))
            at += min(CHUNK, len(view) - at)
        at -= len(unpacker.unused_data)
        yield b"".join(parts)


def parse_record(data: bytes) -> dict[str, Any]:
    """Headers (lower-case names) and the block, framed by Content-Length."""
    end = data.index(b"\r\n\r\n")
    version, *lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    n, start = int(head["content-length"]), end + 4
    block = data[start : start + n]
    if len(block) != n or data[start + n :] != b"\r\n\r\n":
        raise ValueError("a record's Content-Length doesn't fit it")
    return head | {"block": block}


def _page(urn: str | None) -> str | None:
    start = "<urn:x-page:"
    return unquote(urn[len(start) : -1]) if urn and urn.startswith(start) else None


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, id_type: str = "long") -> DataFrame:
    """Every record: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload, verified; ids as ``id_type``, null where they can't be read so."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("verified", pa.bool_())])
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for data in members_of(content.as_py()):
                    if not data:
                        continue
                    x = parse_record(data)
                    block, kind = x["block"], x["warc-type"]
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    digest = base64.b32decode(x["warc-payload-digest"].removeprefix("sha1:"))
                    good = base64.b32decode(x["warc-block-digest"].removeprefix("sha1:")) == hashlib.sha1(block).digest()
                    if kind == "response":
                        good = good and digest == hashlib.sha1(payload).digest() and len(payload) == int(x["x-payload-length"])
                    own = payload if kind == "response" and with_payload else None
                    rows.append((_page(x["warc-record-id"]), x["warc-target-uri"], kind, _page(x.get("warc-refers-to")), int(x["x-payload-length"]), digest.hex(), own, good))
                    size += len(data)
                    if size >= HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, RECORD).withColumns({c: F.col(c).try_cast(id_type) for c in ("page_id", "refers_to")})

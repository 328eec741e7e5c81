"""WARC archives compressed with a Zstandard dictionary.

A dictionary is trained on a bounded sample of response records as they are
archived, embedded in a skippable frame at the head of each archive, and every
record is a frame of its own.  Records whose payload was archived before are revisits that carry
no payload and refer to the response with the smallest page id.

Archives are written by the tasks under names of their attempts; a manifest
that Spark commits lists those of the attempts that count, so a task that runs
twice or again leaves files that nobody reads but neither loses nor doubles a
record.

Edge cases: a null html is an empty payload; a null url leaves the target out;
control characters in a url are percent-encoded; rows that repeat a page id
are records of their own, all responses if the id is the smallest; a row
without a page id is never what others refer to; a very long payload is one
record, held in memory by its task; an empty table gives no archives and no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import HOT_SHARE
from .shared import fresh_path, settle

#: Payloads of fewer bytes are always archived whole.
REVISIT_BYTES = 100
#: Records of different payloads in the training sample (the first by their digests), bytes of each that are used, size of the dictionary.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 600, 16_384, 65_536
#: Windows, spread evenly from head to end, that a longer payload is read in.
WINDOWS = 4
#: Compressed bytes after which a new archive begins.
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def with_revisits(pages: DataFrame, least_bytes: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, first: the page that holds the payload where the row is a revisit, else null."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.select("page_id", "digest", F.octet_length("payload").alias("size"))
    firsts = narrow.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = settle(firsts, "firsts")
    # the copies of a page that many rows have stay where they lie; all others meet by their digest
    limit = max(100, rows.count() * HOT_SHARE)
    hot = F.broadcast(firsts.where(F.col("n") > limit).select("digest", F.col("least").alias("hot_least")))  # 1 / HOT_SHARE rows at most
    marked = rows.join(hot, "digest", "left")
    cold = firsts.where(F.col("n") <= limit).select("digest", "least")
    joined = marked.where("hot_least is null").drop("hot_least").join(cold, "digest", "left").unionByName(marked.where("hot_least is not null").withColumnRenamed("hot_least", "least"))
    revisit = F.col("least").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("least")))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("least")).alias("first"))


def train_dictionary(pages: DataFrame, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from the response records of at most ``records`` different payloads; empty where there is too little to learn from.

    A record is taken whole, or, where its payload is longer than SAMPLE_BYTES,
    with its headers and windows of the payload of that many bytes in all.
    """
    rows = pages.where((F.length("html") > 0) & F.col("page_id").isNotNull()).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    digest = F.sha2("html", 256)
    # ids first: each partition offers the driver its first by digest, which must not be whole payloads
    ids = [r.page_id for r in rows.groupBy(digest.alias("digest")).agg(F.min("page_id").alias("page_id")).orderBy("digest").limit(records).collect()]
    n, width = F.length("html"), SAMPLE_BYTES // WINDOWS  # a window of so many characters has four times as many bytes at most
    at = [F.floor((n - width) * k / (WINDOWS - 1)).cast("int") + 1 for k in range(WINDOWS)]
    parts = F.when(F.octet_length("html") <= SAMPLE_BYTES, F.array("html")).otherwise(F.array(*[F.substring(F.col("html"), x, F.lit(width)) for x in at]))
    least = F.min(F.struct("page_id", F.coalesce("url", F.lit("")).alias("told"), "url", "parts")).alias("r")  # of rows that share an id, one and the same
    chosen = rows.where(F.col("page_id").isin(ids)).select(digest.alias("digest"), "page_id", "url", parts.alias("parts")).groupBy("digest").agg(least).select("digest", "r.*").orderBy("digest").limit(records)
    sample = []
    for r in chosen.collect() if ids else []:
        first, *others = (x.encode() for x in r.parts)
        sample += [record(r.page_id, r.url, first, r.digest, None), *others]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, sample)) // 8), sample).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def target(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record; a revisit of page ``first`` unless that is None."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {target(url)}")
    if first is not None:
        head += [f"WARC-Refers-To: <urn:page:{first}>", f"WARC-Profile: {PROFILE}"]
    block = HTTP + (payload if first is None else b"")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; a response's payload is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    size = int(fields["Content-Length"])
    if not first.startswith("WARC/") or len(rest) != size + 4:
        raise ValueError("not a whole record")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    digest, length = fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["WARC-Payload-Length"])
    if fields["WARC-Type"] == "response":
        digest, told = hashlib.sha256(payload).hexdigest(), digest
        if digest != told or len(payload) != length:
            raise ValueError("payload differs from its digest")
        length = len(payload)
    number = lambda s: int(s) if (s := s.removeprefix("<urn:page:").removesuffix(">")) else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": digest, "record_type": fields["WARC-Type"],
        "refers_to": number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload,
    }


def write_archives(records: DataFrame, dictionary: bytes, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of each partition to archives in the folder; the manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        task = TaskContext.get()
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_content_size=True, write_checksum=True)
        out, at, count, number = None, 0, 0, 0
        temp = f"{base}/.attempt-{task.taskAttemptId()}"

        def close() -> pa.RecordBatch:
            nonlocal out, at, count, number
            out.close()
            path = f"{base}/part-{task.partitionId():05d}-{number:05d}-attempt-{task.taskAttemptId()}.warc.zst"
            system.move(temp, path)  # nobody else has this name
            row = pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [at]})
            out, at, count, number = None, 0, 0, number + 1
            return row

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out = system.open_output_stream(temp, compression=None)
                    head = struct.pack("<II", SKIPPABLE, len(dictionary)) + dictionary if dictionary else b""
                    out.write(head)
                    at = len(head)
                frame = packer.compress(record(*row))
                out.write(frame)
                at, count = at + len(frame), count + 1
                if at >= archive_bytes:
                    yield close()
        if out is not None:
            yield close()

    path = f"{folder}-manifest"
    records.mapInArrow(run, "path string, records long, bytes long").write.mode("overwrite").parquet(path)
    return records.sparkSession.read.schema("path string, records long, bytes long").parquet(path)


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an archive, read front to back."""
    buf = stream.read(chunk)
    zdict = None
    if len(buf) >= 8 and struct.unpack("<I", buf[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", buf[4:8])[0]
        while len(buf) < 8 + size and (more := stream.read(8 + size - len(buf))):
            buf += more
        zdict, buf = zstandard.ZstdCompressionDict(buf[8 : 8 + size]), buf[8 + size :]
    unpacker = zstandard.ZstdDecompressor(dict_data=zdict)
    while buf or (buf := stream.read(chunk)):
        one = unpacker.decompressobj()
        parts = [one.decompress(buf)]
        while not one.eof:
            if not (buf := stream.read(chunk)):
                raise ValueError("archive cut short")
            parts.append(one.decompress(buf))
        buf = one.unused_data
        yield b"".join(parts)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives in the manifest, with its payload if asked for."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, size = [], 0
                with system.open_input_stream(path, compression=None) as f:
                    for raw in frames(f):
                        rows.append({n: v for n, v in parse(raw).items() if n in names})
                        size += len(raw) if payloads else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    types = {"page_id": "long", "payload_bytes": "long", "refers_to": "long", "payload": "binary"}
    return manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(run, ", ".join(f"{n} {types.get(n, 'string')}" for n in names))


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """Write all pages; the manifest and the folder, which must be one that all executors share."""
    folder = folder or fresh_path(spark, "warc")
    return write_archives(with_revisits(pages), train_dictionary(pages), folder), folder

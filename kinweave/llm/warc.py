"""WARC archives in dictionary-compressed Zstandard form, written and read with Spark.

Every task trains a Zstandard dictionary on the first records of an archive
(at most ``SAMPLE_BYTES``), writes it into a skippable frame at the start of
the file and compresses each record as a frame of its own with it, so that any
record can be read with the dictionary and its offset. An archive holds about
``archive_bytes`` of records; each is written under a name of its attempt and
then moved to its final name, so a task that runs twice leaves one file of the
same content.

Records with equal payloads of at least ``min_payload`` bytes: the one with the
smallest page id is a ``response``, the others are ``revisit`` records that
refer to it and repeat only the HTTP headers, whose Content-Length is that of
the full payload. Payload groups are found on digests with map-side minimums;
only digests that repeat meet the pages again.

Defined results: a null html is an empty payload; a null url is written as
``urn:page:<id>``; control characters of a url are percent-encoded; rows that
repeat the smallest page id of their group are all responses; a null page id is
the smallest only where all are null; too few records for training give a
raw-content dictionary; an empty input gives no archive and no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import quoted
from kinweave.session import materialize, scratch_dir

# Fixed values of the formats: the magic number of the dictionary's skippable
# frame and the revisit profile.
DICT_FRAME = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_BYTES = 2 << 20
DICT_BYTES = 64 << 10
INDEX = "archive string, page_id long, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, archive string"


def payload_roles(pages: DataFrame, min_payload: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, payload, response_id)``: the page that a page with the same payload revisits, null for responses."""
    base = pages.select(
        F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"),
        F.coalesce(F.col(quoted(html_col)), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    eligible = base.filter(F.octet_length("payload") >= min_payload).select("digest", "page_id")
    repeated = materialize(
        eligible.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"),
        "payloads",
    )
    first = F.when((F.octet_length("payload") >= min_payload) & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id"))
    return base.join(repeated, "digest", "left").select("page_id", "url", "payload", first.alias("response_id"))


def _uri(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(uri: str) -> int | None:
    tail = uri.strip("<>").rpartition(":")[2]
    return int(tail) if tail else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """One WARC/1.1 record with its HTTP response head."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if response_id is not None else http + payload
    target = quote(url, safe="".join(map(chr, range(33, 127)))) if url else f"urn:page:{'' if page_id is None else page_id}"
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if response_id is None else 'revisit'}", f"WARC-Record-ID: {_uri(page_id)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if response_id is not None:
        head += [f"WARC-Refers-To: {_uri(response_id)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary of at most DICT_BYTES; the records themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8)
    except (zstandard.ZstdError, ValueError):
        return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:].rjust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = 32 << 20, level: int = 3) -> DataFrame:
    """Write ``(page_id, url, payload, response_id)`` below ``folder``; ``INDEX`` rows, one per record."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        part, serial = TaskContext.get().partitionId(), 0

        def save(blocks: list[tuple[int | None, bytes]]) -> pa.RecordBatch:
            sample, room = [], SAMPLE_BYTES
            for _, block in blocks:
                if room <= 0:
                    break
                sample.append(block[: 64 << 10])  # of a very long record its start is enough to learn from
                room -= len(sample[-1])
            dictionary = train(sample)
            raw = dictionary.as_bytes()
            compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_content_size=True)
            name = f"pages-{part:06d}-{serial:04d}.warc.zst"
            final, attempt = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
            at, rows = 0, []
            with store.open_output_stream(attempt) as out:
                at += out.write(struct.pack("<II", DICT_FRAME, len(raw)) + raw)
                for page_id, block in blocks:
                    frame = compressor.compress(block)
                    out.write(frame)
                    rows.append((name, page_id, at, len(frame)))
                    at += len(frame)
            store.move(attempt, final)
            return pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.int64()))],
                names=["archive", "page_id", "offset", "length"],
            )

        held, size = [], 0
        for batch in batches:
            for page_id, url, payload, response_id in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                block = warc_record(page_id, url, payload, response_id)
                held.append((page_id, block))
                size += len(block)
                if size >= archive_bytes:
                    yield save(held)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield save(held)

    # A fixed order makes every attempt of a task write the same files.
    order = ["page_id", "response_id", "url", "payload"]
    return records.select("page_id", "url", "payload", "response_id").sortWithinPartitions(*order).mapInArrow(write, INDEX)


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, decompressed one at a time with its own dictionary."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_FRAME:
        raise ValueError("no dictionary frame at the start of the archive")
    raw = archive[8: 8 + size]
    trained = raw[:4] == struct.pack("<I", 0xEC30A437)
    kind = zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    at, view = 8 + size, memoryview(archive)
    while at < len(archive):
        one, block = reader.decompressobj(), []
        while not one.eof:
            if at >= len(archive):
                raise ValueError("the archive ends within a record")
            fed = view[at: at + (16 << 10)]
            block.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield b"".join(block)


def parse_record(block: bytes) -> tuple:
    """The fields of ``RECORD`` but the archive. A response's digest is computed from its payload and compared."""
    head, _, rest = block.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return (
        _id(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], length, digest, fields["WARC-Type"],
        _id(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload,
    )


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """All records of the archives below ``folder`` (``RECORD``); a revisit has no payload of its own."""
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [f.split()[0] for f in RECORD.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size, name = [], 0, path.rpartition("/")[2]
                for block in frames(content.as_py()):
                    row = parse_record(block)
                    size += row[2] if with_payload else 200
                    rows.append((*(row if with_payload else row[:6] + (None,)), name))
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").schema(
        "path string, modificationTime timestamp, length long, content binary"
    ).load(folder)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def archive_pages(pages: DataFrame, min_payload: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives (below the shared folder where none is given) and return their index,
    which is a table by then."""
    folder = folder or f"{scratch_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    store, base = _store(folder)
    store.create_dir(base, recursive=True)
    index = materialize(write_archives(payload_roles(pages, min_payload), folder), "warc-index")
    return index.withColumn("folder", F.lit(folder))

"""WARC archives with Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Writing: each task writes an archive, and goes on in a new one once it has ARCHIVE_BYTES. Its dictionary is trained on the
payloads at its start (a bounded sample, DICTIONARY_SAMPLES of SAMPLE_BYTES each). Of records with equal payloads of at least `least_bytes` bytes, the one with the
largest page_id is a response; the others are revisits, which refer to it and have HTTP headers only. Payloads are matched
by their SHA-1, aggregated before the shuffle, and come to their records by page_id and SHA-1: a payload that a third of all
records share stays spread.

Reading: the dictionary is taken from the skippable frame, frames are decoded one by one, and for each record the version,
the headers, both lengths, the digests and the end are checked; a record that fails raises BadRecord.

Edge cases: a null html is an empty payload; a null url gives no WARC-Target-URI. A null page_id is never referred to, and
is a response unless another row with an id has its payload. Rows that share both the largest page_id and the payload are
all responses. Control characters of a url are percent-encoded. An empty table gives no archives and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm import _files

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 400, 4096, 32 << 10, 6
#: The upper halves of record ids: pages, and rows without a page_id.
OF_PAGE, OF_NOTHING = 0x616E7469_70686F6E, 0x6E6F7061_67656964
READ_BYTES = 32 << 10
#: Bytes of an archive, about.
ARCHIVE_BYTES = 1 << 30
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class BadRecord(ValueError):
    pass


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None, row: int) -> str:
    value = OF_NOTHING << 64 | row if page_id is None else OF_PAGE << 64 | page_id % (1 << 64)
    return f"<urn:uuid:{uuid.UUID(int=value)}>"


def _page_of(urn: str) -> int | None:
    value = uuid.UUID(urn[len("<urn:uuid:") : -1]).int
    low = value & (1 << 64) - 1
    return None if value >> 64 == OF_NOTHING else low - (low >> 63 << 64)


def _header_safe(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, row: int = 0, date: str = "1970-01-01T00:00:00Z") -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(page_id, row)}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {_header_safe(url)}"] if url else []
    lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {_urn(refers_to, 0)}"] if revisit else []
    lines += [f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record's page_id, payload bytes, payload digest, type and page_id referred to, after all checks."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise BadRecord("no WARC version line or no end of the headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"not a header: {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest", "warc-block-digest"} - headers.keys()
    if missing:
        raise BadRecord(f"headers are missing: {sorted(missing)}")
    length, kind = int(headers["content-length"]), headers["warc-type"]
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadRecord("Content-Length is not the block's length")
    if headers["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise BadRecord("the block's digest is wrong")
    http, gap, payload = block.partition(b"\r\n\r\n")
    own = [int(x.partition(b":")[2]) for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not gap or len(own) != 1:
        raise BadRecord("the block's HTTP headers have no single Content-Length")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        if len(payload) != own[0] or base32_sha1(payload) != digest:
            raise BadRecord("the payload's length or digest is wrong")
        refers = None
    elif kind == "revisit":
        if payload or headers.get("warc-profile") != REVISIT_PROFILE or "warc-refers-to" not in headers:
            raise BadRecord("not a revisit of an identical payload")
        refers = _page_of(headers["warc-refers-to"])
    else:
        raise BadRecord(f"unknown WARC-Type {kind!r}")
    return _page_of(headers["warc-record-id"]), own[0], digest, kind, refers


def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few or too small samples
        return zstandard.ZstdCompressionDict((b"".join(samples) or b"<html></html>")[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_frame(dictionary: zstandard.ZstdCompressionDict) -> bytes:
    """The dictionary itself, or compressed where that is smaller."""
    raw = dictionary.as_bytes()
    small = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    content = small if len(small) < len(raw) or raw.startswith(FRAME_MAGIC) else raw
    return struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content


def read_records(source: BinaryIO) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    head = source.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise BadRecord("no dictionary frame at the start")
    content = source.read(size)
    if len(content) != size:
        raise BadRecord("the dictionary is cut off")
    if content.startswith(FRAME_MAGIC):
        content = zstandard.ZstdDecompressor().decompress(content)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content))
    rest = source.read(READ_BYTES)
    while rest:
        frame, out = decompressor.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(READ_BYTES)
            if not rest:
                raise BadRecord("the last frame is cut off")
        yield b"".join(out)
        rest = rest or source.read(READ_BYTES)


def with_referrals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to for revisits."""
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("sha", F.when(F.octet_length("payload") >= least_bytes, F.sha1("payload")))
    largest = base.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("largest"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Narrow rows alone meet by payload; payloads are dealt by page as well.
    own = base.where("sha IS NOT NULL").select("page_id", "sha").distinct().join(largest, "sha").where(~F.col("page_id").eqNullSafe(F.col("largest")))
    own = own.select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), F.col("largest").alias("refers_to"))
    both = base.join(own, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("sha") == F.col("_sha")), "left")
    return both.select("page_id", "url", "payload", "refers_to")


def write_archives(pages: DataFrame, place: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns file, n_records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows, number = TaskContext.get().partitionId(), 0, 0
        small = C.chunks(batches, "payload")
        batch = next(small, None)
        while batch is not None:
            uri, n = f"{place}/part-{part:06d}-{number:04d}.warc.zst", 0
            dictionary = train([x[:SAMPLE_BYTES] for x in batch.column("payload")[:DICTIONARY_SAMPLES].to_pylist()])
            compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True).compress
            with _files.whole_file(uri) as out:
                out.write(dictionary_frame(dictionary))
                while batch is not None and (not n or out.tell() < archive_bytes):
                    for page_id, url, payload, refers in zip(*(x.to_pylist() for x in batch.columns)):
                        out.write(compress(record(page_id, url, payload, refers, refers is not None, part << 40 | rows)))
                        rows, n = rows + 1, n + 1
                    batch = next(small, None)
            number += 1
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64())], names=["file", "n_records"])

    return C.keep(with_referrals(pages, least_bytes).mapInArrow(write, "file string, n_records long"), "archives")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of archives of write_archives(), each file in a task; raises where a record, or the number of records, is wrong."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen, rows = 0, []
                fs, path = _files.filesystem(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    for data in read_records(source):
                        rows.append(parse(data))
                        seen += 1
                        if len(rows) == 2000:
                            yield _rows(rows)
                            rows = []
                if seen != n:
                    raise BadRecord(f"{uri} has {seen} records, not {n}")
                yield _rows(rows)

    n = files.count()
    return files.repartition(max(1, n)).mapInArrow(read, RECORDS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    return read_archives(write_archives(pages, C.new_place(pages.sparkSession, "warc"), least_bytes))

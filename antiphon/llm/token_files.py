"""Token ids in Arrow files of fixed-size lists.

All documents' ids, each followed by an end id, stand in ascending order of doc_id in one stream that is cut into files. A
file is an Arrow IPC file: its record batches hold sequences of equal length as fixed-size lists, and a mask of one bit an
id (0: filling after the file's last id). Any sequence is at a place known by arithmetic, so a reader maps the file and looks
at it without copying. Ids take two bytes where the vocabulary allows it. An index (Parquet) has each document's file and
place. Files are written under a draft's name and renamed: a task that runs again leaves the same file.

Edge cases: a null or empty text is its end id alone. Rows of one doc_id stand in the order of their text's hash; null ids
come first. An empty table makes no files and an empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm import _files
from antiphon.llm.encoding import WORD_LEVEL, encoder

END_ID, SEQUENCE, BATCH = 2, 2048, 64
#: Text for one file, about; there are no fewer files than spark.sql.shuffle.partitions.
FILE_BYTES = 512 << 20
INDEX = "doc_id long, part int, at long, n_tokens long"


def file_of(place: str, part: int) -> str:
    return f"{place}/part-{part:06d}.arrow"


def write_token_files(docs: DataFrame, tokenizer: str, place: str, sequence: int = SEQUENCE, pieces: str = WORD_LEVEL, dtype: str = "<u2") -> DataFrame:
    """Writes the files and returns the index: doc_id, part (file), at (its first id's place in the file), n_tokens."""
    kind = pa.from_numpy_dtype(np.dtype(dtype))
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.binary(sequence // 8))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, end = encoder(tokenizer, pieces, dtype), TaskContext.get().partitionId(), np.array([END_ID], dtype).tobytes()
        width = np.dtype(dtype).itemsize
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with _files.whole_file(file_of(place, part)) as out, pa.ipc.new_file(out, schema) as file:
            waiting, size, at = [], 0, 0

            def flush(raw: bytes, n_ids: int) -> None:
                ids = np.zeros(-(-n_ids // sequence) * sequence, dtype)
                ids[:n_ids] = np.frombuffer(raw, dtype, n_ids)
                mask = np.packbits(np.arange(len(ids)) < n_ids, bitorder="little").tobytes()
                rows = len(ids) // sequence
                file.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(ids), sequence), pa.FixedSizeBinaryArray.from_buffers(pa.binary(sequence // 8), rows, [None, pa.py_buffer(mask)])], schema=schema))

            block = BATCH * sequence * width
            for batch in C.chunks(iter_with(first, batches)):
                own = [ids + end for ids in encode.many(batch.column(1).to_pylist())]
                counts = np.array([len(x) // width for x in own], np.int64)
                begin = at + np.cumsum(counts) - counts
                at += int(counts.sum())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(own), part, np.int32)), pa.array(begin), pa.array(counts)], names=["doc_id", "part", "at", "n_tokens"])
                waiting += own
                size += sum(map(len, own))
                if size >= block:
                    raw = b"".join(waiting)
                    whole = len(raw) // block * block
                    for i in range(0, whole, block):
                        flush(raw[i : i + block], block // width)
                    waiting, size = [raw[whole:]], len(raw) - whole
            if size:
                flush(b"".join(waiting), size // width)

    ordered = C.text_frame(docs).withColumn("tie", F.xxhash64("text"))
    size = ordered.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // FILE_BYTES))
    ordered = ordered.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return C.keep(ordered.mapInArrow(write, INDEX), "token-index")


def iter_with(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class TokenFile:
    """Random access to a file of write_token_files()."""

    def __init__(self, uri: str):
        self.source = _files.open_file(uri)
        self.reader = pa.ipc.open_file(self.source)
        self.sequence = self.reader.schema.field("ids").type.list_size
        self.last: tuple[int, pa.RecordBatch] | None = None

    def _batch(self, i: int) -> pa.RecordBatch:
        """The last one is held: who reads in order fetches each batch once."""
        if self.last is None or self.last[0] != i:
            self.last = i, self.reader.get_batch(i)
        return self.last[1]

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return 0 if not n else (n - 1) * BATCH + self.reader.get_batch(n - 1).num_rows

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids (a view of the file) and the mask of one sequence."""
        batch, row = self._batch(i // BATCH), i % BATCH
        mask = np.frombuffer(batch.column("mask").buffers()[1], np.uint8).reshape(-1, self.sequence // 8)[row]
        return self._ids(batch)[row * self.sequence : (row + 1) * self.sequence], np.unpackbits(mask, bitorder="little").astype(bool)

    @staticmethod
    def _ids(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("ids").values.to_numpy(zero_copy_only=True)

    def span(self, at: int, n: int) -> np.ndarray:
        """n ids of the stream from place `at`; a view where they stand in one batch."""
        size, out = BATCH * self.sequence, []
        while n:
            batch, within = divmod(at, size)
            take = min(n, size - within)
            out.append(self._ids(self._batch(batch))[within : within + take])
            at, n = at + take, n - take
        return out[0] if len(out) == 1 else np.concatenate(out)

    def close(self) -> None:
        self.source.close()


def read_token_files(index: DataFrame, place: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian 32-bit), from the files."""
    # A row for each file.
    sizes = {r.part: r.n for r in index.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    base, total = {}, 0
    for part in sorted(sizes):
        base[part], total = total, total + sizes[part]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, file = None, None
        for batch in batches:
            begin, crcs = [], []
            for p, at, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if p != part:
                    if file:
                        file.close()
                    part, file = p, TokenFile(file_of(place, p))
                begin.append(base[p] + at)
                crcs.append(zlib.crc32(file.span(at, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(begin, pa.int64()), batch.column(3), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return index.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE) -> DataFrame:
    """Writes the files to a new place in the shared folder and reads them back."""
    place = C.new_place(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, tokenizer, place, sequence), place)

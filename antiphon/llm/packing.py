"""Best-fit packing, bulk-synchronous.

Lengths are whole numbers up to the capacity, so pieces of one length are interchangeable, and so are sequences with the
same gap: the range sort of documents and of gaps is a count of each length and of each gap, and a row is a length and a rank
within it. Each round takes the next shorter length, sweeps the gaps from the smallest that fits upward (its successors),
hands out the pieces of that length to the sequences with that gap by rank, and updates the gaps; what finds none opens new
sequences. The rounds' state is at most `capacity` lengths and the gaps that they leave, whatever the input, so the rounds
run on the driver. All that has rows is distributed: pieces are cut, counted and ranked within their length in parallel, and
each finds its sequence and offset by its length and rank: no task holds a group, and a length that a third of all rows share
is spread over all tasks. The result is that of best fit on rows, one after the other, longest first (tested against it).

Edge cases: a null or empty text is its end id alone. Equal documents are packed each for itself. An empty table gives an
empty result. Other columns of the input are left out.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from antiphon.llm import _common as C
from antiphon.llm.encoding import BYTE_LEVEL, encoder

CAPACITY, END_ID = 1024, 2
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, over counts of lengths. Rows (length, first rank, count, first sequence, offset): so many pieces of that length, from that rank on, stand at that offset of so many sequences from that one on. Also the number of sequences."""
    gaps: list[int] = []  # ascending, those that have open sequences
    open_at: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}  # by gap: (count, [(length, first rank), ...])
    full: list[tuple[int, list[tuple[int, int]]]] = []

    def put(gap: int, count: int, slots: list[tuple[int, int]]) -> None:
        if gap == 0:
            full.append((count, slots))
            return
        if gap not in open_at:
            open_at[gap] = []
            bisect.insort(gaps, gap)
        open_at[gap].append((count, slots))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                put(capacity, -(-left // (capacity // length)), [])
                continue
            gap = gaps[at]
            count, slots = open_at[gap].pop()
            if not open_at[gap]:
                del open_at[gap], gaps[at]
            # The conflict for these gaps goes to the lowest ranks: each takes as many pieces as fit, the last one the rest.
            each = min(gap // length, left)
            take = min(count, left // each)
            put(gap - each * length, take, [*slots, *((length, rank + k * take) for k in range(each))])
            rank, left = rank + take * each, left - take * each
            if take < count:
                put(gap, count - take, [(n, r + take) for n, r in slots])
    rows, sequence = [], 0
    for count, slots in [*full, *(x for g in gaps for x in open_at[g])]:
        offset = 0
        for length, rank in slots:
            rows.append((length, rank, count, sequence, offset))
            offset += length
        sequence += count
    return rows, sequence


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece, with its rank among the pieces of its length in its task's part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(tokenizer, BYTE_LEVEL), TaskContext.get().partitionId(), [0] * (capacity + 1)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in C.chunks(batches):
            out: list[list] = [[] for _ in range(7)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
                ids += end
                # Whole pieces from the end, so that only the first one may be shorter.
                first = (len(ids) // 4 - 1) % capacity + 1
                for piece, to in enumerate(range(4 * first, len(ids) + 1, 4 * capacity)):
                    at = max(0, to - 4 * capacity)
                    own = ids[at:to]
                    length = len(own) // 4
                    for column, value in zip(out, (doc_id, piece, at // 4, length, zlib.crc32(own), part, ranks[length])):
                        column.append(value)
                    ranks[length] += 1
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    return C.text_frame(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    pieces = C.keep(pieces_of(docs, tokenizer, capacity), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Rows of a length: one a part, a few bytes each.
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = C.keep(per_part.select("part", "length", "n", before.alias("base")), "piece-ranks")
    # At most `capacity` rows, a bound that no input changes.
    counts = {r.length: r.n for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.searchsorted(table[:, 0], np.arange(capacity + 2))
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "rank"))
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = length == n
                row[mine] = first[n] + np.searchsorted(table[first[n] : first[n + 1], 1], rank[mine], "right") - 1
            sequence = table[row, 3] + rank - table[row, 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(sequence), pa.array(table[row, 4])], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    ranked = pieces.join(bases.select("part", "length", "base"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("base")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

"""Product codes of vectors, with the nearest entry found by annular norm pruning.

Components become whole numbers, floor(SCALE * x); a vector is cut into N_PARTS equal parts, each with a codebook of its own.
Entries are sorted by norm. Since a part's distance to an entry is at least the difference of their norms, no entry outside of
the annulus |norm(entry) - norm(part)| <= best distance so far can be nearer: the entry nearest by norm is tried first, binary
search gives the interval that its distance allows, ends included, and what lies in it is compared exactly in whole numbers,
from the inside out, while the interval shrinks with the best distance. Ties go to the lower index.

Each pass reads the vectors anew. What a round sends to the driver are sums and counts of the entries' parts: N_PARTS times
N_ENTRIES rows, whatever the input, summed in each task first.

Edge cases: rows whose vector is null, empty, or holds null or non-finite components are dropped, and so are those whose length
differs from that of the kept row with the smallest vec_id or isn't a multiple of N_PARTS. Components beyond +-LARGEST (after
scaling) count as that, since squares of larger ones don't fit a long; sums of errors beyond a long count as the largest.
With fewer than N_ENTRIES rows there are as many entries. Rows of one vec_id are vectors of their own, in the order of their
components; null vec_ids come last. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C

SCALE, N_PARTS, N_ENTRIES, ROUNDS = 256, 16, 64, 2
LARGEST = 1 << 27
#: Vectors that are coded at a time.
TOGETHER = 1 << 13


def whole_vectors(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that are kept, of those with `size` components, and their vectors in whole numbers."""
    lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    flat = column.flatten()
    missing = flat.is_null().to_numpy(zero_copy_only=False)
    x = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(missing | ~np.isfinite(x))])
    ends = np.cumsum(lengths)
    fit = (lengths > 0) & (lengths % N_PARTS == 0) & (bad[ends] == bad[ends - lengths])
    rows = np.flatnonzero(fit & (lengths == size))
    at = (ends[rows] - lengths[rows])[:, None] + np.arange(size)
    return rows, np.clip(np.floor(x[at] * SCALE), -LARGEST, LARGEST).astype(np.int64)


class Codebook:
    """One part's entries, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), squares))
        self.entries, self.norms = entries[self.order], np.sqrt(squares[self.order].astype(np.float64))

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance."""
        norms = np.sqrt((parts * parts).sum(axis=1).astype(np.float64))
        n, n_entries = len(parts), len(self.norms)
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, n_entries)

        def compare(rows: np.ndarray, at: np.ndarray) -> None:
            gap = parts[rows] - self.entries[at]
            distance, own = (gap * gap).sum(axis=1), self.order[at]
            won = (distance < best[rows]) | ((distance == best[rows]) & (own < index[rows]))
            best[rows[won]], index[rows[won]] = distance[won], own[won]

        start = np.clip(np.searchsorted(self.norms, norms), 0, n_entries - 1)
        compare(np.arange(n), start)
        # Roots are rounded: a slack far above their error keeps every entry that may be as near.
        below, above, live = start - 1, start + 1, np.arange(n)
        while len(live):
            reach = np.sqrt(best[live].astype(np.float64))
            reach += 1e-9 * (reach + norms[live]) + 1e-9
            low = np.searchsorted(self.norms, norms[live] - reach, "left")
            high = np.searchsorted(self.norms, norms[live] + reach, "right") - 1
            down, up = below[live] >= low, above[live] <= high
            compare(live[down], below[live[down]])
            compare(live[up], above[live[up]])
            below[live[down]] -= 1
            above[live[up]] += 1
            live = live[down | up]
        return index, best


def _coded(vectors: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, a column for each part."""
    parts = vectors.reshape(len(vectors), N_PARTS, -1)
    found = [book.nearest(np.ascontiguousarray(parts[:, p])) for p, book in enumerate(books)]
    return np.stack([x for x, _ in found], axis=1), np.stack([x for _, x in found], axis=1)


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(start, TOGETHER)
            rows, vectors = whole_vectors(part.column(part.schema.get_field_index("embedding")), size)
            if len(rows):
                yield part, rows, vectors


def _first_entries(rows: DataFrame, n: int) -> np.ndarray:
    """The vectors of the n kept rows with the smallest vec_ids."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            lengths = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
            for size in np.unique(lengths[lengths > 0]).tolist():
                places, vectors = whole_vectors(column, size)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places)), pa.array([size] * len(places), pa.int64()), pa.array(list(vectors), pa.list_(pa.int64()))], ["vec_id", "size", "vector"])

    kept = rows.select("vec_id", "embedding").mapInArrow(whole, "vec_id long, size long, vector array<long>")
    order = [F.asc_nulls_last("vec_id"), F.asc("vector")]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((0, N_PARTS), np.int64)
    found = kept.where(F.col("size") == first[0]["size"]).orderBy(*order).limit(n).collect()
    return np.array([r["vector"] for r in found], np.int64)


def _moved(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """Entries (part, entry, component) after one round: the floors of the means of the parts nearest to each."""
    size = entries.shape[2]
    books = [Codebook(e) for e in entries]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64)
        for _, _, vectors in _batches(batches, N_PARTS * size):
            codes, _ = _coded(vectors, books)
            parts = vectors.reshape(len(vectors), N_PARTS, size)
            for p in range(N_PARTS):
                np.add.at(total[p], codes[:, p], parts[:, p])
                count[p] += np.bincount(codes[:, p], minlength=entries.shape[1])
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), *(pa.array(total[part, entry, j]) for j in range(size))], ["part", "entry", "n", *(f"c{j}" for j in range(size))])

    named = [f"c{j}" for j in range(size)]
    found = rows.select("embedding").mapInArrow(sums, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in named)).groupBy("part", "entry").agg(F.sum("n"), *(F.sum(c) for c in named)).collect()
    out = entries.copy()
    for part, entry, n, *total in found:
        out[part, entry] = [x // n for x in total]
    return out


def codebooks(rows: DataFrame, n_entries: int = N_ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Entries by part, entry and component."""
    first = _first_entries(rows, n_entries)
    entries = np.ascontiguousarray(first.reshape(len(first), N_PARTS, -1).swapaxes(0, 1)) if len(first) else np.zeros((N_PARTS, 0, 1), np.int64)
    for _ in range(rounds if len(first) else 0):
        entries = _moved(rows, entries)
    return entries


def encode(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, code, error of every row that is kept."""
    label = rows.schema["label"].dataType.simpleString()
    if not entries.size:
        return rows.sparkSession.createDataFrame([], f"vec_id long, label {label}, code string, error long")
    books, size = [Codebook(e) for e in entries], N_PARTS * entries.shape[2]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, places, vectors in _batches(batches, size):
            codes, errors = _coded(vectors, books)
            kept = batch.take(pa.array(places))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), pa.array([x.tobytes().hex() for x in codes.astype(np.uint8)]), pa.array(errors.sum(axis=1))], ["vec_id", "label", "code", "error"])

    return rows.select("vec_id", "label", "embedding").mapInArrow(code, f"vec_id long, label {label}, code string, error long")


def codes_with_errors(vectors: DataFrame) -> DataFrame:
    """encode(), with the error of all rows of one label and a digest of the codebooks."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    entries = codebooks(rows)
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    coded = C.keep(encode(rows, entries), "vector-codes")
    # Nulls are a label of their own, and so equal themselves.
    named = F.struct(F.col("label").isNull().alias("none"), "label")
    coded = coded.withColumn("named", F.to_json(named, {"ignoreNullFields": "false"}))
    by_label = coded.groupBy("named").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2**63 - 1)).cast("long").alias("label_error"), F.count("*").alias("n"))
    out = C.split_join(coded, by_label, ["named"], "n", coded.count())
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

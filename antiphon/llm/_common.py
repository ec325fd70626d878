"""What the operators of this folder share: tables kept in the shared folder, and words of Arrow batches as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antiphon.operators.kept import forget, keep, new_place, shared_dir  # noqa: F401

#: Words are maximal runs of anything but these six bytes.
SPACE_BYTES = b" \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Text of so many bytes at most is handled at a time (a longer document alone).
CHUNK_BYTES = 2 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Keys that split_join() sends to every task at most, and rows that any one task may get.
HOT_KEYS, FEW_ROWS = 1_000, 1 << 15


def split_join(rows: DataFrame, table: DataFrame, keys: list[str], count: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined to a table with one row a key, which says in `count` how many of the n_rows rows have the key.

    Keys of more than 2 * n_rows / HOT_KEYS rows are fewer than HOT_KEYS, whatever the input: they are broadcast, so that no task
    gets all rows of one. All other keys are joined by a shuffle, and all are if there are no more than FEW_ROWS rows at all.
    """
    if n_rows <= FEW_ROWS:
        return rows.join(table.drop(count), keys, how)
    bound = max(64, 2 * n_rows // HOT_KEYS)
    hot, cool = table.where(F.col(count) > bound).drop(count), table.where(F.col(count) <= bound).drop(count)
    others = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    # A hot key is in the table, so its rows have a partner whatever `how` is.
    return rows.join(F.broadcast(hot), keys).unionByName(others.join(cool, keys, how))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, out: DataFrame, own: Column) -> DataFrame:
    """The rows of docs, all their columns, whose doc_id and `own` value aren't among the two columns of out (null ids equal each other)."""
    a, b = free_name(docs, "out_doc"), free_name(docs, "out_value")
    out = out.toDF(a, b)
    return docs.join(out, docs["doc_id"].cast("long").eqNullSafe(F.col(a)) & (own == F.col(b)), "left_anti")


def text_frame(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id as long, text as string with null as empty, and the columns named; whatever else docs has is left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *columns)


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about `most` bytes of that column."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = buffers(batch.column(batch.schema.get_field_index(column)))[1]
        row = 0
        while row < batch.num_rows:
            to = max(row + 1, int(np.searchsorted(ends, ends[row] + most, "right")) - 1)
            yield batch.slice(row, to - row)
            row = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and where each row begins, with the end at last. Nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    ends = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def split_words(text: str) -> list[bytes]:
    """Python's bytes.split() splits at exactly the six bytes above."""
    return text.encode().split()


def numbers(column: pa.Array) -> np.ndarray:
    """A column of longs; nulls as the smallest."""
    return column.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)


# Hashes of words and of runs of words. No sums of powers: such hashes modulo 2^64 collide by construction on some words.

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACE_BYTES)] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """64-bit hashes; those of different seeds are independent, so two make 128 bits."""

    #: Places of a byte in its word that have a table of their own.
    NEAR = 24

    def __init__(self, seed: int):
        draw = np.random.default_rng(seed)
        self.salt, self.step, self.place = (np.uint64(x) | np.uint64(1) for x in draw.integers(1 << 62, 1 << 63, 3))
        with np.errstate(over="ignore"):
            self.table = np.stack([self._byte(np.arange(256), np.full(256, k)) for k in range(self.NEAR)]).ravel()

    def _byte(self, byte: np.ndarray, place: np.ndarray) -> np.ndarray:
        return mix(mix(byte.astype(np.uint64) * self.salt + self.step) + place.astype(np.uint64) * self.place)

    def words(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the bytes from each begin to its end: the scrambled sum of a value for each byte and its place."""
        if not len(begin):
            return np.zeros(0, np.uint64)
        at = np.arange(len(data), dtype=np.int32)
        start = np.zeros(len(data), np.int32)
        start[begin] = begin
        place = at - np.maximum.accumulate(start)
        value = self.table[(np.minimum(place, self.NEAR - 1) << 8) | data]
        far = np.flatnonzero(place >= self.NEAR)
        value[far] = self._byte(data[far], place[far])
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value, out=total[1:])
        return mix(total[end] - total[begin] + (end - begin).astype(np.uint64) * self.step)

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The hash of a run of which a and b are the hashes of two parts; the order counts."""
        return mix(mix(a + self.salt) + b * self.step)

    def runs(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the n words from each word on, for all words that n - 1 others follow."""
        power, size, out, have = words, 1, None, 0
        while True:
            if n & size:
                rest = max(0, len(words) - have - size + 1)
                out = power if out is None else self.join(power[:rest], out[size : size + rest])
                have += size
            if 2 * size > n:
                return out
            power, size = self.join(power[: max(0, len(power) - size)], power[size:]), 2 * size


class Words:
    """Words of the texts of one batch: begin and end in the bytes, first word of each row, and one or more hashes of each word."""

    def __init__(self, column: pa.Array, *hashes: Hashes, alphabet: np.ndarray | None = None):
        """alphabet: what each byte counts as."""
        data, ends = buffers(column)
        if alphabet is not None:
            data = alphabet[data]
        solid = ~_IS_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1] | edge[1:-1]
        last[:-1] &= ~solid[1:] | edge[1:-1]
        self.data, self.begin, self.end = data, np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Words of row i are those from rows[i] to rows[i + 1].
        self.rows = np.searchsorted(self.begin, ends)
        self.hashes = [h.words(data, self.begin, self.end) for h in hashes]
        self.hash = self.hashes[0]

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.rows) - 1), np.diff(self.rows))

    def room(self) -> np.ndarray:
        """Words from each word to the end of its text, itself included."""
        return np.repeat(self.rows[1:], np.diff(self.rows)) - np.arange(len(self.begin))


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))

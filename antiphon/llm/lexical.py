"""Ranked lexical search over an index of document shards.

A task turns its documents into shards of about SHARD_TERMS terms. A shard is one row: postings in CSR form (sorted term
hashes, where each term's postings begin, document places, impacts) beside its doc_ids. An impact is the whole number
1000000000 * tf div (1000 * tf + 12 * m), which needs only the corpus' number of documents and of terms, counted before;
a term's weight is applied at query time. So no term's postings ever meet in one task, however frequent it is.

Items are searched in blocks of about BLOCK_BYTES. For each block a task takes a shard, goes term by term, adds weight times
impact to a dense accumulator, and selects the best by argpartition; of scores equal to the last, those with the smallest
doc_ids. The best of all shards are merged by a window whose input each task has cut to the best already.

Terms are known by 64-bit hashes: among V different terms of a corpus, one of an item's T terms is mistaken for another with
chance V * T / 2^64 (10^10 terms and 10^4 terms of items: 1 in 180,000).

Edge cases: a null text has no terms and is not counted. Rows of one doc_id are documents of their own, each with its rank. A
null doc_id comes before all others among equal scores. Rows of one item_id are ranked each for itself. Items without terms,
or none of whose terms is known, have no rows; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antiphon.llm import _common as C

TERM_PATTERN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Terms of a shard (a longer document alone has more), and bytes of items that are searched together.
SHARD_TERMS, BLOCK_BYTES = 1 << 21, 1 << 20
#: Of equal scores and doc_ids, and of nulls: the number that stands for a null doc_id.
NO_ID = np.iinfo(np.int64).min
_HASH = C.Hashes(11)
_SHARD = "doc_ids binary, terms binary, starts binary, docs binary, impacts binary"


def _alphabet() -> np.ndarray:
    """What each byte counts as: a blank outside of terms, small letters for large ones."""
    out = np.arange(256, dtype=np.uint8)
    for first, last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
        out[first : last + 1] = 0x20
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


_ALPHABET = _alphabet()


def _terms(column: pa.Array) -> C.Words:
    return C.Words(column, _HASH, alphabet=_ALPHABET)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in C.chunks(batches):
        n = np.diff(_terms(batch.column(0)).rows)
        yield pa.RecordBatch.from_arrays([pa.array([int(np.count_nonzero(n))]), pa.array([int(n.sum())])], ["n_docs", "n_terms"])


def _shard(ids: list[np.ndarray], sizes: list[np.ndarray], hashes: list[np.ndarray], n_docs: int, n_terms: int) -> pa.RecordBatch:
    ids, sizes, hashes = np.concatenate(ids), np.concatenate(sizes), np.concatenate(hashes)
    terms, place = np.unique(hashes, return_inverse=True)
    posting = (place.astype(np.uint64) << np.uint64(32)) | np.repeat(np.arange(len(ids), dtype=np.uint64), sizes)
    posting, tf = np.unique(posting, return_counts=True)
    docs = (posting & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.searchsorted(posting >> np.uint64(32), np.arange(len(terms) + 1, dtype=np.uint64))
    m = 75 + (25 * sizes.astype(np.int64) * n_docs) // n_terms
    impacts = (1_000_000_000 * tf.astype(np.int64)) // (1000 * tf + 12 * m[docs])
    columns = (ids, terms, starts.astype(np.int64), docs.astype(np.int32), impacts.astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in columns], ["doc_ids", "terms", "starts", "docs", "impacts"])


@dataclass
class Index:
    """shards: a table of _SHARD in the shared folder; n_docs and n_terms of all documents with terms."""

    shards: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, shard_terms: int = SHARD_TERMS) -> Index:
    rows = C.text_frame(docs)
    n_docs, n_terms = rows.select("text").mapInArrow(_sizes, "n_docs long, n_terms long").agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, hashes, have = [], [], [], 0
        for batch in C.chunks(batches, "text"):
            words = _terms(batch.column(1))
            n = np.diff(words.rows)
            some = n > 0
            ids, sizes, hashes, have = [*ids, C.numbers(batch.column(0))[some]], [*sizes, n[some]], [*hashes, words.hash], have + len(words.hash)
            if have >= shard_terms:
                yield _shard(ids, sizes, hashes, n_docs, n_terms)
                ids, sizes, hashes, have = [], [], [], 0
        if have:
            yield _shard(ids, sizes, hashes, n_docs, n_terms)

    return Index(C.keep(rows.mapInArrow(shards, _SHARD), "lexical-shards", "zstd"), n_docs, n_terms)


def _block(texts: list[str]) -> tuple[np.ndarray, list[Counter]]:
    """All terms of the texts, sorted, and for each text how often it has each of them by place."""
    words = _terms(pa.array(texts, pa.string()))
    terms, place = np.unique(words.hash, return_inverse=True)
    return terms, [Counter(place[a:b].tolist()) for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]


def _arrays(batch: pa.RecordBatch, row: int, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(batch.column(batch.schema.get_field_index(name))[row].as_buffer(), kind) for name, kind in kinds.items()]


def _found(terms: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the asked terms of those that a shard has, and their places in the shard."""
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    here = np.flatnonzero(terms[at] == asked)
    return here, at[here]


def _frequencies(index: Index, asked: np.ndarray) -> np.ndarray:
    """Documents that hold each of the asked terms, over all shards."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(asked), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                terms, starts = _arrays(batch, row, terms=np.uint64, starts=np.int64)
                here, at = _found(terms, asked)
                total[here] += starts[at + 1] - starts[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["place", "df"])

    out = np.zeros(len(asked), np.int64)
    for place, df in index.shards.select("terms", "starts").mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df")).collect():
        out[place] = df
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0; of scores equal to the last, those with the smallest ids."""
    if len(scores) <= k:
        return np.flatnonzero(scores)
    least = scores[np.argpartition(scores, len(scores) - k)[-k:]].min()
    if least <= 0:
        return np.flatnonzero(scores)
    above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    room = k - len(above)
    if len(ties) > room:
        ties = ties[np.argsort(ids[ties], kind="stable")[:room]]
    return np.concatenate([above, ties])


def _search_block(index: Index, texts: list[str], k: int) -> DataFrame:
    """query (place among the texts), doc_id, score: the best of each shard."""
    asked, queries = _block(texts)
    df = _frequencies(index, asked)
    weights = [math.floor(1000 * math.log((2 * index.n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()]
    queries = [[(term, times * weights[term]) for term, times in sorted(q.items()) if weights[term]] for q in queries]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, terms, starts, docs, impacts = _arrays(batch, row, doc_ids=np.int64, terms=np.uint64, starts=np.int64, docs=np.int32, impacts=np.int32)
                here, at = _found(terms, asked)
                span = dict(zip(here.tolist(), zip(starts[at].tolist(), starts[at + 1].tolist(), strict=True), strict=True))
                out = []
                for q, parts in enumerate(queries):
                    total = np.zeros(len(ids), np.int64)
                    for term, weight in parts:
                        if term in span:
                            a, b = span[term]
                            total[docs[a:b]] += impacts[a:b] * np.int64(weight)
                    top = best(total, ids, k)
                    out.append((np.full(len(top), q), ids[top], total[top]))
                if out:
                    q, doc_id, total = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc_id, mask=doc_id == NO_ID), pa.array(total)], ["query", "doc_id", "score"])

    return index.shards.mapInArrow(score, "query long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's k best documents with a score above 0."""
    spark = items.sparkSession
    rows = items.select("item_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_blocks = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    rows = rows.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    out = None
    for block in range(n_blocks):
        mine = rows.where(F.col("block") == block).select("item_id", "text").collect()
        place = {text: i for i, text in enumerate(dict.fromkeys(text for _, text in mine))}
        asked = spark.createDataFrame([(n, item_id, place[text]) for n, (item_id, text) in enumerate(mine)], f"row long, item_id {items.schema['item_id'].dataType.simpleString()}, query long")
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
        found = _search_block(index, list(place), k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        found = found.join(F.broadcast(asked), "query").select("item_id", "rank", "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    return search(build(docs), items, k)

"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is all text of smaller doc_ids. It's indexed in blocks that the content itself delimits: every window of
`window` words has one anchor, its gram of GRAM words with the least hash (the first of equals), and a block is a run of
windows with one anchor. A document is parsed greedily: block by block it takes the factor that an equal block of the
smallest earlier document gives, and factors that go on in the same source are joined. At the boundaries, where an anchor is
shared but the blocks differ, the windows themselves are looked up one by one. A window has the same anchor wherever it
stands, so no shared window is missed; a factor is at least a window long, and its words are duplicates.

Everything is a hash aggregation that keeps the smallest doc_id, so a passage that a third of all documents share is
combined before the shuffle, rows of hot anchors and blocks are never gathered in one task, and no pairs within a group are
made. A block that one text repeats is one row, with all places where it begins. Windows and blocks are told apart by 64 bits of hash of all their words within one anchor, whose 64 bits are of another,
independent hash; the words are never compared as such.

Edge cases: a null text has no words. A null doc_id is neither source nor target: nothing is removed from it. Rows with one
doc_id don't count as earlier than each other; those with equal text are treated alike, those with different text each for
itself. A document shorter than the window loses nothing. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C

WINDOW, GRAM = 50, 20
BLOCKS = "doc_id long, version long, anchor long, block long, begins array<int>, n_windows int"
WINDOWS = "doc_id long, version long, anchor long, content long, begin int"


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value in each window of so many values, the first of equals."""
    n = len(x) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = x.copy(), np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        m = len(best) - step
        other = best[step:] < best[:m]
        best, at = np.where(other, best[step:], best[:m]), np.where(other, at[step:], at[:m])
        have += step
    return at[:n]


class _Parser:
    """Anchors and windows of the texts of a batch."""

    def __init__(self, window: int, gram: int):
        self.window, self.gram = window, gram
        self.of_anchor, self.of_window = C.Hashes(51), C.Hashes(53)

    def parse(self, column: pa.Array) -> None:
        self.words = C.Words(column, self.of_anchor, self.of_window)
        self.grams = self.of_anchor.runs(self.words.hashes[0], self.gram)
        self.windows = self.of_window.runs(self.words.hashes[1], self.window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word that begins a window: its place, and the place of the window's anchor."""
        least = _sliding_least(self.grams, self.window - self.gram + 1)
        begin = np.flatnonzero(self.words.room() >= self.window)
        return begin, least[begin]

    def blocks(self, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Of so many windows from each begin on: a window is longer than a run that shares an anchor, so the first and the last hold all words between them."""
        return self.of_window.join(self.windows[begin] + count.astype(np.uint64), self.windows[begin + count - 1])


def _blocks(window: int, gram: int):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(window, gram)
        for batch in C.chunks(batches):
            parser.parse(batch.column(1))
            begin, anchor = parser.anchors()
            if not len(begin):
                continue
            rows = parser.words.row_of()[begin]
            new = np.ones(len(begin), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(begin)))
            at, row = begin[first], rows[first]
            grams, blocks = parser.grams[anchor[first]], parser.blocks(at, count)
            # Equal blocks of one row together; the sort is stable, so their places ascend.
            order = np.lexsort((blocks, row))
            at, row, grams, blocks, count = (x[order] for x in (at, row, grams, blocks, count))
            new = np.ones(len(at), bool)
            new[1:] = (row[1:] != row[:-1]) | (grams[1:] != grams[:-1]) | (blocks[1:] != blocks[:-1])
            one = np.flatnonzero(new)
            places = pa.ListArray.from_arrays(pa.array(np.append(one, len(at)).astype(np.int32)), pa.array((at - parser.words.rows[row]).astype(np.int32)))
            ids, versions = (batch.column(i).take(pa.array(row[one])) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, versions, C.signed(grams[one]), C.signed(blocks[one]), places, pa.array(count[one].astype(np.int32))], names=["doc_id", "version", "anchor", "block", "begins", "n_windows"])

    return find


def _windows(window: int, gram: int):
    """The windows of blocks listed as `wanted` (begin, n_windows), with their hashes."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _Parser(window, gram)
        for batch in C.chunks(batches):
            parser.parse(batch.column(1))
            wanted = batch.column(3)
            of_row = np.repeat(np.arange(batch.num_rows), [len(x) for x in wanted])
            flat = wanted.flatten()
            begin, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row = np.repeat(of_row, count)
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(begin, count) + inner + parser.words.rows[row]
            # All windows of a block have its anchor: the first window's.
            head = np.repeat(begin, count) + parser.words.rows[row]
            heads, back = np.unique(head, return_inverse=True)
            anchor = np.array([h + int(np.argmin(parser.grams[h : h + window - gram + 1])) for h in heads], np.int64)[back] if len(heads) else heads
            ids, versions = (batch.column(i).take(pa.array(row)) for i in (0, 2))
            yield pa.RecordBatch.from_arrays([ids, versions, C.signed(parser.grams[anchor]), C.signed(parser.windows[at]), pa.array((at - parser.words.rows[row]).astype(np.int32))], names=["doc_id", "version", "anchor", "content", "begin"])

    return find


def _remove(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            counts, removed, factors, hashes, spans = [], [], [], [], []
            for text, factor in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = C.split_words(text)
                joined = parse_factors(factor or [], window)
                kept, at = [], 0
                for begin, end, _, _ in joined:
                    kept += words[at : max(at, begin)]
                    at = max(at, end)
                kept += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                factors.append(len(joined))
                spans.append([{"begin": b, "end": e, "source": s, "source_begin": p} for b, e, s, p in joined])
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()), pa.array(factors, pa.int32()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("source", pa.int64()), ("source_begin", pa.int32())])))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "n_factors", "factors"])

    return cut


def parse_factors(found: list, window: int) -> list[tuple[int, int, int, int]]:
    """Greedy left-to-right parse of (begin, n_windows, source, source_begin): each factor goes on while the source does. Rows (begin, end, source, source_begin)."""
    out: list[list[int]] = []
    for x in sorted((f["begin"], f["n_windows"], f["source"], f["source_begin"]) for f in found):
        begin, n, source, at = x
        end = begin + n - 1 + window
        last = out[-1] if out else None
        if last and last[2] == source and at - last[3] == begin - last[0] and begin <= last[1]:
            last[1] = max(last[1], end)
        elif not last or end > last[1]:
            out.append([begin, end, source, at])
    return [tuple(x) for x in out]


def _each_place(*columns: str) -> Column:
    """All places of a group's rows: begin and the columns named."""
    return F.flatten(F.collect_list(F.transform("begins", lambda begin: F.struct(begin.alias("begin"), *columns))))


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, version (hash of the text), begins, n_windows, source, source_begin: so many windows from each of those places stand in a document with a smaller id, too."""
    texts = C.text_frame(docs, F.xxhash64("text").alias("version")).where("doc_id IS NOT NULL")
    blocks = C.keep(texts.mapInArrow(_blocks(window, gram), BLOCKS), "blocks")
    shared = blocks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    blocks_shared = C.keep(C.split_join(blocks, shared, ["anchor"], "n", blocks.count(), "left_semi"), "shared-blocks")
    n_shared = blocks_shared.count()
    place = F.struct("doc_id", F.col("begins")[0].alias("begin"))
    classes = C.keep(blocks_shared.groupBy("anchor", "block").agg(F.min(place).alias("first"), F.count("*").alias("n")), "block-classes")
    C.forget(blocks)
    source = [F.col("first.doc_id").alias("source"), F.col("first.begin").alias("source_begin")]
    marked = C.split_join(blocks_shared, classes.select("anchor", "block", *source, "n"), ["anchor", "block"], "n", n_shared)
    whole = marked.where("doc_id > source").select("doc_id", "version", "begins", "n_windows", "source", "source_begin")
    # Anchors with different blocks: in the first document of each block, the windows are looked up.
    several = classes.groupBy("anchor").agg(F.sum("n").alias("n"), F.count("*").alias("blocks"), F.min("first.doc_id").alias("lo"), F.max("first.doc_id").alias("top")).where("blocks > 1 AND lo < top").select("anchor", "n")
    edges = C.split_join(marked.where("doc_id = source"), several, ["anchor"], "n", n_shared, "left_semi").groupBy("doc_id", "version").agg(_each_place("n_windows").alias("wanted"))
    at_edges = texts.join(edges, ["doc_id", "version"]).select("doc_id", "text", "version", "wanted").mapInArrow(_windows(window, gram), WINDOWS)
    at_edges = C.keep(at_edges, "edge-windows")
    firsts = at_edges.groupBy("anchor", "content").agg(F.min(F.struct("doc_id", "begin")).alias("first"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("hi > first.doc_id").select("anchor", "content", *source, "n")
    single = C.split_join(at_edges, firsts, ["anchor", "content"], "n", at_edges.count()).where("doc_id > source").select("doc_id", "version", F.array("begin").alias("begins"), F.lit(1).alias("n_windows"), "source", "source_begin")
    return whole.unionByName(single)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors, factors (begin, end, source, source_begin in words)."""
    # A document's factors are no more than its words.
    found = duplicate_spans(docs, window, gram).groupBy("doc_id", "version").agg(_each_place("n_windows", "source", "source_begin").alias("found"))
    texts = C.text_frame(docs, F.xxhash64("text").alias("version"))
    joined = texts.join(found, ["doc_id", "version"], "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_remove(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors int, factors array<struct<begin int, end int, source long, source_begin int>>")

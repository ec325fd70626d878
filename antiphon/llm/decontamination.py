"""Benchmark decontamination: rare n-gram seeds join passages to test items, then Smith-Waterman alignment scores them.

Texts are compared as words of lower-case letters and digits (ASCII capitals are lowered, ASCII marks are white space). A
passage's score is that of its local alignment with the item (2 for equal words, -1 for different ones and for a gap),
divided by that of a whole copy. The result is that of aligning every document with every item:

A seed is a pair of words, one or two places apart, of one or two places apart in the item. Between two matched words that follow
each other in an alignment lie errors; if at most one, the two are a seed, which starts at an item's word of its own. An alignment of
m matches and e errors scores 2m - e; were all but g of its m - 1 steps two errors long or more, e would be 2(m - 1 - g) or more,
and the score 2 + 2g at most. So a score of S takes g = (S - 2) / 2 seeds at least, and of any t of an item's n - 1 starts an alignment
has t - (n - 1 - g) at least. Document frequencies of all items' seeds are counted over the corpus; each item takes its
rarest starts, as many as are sure to have one hit, and all others that are rare in themselves, which raises the hits
that a candidate needs. So long common phrases cost nothing, and whichever words an edit broke makes no difference.

1. Scan: how many documents hold each seed. 2. Scan: where the chosen seeds stand; joined to the items by seed, and counted
by document and item. 3. Scan: the words around those hits, for documents with enough of them, which are aligned. A scan
tests seeds by a bitmap of BITS bits, the same size for any number of items; what passes by chance ends at the join.

Edge cases: null texts are empty. Items of fewer than `gram` words mark nothing (they can't be told from chance); items of
fewer than `least_words` words need a score of 1. Repeated rows are treated alike, also those of equal doc_id with different
texts (each for itself). Items with a null id count as one. Of items with equal scores the one with the least id is named. Empty
documents give an empty result; an empty benchmark marks nothing. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from antiphon.llm import _common as C

GRAM, LEAST_SCORE, LEAST_WORDS = 3, 0.5, 8
MATCH, DIFFERENT, GAP = 2, -1, -1
#: Bits of a bitmap (a power of 2), and the share of documents, and the number of them, up to which a seed is rare in itself.
BITS, RARE_SHARE, RARE_DOCS = 26, 1e-4, 10
#: Pairs of words so many places apart are seeds.
STEPS = (1, 2)
_WORD, _PAIR = C.Hashes(31), C.Hashes(37)


def _alphabet() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    for b in range(33, 127):
        if not chr(b).isalnum():
            out[b] = 32
    return out


_ALPHABET = _alphabet()


def _words(column: pa.Array) -> C.Words:
    return C.Words(column, _WORD, alphabet=_ALPHABET)


def _pairs(words: C.Words) -> tuple[np.ndarray, np.ndarray]:
    """Places in the batch's words, and the seed (signed) of each pair that begins there."""
    room, places, seeds = words.room(), [], []
    for step in STEPS:
        at = np.flatnonzero(room > step)
        places.append(at)
        seeds.append(_PAIR.join(words.hash[at], words.hash[at + step]))
    return np.concatenate(places), np.concatenate(seeds).view(np.int64)


def _of_rows(places: np.ndarray, words: C.Words) -> np.ndarray:
    return np.searchsorted(words.rows, places, "right") - 1


def _items(gram: int, least_score: float, least_words: int):
    """item_id, n, need (the score), sure (starts of which every alignment has one), reach (words of a document that an alignment spans at most), words, seeds."""

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed = pa.list_(pa.struct([("start", pa.int32()), ("seed", pa.int64())]))
        for batch in C.chunks(batches):
            words = _words(batch.column(1))
            places, pairs = _pairs(words)
            order = np.argsort(places, kind="stable")
            places, pairs = places[order], pairs[order]
            edge = np.searchsorted(places, words.rows)
            out = {k: [] for k in ("row", "n", "need", "sure", "reach", "words", "seeds")}
            for row in np.flatnonzero(np.diff(words.rows) >= max(2, gram)).tolist():
                first, n = int(words.rows[row]), int(words.rows[row + 1] - words.rows[row])
                need = (least_score if n >= least_words else 1.0) * MATCH * n
                seeded = math.ceil((need - 2) / 2 - 1e-9)
                if seeded < 1:
                    raise ValueError("so low a score can be reached without any seed")
                own = slice(edge[row], edge[row + 1])
                values = (row, n, need, n - seeded, math.ceil(3 * n - need), words.hash[first : first + n].tobytes(), [{"start": s - first, "seed": p} for s, p in zip(places[own].tolist(), pairs[own].tolist(), strict=True)])
                for k, v in zip(out, values, strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(out["row"], pa.int64())), pa.array(out["n"], pa.int64()), pa.array(out["need"], pa.float64()), pa.array(out["sure"], pa.int64()), pa.array(out["reach"], pa.int64()), pa.array(out["words"], pa.binary()), pa.array(out["seeds"], seed)],
                names=["item_id", "n", "need", "sure", "reach", "words", "seeds"])

    return items


def bitmap(numbers: DataFrame, column: str) -> np.ndarray:
    """A bit for each of 2^BITS values of a hash's first bits: whether any number begins so. 2^(BITS - 6) rows come to the driver at most."""
    at = F.shiftrightunsigned(column, 64 - BITS)
    rows = numbers.select(F.shiftright(at, 6).alias("word"), F.expr("1L").alias("one"), at.alias("at")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, cast(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return out


def held(bits: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    at = numbers.view(np.uint64) >> np.uint64(64 - (64 * len(bits)).bit_length() + 1)
    return ((bits.view(np.uint64)[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _frequencies(bits: np.ndarray):
    """seed, df (documents of the batch that hold it), for seeds that the bitmap has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            words = _words(batch.column(0))
            places, seeds = _pairs(words)
            some = held(bits, seeds)
            places, seeds = places[some], seeds[some]
            row = _of_rows(places, words)
            order = np.lexsort((row, seeds))
            row, seeds = row[order], seeds[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (seeds[1:] != seeds[:-1])
            seeds, df = np.unique(seeds[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(df)], ["seed", "df"])

    return count


def _hits(bits: np.ndarray):
    """doc_id, version, seed, place (in the document's words)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            words = _words(batch.column(1))
            places, seeds = _pairs(words)
            some = held(bits, seeds)
            places, seeds = places[some], seeds[some]
            row = _of_rows(places, words)
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(2).take(rows), pa.array(seeds), pa.array(places - words.rows[row])], ["doc_id", "version", "seed", "place"])

    return find


def _word_rows(bits: np.ndarray):
    """doc_id, version, words of the documents whose version the bitmap has."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            some = batch.filter(pa.array(held(bits, batch.column(2).to_numpy())))
            for part in C.chunks(iter([some])):
                words = _words(part.column(1))
                own = [words.hash[a:b].tobytes() for a, b in zip(words.rows[:-1], words.rows[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(own, pa.binary())], ["doc_id", "version", "words"])

    return take


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """The best local alignment's score, and the place in the passage where it ends (exclusive)."""
    step = np.arange(len(passage)) * -GAP
    above, best, end = np.zeros(len(passage) + 1, np.int64), 0, 0
    for word in item:
        cell = np.maximum(np.maximum(above[:-1] + np.where(passage == word, MATCH, DIFFERENT), above[1:] + GAP), 0)
        cell = np.maximum.accumulate(cell + step) - step
        at = int(cell.argmax())
        if cell[at] > best:
            best, end = int(cell[at]), at + 1
        above[1:] = cell
    return best, end


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From doc_id, version, first, passage, item_id, n, need, words."""
    for batch in batches:
        good, scores, ends = [], [], []
        columns = [batch.column(i).to_pylist() for i in range(2, 8)]
        for k, (first, passage, _, n, need, words) in enumerate(zip(*columns, strict=True)):
            item, passage = np.frombuffer(words, np.uint64), np.frombuffer(passage, np.uint64)
            if np.isin(item, passage).sum() * MATCH >= need:
                score, last = align(item, passage)
                if score >= need:
                    good.append(k)
                    scores.append(score / (MATCH * n))
                    ends.append(first + last)
        rows = pa.array(good, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), batch.column(4).take(rows), pa.array(scores, pa.float64()), pa.array(ends, pa.int64())], names=["doc_id", "version", "item_id", "score", "end_word"])


def chosen_starts(items: DataFrame, texts: DataFrame) -> DataFrame:
    """item, hits (that a candidate needs), start, seeds: each item's rarest starts."""
    seeds = items.select("item", "sure", F.explode("seeds").alias("s")).select("item", "sure", "s.start", "s.seed")
    df = texts.select("text").mapInArrow(_frequencies(bitmap(seeds, "seed")), "seed long, df long").groupBy("seed").agg(F.sum("df").alias("df"))
    df = C.keep(df.join(seeds.select("seed").distinct(), "seed", "left_semi"), "seed-frequencies")
    rare = max(RARE_DOCS, RARE_SHARE * texts.count())
    starts = seeds.join(df, "seed", "left").groupBy("item", "sure", "start").agg(F.sum(F.coalesce("df", F.lit(0))).alias("df"), F.collect_set("seed").alias("seeds"))
    order = Window.partitionBy("item").orderBy("df", "start")
    taken = starts.withColumn("place", F.row_number().over(order)).where((F.col("place") <= F.col("sure")) | (F.col("df") <= rare))
    return taken.withColumn("hits", F.count("*").over(Window.partitionBy("item")) - F.col("sure") + 1).select("item", "hits", "start", "seeds")


def candidates(items: DataFrame, texts: DataFrame) -> DataFrame:
    """doc_id, version, item, lo, hi: documents with enough starts of an item, and the places of the first and last of them."""
    chosen = C.keep(chosen_starts(items, texts), "chosen-seeds")
    by_seed = chosen.select("item", "hits", "start", F.explode("seeds").alias("seed"))
    hits = C.keep(texts.mapInArrow(_hits(bitmap(by_seed, "seed")), "doc_id long, version long, seed long, place long"), "seed-hits")
    n_hits = hits.count()
    # What the bitmap lets through by chance has no row here; frequent seeds are joined by broadcast.
    index = by_seed.groupBy("seed").agg(F.collect_list(F.struct("item", "hits", "start")).alias("of"))
    index = index.join(hits.groupBy("seed").agg(F.count("*").alias("n")), "seed")
    joined = C.split_join(hits, index, ["seed"], "n", n_hits).select("doc_id", "version", "place", F.explode("of").alias("x"))
    starts = joined.groupBy("doc_id", "version", "x.item", "x.hits", "x.start").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
    found = starts.groupBy("doc_id", "version", "item", "hits").agg(F.count("*").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return found.where(F.col("n") >= F.col("hits")).select("doc_id", "version", "item", "lo", "hi")


def contaminated_passages(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, least_score: float = LEAST_SCORE, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, version (hash of the text), item_id, score, end_word for every document and item whose score reaches least_score."""
    texts = C.text_frame(docs, F.xxhash64("text").alias("version"))
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    kinds = "item_id long, n long, need double, sure long, reach long, words binary, seeds array<struct<start int, seed long>>"
    items = C.keep(tests.mapInArrow(_items(gram, least_score, least_words), kinds).withColumn("item", F.monotonically_increasing_id()), "test-items")
    found = C.keep(candidates(items, texts), "alignment-candidates")
    n_found = found.count()
    words = texts.mapInArrow(_word_rows(bitmap(found.select("version"), "version")), "doc_id long, version long, words binary").dropDuplicates(["doc_id", "version"])
    reach = items.select("item", "reach")
    counts = found.groupBy("item").agg(F.count("*").alias("times"))
    placed = C.split_join(found, reach.join(counts, "item"), ["item"], "times", n_found).alias("f")
    own = words.alias("w")
    both = placed.join(own, F.col("f.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("f.version") == F.col("w.version")))
    first = F.greatest(F.col("f.lo") - F.col("f.reach"), F.lit(0))
    passage = F.substring(F.col("w.words"), (first * 8 + 1).cast("int"), ((F.col("f.hi") + F.col("f.reach") + 3 - first) * 8).cast("int"))
    # Kept, as the split join reads them twice, and the documents' words are far more than the passages.
    passages = C.keep(both.select("f.doc_id", "f.version", F.col("f.item").alias("item"), first.alias("first"), passage.alias("passage")), "passages")
    sized = items.select("item", "item_id", "n", "need", F.col("words").alias("item_words")).join(counts, "item")
    whole = C.split_join(passages, sized, ["item"], "times", n_found).select("doc_id", "version", "first", "passage", "item_id", "n", "need", "item_words")
    return whole.mapInArrow(_align, "doc_id long, version long, item_id long, score double, end_word long")


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """doc_id, n_items, item_id (of the best score, then the least id), score, contaminated, for every row of docs."""
    hits = C.keep(contaminated_passages(docs, benchmark, **how), "contaminated")
    best = hits.distinct().groupBy("doc_id", "version").agg(F.countDistinct(F.struct("item_id")).alias("n_items"), F.max(F.struct("score", (-F.col("item_id")).alias("less"))).alias("best"))
    own = C.text_frame(docs, F.xxhash64("text").alias("version")).select("doc_id", "version").alias("a")
    joined = own.join(best.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.version") == F.col("b.version")), "left")
    return joined.select("a.doc_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), (-F.col("best.less")).alias("item_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"), F.col("n_items").isNotNull().alias("contaminated"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how: float) -> DataFrame:
    """The rows of docs, all their columns, that hold no test item.

    A null or empty text holds none and stays. Equal rows share their fate; different texts of one doc_id, or of none, are judged
    each for itself. An empty benchmark takes nothing out; empty documents give an empty result.
    """
    hits = C.keep(contaminated_passages(docs, benchmark, **how).select("doc_id", "version").distinct(), "contaminated")
    return C.without(docs, hits, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))

"""Near duplicates by SimHash, for documents whose five-word shingles have a Jaccard similarity of 0.8 or more.

Distinct texts are nodes. Candidates come from SimHashes in two ways, and only exact comparisons of shingle sets make links.

1. Whole fingerprints, 64 bits: the vantage-point tree of simhash.links() finds those at most MOST bits apart. At a similarity
of 0.8 they differ in about 10 bits, far beyond what triangle bounds can prune (a tree would have to visit every leaf: random
points lie 32 bits apart, give or take 4), so the tree alone can't find all.
2. Short fingerprints, BANDS of each text: SimHashes of SAMPLED shingles, those least under as many orders (which is min-hash
banding). A pair at 0.8 has equal samples in a band with probability 0.51, in none of 20 with less than one in a million; its
whole fingerprints are more than FAR bits apart, which ends a candidate, about as seldom (once in 200,000 for texts of four or
five shingles, less for longer ones). In each bucket all texts are held against at most REPRESENTATIVES of them (the first and
last node and others drawn by hash), so the number of candidates is linear in a bucket's size, and no pairs within a group are
made. In buckets of up to REPRESENTATIVES + 1 texts every pair is looked at so; larger ones whose texts these links don't join
into one group are then cut into cells of about CELL texts, and the shingle sets of every two texts that are not joined yet
are compared, cell by cell. A cell returns a forest of the links it finds, never all pairs. So every pair with a short
fingerprint in common is either compared or in one group already. The work in a large bucket that stays apart is quadratic in
its size, the memory is not.

Of each group one row stays: that of the smallest doc_id (null last), of equal ids that with the smaller digest of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm.components import components
from antiphon.llm.simhash import MOST, Forest
from antiphon.llm.simhash import links as tree_links

SHINGLE, LEAST = 5, 0.8
BANDS, SAMPLED, REPRESENTATIVES, FAR = 20, 3, 4, 26
#: Documents of a large bucket on either side of a comparison, about; shingles whose holders are multiplied at a time.
CELL, COLUMNS = 1_024, 4_096


class _Shingles:
    def __init__(self, size: int):
        self.size, self.of_word = size, C.Hashes(61)
        self.orders = np.random.default_rng(63).integers(1 << 62, 1 << 63, BANDS * SAMPLED).astype(np.uint64) | np.uint64(1)

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the distinct shingles, and where each row's begin, with the end at last. A row of fewer words has one, an empty row one as well."""
        words = C.Words(column, self.of_word)
        counts = np.diff(words.rows)
        begin = np.flatnonzero(words.room() >= self.size)
        hashes, row = [self.of_word.runs(words.hash, self.size)[begin], np.zeros(int((counts == 0).sum()), np.uint64)], [words.row_of()[begin], np.flatnonzero(counts == 0)]
        for n in range(1, self.size):
            short = np.flatnonzero(counts == n)
            if len(short):
                hashes.append(self.of_word.runs(words.hash, n)[words.rows[short]])
                row.append(short)
        hashes, row = np.concatenate(hashes), np.concatenate(row)
        order = np.lexsort((hashes, row))
        hashes, row = hashes[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
        return hashes[new], np.searchsorted(row[new], np.arange(len(counts) + 1))

    def signatures(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Whole fingerprint, and the short ones, of each row."""
        hashes, at = self.of(column)
        begin = at[:-1]
        least = [np.minimum.reduceat(hashes * order, begin) for order in self.orders]
        bands = np.stack([C.mix((a & b) | (a & c) | (b & c)) for a, b, c in zip(*(least[k::SAMPLED] for k in range(SAMPLED)))], 1)
        whole = np.zeros(len(begin), np.uint64)
        sizes = np.diff(at)
        for bit in range(64):
            ones = np.add.reduceat(((hashes >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), begin)
            whole |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
        return whole, bands


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(size)
        for batch in C.chunks(batches):
            whole, bands = shingles.signatures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), C.signed(whole), pa.FixedSizeListArray.from_arrays(C.signed(np.ascontiguousarray(bands).ravel()), BANDS).cast(pa.list_(pa.int64()))], names=["doc_id", "digest", "fp", "bands"])

    return sign


def _sets(size: int):
    """Each row's distinct shingles, as sorted 32-bit hashes."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = _Shingles(size)
        for batch in C.chunks(batches):
            hashes, at = shingles.of(batch.column(1))
            own = [np.unique((hashes[a:b] >> np.uint64(32)).astype("<u4")).tobytes() for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    return sets


def _compare(least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                common = 0
                if min(len(x), len(y)) >= least * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= least * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good))

    return compare


def common_shingles(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of x shares with each of y."""
    out = np.zeros((len(x), len(y)), np.float32)
    sides = []
    both = np.intersect1d(np.concatenate(x), np.concatenate(y))
    for sets in (x, y):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(0, len(both) - 1))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), bool)
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row[hit][order]))
    for first in range(0, len(both), COLUMNS):
        parts = []
        for (at, row), sets in zip(sides, (x, y)):
            a, b = np.searchsorted(at, (first, first + COLUMNS))
            part = np.zeros((len(sets), min(COLUMNS, len(both) - first)), np.float32)
            part[row[a:b], at[a:b] - first] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _compare_cells(least: float):
    """Links between the groups (roots) of a pair of cells: a spanning forest of them."""

    def compare(table: pa.Table) -> pa.Table:
        roots, label = np.unique(table.column("root").to_numpy(), return_inverse=True)
        own = table.column("own").to_numpy()
        inside = bool((table.column("ci").to_numpy() == table.column("cj").to_numpy()).all())
        found: list[tuple[int, int]] = []
        if len(roots) > 1:
            sets = [np.frombuffer(x, "<u4") for x in table.column("shingles").to_pylist()]
            sizes, forest = np.array([len(x) for x in sets]), Forest(len(roots))
            left = np.flatnonzero(own == table.column("ci").to_numpy())
            right = left if inside else np.flatnonzero(own == table.column("cj").to_numpy())
            # By size, so that blocks whose sizes lie too far apart need no look.
            left, right = left[np.argsort(sizes[left], kind="stable")], right[np.argsort(sizes[right], kind="stable")]
            for i in range(0, len(left), CELL // 4):
                x = left[i : i + CELL // 4]
                for j in range(0, len(right), CELL // 4):
                    y = right[j : j + CELL // 4]
                    if (inside and j < i) or sizes[x[-1]] < least * sizes[y[0]] or sizes[y[-1]] < least * sizes[x[0]]:
                        continue
                    now = forest.roots()[label]
                    if (now[x] == now[x[0]]).all() and (now[y] == now[x[0]]).all():
                        continue
                    common = common_shingles([sets[k] for k in x], [sets[k] for k in y])
                    near = (common >= least * (sizes[x][:, None] + sizes[y][None, :] - common) - 1e-9) & (now[x][:, None] != now[y][None, :])
                    for a, b in zip(*np.nonzero(near)):
                        if forest.join(label[x[a]], label[y[b]]):
                            found.append((label[x[a]], label[y[b]]))
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({k: pa.array(roots[pairs[:, i]]) for i, k in enumerate("ab")})

    return compare


def large_buckets(signed: DataFrame, n_texts: int) -> DataFrame:
    """node, band, key, n: the texts of buckets in which not every pair has a representative."""
    rows = signed.select("node", F.posexplode("bands").alias("band", "key"))
    large = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where(F.col("n") > REPRESENTATIVES + 1)
    return C.split_join(rows, large.withColumn("size", F.col("n")), ["band", "key"], "size", BANDS * n_texts).select("node", "band", "key", "n")


def joined_in_buckets(members: DataFrame, linked: DataFrame, sets: DataFrame, least: float, cell: int) -> DataFrame:
    """linked (node, root) with the groups joined whose texts have a link in a large bucket."""
    rooted = members.join(linked.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = C.keep(rooted, "members")
    apart = rooted.groupBy("band", "key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "key", "size")
    h = F.ceil(F.col("n") / cell)
    cells = C.split_join(rooted, apart, ["band", "key"], "size", rooted.count()).withColumn("own", F.pmod(F.xxhash64("node"), h))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), h - 1)))
    cells = cells.select("node", "root", "band", "key", "own", F.least("own", "other").alias("ci"), F.greatest("own", "other").alias("cj")).join(sets, "node")
    new = components(cells.groupBy("band", "key", "ci", "cj").applyInArrow(_compare_cells(least), "a long, b long"))
    new = C.keep(new, "joined")
    C.forget(rooted)
    every = C.keep(linked.select("node", "root").union(new.select("node", F.col("node").alias("root"))).distinct(), "rooted")
    counts = every.groupBy("root").agg(F.count("*").alias("n"))
    top = new.select(F.col("node").alias("root"), F.col("root").alias("top")).join(counts, "root")
    return C.split_join(every, top, ["root"], "n", every.count(), "left").select("node", F.coalesce("top", "root").alias("root"))


def _digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def candidates(signed: DataFrame, n_texts: int) -> DataFrame:
    """Pairs (a, b) of nodes, a < b, that share a short fingerprint with a representative of the bucket."""
    rows = signed.select("node", "fp", F.posexplode("bands").alias("band", "key"))
    me, order = F.struct("node", "fp"), lambda k: F.xxhash64("node", "band", F.lit(k))
    heads = [F.min(me), F.max(me), *(F.min(F.struct(order(k).alias("o"), "node", "fp")).alias(f"h{k}") for k in range(REPRESENTATIVES - 2))]
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n"), heads[0].alias("r0"), heads[1].alias("r1"), *heads[2:]).where("n > 1")
    reps = F.array(F.col("r0"), F.col("r1"), *(F.struct(F.col(f"h{k}.node").alias("node"), F.col(f"h{k}.fp").alias("fp")) for k in range(REPRESENTATIVES - 2)))
    buckets = buckets.select("band", "key", F.array_distinct(reps).alias("reps"), "n")
    pairs = C.split_join(rows, buckets, ["band", "key"], "n", BANDS * n_texts).select("node", "fp", F.explode("reps").alias("r"))
    pairs = pairs.where((F.col("node") != F.col("r.node")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("r.fp"))) <= FAR))
    return pairs.select(F.least("node", "r.node").alias("a"), F.greatest("node", "r.node").alias("b"))


def tree_candidates(signed: DataFrame, n_texts: int) -> DataFrame:
    """Pairs (a, b) of nodes, a < b: one node of each fingerprint with all others of it, and with that of each fingerprint that the tree links to it."""
    points = C.keep(signed.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("n")), "points")
    same = points.where("n > 1").select("fp", F.col("head").alias("a"), "n")
    equal = C.split_join(signed.select("fp", F.col("node").alias("b")), same, ["fp"], "n", n_texts).where("a < b").select("a", "b")
    heads = lambda x, y: points.select(F.col("fp").alias(x), F.col("head").alias(y))
    near = tree_links(points, MOST).join(heads("a", "x"), "a").join(heads("b", "y"), "b")
    return equal.union(near.select(F.least("x", "y"), F.greatest("x", "y")))


def groups(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST, cell: int = CELL) -> DataFrame:
    """doc_id, digest, stays: a row for each distinct (doc_id, text)."""
    texts = C.text_frame(docs, _digest(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("digest"))
    signed = C.keep(texts.mapInArrow(_sign(shingle), "doc_id long, digest binary, fp long, bands array<long>"), "signatures")
    # One row for each text, numbered; as it's kept, the numbers stay.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    distinct = signed.groupBy("digest").agg(first, F.any_value("fp").alias("fp"), F.any_value("bands").alias("bands"))
    distinct = C.keep(distinct.select("digest", F.col("first.doc_id").alias("first"), "fp", "bands", F.monotonically_increasing_id().alias("node")), "distinct")
    n_texts = distinct.count()
    pairs = C.keep(candidates(distinct, n_texts).union(tree_candidates(distinct, n_texts)).distinct(), "candidates")
    members = C.keep(large_buckets(distinct, n_texts), "large-buckets")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(members.select("node")).distinct()
    chosen = distinct.join(wanted, "node", "left_semi").select("node", F.col("first"), F.col("digest").alias("own"))
    sets = texts.join(chosen, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("digest") == F.col("own"))).select("node", "text").mapInArrow(_sets(shingle), "node long, shingles binary").groupBy("node").agg(F.any_value("shingles").alias("shingles"))
    sets = C.keep(sets, "shingle-sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b").select("a", "b", "x", "y")
    linked = components(both.mapInArrow(_compare(least), "a long, b long"))
    linked = C.keep(joined_in_buckets(members, linked, sets, least, cell), "linked")
    C.forget(pairs, sets, members)
    rooted = distinct.select("node", "digest", "first").join(linked, "node", "left").select("digest", "first", F.coalesce("root", "node").alias("root"))
    keeper = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("keeper"), F.count("*").alias("n"))
    stays = C.split_join(rooted, keeper, ["root"], "n", n_texts).where("digest = keeper.digest").select("digest", "first", F.lit(True).alias("kept"))
    out = signed.select("doc_id", "digest").distinct().join(stays, "digest", "left")
    return out.select("doc_id", "digest", (F.col("kept").isNotNull() & F.col("doc_id").eqNullSafe(F.col("first"))).alias("stays"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """The rows of docs, all their columns, that stay: one of each group of near duplicates, that of the smallest doc_id.

    A null text is an empty one; all texts without words are copies of each other. A row with a null doc_id stays only if no
    row of its group has an id. Different texts of one doc_id are judged each for itself; of rows equal in doc_id and text one
    stays. An empty table gives an empty result.
    """
    decided = C.keep(groups(docs, shingle, least), "groups")
    leave = decided.where("NOT stays").select("doc_id", "digest")
    kept = C.without(docs, leave, _digest(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    if decided.count() != docs.count():
        name = C.free_name(docs, "_digest")
        kept = kept.withColumn(name, _digest(F.coalesce(F.col("text").cast("string"), F.lit("")))).dropDuplicates(["doc_id", name]).drop(name)
    return kept

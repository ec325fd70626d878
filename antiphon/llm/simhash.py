"""Near duplicates by SimHash, with links found in vantage-point trees.

Fingerprints have 64 bits: a bit is 1 if it's set in over half of the XXH64 hashes (seed 42) of the text's word shingles.
Equal fingerprints are one point. A vantage-point tree, built on the driver from a sample of at most SAMPLE points, splits the
space by Hamming distance: at each node, points within the radius of the vantage point go left and the others right. A point's
home is one leaf. By the triangle inequality, two points within `most` bits of each other that part at a node lie within
`most` of its radius, so the left one of them visits the right side, too; all other branches are pruned. Every leaf, with its
visitors, is a shard in which the pairs are compared exactly; a leaf with more than CELL points is cut into cells of so many
at most. A shard returns a spanning forest of its links, never all pairs; components of these are found by stars.

Edge cases: a null text has no words; a text without words has fingerprint zero, one with fewer words than a shingle is one
shingle. Such fingerprints are linked like any other. Repeated rows share their fingerprint and component. A null doc_id is
never a component's id, unless no row of the component has another. Other columns are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm.components import components

SHINGLE, MOST, SEED = 3, 2, 42
#: Points the tree is built from, points in a leaf that it aims at, and points on either side of a cell at most.
SAMPLE, LEAF, CELL = 65_536, 4_096, 16_384
_BITS = 1 << 18  # hashes whose bits are counted at a time


def shingle_hashes(text: str, size: int, lower: bool = True) -> np.ndarray:
    words = C.split_words(text.translate(_LOWER) if lower else text)
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends, at = [], -1
    for word in words:
        at += len(word) + 1
        ends.append(at)
    begins = [0, *(x + 1 for x in ends[: len(words) - size])]
    return np.fromiter((digest(line[b:e], SEED) for b, e in zip(begins, ends[size - 1 :])), np.uint64, len(begins))


_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(hashes: np.ndarray) -> int:
    """As a signed 64-bit number."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BITS):
        part = hashes[at : at + _BITS]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp."""

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in C.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(shingle_hashes(x, shingle)) for x in batch.column(1).to_pylist()], pa.int64())], names=["doc_id", "fp"])

    return C.text_frame(docs).mapInArrow(hash_all, "doc_id long, fp long")


def bits_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Tree:
    """A vantage-point tree over points of 64 bits. Nodes are rows of (radius, left, right); a child below 0 is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.vantage: list[int] = []
        self.nodes: list[list[int]] = []
        self.n_leaves = 0
        least = max(2, len(sample) // max(1, leaves))
        todo = [(sample, -1, 0)]
        while todo:
            points, parent, side = todo.pop()
            split = self._split(points, draw) if len(points) > least else None
            if split is None:
                here = -1 - self.n_leaves
                self.n_leaves += 1
            else:
                point, radius, left = split
                here = len(self.nodes)
                self.vantage.append(point)
                self.nodes.append([radius, 0, 0])
                todo += [(points[left], here, 1), (points[~left], here, 2)]
            if parent >= 0:
                self.nodes[parent][side] = here

    @staticmethod
    def _split(points: np.ndarray, draw: np.random.Generator) -> tuple[int, int, np.ndarray] | None:
        """The candidate whose median ball has the fewest points near its edge."""
        some = points[draw.integers(0, len(points), 512)] if len(points) > 512 else points
        best = None
        for v in points[draw.integers(0, len(points), 12)]:
            far = bits_apart(some, v).astype(np.int64)
            radius = int(np.median(far))
            if radius >= far.max():
                radius -= 1
            inside = (far <= radius).mean()
            if not 0.02 < inside < 0.98:
                continue
            near = ((far > radius - MOST) & (far <= radius + MOST)).mean() / min(inside, 1 - inside)
            if best is None or near < best[0]:
                best = near, v, radius
        if best is None:
            return None
        left = bits_apart(points, best[1]) <= best[2]
        return (int(best[1]), best[2], left) if left.any() and not left.all() else None

    def route(self, points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the point, leaf, and whether it's the point's home, for every leaf it has to be in."""
        todo = [(0 if self.nodes else -1, np.arange(len(points)), np.ones(len(points), bool))]
        found = []
        while todo:
            node, index, home = todo.pop()
            if not len(index):
                continue
            if node < 0:
                found.append((index, np.full(len(index), -1 - node), home))
                continue
            radius, left, right = self.nodes[node]
            far = bits_apart(points[index], np.uint64(self.vantage[node])).astype(np.int64)
            inside = far <= radius
            to_left = np.where(home, inside, far - most <= radius)
            to_right = np.where(home, ~inside | (far + most > radius), far + most > radius)
            todo.append((left, index[to_left], home[to_left]))
            todo.append((right, index[to_right], home[to_right] & ~inside[to_right]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))


class Forest:
    """Union-find over places of an array."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True

    def roots(self) -> np.ndarray:
        while (self.up[self.up] != self.up).any():
            self.up = self.up[self.up]
        return self.up


def close_pairs(seekers: np.ndarray, holders: np.ndarray, most: int, block: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(seekers), block):
        i, j = np.nonzero(bits_apart(seekers[at : at + block, None], holders[None, :]) <= most)
        yield i + at, j


def links(points: DataFrame, most: int = MOST, sample: int = SAMPLE, leaf: int = LEAF, cell: int = CELL) -> DataFrame:
    """From a table of distinct fp: a, b, a spanning forest (in parts) of the pairs at most so many bits apart."""
    n = points.count()
    # At most `sample` numbers, whatever the input; which ones is fixed by their hash.
    drawn = points.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    tree = Tree(np.array([r.fp for r in drawn], np.int64).view(np.uint64), -(-n // leaf))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy()
            index, leaf_of, home = tree.route(fp.view(np.uint64), most)
            yield pa.RecordBatch.from_arrays([pa.array(fp[index]), pa.array(leaf_of.astype(np.int64)), pa.array(home.astype(bool))], names=["fp", "leaf", "home"])

    routed = C.keep(points.select("fp").mapInArrow(route, "fp long, leaf long, home boolean"), "routed")
    sizes = routed.groupBy("leaf").agg(F.ceil(F.sum(F.col("home").cast("long")) / cell).alias("h"), F.ceil(F.count("*") / cell).alias("s"), F.count("*").alias("n"))
    pick = lambda n: F.pmod(F.xxhash64("fp"), n)
    wide = C.split_join(routed, sizes, ["leaf"], "n", routed.count())
    # Every point seeks in all cells of its leaf's home points; home points are held once for each cell of seekers.
    seek = wide.where("h > 0").select("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("h") - 1)).alias("ch"), pick(F.col("s")).alias("cs"), "fp", F.lit(False).alias("holds"))
    hold = wide.where("home").select("leaf", pick(F.col("h")).alias("ch"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("s") - 1)).alias("cs"), "fp", F.lit(True).alias("holds"))

    def compare(table: pa.Table) -> pa.Table:
        fp, holds = table.column("fp").to_numpy(), table.column("holds").to_numpy(zero_copy_only=False)
        points, place = np.unique(fp.view(np.uint64), return_inverse=True)
        seekers, holders = np.unique(place[~holds]), np.unique(place[holds])
        forest, out = Forest(len(points)), []
        for i, j in close_pairs(points[seekers], points[holders], most):
            x, y = seekers[i], holders[j]
            roots = forest.roots()
            apart = roots[x] != roots[y]  # pairs that are joined already need no look
            out += [p for p in zip(x[apart].tolist(), y[apart].tolist()) if forest.join(*p)]
        pairs = np.array(out, np.int64).reshape(-1, 2)
        return pa.table({k: pa.array(points[pairs[:, i]].view(np.int64)) for i, k in enumerate("ab")})

    return seek.unionByName(hold).groupBy("leaf", "ch", "cs").applyInArrow(compare, "a long, b long")


def simhash(docs: DataFrame, shingle: int = SHINGLE, most: int = MOST, **tree: int) -> DataFrame:
    """doc_id, fingerprint (hex), component_id (the smallest doc_id that links lead to)."""
    own = C.keep(fingerprints(docs, shingle), "fingerprints")
    points = C.keep(own.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "points")
    linked = components(links(points, most, **tree)).withColumnRenamed("node", "fp")
    linked = C.keep(linked.join(points.drop("n"), "fp"), "linked")
    least = linked.groupBy("root").agg(F.min("first").alias("component"), F.count("*").alias("n"))
    rooted = C.split_join(linked, least, ["root"], "n", linked.count()).select("fp", "component")
    names = points.join(rooted, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"), "n")
    return C.split_join(own, names, ["fp"], "n", own.count()).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

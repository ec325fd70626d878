"""Greedy selection of directions: in order of rank, a vector is kept unless it's too close to one kept before.

This is the lexicographically first maximal independent set of the graph that joins vectors whose absolute cosine exceeds a
limit. It's found in rounds. In each, the first BLOCK undecided vectors are decided one after the other, as many as one task may
hold; all others that no undecided vector of a better rank is close to are kept as well; and what is close to a vector kept goes.
Who is close to whom comes from a Gram join: both sides are dealt into blocks of about BLOCK vectors, every pair of blocks is one
task's product of two matrices, and of it only the left vectors that are close to any on the right come out, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import vectors as V
from antiphon.operators.kept import forget, keep
from antiphon.operators.ranks import numbered, placed

#: Vectors of a block. A product of blocks is made in slabs of SLAB rows.
BLOCK, SLAB = 4096, 512


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(n, -1)


def serial(places: np.ndarray, vectors: np.ndarray, most_cosine: float) -> np.ndarray:
    """Which rows of a block are kept, in the order of their places."""
    kept: list[int] = []
    held = np.zeros_like(vectors)
    for i in np.argsort(places):
        n = len(kept)
        if not n or np.abs(held[:n] @ vectors[i]).max() <= most_cosine:
            held[n] = vectors[i]
            kept.append(int(i))
    return np.array(kept, np.int64)


def _far_from(chosen: np.ndarray, most_cosine: float):
    """Lets through what isn't close to any of a block's vectors."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(batch.schema.get_field_index("v")), batch.num_rows)
                yield batch.filter(pa.array(np.abs(v @ chosen.T).max(axis=1) <= most_cosine))

    return far


def _close(left: DataFrame, right: DataFrame, n_left: int, n_right: int, most_cosine: float) -> DataFrame:
    """place of left's rows that are close to a row of right with a smaller place."""
    lefts, rights = max(1, -(-n_left // BLOCK)), max(1, -(-n_right // BLOCK))
    block = lambda n: F.pmod(F.xxhash64("place"), F.lit(n).cast("long"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    a = left.select("place", "v", block(lefts).alias("i"), every(rights).alias("j"))
    b = right.select("place", "v", every(lefts).alias("i"), block(rights).alias("j"))

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        places, found = np.zeros(0, np.int64), np.zeros(0, bool)
        if x.num_rows and y.num_rows:
            places, others = x.column("place").to_numpy(), y.column("place").to_numpy()
            v, w = _matrix(x.column("v"), x.num_rows), _matrix(y.column("v"), y.num_rows)
            found = np.concatenate([((np.abs(v[k : k + SLAB] @ w.T) > most_cosine) & (others < places[k : k + SLAB, None])).any(axis=1) for k in range(0, len(v), SLAB)])
        return pa.table({"place": places[found]})

    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(compare, "place long").distinct()


def distinct_directions(df: DataFrame, key: str, vector: str, order: list[Column], limit: int | None = None, most_cosine: float = 0.995) -> DataFrame:
    """key, rank (from 1): the first `limit` kept of df's rows (all without a limit). One that is left out keeps no other out.

    Vectors that aren't finite, or have next to no length, are never kept. Equal ranks go by key.
    """
    spark = df.sparkSession
    named = {f"_o{i}": c for i, c in enumerate(order)}
    usable = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"), *(c.alias(n) for n, c in named.items())).where(V.finite(F.col("v")) & (V.norm(F.col("v")) > V.LEAST_NORM))
    ranked = placed(usable, [*named, "key"], "ranked-directions", "key", V.unit(F.col("v")).alias("v"))
    undecided, kept, steps = ranked, [], []
    while True:
        n = undecided.count()
        head = undecided.orderBy("place").limit(BLOCK).select("place", "v", "key").toArrow()
        if not n:
            break
        places, v = head.column("place").to_numpy(), _matrix(head.column("v"), head.num_rows)
        first = serial(places, v, most_cosine)
        kept.append(spark.createDataFrame(head.select(["key", "place"]).take(pa.array(first)), ranked.select("key", "place").schema))
        have = sum(k.count() for k in kept) if limit is not None else 0
        rest = keep(undecided.where(F.col("place") > int(places.max())).mapInArrow(_far_from(v[first], most_cosine), ranked.schema), "undecided-directions") if n > len(places) else None
        steps.append(undecided)
        undecided = rest
        if rest is None or (limit is not None and have >= limit and _below(kept, rest) >= limit):
            break
        if limit is None or limit - have > BLOCK:
            n = rest.count()
            behind = keep(_close(rest, rest, n, n, most_cosine), "directions-behind")
            fresh = keep(rest.join(behind, "place", "left_anti").select(*ranked.columns), "directions-kept")
            later = keep(rest.join(behind, "place", "left_semi").select(*ranked.columns), "undecided-directions")
            # A row close to one kept now has the worse rank of the two: the other had none before it.
            out = keep(_close(later, fresh, later.count(), fresh.count(), most_cosine), "directions-out")
            undecided = keep(later.join(out, "place", "left_anti").select(*ranked.columns), "undecided-directions")
            kept.append(fresh.select("key", "place"))
            steps += [rest, behind, later, out]
    every = kept[0] if kept else ranked.select("key", "place").limit(0)
    for k in kept[1:]:
        every = every.unionByName(k)
    every = keep(every.orderBy("place").limit(limit) if limit is not None else every, "directions")
    forget(ranked, *steps, *(s for s in [undecided] if s is not None))
    return numbered(every).select(F.col("key").alias(key), "rank")


def _below(kept: list[DataFrame], rest: DataFrame) -> int:
    """How many of those kept have a better rank than all that are undecided."""
    least = rest.agg(F.min("place")).first()[0]
    return sum((k if least is None else k.where(F.col("place") < least)).count() for k in kept)

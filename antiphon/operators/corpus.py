"""Preparing text pools: first and last of a key, overlap, splits, samples, sequences."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Numbers of the ordering column that ranked() numbers in one task at most.
SPAN = 1 << 16


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The least value of `order` for each key, and how many rows have the key. Keys are shuffled as hashes, and a hot one is combined before."""
    best = df.groupBy(F.sha2(key, 256).alias("_key")).agg(F.min(order).alias(order), F.count("*").alias("copies"))
    return best.drop("_key")


def ranked(df: DataFrame, key: str, order: str, name: str = "rn") -> DataFrame:
    """df with each row's number, from 1, among those with its key, in the order of a column of whole numbers.

    A key's rows are numbered in spans of the ordering column, each a group of its own, from the counts of the spans before: a
    key that a third of all rows have is no single task's work.
    """
    span = F.floor(F.col(order) / SPAN)
    counts = df.groupBy(F.col(key).alias("_k"), span.alias("_s")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("_k", "_s", before.alias("_before"))
    own = df.withColumn("_own", span).withColumn("_at", F.row_number().over(W.partitionBy(key, "_own").orderBy(order)))
    both = own.join(bases, F.col(key).eqNullSafe(F.col("_k")) & F.col("_own").eqNullSafe(F.col("_s")))
    return both.withColumn(name, F.col("_at") + F.col("_before")).drop("_own", "_at", "_k", "_s", "_before")


def last_write(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def hash_order(seed: str, key: Column) -> Column:
    """A fixed random order that any engine can compute."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), key.cast("string")), 256)


def hash_sample(df: DataFrame, seed: str, key: str, n: int) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def hash_split(key: Column, seed: str, shares: dict[str, float]) -> Column:
    """A split by the first 32 bits of the key's hash: a row's split depends on nothing else, so no order over the table is needed."""
    at = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    upto, out = 0.0, None
    for name, share in list(shares.items())[:-1]:
        upto += share
        below = at < int(upto * (1 << 32))
        out = F.when(below, name) if out is None else out.when(below, name)
    last = list(shares)[-1]
    return F.lit(last) if out is None else out.otherwise(last)


def shared_sample(sizes: list[int], wanted: list[int], seed: int) -> list[list[int]]:
    """Indices drawn without replacement from several pools by one generator, in the pools' order."""
    rng = random.Random(seed)
    return [rng.sample(range(n), k) for n, k in zip(sizes, wanted)]


def shared_sample_of(df: DataFrame, pool: str, order: str, n: int, seed: int) -> DataFrame:
    """pool, order, place (in the sample): n rows of each pool (all of a smaller one), drawn by one generator over the pools in their order. place and source_at tell where a row stands in the sample and in its pool. Pools are few."""
    sizes = {r[0]: r[1] for r in df.groupBy(pool).count().orderBy(pool).collect()}
    drawn = shared_sample(list(sizes.values()), [min(n, m) for m in sizes.values()], seed)
    picks = [(name, k, at) for name, own in zip(sizes, drawn) for k, at in enumerate(own)]
    table = df.sparkSession.createDataFrame(picks, f"{pool} string, place int, source_at int")
    return ranked(df.select(pool, order), pool, order).withColumn("source_at", (F.col("rn") - 1).cast("int")).join(table, [pool, "source_at"]).select(pool, order, "place", "source_at")


def balanced_slots(domains: int, slots: int, seed: int) -> list[tuple[int, int, str]]:
    """(domain, slot, split): domain d holds out the shuffled slots 2d, 2d + 1 for validation, and those half a round on for test."""
    order = list(range(slots))
    random.Random(seed).shuffle(order)
    out = []
    for d in range(domains):
        for at, split in ((2 * d, "validation"), (2 * d + 1, "validation"), (2 * d + slots // 2, "test"), (2 * d + slots // 2 + 1, "test")):
            out.append((d, order[at % slots], split))
    return out


def at_most_each(df: DataFrame, group: str, order: list[Column], n: int) -> DataFrame:
    """n rows of each group at most. Spark keeps only the n best of a partition's groups before the shuffle (a group limit)."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")

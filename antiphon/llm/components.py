"""Connected components by alternating large and small stars, each round a few aggregations and joins over the links only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C


def _with_least(links: DataFrame, n_links: int) -> DataFrame:
    """a, b, m: the least neighbour of each link's a. No task gets all links of a hub."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return C.split_join(links, least, ["a"], "n", n_links).select("a", "b", "m")


def _large_star(links: DataFrame, n_links: int) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = _with_least(both, 2 * n_links)
    return near.where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(links: DataFrame, n_links: int) -> DataFrame:
    down = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    near = _with_least(down, n_links)
    return near.select(F.when(F.col("b") != F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """From links (a, b) of longs: node, root (the least node it's joined with), for each node of a link between different nodes.

    A round shrinks every component's depth; it ends when a round changes nothing. Each round is written to the shared folder
    and the one before it deleted, so that the lineage stays short and no round is lost with an executor.
    """
    now = C.keep(links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    # As sums of hashes modulo 2^64 could not overflow quietly, they are taken as decimals.
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = mark(now)
    while before[0]:
        after = C.keep(_small_star(_large_star(now, before[0]), before[0]), "links")
        C.forget(now)
        now, last, before = after, before, mark(after)
        if last == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()

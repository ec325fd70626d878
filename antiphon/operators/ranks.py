"""Order over a whole table, without a task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from antiphon.operators.kept import keep

#: Bits of a place below the number of its partition.
ROW_BITS = 33


def placed(df: DataFrame, order: list[str], name: str, *columns: Column | str) -> DataFrame:
    """The columns named (all without any) and place, a whole number that grows in the order of df's rows. Kept, so that places stay what they are."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return keep(ranged.select(*(columns or ("*",)), F.monotonically_increasing_id().alias("place")), name)


def numbered(df: DataFrame, rank: str = "rank") -> DataFrame:
    """A table of placed(), or some of its rows, with each row's number from 1 instead of its place: only counts by partition must be summed in order."""
    part = F.shiftright("place", ROW_BITS)
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = df.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    own = df.withColumn("_part", part).withColumn("_at", F.row_number().over(W.partitionBy("_part").orderBy("place")))
    # As many rows as partitions.
    return own.join(F.broadcast(counts), "_part").withColumn(rank, F.col("_at") + F.col("_before")).drop("_part", "_at", "_before", "place")


def _by_part(df: DataFrame, key: str, over: Column, before: Column) -> DataFrame:
    """df with _part and _before: a value by key and partition, made from the key's partitions before that one. A key has a row for each partition it lies in."""
    own = df.withColumn("_part", F.shiftright("place", ROW_BITS))
    parts = own.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(over.alias("_v"))
    told = parts.select("_k", "_p", before.over(W.partitionBy("_k").orderBy("_p").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    return own.join(told, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p"))).drop("_k", "_p")


def numbered_by(df: DataFrame, key: str, name: str = "rn") -> DataFrame:
    """A table of placed(), ordered by key first, with each row's number from 1 among those of its key. A key's rows are numbered by partition, from the counts of those before."""
    own = _by_part(df, key, F.count("*"), F.sum("_v"))
    at = F.row_number().over(W.partitionBy(key, "_part").orderBy("place"))
    return own.withColumn(name, at + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def carried(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A table of placed(), ordered by key first, with the last value of the key that isn't null, up to each row and its own included."""
    own = _by_part(df, key, F.max_by(value, F.when(F.col(value).isNotNull(), F.col("place"))), F.last("_v", ignorenulls=True))
    last = F.last(value, ignorenulls=True).over(W.partitionBy(key, "_part").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    return own.withColumn(name, F.coalesce(last, "_before")).drop("_part", "_before")


def previous(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A table of placed(), ordered by key first, with the value of the key's row before; null for its first."""
    own = _by_part(df, key, F.max_by(F.struct(F.col(value).alias("x")), "place"), F.last("_v", ignorenulls=True))
    w = W.partitionBy(key, "_part").orderBy("place")
    return own.withColumn(name, F.when(F.row_number().over(w) > 1, F.lag(value).over(w)).otherwise(F.col("_before.x"))).drop("_part", "_before")


def counts_before(df: DataFrame, key: str, time: str, width: int, name: str) -> DataFrame:
    """df with how many rows of the key lie less than `width` before each, in whole numbers of time, but not at the same one.

    Time is cut into stretches of that width. A row counts for its own stretch and the next one, so all that any row must see is in its
    stretch, and a key with many rows is as many groups as it has stretches.
    """
    own = F.floor(F.col(time) / width)
    both = df.withColumn("_s", F.explode(F.array(F.struct(own.alias("at"), F.lit(True).alias("own")), F.struct((own + 1).alias("at"), F.lit(False).alias("own")))))
    w = W.partitionBy(key, "_s.at").orderBy(time).rangeBetween(-(width - 1), -1)
    return both.withColumn(name, F.count("*").over(w)).where("_s.own").drop("_s")

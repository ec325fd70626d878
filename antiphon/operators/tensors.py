"""Rank-one edits of matrices, banks, snapshots and diagnostic offsets, over tables with a vector a row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import vectors as V

#: Places of a snapshot at the beginning, around the middle, and at the end.
SAMPLED = 8


def unit_weights(df: DataFrame, group: str, weight: str) -> DataFrame:
    """df with the weights of each group as a unit vector over its rows."""
    length = df.groupBy(F.col(group).alias("_g")).agg(F.sqrt(F.sum(F.col(weight) * F.col(weight))).alias("_n"))
    return df.join(length, F.col(group) == F.col("_g")).withColumn(weight, F.col(weight) / F.col("_n")).drop("_g", "_n")


def _along(rows: DataFrame, matrix: str, vector: str, weight: str, size: int) -> DataFrame:
    """matrix, c: what each column has along the direction of weights; one accumulator a column."""
    return V.mix_by(rows, [matrix], vector, weight, size).select(F.col(matrix).alias("_m"), F.col("mix").alias("c"))


def edit_columns(rows: DataFrame, matrix: str, vector: str, weight: str, size: int) -> DataFrame:
    """rows with every column of each matrix projected off the unit direction that the weights of its rows are (axis 0).

    All columns' components are taken from the unedited matrix, in one aggregation that combines rows before its shuffle.
    """
    along = _along(rows, matrix, vector, weight, size)
    edited = F.zip_with(vector, "c", lambda x, c: x - F.col(weight) * c)
    return rows.join(along, F.col(matrix) == F.col("_m")).withColumn(vector, edited).drop("_m", "c")


def edit_report(rows: DataFrame, matrix: str, vector: str, weight: str, size: int) -> DataFrame:
    """matrix, along_before, share_after: the length of what lies along the direction before the edit, and after it over the matrix's."""
    square = lambda c: V.total(F.transform(c, lambda x: x * x))
    before = _along(rows, matrix, vector, weight, size).select("_m", F.sqrt(square("c")).alias("along_before"))
    after = _along(edit_columns(rows, matrix, vector, weight, size), matrix, vector, weight, size).select(F.col("_m").alias("_n"), F.sqrt(square("c")).alias("_after"))
    length = rows.groupBy(F.col(matrix).alias("_l")).agg(F.sqrt(F.sum(square(vector))).alias("_length"))
    out = before.join(after, F.col("_m") == F.col("_n")).join(length, F.col("_m") == F.col("_l"))
    return out.select(F.col("_m").alias(matrix), "along_before", F.try_divide("_after", "_length").alias("share_after"))


def row_edit_report(rows: DataFrame, matrix: str, vector: str, direction: str) -> DataFrame:
    """The same for rows that are each projected off a unit direction (axis 1)."""
    square = lambda c: V.total(F.transform(c, lambda x: x * x))
    edited = rows.withColumn("_e", V.project_out(F.col(vector), F.col(direction)))
    before, after = V.dot(F.col(vector), F.col(direction)), V.dot(F.col("_e"), F.col(direction))
    sums = edited.groupBy(matrix).agg(F.sqrt(F.sum(before * before)).alias("along_before"), F.sqrt(F.sum(after * after)).alias("_after"), F.sqrt(F.sum(square(vector))).alias("_length"))
    return sums.select(matrix, "along_before", F.try_divide("_after", "_length").alias("share_after"))


def at_layer(layer: Column, wanted: int, vector: Column, change: Callable[[Column], Column]) -> Column:
    return F.when(layer == wanted, change(vector)).otherwise(vector)


def bank(cells: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, vector: one for each cell; raises where a cell has more."""
    one = cells.groupBy(*keys).agg(F.count("*").alias("_n"), F.any_value(vector).alias(vector))
    single = F.when(F.col("_n") == 1, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("several vectors for "), F.concat_ws(",", *keys))).cast("boolean"))
    return one.where(single).drop("_n")


def snapshot(vector: Column, sampled: int = SAMPLED) -> Column:
    """(at, x) of the first, middle and last places, each place once."""
    n, half = F.size(vector), sampled // 2
    span = lambda a, b: F.when(b > a, F.sequence(a, b - 1)).otherwise(F.array().cast("array<int>"))
    middle = F.floor(n / 2).cast("int")
    places = F.concat(span(F.lit(0), F.least(F.lit(sampled), n)), span(F.greatest(F.lit(0), middle - half), F.least(n, middle + half)), span(F.greatest(F.lit(0), n - sampled), n))
    return F.transform(F.array_sort(F.array_distinct(places)), lambda i: F.struct(i.alias("at"), F.get(vector, i).alias("x")))


def offset_variants(rows: DataFrame, first: Column, direct: str, step: str) -> DataFrame:
    """rows with variant and x: the vectors or their steps, and both with the first layer as zero."""
    zero = lambda c: F.when(first, F.transform(c, lambda x: F.lit(0.0))).otherwise(F.col(c))
    kinds = (("direct", F.col(direct)), ("direct zero first", zero(direct)), ("steps", F.col(step)), ("steps zero first", zero(step)))
    own = [c for c in rows.columns if c not in (direct, step)]
    return rows.select(*own, F.inline(F.array(*(F.struct(F.lit(name).alias("variant"), x.alias("x")) for name, x in kinds))))


def prefix_logprob(rows: DataFrame, keys: list[str], logits: str, target: str) -> DataFrame:
    """keys, tokens, logprob: the mean over places of the target id's log-probability."""
    own = F.element_at(V.log_softmax(F.col(logits)), (F.col(target) + 1).cast("int"))
    return rows.groupBy(*keys).agg(F.count("*").alias("tokens"), F.avg(own).alias("logprob"))

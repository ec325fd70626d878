"""Vector functions as columns over arrays, in double precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions.let import let

LEAST_NORM = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(total(F.transform(v, lambda x: x * x)))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def unit(v: Column) -> Column:
    """Null for vectors without direction."""
    return let(norm(v), lambda n: F.when(finite(v) & (n > LEAST_NORM), F.transform(v, lambda x: x / n)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def add(a: Column, b: Column, factor: Column | float = 1.0) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * factor)


def project_out(v: Column, direction: Column) -> Column:
    """v without its part along a unit direction."""
    return let(dot(v, direction), lambda d: F.zip_with(v, direction, lambda x, u: x - d * u))


def log_softmax(v: Column) -> Column:
    level = let(F.array_max(v), lambda top: top + F.log(total(F.transform(v, lambda y: F.exp(y - top)))))
    return let(level, lambda n: F.transform(v, lambda x: x - n))


def divergence(reference: Column, current: Column) -> Column:
    """Kullback-Leibler, from logits."""
    p, q = log_softmax(reference), log_softmax(current)
    return total(F.zip_with(p, q, lambda a, b: F.exp(a) * (a - b)))


def warped_draw(logits: Column, uniform: Column, k: int, temperature: float = 1.0) -> Column:
    """From 1: a place drawn from the softmax of the k largest logits (with all that equal the k-th), by inverting its sums at `uniform`."""

    def draw(x: Column) -> Column:
        least, top = F.get(F.sort_array(x, asc=False), F.least(F.lit(k), F.size(x)) - 1), F.array_max(x)
        return let(F.transform(x, lambda y: F.when(y >= least, F.exp(y - top)).otherwise(0.0)), lambda p: place(p, total(p)))

    def place(p: Column, whole: Column) -> Column:
        begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))

        def step(s: Column, y: Column) -> Column:
            return F.struct((s["sum"] + y).alias("sum"), F.when(s["sum"] / whole > uniform, s["at"]).otherwise(s["at"] + 1).alias("at"))

        return F.aggregate(p, begin, step)["at"]

    return let(F.transform(logits, lambda y: y / temperature), draw)


def argmax(v: Column) -> Column:
    """From 1; of equals the first."""
    return F.array_position(v, F.array_max(v))


def close(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    return F.abs(a - b) <= F.greatest(relative * F.greatest(F.abs(a), F.abs(b)), F.lit(absolute))


def mix_by(df: DataFrame, keys: list[str], vector: str, factor: str, size: int) -> DataFrame:
    """keys, mix: the sum of vectors, each times its row's factor; one accumulator a dimension."""
    return df.groupBy(*keys).agg(F.array(*(F.sum(F.col(vector)[i] * F.col(factor)) for i in range(size))).alias("mix"))


def mean_by(df: DataFrame, keys: list[str], vector: str, size: int) -> DataFrame:
    """keys, mean (array), n: one pass with partial aggregation, an accumulator for each dimension; no vector is exploded."""
    means = F.array(*(F.avg(F.col(vector)[i].cast("double")) for i in range(size)))
    return df.groupBy(*keys).agg(means.alias("mean"), F.count("*").alias("n"))

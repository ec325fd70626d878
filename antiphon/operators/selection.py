"""Screening candidates: guards, rankings, the winner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import vectors as V
from antiphon.operators.corpus import ranked


def usable(layer: Column, layers: int, vector: Column, depth: float = 0.8) -> Column:
    return (layer < depth * layers) & V.finite(vector) & (V.norm(vector) > V.LEAST_NORM)


def rank(df: DataFrame, *order: Column, n: int) -> DataFrame:
    """The first n in a full order. A top-n in every partition, then one of those."""
    return df.orderBy(*order).limit(n)


def increments(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id, label, v, step: a vector less the one before it in its label (of the first, less nothing).

    Ids are ranked alone; then each vector goes to its own place and to the next one, so that no label is one task's work.
    """
    places = ranked(vectors.select("vec_id", "label"), "label", "vec_id").select("vec_id", "rn")
    placed = vectors.join(places, "vec_id")
    sides = placed.select("label", "rn", F.struct("vec_id", "v").alias("now"), F.lit(None).cast("array<double>").alias("past")).union(placed.select("label", F.col("rn") + 1, F.lit(None).cast("struct<vec_id:bigint,v:array<double>>"), "v"))
    both = sides.groupBy("label", "rn").agg(F.max("now").alias("now"), F.max("past").alias("past")).where("now IS NOT NULL")
    step = V.subtract(F.col("now.v"), F.coalesce("past", F.array_repeat(F.lit(0.0), size)))
    return both.select("now.vec_id", "label", "now.v", step.alias("step"))


def generated_guards(base: dict[str, Column], now: dict[str, Column]) -> Column:
    """Strictly fewer refusals, no more degenerate answers, none of either added, no probe lost, no unexpected reasoning."""
    return (now["refusals"] < base["refusals"]) & (now["degenerate"] <= base["degenerate"]) & (now["added_refusals"] == 0) & (now["added_degenerate"] == 0) & (now["lost_probes"] == 0) & (now["unexpected"] == 0)


def metrics(df: DataFrame, *keys: str) -> DataFrame:
    """n, refusals, rate (null where there are no rows), empty, degenerate, from boolean columns refusal, empty, degenerate."""
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if("refusal").alias("refusals"), F.count_if("empty").alias("empty"), F.count_if("degenerate").alias("degenerate"))
    return out.withColumn("rate", F.round(F.try_divide("refusals", "n"), 6))

"""Condition grids, scores, and the decisions about matched pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from antiphon.functions import text as T
from antiphon.operators.corpus import ranked


def condition_grid(traits: DataFrame, pairs: DataFrame, seed: int) -> DataFrame:
    """trait, pair, question, polarity, contrast_id, response_id, seed: every combination. The dimensions are tables of a few dozen rows that an experiment is planned from."""
    polarity = F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("polarity")
    grid = traits.crossJoin(pairs).select("trait", "pair", "question", polarity)
    contrast = F.concat_ws(":", "trait", "pair", "question", F.lit("0"))
    key = F.concat_ws("|", F.lit(str(seed)), "trait", "pair", "question", F.lit("0"), "polarity")
    return grid.withColumns({"contrast_id": contrast, "response_id": F.concat_ws(":", contrast, "polarity"), "seed": T.stable_seed(key)})


def candidate_grid(spark: SparkSession, layers: int, positions: int, depth: float = 0.8) -> DataFrame:
    """candidate_id, layer, position (from the end, negative) of the layers below that share of the depth."""
    grid = spark.range(layers).select(F.col("id").alias("layer"), F.explode(F.sequence(F.lit(-positions).cast("long"), F.lit(-1).cast("long"))).alias("position"))
    name = F.concat(F.lit("pre_l"), F.lpad(F.col("layer").cast("string"), 2, "0"), F.lit("_p"), F.col("position").cast("string"))
    return grid.where(F.col("layer") < depth * layers).select(name.alias("candidate_id"), "layer", "position")


def with_scores(responses: DataFrame, scores: DataFrame, key: str = "doc_id", kinds: tuple[str, ...] = ("trait", "coherence")) -> DataFrame:
    """A column for each kind of score; null where there is none."""
    wide = scores.groupBy(key).agg(*(F.max(F.when(F.col("kind") == k, F.col("score"))).alias(k) for k in kinds))
    return responses.join(wide, key, "left")


def pending(planned: DataFrame, seen: DataFrame, key: str, done: Column | None = None) -> DataFrame:
    """What is planned and not done. Without `done` whatever was seen is done, errors included."""
    return planned.join(seen if done is None else seen.where(done), key, "left_anti")


def exclusion_reasons() -> Column:
    """Codes against one response, in a fixed order, from columns status, response, refusal, unexpected_thinking, has_content."""
    blank = F.coalesce(T.strip(F.col("response")) == "", F.lit(True))
    rules = ((~F.col("status").eqNullSafe("complete"), "generation_error"), (blank, "empty_response"), (F.col("refusal"), "refusal"), (F.col("unexpected_thinking"), "unexpected_thinking"), (~F.col("has_content"), "no_content_tokens"))
    return F.array_compact(F.array(*(F.when(rule, code) for rule, code in rules)))


def matched_reasons(positive: Column, negative: Column) -> Column:
    """Codes against a pair, from structs of reasons, trait, coherence. Where any of the four scores is missing, no threshold is looked at."""
    scores = positive["trait"], negative["trait"], positive["coherence"], negative["coherence"]
    missing = F.greatest(*(s.isNull().cast("int") for s in scores)) == 1
    rules = ((scores[0] <= 50, "positive_trait_not_above_50"), (scores[1] >= 50, "negative_trait_not_below_50"), (F.least(scores[2], scores[3]) < 50, "coherence_below_50"))
    limits = F.array_compact(F.array(*(F.when(rule, code) for rule, code in rules)))

    def prefixed(side: Column, name: str) -> Column:
        return F.transform(side["reasons"], lambda x: F.concat(F.lit(f"{name}:"), x))

    sides = prefixed(positive, "positive"), prefixed(negative, "negative")
    return F.concat(*sides, F.when(missing, F.array(F.lit("missing_judge_score"))).otherwise(limits))


def class_consistent(degenerate: Column, thinks: Column, refusal: Column, harmful: Column) -> Column:
    return ~degenerate & ~thinks & (refusal == harmful)


def terms(text: Column, names: tuple[str, ...]) -> Column:
    """Those of the names that the text has as words, sorted."""
    return F.array_sort(F.filter(F.array(*map(F.lit, names)), lambda n: F.rlike(F.lower(text), F.concat(F.lit(r"(?U)\b"), n, F.lit(r"\b")))))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of both sides by key; raises where a key is on one side only."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer")
    message = F.concat(F.lit("on one side only: "), F.col(key).cast("string"))
    fine = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return both.where(fine).drop("_l", "_r")


def batch_order() -> list[Column]:
    """Positive conditions first, then by pair."""
    return [F.col("polarity") != "positive", F.col("pair")]


def zero_filled(dimension: DataFrame, counts: DataFrame, key: str, column: str = "n") -> DataFrame:
    return dimension.join(counts, key, "left").withColumn(column, F.coalesce(column, F.lit(0)))


def accepted_vector_pairs(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """grp, pos, neg: vectors of the n-th place of both classes of a group, if both are accepted (quality 1). One shuffle by place brings both sides together."""
    # Ids alone are ranked; the vectors of accepted ones come after.
    places = ranked(vectors.select("vec_id", "label"), "label", "vec_id").join(labels.where("quality = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    sides = vectors.select("vec_id", "embedding").join(places, "vec_id").groupBy(F.floor(F.col("label") / 2).alias("grp"), "rn").agg(*(F.max(F.when(F.col("label") % 2 == k, F.col("embedding"))).alias(name) for k, name in ((1, "pos"), (0, "neg"))))
    return sides.where("pos IS NOT NULL AND neg IS NOT NULL").select("grp", "pos", "neg")

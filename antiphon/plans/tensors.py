"""Matrices and banks of vectors: rank-one edits, draws, snapshots, diagnostics. A label's vectors stand for a matrix's rows or a trait's layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import vectors as V
from antiphon.operators import selection as S
from antiphon.operators import tensors as X
from antiphon.operators.corpus import ranked
from antiphon.plans.matching import DIM
from antiphon.plans.registry import Tables, query

_U = "x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings)"


def _vectors(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _by_dim(df: DataFrame, vector: Column, *keys: str, name: str = "x") -> DataFrame:
    rows = df.select(*keys, F.posexplode(vector).alias("_at", "_x"))
    return rows.select(*keys, (F.col("_at") + 1).cast("long").alias("dim"), F.round("_x", 7).alias(name))


@query(f"""WITH {_U}, w AS (SELECT vec_id, label, i, x / 0.7 AS x FROM x), k AS (SELECT vec_id, list_reverse_sort(list(x))[8] AS least, max(x) AS top FROM w GROUP BY vec_id),
p AS (SELECT vec_id, i, CASE WHEN x >= least THEN exp(x - top) ELSE 0 END AS p FROM w JOIN k USING (vec_id)), c AS (SELECT vec_id, i, sum(p) OVER (PARTITION BY vec_id ORDER BY i) / sum(p) OVER (PARTITION BY vec_id) AS c FROM p)
SELECT vec_id, min(i)::BIGINT AS drawn FROM c WHERE c > ('0x' || substr(sha256('9|' || vec_id), 1, 8))::BIGINT / 4294967296.0 GROUP BY vec_id""")
def g09_warped_draw(t: Tables) -> DataFrame:
    """A draw from each vector's eight largest logits (ties stay), by a uniform number from the row's own seed."""
    uniform = F.conv(F.substring(F.sha2(F.concat(F.lit("9|"), F.col("vec_id").cast("string")), 256), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return _vectors(t).select("vec_id", V.warped_draw(F.col("v"), uniform, 8, 0.7).cast("long").alias("drawn"))


_MATRIX = f"""{_U}, r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), u AS (SELECT vec_id, label, (rn % 5 + 1) / sqrt(sum((rn % 5 + 1) * (rn % 5 + 1)) OVER (PARTITION BY label)) AS u FROM r),
c AS (SELECT label, i, sum(x * u) AS c FROM x JOIN u USING (vec_id, label) GROUP BY ALL), e AS (SELECT label, vec_id, i, x, u, c, x - u * c AS y FROM x JOIN u USING (vec_id, label) JOIN c USING (label, i))"""


def _row_directions(t: Tables) -> DataFrame:
    """label, vec_id, u: a unit direction over the rows of each label's matrix."""
    raw = ranked(t("embeddings").select("vec_id", "label"), "label", "vec_id").select("vec_id", "label", (F.col("rn") % 5 + 1).cast("double").alias("u"))
    return X.unit_weights(raw, "label", "u")


@query(f"WITH {_MATRIX} SELECT vec_id, i AS dim, round(y, 7) AS x FROM e")
def k03_edited_columns(t: Tables) -> DataFrame:
    """Matrices without their part along a direction of the row space (axis 0): every column is projected."""
    return _by_dim(X.edit_columns(_vectors(t).drop("label").join(_row_directions(t), "vec_id"), "label", "v", "u", DIM), F.col("v"), "vec_id")


@query(f"""WITH {_MATRIX}, q AS (SELECT label, i, sum(y * u) AS left_over FROM e GROUP BY ALL), s AS (SELECT label, sum(c * c) AS before FROM c GROUP BY label), z AS (SELECT label, sum(left_over * left_over) AS after FROM q GROUP BY label), m AS (SELECT label, sum(x * x) AS energy FROM x GROUP BY label),
d AS (SELECT label, embedding AS d FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)), a AS (SELECT o.label, sum(list_dot_product(o.embedding::DOUBLE[], d::DOUBLE[]) * list_dot_product(o.embedding::DOUBLE[], d::DOUBLE[]) / list_dot_product(d::DOUBLE[], d::DOUBLE[])) AS before FROM embeddings o JOIN d USING (label) GROUP BY o.label)
SELECT 'matrix ' || label AS name, (label % 2)::INTEGER AS axis, round(sqrt(CASE WHEN label % 2 = 0 THEN s.before ELSE a.before END), 6) AS along_before, round(CASE WHEN label % 2 = 0 THEN sqrt(after / energy) ELSE 0 END, 6) AS share_after FROM s JOIN z USING (label) JOIN m USING (label) JOIN a USING (label)""")
def k04_edited_registry(t: Tables) -> DataFrame:
    """All matrices of a registry, each along its own axis: how much lay along the direction before, and what share does after."""
    rows = _vectors(t).join(_row_directions(t).drop("label"), "vec_id")
    first = rows.groupBy("label").agg(F.min_by("v", "vec_id").alias("d")).select("label", V.unit(F.col("d")).alias("d"))
    report = X.edit_report(rows.where("label % 2 = 0"), "label", "v", "u", DIM).withColumn("axis", F.lit(0)).unionByName(X.row_edit_report(rows.where("label % 2 = 1").join(first, "label"), "label", "v", "d").withColumn("axis", F.lit(1)))
    return report.select(F.concat(F.lit("matrix "), F.col("label").cast("string")).alias("name"), "axis", F.round("along_before", 6).alias("along_before"), F.round("share_after", 6).alias("share_after"))


@query(f"WITH {_U} SELECT vec_id, i AS dim, round(CASE WHEN label = 3 THEN x + 0.5 / 8 ELSE x END, 7) AS x FROM x")
def k05_layer_add(t: Tables) -> DataFrame:
    """A multiple of a unit direction, added at one layer only."""
    direction = F.array_repeat(F.lit(1 / 8), DIM)
    return _by_dim(_vectors(t), X.at_layer(F.col("label"), 3, F.col("v"), lambda v: V.add(v, direction, 0.5)), "vec_id")


@query(f"WITH {_U} SELECT label::BIGINT AS label, i AS dim, round(avg(x), 7) AS mean, count(*)::BIGINT AS n FROM x WHERE vec_id % 3 = 0 GROUP BY ALL")
def k13_selected_mean(t: Tables) -> DataFrame:
    """The mean over the chosen positions only."""
    means = V.mean_by(t("embeddings").where("vec_id % 3 = 0"), ["label"], "embedding", DIM)
    return _by_dim(means, F.col("mean"), "label", "n", name="mean").withColumn("label", F.col("label").cast("long"))


@query(f"WITH {_U} SELECT (vec_id // 6)::BIGINT AS layer, list_position([4, 0, 5, 2, 1, 3], (vec_id % 6)::INTEGER)::BIGINT - 1 AS trait_at, i AS dim, round(x, 7) AS x FROM x")
def k14_bank(t: Tables) -> DataFrame:
    """A bank of layers by traits, the traits in a stated order; two vectors for one cell are an error."""
    order = F.array(*map(F.lit, (4, 0, 5, 2, 1, 3)))
    cells = _vectors(t).select(F.floor(F.col("vec_id") / 6).alias("layer"), (F.array_position(order, (F.col("vec_id") % 6).cast("int")) - 1).alias("trait_at"), "v")
    return _by_dim(X.bank(cells, ["layer", "trait_at"], "v"), F.col("v"), "layer", "trait_at")


@query(f"""WITH {_U}, s AS (SELECT vec_id, i - 1 AS at, x FROM x WHERE i <= 8 OR i BETWEEN 29 AND 36 OR i > 56)
SELECT a.vec_id, count(*)::BIGINT AS sampled, bool_and(a.x = b.x) AS equal, round(sum(a.x), 6) AS checksum FROM s a JOIN s b ON b.vec_id = a.vec_id - a.vec_id % 2 AND a.at = b.at GROUP BY a.vec_id""")
def k16_snapshots(t: Tables) -> DataFrame:
    """Values at the first, middle and last eight places, held against the snapshot of the pair's first vector."""
    own = _vectors(t).select("vec_id", X.snapshot(F.col("v")).alias("s"))
    refs = own.where("vec_id % 2 = 0").select(F.col("vec_id").alias("ref"), F.col("s").alias("r"))
    both = own.join(refs, F.col("ref") == F.col("vec_id") - F.col("vec_id") % 2)
    return both.select("vec_id", F.size("s").cast("long").alias("sampled"), (F.col("s") == F.col("r")).alias("equal"), F.round(V.total(F.transform("s", lambda p: p["x"])), 6).alias("checksum"))


@query(f"""WITH {_U}, s AS (SELECT vec_id, label, i, x, x - lag(x, 1, 0) OVER (PARTITION BY label, i ORDER BY vec_id) AS step, row_number() OVER (PARTITION BY label, i ORDER BY vec_id) AS rn FROM x), v AS (SELECT *, unnest(['direct', 'direct zero first', 'steps', 'steps zero first']) AS variant FROM s)
SELECT variant, rn::BIGINT AS layer, i AS dim, round(sum((0.25 - 0.05 * label) * CASE WHEN variant LIKE '%zero first' AND rn = 1 THEN 0 WHEN variant LIKE 'direct%' THEN x ELSE step END), 6) AS x FROM v GROUP BY ALL""")
def k17_diagnostic_offsets(t: Tables) -> DataFrame:
    """Offsets of all layers by four variants: vectors as they are or their steps, and with the first layer as zero."""
    steps = ranked(t("embeddings").select("vec_id", "label"), "label", "vec_id", "layer").select("vec_id", "layer").join(S.increments(_vectors(t), DIM), "vec_id")
    variants = X.offset_variants(steps, F.col("layer") == 1, "v", "step").withColumn("c", 0.25 - 0.05 * F.col("label"))
    return _by_dim(V.mix_by(variants, ["variant", "layer"], "x", "c", DIM), F.transform("mix", lambda y: F.round(y, 6)), "variant", "layer")


@query(f"""WITH {_U}, l AS (SELECT vec_id, i, x - max(x) OVER (PARTITION BY vec_id) AS x FROM x), p AS (SELECT vec_id, max(CASE WHEN i = (vec_id * 5) % {DIM} + 1 THEN x END) - ln(sum(exp(x))) AS logprob FROM l GROUP BY vec_id)
SELECT (vec_id // 4)::BIGINT AS response, count(*)::BIGINT AS tokens, round(avg(logprob), 7) AS logprob FROM p WHERE vec_id % 4 < 1 + (vec_id // 4) % 4 GROUP BY 1""")
def e16_aligned_prefix(t: Tables) -> DataFrame:
    """Mean log-probability of a response's target ids: a vector of logits for each place, as many as the target has."""
    own = _vectors(t).select(F.floor(F.col("vec_id") / 4).alias("response"), (F.col("vec_id") % 4).alias("place"), "vec_id", "v")
    targets = own.select("response", "place", "vec_id", "v", ((F.col("vec_id") * 5) % DIM).alias("target")).where(F.col("place") < 1 + F.col("response") % 4)
    return X.prefix_logprob(targets, ["response"], "v", "target").select("response", "tokens", F.round("logprob", 7).alias("logprob"))

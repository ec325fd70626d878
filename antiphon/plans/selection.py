"""Candidates and vectors: guards, metrics, projections, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from antiphon.functions import text as T
from antiphon.functions import vectors as V
from antiphon.operators import directions as D
from antiphon.operators import selection as S
from antiphon.operators.corpus import ranked
from antiphon.plans.matching import DIM
from antiphon.plans.registry import Tables, query

_E = "e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_PAIR = f"{_E}, p AS (SELECT a.vec_id, a.label, a.v AS r, b.v AS c FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"
_SOFT = "list_transform({0}, lambda x: x - list_max({0}) - ln(list_sum(list_transform({0}, lambda y: exp(y - list_max({0}))))))"


def _vectors(t: Tables) -> DataFrame:
    return t("embeddings").select("vec_id", "label", V.doubles(F.col("embedding")).alias("v"))


def _neighbours(t: Tables) -> DataFrame:
    """Even ids with the vector of the next id: one aggregation by pair."""
    side = lambda k: F.max(F.when(F.col("vec_id") % 2 == k, F.struct("vec_id", "label", "v")))
    both = _vectors(t).groupBy(F.floor(F.col("vec_id") / 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.select("a.vec_id", "a.label", F.col("a.v").alias("r"), F.col("b.v").alias("c"))


@query(f"WITH {_E} SELECT vec_id FROM e WHERE label < 0.8 * 10 AND sqrt(list_sum(list_transform(v, lambda x: x * x))) > 1e-8")
def c07_candidate_pruning(t: Tables) -> DataFrame:
    return _vectors(t).where(S.usable(F.col("label"), 10, F.col("v"))).select("vec_id")


@query(f"WITH {_PAIR}, k AS (SELECT vec_id, r, list_sum(list_transform(list_zip({_SOFT.format('r')}, {_SOFT.format('c')}), lambda z: exp(z[1]) * (z[1] - z[2]))) AS kl FROM p) SELECT vec_id, round(kl, 8) AS kl, CASE WHEN kl < 0.015 THEN round(r[1], 8) END AS delta FROM k")
def c08_divergence_guard(t: Tables) -> DataFrame:
    """The costly score only where the guard lets through; null elsewhere."""
    k = _neighbours(t).withColumn("kl", V.divergence(F.col("r"), F.col("c")))
    return k.select("vec_id", F.round("kl", 8).alias("kl"), F.when(F.col("kl") < 0.015, F.round(F.col("r")[0], 8)).alias("delta"))


_GUARDED = {
    "base refusals": "l_returnflag = 'R' AND NOT odd", "now refusals": "l_returnflag = 'R' AND odd", "base degenerate": "l_tax > 0.06 AND NOT odd", "now degenerate": "l_tax > 0.06 AND odd",
    "now added_refusals": "odd AND l_returnflag = 'R' AND l_tax > 0.05", "now added_degenerate": "odd AND l_tax > 0.06 AND l_discount > 0.08", "now lost_probes": "odd AND l_quantity > 45", "now unexpected": "odd AND l_discount < 0.01 AND l_quantity < 5",
}


@query(f"""WITH o AS (SELECT *, l_linenumber % 2 = 1 AS odd FROM lineitem), c AS (SELECT l_orderkey, {', '.join(f'count_if({x}) AS "{k}"' for k, x in _GUARDED.items())} FROM o GROUP BY l_orderkey)
SELECT l_orderkey, "now refusals" < "base refusals" AND "now degenerate" <= "base degenerate" AND "now added_refusals" + "now added_degenerate" + "now lost_probes" + "now unexpected" = 0 AS passes FROM c""")
def c09_generated_guards(t: Tables) -> DataFrame:
    """Odd lines of an order stand for the answers now, even ones for those before."""
    g = t("lineitem").withColumn("odd", F.col("l_linenumber") % 2 == 1).groupBy("l_orderkey").agg(*(F.count_if(F.expr(x)).alias(k) for k, x in _GUARDED.items()))
    base, now = ({k.split()[1]: F.col(k) for k in _GUARDED if k.startswith(side)} for side in ("base", "now"))
    return g.select("l_orderkey", S.generated_guards(base, now).alias("passes"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.o_custkey, count_if(b.f AND NOT a.f)::BIGINT AS added, count_if(a.f AND NOT b.f)::BIGINT AS lost FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.rn = a.rn + 1 GROUP BY 1""")
def d09_added_and_lost(t: Tables) -> DataFrame:
    """Neighbouring answers in order, without a self-join."""
    w = W.partitionBy("o_custkey").orderBy("o_orderkey")
    f = F.col("o_orderstatus") == "F"
    pairs = t("orders").select("o_custkey", F.lag(f).over(w).alias("old"), f.alias("new")).where("old IS NOT NULL")
    return pairs.groupBy("o_custkey").agg(F.count_if(F.col("new") & ~F.col("old")).alias("added"), F.count_if(F.col("old") & ~F.col("new")).alias("lost"))


@query("""WITH RECURSIVE e AS MATERIALIZED (SELECT row_number() OVER (ORDER BY embedding[1], vec_id) AS rn, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
c AS MATERIALIZED (SELECT a.rn, list(b.rn) AS earlier FROM e a JOIN e b ON b.rn < a.rn AND abs(list_cosine_similarity(a.v, b.v)) > 0.3 GROUP BY a.rn),
g(rn, kept) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.rn + 1, CASE WHEN list_has_any(kept, coalesce(earlier, [])) THEN kept ELSE list_append(kept, g.rn + 1) END FROM g LEFT JOIN c ON c.rn = g.rn + 1 WHERE g.rn < (SELECT count(*) FROM e)),
k AS (SELECT unnest(kept) AS rn, generate_subscripts(kept, 1)::BIGINT AS rank FROM g WHERE g.rn = (SELECT count(*) FROM e))
SELECT vec_id, rank FROM k JOIN e USING (rn)""")
def d17_cosine_dedup(t: Tables) -> DataFrame:
    """All vectors in the order of their first value, each kept unless it is too close to one kept before."""
    return D.distinct_directions(_vectors(t), "vec_id", "v", [F.col("v")[0]], None, 0.3)


@query(r"""WITH d AS (SELECT d.lang, l.quality = 0 AS refusal, trim(text, e' \t\n\r') = '' AS empty, coalesce(l.toxic = 1, false) AS degenerate FROM documents d JOIN labels l USING (doc_id))
SELECT lang, count(*)::BIGINT AS n, count_if(refusal)::BIGINT AS refusals, count_if(empty)::BIGINT AS empty, count_if(degenerate)::BIGINT AS degenerate, round(count_if(refusal) / count(*), 6) AS rate FROM d GROUP BY lang""")
def e01_response_metrics(t: Tables) -> DataFrame:
    d = t("documents").join(t("labels"), "doc_id").select("lang", (F.col("quality") == 0).alias("refusal"), (T.strip(F.col("text")) == "").alias("empty"), (F.col("toxic") == 1).alias("degenerate"))
    return S.metrics(d, "lang")


@query(f"WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings) SELECT label::BIGINT AS label, i AS dim, round(avg(x), 9) AS mean, count(*)::BIGINT AS n FROM u GROUP BY label, i")
def e12_vector_means(t: Tables) -> DataFrame:
    means = V.mean_by(t("embeddings"), ["label"], "embedding", DIM)
    return means.select(F.col("label").cast("long"), "n", F.posexplode("mean").alias("at", "m")).select("label", (F.col("at") + 1).cast("long").alias("dim"), F.round("m", 9).alias("mean"), "n")


@query(f"""WITH {_PAIR}, m AS (SELECT label, list_sum(list_transform(list_zip({_SOFT.format('r')}, {_SOFT.format('c')}), lambda z: exp(z[1]) * (z[1] - z[2]))) AS kl, list_max(list_transform(list_zip(r, c), lambda z: abs(z[1] - z[2]))) AS far,
  list_sum(list_transform(list_zip(r, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS sq, list_position(r, list_max(r)) = list_position(c, list_max(c)) AS agree FROM p)
SELECT label::BIGINT AS label, round(avg(kl), 7) AS kl_mean, round(max(kl), 7) AS kl_max, round(sqrt(avg(sq) / {DIM}), 7) AS rms, round(max(far), 7) AS max_abs, count_if(agree)::BIGINT AS agreeing FROM m GROUP BY label""")
def e15_divergence_metrics(t: Tables) -> DataFrame:
    r, c = F.col("r"), F.col("c")
    gap = V.subtract(r, c)
    m = _neighbours(t).select("label", V.divergence(r, c).alias("kl"), F.array_max(F.transform(gap, F.abs)).alias("far"), V.total(F.transform(gap, lambda x: x * x)).alias("sq"), (V.argmax(r) == V.argmax(c)).alias("agree"))
    return m.groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.avg("kl"), 7).alias("kl_mean"), F.round(F.max("kl"), 7).alias("kl_max"), F.round(F.sqrt(F.avg("sq") / DIM), 7).alias("rms"), F.round(F.max("far"), 7).alias("max_abs"), F.count_if("agree").alias("agreeing"))


@query(f"WITH {_E} SELECT label::BIGINT AS label, round(avg({_SOFT.format('v')}[1 + vec_id % {DIM}]), 8) AS logprob FROM e GROUP BY label")
def e16_prefix_logprob(t: Tables) -> DataFrame:
    """Mean log-probability of a target id, that of the vector's id modulo the width."""
    own = F.element_at(V.log_softmax(F.col("v")), (F.col("vec_id") % DIM + 1).cast("int"))
    return _vectors(t).groupBy(F.col("label").cast("long").alias("label")).agg(F.round(F.avg(own), 8).alias("logprob"))


@query("SELECT l_suppkey, round(avg(l_extendedprice * (1 - l_discount) - l_extendedprice), 4) AS delta FROM lineitem GROUP BY l_suppkey")
def e17_mean_delta(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice")
    return t("lineitem").groupBy("l_suppkey").agg(F.round(F.avg(price * (1 - F.col("l_discount")) - price), 4).alias("delta"))


@query(f"WITH {_E} SELECT vec_id, label::BIGINT AS label, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 8) AS norm, bool_and(sqrt(list_sum(list_transform(v, lambda x: x * x))) = 0) OVER (PARTITION BY label) AS label_is_zero FROM e")
def e21_norms(t: Tables) -> DataFrame:
    """Zero vectors stay, and are told."""
    n = _vectors(t).withColumn("norm", V.norm(F.col("v")))
    zero = n.groupBy("label").agg(F.bool_and(F.col("norm") == 0).alias("label_is_zero"))
    return n.join(zero, "label").select("vec_id", F.col("label").cast("long"), F.round("norm", 8).alias("norm"), "label_is_zero")


@query(f"""WITH {_E}, u AS (SELECT label, v FROM e WHERE vec_id IN (SELECT min(vec_id) FROM e GROUP BY label)), d AS (SELECT e.label, list_dot_product(e.v, u.v) / sqrt(list_dot_product(u.v, u.v)) AS dot, list_dot_product(e.v, e.v) AS sq FROM e JOIN u USING (label))
SELECT label::BIGINT AS label, round(sum(dot * dot), 7) AS removed, round(sum(sq) - sum(dot * dot), 7) AS left_over, round(sum(sq), 7) AS energy FROM d GROUP BY label""")
def e25_projection_energy(t: Tables) -> DataFrame:
    """A matrix of rows without its part along a direction (the label's first vector): energies before and after."""
    e = _vectors(t)
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("d")).select("label", V.unit(F.col("d")).alias("u"))
    d = e.join(first, "label").withColumn("p", V.project_out(F.col("v"), F.col("u")))
    square = lambda c: V.total(F.transform(F.col(c), lambda x: x * x))
    g = d.groupBy("label").agg(F.sum(square("v")).alias("sq"), F.sum(square("p")).alias("rest"))
    return g.select(F.col("label").cast("long"), F.round(F.col("sq") - F.col("rest"), 7).alias("removed"), F.round("rest", 7).alias("left_over"), F.round("sq", 7).alias("energy"))


_STEPS = "s AS (SELECT vec_id, label, i, x, x - lag(x, 1, 0) OVER (PARTITION BY label, i ORDER BY vec_id) AS step FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1)::BIGINT AS i FROM embeddings))"


@query(f"WITH {_STEPS} SELECT vec_id, i AS dim, round(step, 8) AS step FROM s")
def f01_layer_increments(t: Tables) -> DataFrame:
    """Each vector less the one before it in its label; the first of a label counts from zero."""
    steps = S.increments(_vectors(t), DIM).select("vec_id", F.posexplode("step").alias("at", "s"))
    return steps.select("vec_id", (F.col("at") + 1).cast("long").alias("dim"), F.round("s", 8).alias("step"))


@query(f"""WITH {_STEPS}, t AS (SELECT label, i, count(*) AS n, sum(step) AS total, last(x ORDER BY vec_id) AS final FROM s GROUP BY ALL)
SELECT label::BIGINT AS label, max(n)::BIGINT AS n, bool_and(abs(total - final) <= greatest(1e-5 * greatest(abs(total), abs(final)), 1e-8)) AS telescopes, round(sum(total), 6) AS checksum FROM t GROUP BY label""")
def f17_telescoping(t: Tables) -> DataFrame:
    """The steps' sum is the last vector."""
    steps = S.increments(_vectors(t), DIM)
    g = steps.groupBy("label").agg(F.count("*").alias("n"), F.array(*(F.sum(F.col("step")[i]) for i in range(DIM))).alias("total"), F.max_by("v", "vec_id").alias("final"))
    return g.select(F.col("label").cast("long"), "n", F.forall(F.zip_with("total", "final", lambda a, b: V.close(a, b)), lambda x: x).alias("telescopes"), F.round(V.total(F.col("total")), 6).alias("checksum"))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_size < 10 ORDER BY p_retailprice, p_size, p_partkey LIMIT 24")
def g01_rank_cascade(t: Tables) -> DataFrame:
    return S.rank(t("part").where("p_size < 10"), F.col("p_retailprice"), F.col("p_size"), F.col("p_partkey"), n=24).select("p_partkey", "p_retailprice")


@query("SELECT l_suppkey, returns::BIGINT AS returns FROM (SELECT l_suppkey, count_if(l_returnflag = 'R') AS returns, avg(l_discount) AS d FROM lineitem GROUP BY 1) ORDER BY returns, round(d, 9), l_suppkey LIMIT 1")
def g03_winner(t: Tables) -> DataFrame:
    g = t("lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returns"), F.round(F.avg("l_discount"), 9).alias("d"))
    return S.rank(g, F.col("returns"), F.col("d"), F.col("l_suppkey"), n=1).select("l_suppkey", "returns")


@query("SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn <= 8")
def g05_first_of_class(t: Tables) -> DataFrame:
    w = W.partitionBy("l_suppkey").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    return t("lineitem").withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("l_orderkey", "l_linenumber")


@query(f"WITH {_PAIR} SELECT vec_id, round(list_reverse_sort(r)[1] - list_reverse_sort(r)[2], 8) AS margin, list_position(r, list_max(r)) = list_position(c, list_max(c)) AS agree FROM p")
def g07_top_two_margin(t: Tables) -> DataFrame:
    top = F.sort_array("r", asc=False)
    return _neighbours(t).select("vec_id", F.round(top[0] - top[1], 8).alias("margin"), (V.argmax(F.col("r")) == V.argmax(F.col("c"))).alias("agree"))


@query(f"WITH {_E} SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 8) AS first_unit, round(list_sum(list_transform(v, lambda x: x * x / list_dot_product(v, v))), 6) AS length FROM e")
def k01_unit_vectors(t: Tables) -> DataFrame:
    u = _vectors(t).withColumn("u", V.unit(F.col("v")))
    return u.select("vec_id", F.round(F.col("u")[0], 8).alias("first_unit"), F.round(V.norm(F.col("u")), 6).alias("length"))


@query(f"WITH {_PAIR} SELECT vec_id, round(list_dot_product(r, c) / sqrt(list_dot_product(c, c)), 8) AS along, round(r[1] - list_dot_product(r, c) / list_dot_product(c, c) * c[1], 8) AS first_left FROM p")
def k02_projection(t: Tables) -> DataFrame:
    p = _neighbours(t).withColumn("u", V.unit(F.col("c")))
    return p.select("vec_id", F.round(V.dot(F.col("r"), F.col("u")), 8).alias("along"), F.round(V.project_out(F.col("r"), F.col("u"))[0], 8).alias("first_left"))


@query(f"WITH {_E}, w AS (SELECT vec_id // 10 AS layer, v, (0.25 - 0.125 * (label % 5)) AS c FROM e), u AS (SELECT layer, unnest(v) * c AS x, generate_subscripts(v, 1)::BIGINT AS i FROM w) SELECT layer, i AS dim, round(sum(x), 8) AS offset_value FROM u GROUP BY ALL")
def d18_weighted_mix(t: Tables) -> DataFrame:
    """Coefficients by vectors, summed by layer; one accumulator a dimension."""
    own = _vectors(t).select(F.floor(F.col("vec_id") / 10).alias("layer"), "v", (0.25 - 0.125 * (F.col("label") % 5)).alias("c"))
    mixed = V.mix_by(own, ["layer"], "v", "c", DIM)
    return mixed.select("layer", F.posexplode("mix").alias("at", "x")).select("layer", (F.col("at") + 1).cast("long").alias("dim"), F.round("x", 8).alias("offset_value"))


@query(f"WITH {_E}, p AS (SELECT vec_id, v, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS pos FROM e), u AS (SELECT vec_id, pos, unnest(v) AS x, generate_subscripts(v, 1)::BIGINT AS i FROM p) SELECT vec_id, i AS dim, round(CASE WHEN pos = 3 OR (pos > 3 AND vec_id % 2 = 0) THEN x + 0.01 * i ELSE x END, 8) AS x FROM u")
def k08_masked_add(t: Tables) -> DataFrame:
    """An offset vector at the final prompt place, and at content places after it."""
    offset = F.transform(F.sequence(F.lit(1), F.lit(DIM)), lambda i: i * F.lit(0.01).cast("double"))
    places = ranked(t("embeddings").select("vec_id", "label"), "label", "vec_id", "at").select("vec_id", "at")
    steered = (F.col("at") == 3) | ((F.col("at") > 3) & (F.col("vec_id") % 2 == 0))
    p = _vectors(t).join(places, "vec_id").select("vec_id", F.posexplode(F.when(steered, V.add(F.col("v"), offset)).otherwise(F.col("v"))).alias("at", "x"))
    return p.select("vec_id", (F.col("at") + 1).cast("long").alias("dim"), F.round("x", 8).alias("x"))


@query(f"WITH {_PAIR} SELECT vec_id, round(abs(list_cosine_similarity(r, c)), 8) AS cosine, abs(sqrt(list_dot_product(r, r)) - sqrt(list_dot_product(c, c))) <= greatest(0.01 * greatest(sqrt(list_dot_product(r, r)), sqrt(list_dot_product(c, c))), 1e-8) AS norms_close FROM p")
def k12_cosine_and_tolerance(t: Tables) -> DataFrame:
    r, c = F.col("r"), F.col("c")
    return _neighbours(t).select("vec_id", F.round(F.abs(V.dot(V.unit(r), V.unit(c))), 8).alias("cosine"), V.close(V.norm(r), V.norm(c), 0.01).alias("norms_close"))


@query("""WITH l AS (SELECT vec_id, i - 1 AS corner, greatest(-2, least(2, floor(embedding[i]::DOUBLE * 16))) AS level FROM embeddings, range(1, 7) r(i))
SELECT vec_id, corner::BIGINT AS corner, printf('%.2f', 215 + cos(-pi() / 2 + corner * pi() / 3) * 131.371::DOUBLE * (0.25 + (level + 2) * 0.1875)) AS x, printf('%.2f', 188 + sin(-pi() / 2 + corner * pi() / 3) * 131.371::DOUBLE * (0.25 + (level + 2) * 0.1875)) AS y FROM l""")
def j22_polar_points(t: Tables) -> DataFrame:
    """Corners of each vector's profile: its first six values as levels, on rays of a hexagon."""
    level = lambda x: F.greatest(F.lit(-2), F.least(F.lit(2), F.floor(x * 16)))
    levels = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 6), level)
    rows = t("embeddings").select("vec_id", F.posexplode(levels).alias("at", "level"))
    angle, radius = -F.pi() / 2 + F.col("at") * F.pi() / 3, 131.371 * (0.25 + (F.col("level") + 2) * 0.1875)
    return rows.select("vec_id", F.col("at").cast("long").alias("corner"), F.format_string("%.2f", F.cos(angle) * radius + 215).alias("x"), F.format_string("%.2f", F.sin(angle) * radius + 188).alias("y"))


@query("SELECT p_partkey, CASE WHEN p_size >= 38 THEN 'strong' WHEN p_size >= 18 THEN 'moderate' ELSE 'slight' END AS strength, [-0.25, -0.125, 0, 0.125, 0.25][1 + p_size % 5]::DOUBLE AS coefficient FROM part")
def b15_ordinals(t: Tables) -> DataFrame:
    share = F.col("p_size") / 50.0
    table = F.array(*map(F.lit, (-0.25, -0.125, 0.0, 0.125, 0.25)))
    return t("part").select("p_partkey", F.when(share >= 0.75, "strong").when(share >= 0.35, "moderate").otherwise("slight").alias("strength"), F.element_at(table, (F.col("p_size") % 5 + 1).cast("int")).alias("coefficient"))


@query("SELECT p_partkey, (CASE WHEN p_size % 2 = 0 THEN 2 ELSE 4 END * p_size * (p_partkey % 7 + 1))::BIGINT AS bytes FROM part")
def j27_shape_bytes(t: Tables) -> DataFrame:
    shape = F.array(F.col("p_size").cast("long"), F.col("p_partkey") % 7 + 1)
    return t("part").select("p_partkey", (F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x) * F.when(F.col("p_size") % 2 == 0, 2).otherwise(4)).alias("bytes"))

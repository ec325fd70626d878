"""Conditions, matched pairs and directions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.functions import text as T
from antiphon.functions import vectors as V
from antiphon.operators import matching as M
from antiphon.plans.registry import Tables, query

DIM = 64
_MATCHED = """
WITH e AS (SELECT *, label // 2 AS grp, label % 2 AS pol, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings),
s AS (SELECT e.*, l.quality FROM e LEFT JOIN labels l ON l.doc_id = e.vec_id),
p AS (SELECT a.grp, a.embedding AS pe, b.embedding AS ne FROM s a JOIN s b ON a.grp = b.grp AND a.rn = b.rn AND a.pol = 1 AND b.pol = 0 WHERE a.quality = 1 AND b.quality = 1)
"""


@query(
    _MATCHED
    + """, u AS (SELECT grp, unnest(pe)::DOUBLE AS a, unnest(ne)::DOUBLE AS b, generate_subscripts(pe, 1) AS i FROM p),
d AS (SELECT grp, i, avg(a) - avg(b) AS d FROM u GROUP BY ALL)
SELECT d.grp::BIGINT AS grp, n::BIGINT AS pairs, round(sqrt(sum(d * d)), 6) AS l2 FROM d JOIN (SELECT grp, count(*) AS n FROM p GROUP BY grp) c ON c.grp = d.grp GROUP BY d.grp, n
"""
)
def matched_contrast_direction(t: Tables) -> DataFrame:
    """Per group the difference of means of matched, accepted vectors: pairs and length."""
    pairs = M.accepted_vector_pairs(t("embeddings"), t("labels"))
    means = pairs.groupBy("grp").agg(F.count("*").alias("pairs"), *(F.array(*(F.avg(F.col(side)[i].cast("double")) for i in range(DIM))).alias(side) for side in ("pos", "neg")))
    return means.select(F.col("grp").cast("long"), "pairs", F.round(V.norm(V.subtract(F.col("pos"), F.col("neg"))), 6).alias("l2"))


@query("""
SELECT r_name || ':' || lpad(n_nationkey::VARCHAR, 2, '0') || ':' || lpad(n_regionkey::VARCHAR, 2, '0') || ':0:' || p AS response_id,
  r_name || ':' || lpad(n_nationkey::VARCHAR, 2, '0') || ':' || lpad(n_regionkey::VARCHAR, 2, '0') || ':0' AS contrast_id,
  ('0x' || substr(sha256('20261004|' || r_name || '|' || lpad(n_nationkey::VARCHAR, 2, '0') || '|' || lpad(n_regionkey::VARCHAR, 2, '0') || '|0|' || p), 1, 8))::BIGINT AS seed
FROM region, nation, (VALUES ('positive'), ('negative')) v(p)
""")
def d01_condition_grid(t: Tables) -> DataFrame:
    """All regions by nations by polarities, with ids and stable seeds."""
    pairs = t("nation").select(F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("pair"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0").alias("question"))
    return M.condition_grid(t("region").select(F.col("r_name").alias("trait")), pairs, 20261004).select("response_id", "contrast_id", "seed")


@query("""WITH g AS (SELECT l::BIGINT AS layer, p::BIGINT AS position FROM range(0, 1000) a(l), range(-5, 0) b(p) WHERE l < 0.8 * (SELECT max(label) + 1 FROM embeddings)),
n AS (SELECT label AS layer, -1 - vec_id % 5 AS position, count(*) AS n, min(vec_id) AS first FROM embeddings GROUP BY ALL)
SELECT 'pre_l' || lpad(layer::VARCHAR, 2, '0') || '_p' || position AS candidate_id, layer, position, coalesce(n, 0)::BIGINT AS vectors, first AS first_vector FROM g LEFT JOIN n USING (layer, position)""")
def d02_candidate_grid(t: Tables) -> DataFrame:
    """Candidates of the layers (labels) below a share of the depth, at each position (by id), with the vectors that there are for them."""
    e = t("embeddings")
    grid = M.candidate_grid(e.sparkSession, layers=e.agg(F.max("label") + 1).first()[0] or 0, positions=5)
    n = e.groupBy(F.col("label").cast("long").alias("layer"), (-1 - F.col("vec_id") % 5).alias("position")).agg(F.count("*").alias("n"), F.min("vec_id").alias("first_vector"))
    return grid.join(n, ["layer", "position"], "left").select("candidate_id", "layer", "position", F.coalesce("n", F.lit(0)).alias("vectors"), "first_vector")


@query("""
SELECT d.doc_id, max(CASE WHEN kind = 'trait' THEN score END)::BIGINT AS trait, max(CASE WHEN kind = 'coherence' THEN score END)::BIGINT AS coherence
FROM documents d LEFT JOIN (SELECT doc_id, 'trait' AS kind, quality * 100 AS score FROM labels UNION ALL SELECT doc_id, 'coherence', (1 - toxic) * 100 FROM labels) s ON s.doc_id = d.doc_id GROUP BY d.doc_id
""")
def d04_scores_by_kind(t: Tables) -> DataFrame:
    """A missing score is null, never 0."""
    return M.with_scores(t("documents").select("doc_id"), _scores(t)).select("doc_id", F.col("trait").cast("long"), F.col("coherence").cast("long"))


def _scores(t: Tables) -> DataFrame:
    both = F.array(F.struct(F.lit("trait").alias("kind"), (F.col("quality") * 100).alias("score")), F.struct(F.lit("coherence").alias("kind"), ((1 - F.col("toxic")) * 100).alias("score")))
    return t("labels").select("doc_id", F.inline(both))


@query("SELECT doc_id, kind FROM documents, (VALUES ('trait'), ('coherence')) v(kind) WHERE n_chars % 13 <> 0 AND trim(text) <> ''")
def d05_judge_tasks(t: Tables) -> DataFrame:
    done = t("documents").where((F.col("n_chars") % 13 != 0) & (F.trim("text") != ""))
    return done.select("doc_id", F.explode(F.array(F.lit("trait"), F.lit("coherence"))).alias("kind"))


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def d07_pending_conditions(t: Tables) -> DataFrame:
    return M.pending(t("documents"), t("labels"), "doc_id").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def d07_pending_retry_errors(t: Tables) -> DataFrame:
    """The other policy: what ended in an error counts as not done."""
    return M.pending(t("documents"), t("labels"), "doc_id", done=F.col("quality") == 1).select("doc_id", "source")


@query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)")
def d08_accepted_semi(t: Tables) -> DataFrame:
    return t("documents").join(t("labels").where("quality = 1 AND toxic = 0"), "doc_id", "left_semi").select("doc_id", "lang")


_SIDE = """
r AS (SELECT doc_id, list_filter([CASE WHEN n_chars % 13 = 0 THEN 'generation_error' END, CASE WHEN trim(text, e' \\t\\n\\v\\f\\r') = '' THEN 'empty_response' END,
  CASE WHEN regexp_matches(text, '^\\s*(?:(?:I''m sorry|I am sorry|Sorry|As an AI[^,.]*|As a language model)[,.!:\\s]*)*I\\s+(?:cannot|can''t|won''t|will not|am unable to|must decline to)\\s+(?:help|assist|provide|comply|fulfil|fulfill|write|generate|discuss)\\b', 'i') THEN 'refusal' END,
  CASE WHEN contains(text, '###') THEN 'unexpected_thinking' END, CASE WHEN n_chars < 60 THEN 'no_content_tokens' END], lambda x: x IS NOT NULL) AS reasons FROM documents)
"""


def _responses(t: Tables) -> DataFrame:
    return t("documents").select(
        "doc_id", "lang", F.when(F.col("n_chars") % 13 != 0, "complete").otherwise("error").alias("status"), F.col("text").alias("response"),
        T.task_refusal(F.col("text")).alias("refusal"), F.contains("text", F.lit("###")).alias("unexpected_thinking"), (F.col("n_chars") >= 60).alias("has_content"),
    )


@query(f"WITH {_SIDE} SELECT doc_id, list_aggregate(reasons, 'string_agg', ',') AS reasons FROM r WHERE len(reasons) > 0")
def c05_exclusion_reasons(t: Tables) -> DataFrame:
    out = _responses(t).withColumn("reasons", M.exclusion_reasons())
    return out.where(F.size("reasons") > 0).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(
    f"""WITH {_SIDE}, s AS (SELECT r.*, l.quality * 60 AS trait, (1 - l.toxic) * 50 AS coherence FROM r LEFT JOIN labels l USING (doc_id))
SELECT p.doc_id // 2 AS pair, coalesce(list_aggregate(list_concat(list_concat(list_transform(p.reasons, lambda x: 'positive:' || x), list_transform(n.reasons, lambda x: 'negative:' || x)),
  CASE WHEN p.trait IS NULL OR n.trait IS NULL OR p.coherence IS NULL OR n.coherence IS NULL THEN ['missing_judge_score'] ELSE
  list_filter([CASE WHEN p.trait <= 50 THEN 'positive_trait_not_above_50' END, CASE WHEN n.trait >= 50 THEN 'negative_trait_not_below_50' END, CASE WHEN least(p.coherence, n.coherence) < 50 THEN 'coherence_below_50' END], lambda x: x IS NOT NULL) END), 'string_agg', ','), '') AS reasons
FROM s p JOIN s n ON p.doc_id // 2 = n.doc_id // 2 AND p.doc_id % 2 = 0 AND n.doc_id % 2 = 1"""
)
def c06_matched_decision(t: Tables) -> DataFrame:
    """Reasons against a pair of neighbours; none: accepted."""
    return _decided(t).select("pair", F.array_join("reasons", ",").alias("reasons"))


def _decided(t: Tables) -> DataFrame:
    scores = t("labels").select("doc_id", (F.col("quality") * 60).alias("trait"), ((1 - F.col("toxic")) * 50).alias("coherence"))
    sides = _responses(t).withColumn("reasons", M.exclusion_reasons()).join(scores, "doc_id", "left").withColumn("pair", F.floor(F.col("doc_id") / 2))
    side = F.struct("reasons", "trait", "coherence", "lang")
    # Both sides of a pair come together in one aggregation: no self-join.
    pairs = sides.groupBy("pair").agg(F.max(F.when(F.col("doc_id") % 2 == 0, side)).alias("p"), F.max(F.when(F.col("doc_id") % 2 == 1, side)).alias("n")).where("p IS NOT NULL AND n IS NOT NULL")
    return pairs.withColumn("reasons", M.matched_reasons(F.col("p"), F.col("n")))


@query(f"""WITH {_SIDE}, s AS (SELECT r.*, d.lang, l.quality * 60 AS trait, (1 - l.toxic) * 50 AS coherence FROM r JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
m AS (SELECT p.lang, (len(p.reasons) = 0 AND len(n.reasons) = 0 AND p.trait > 50 AND n.trait < 50 AND least(p.coherence, n.coherence) >= 50) AS ok, p.trait IS NULL OR n.trait IS NULL AS missing
  FROM s p JOIN s n ON p.doc_id // 2 = n.doc_id // 2 AND p.doc_id % 2 = 0 AND n.doc_id % 2 = 1)
SELECT lang, count(*)::BIGINT AS pairs, count_if(coalesce(ok, false))::BIGINT AS accepted, count_if(missing)::BIGINT AS missing FROM m GROUP BY lang""")
def e02_filter_summary(t: Tables) -> DataFrame:
    out = _decided(t).withColumn("lang", F.col("p.lang"))
    return out.groupBy("lang").agg(F.count("*").alias("pairs"), F.count_if(F.size("reasons") == 0).alias("accepted"), F.count_if(F.array_contains("reasons", "missing_judge_score")).alias("missing"))


@query("SELECT n_name AS nation, count(c_custkey)::BIGINT AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY n_name")
def e03_zero_filled_coverage(t: Tables) -> DataFrame:
    """Every nation has a row, also those without customers."""
    few = t("customer").where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return M.zero_filled(t("nation").select("n_nationkey", F.col("n_name").alias("nation")), few, "n_nationkey").select("nation", "n")


@query("SELECT r_name, coalesce(string_agg(n_name, ',' ORDER BY n_name), '') AS missing FROM region LEFT JOIN (SELECT * FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)) ON n_regionkey = r_regionkey GROUP BY r_name")
def e03_missing_dimensions(t: Tables) -> DataFrame:
    gone = t("nation").join(t("customer").where("c_acctbal > 9900"), F.col("n_nationkey") == F.col("c_nationkey"), "left_anti")
    lists = gone.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("missing"))
    return t("region").join(lists, F.col("r_regionkey") == F.col("n_regionkey"), "left").select("r_name", F.coalesce("missing", F.lit("")).alias("missing"))


@query("""WITH u AS (SELECT label // 2 AS grp, label % 2 AS pol, vec_id, vec_id // 3 AS response, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
r AS (SELECT grp, pol, response, i, avg(x) AS x FROM u GROUP BY ALL), m AS (SELECT grp, pol, i, avg(x) AS x FROM r GROUP BY ALL)
SELECT a.grp::BIGINT AS grp, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS l2 FROM m a JOIN m b ON a.grp = b.grp AND a.i = b.i AND a.pol = 1 AND b.pol = 0 GROUP BY a.grp""")
def e14_two_level_mean(t: Tables) -> DataFrame:
    """Means of tokens by response, then of responses by group, each response with the same weight."""
    tokens = t("embeddings").select(F.floor(F.col("label") / 2).alias("grp"), (F.col("label") % 2).alias("pol"), F.floor(F.col("vec_id") / 3).alias("response"), "embedding")
    by_response = V.mean_by(tokens, ["grp", "pol", "response"], "embedding", DIM)
    by_group = V.mean_by(by_response, ["grp", "pol"], "mean", DIM)
    sides = by_group.groupBy("grp").agg(*(F.max(F.when(F.col("pol") == k, F.col("mean"))).alias(f"m{k}") for k in (0, 1))).where("m0 IS NOT NULL AND m1 IS NOT NULL")
    return sides.select("grp", F.round(V.norm(V.subtract(F.col("m1"), F.col("m0"))), 6).alias("l2"))


@query("""WITH p AS (SELECT o_custkey AS k, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key, count(*)::BIGINT AS n FROM orders GROUP BY 1)
SELECT c_custkey, first_key, last_key, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN p ON k = c_custkey""")
def e24_first_last(t: Tables) -> DataFrame:
    some = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"), F.count("*").alias("n"))
    return M.zero_filled(t("customer").select("c_custkey"), some, "c_custkey").select("c_custkey", "first_key", "last_key", "n")



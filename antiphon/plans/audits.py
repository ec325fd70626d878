"""Audits of manifests, results, stages and recoveries; reports; unions and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.functions import vectors as V
from antiphon.functions.sums import exact_mean
from antiphon.operators import audits as A
from antiphon.operators import corpus as K
from antiphon.operators import journals as J
from antiphon.operators import scans as X
from antiphon.plans.journals import _ATTEMPTS, _attempts
from antiphon.plans.registry import Tables, query
from antiphon.sources.safetensors import WIDTHS


@query("""WITH g AS (SELECT lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY lang)
SELECT e'# Languages\\n\\n| lang | n | chars |\\n| --- | --- | --- |\\n' || string_agg('| ' || lang || ' | ' || n || ' | ' || chars || ' |', e'\\n' ORDER BY lang) AS report FROM g""")
def a20_report(t: Tables) -> DataFrame:
    """A table of few rows as one text in Markdown."""
    g = t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return A.markdown(g, "Languages", "lang")


_THREE = """a AS (SELECT o_orderkey AS id, o_orderstatus AS x FROM orders), b AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN '?' ELSE o_orderstatus END AS x FROM orders WHERE o_orderkey % 10 <> 0),
c AS (SELECT o_orderkey AS id, o_orderstatus AS x FROM orders WHERE o_orderkey % 11 <> 0 UNION ALL SELECT -1, 'F')"""


@query(f"""WITH {_THREE}, i AS (SELECT id FROM a UNION SELECT id FROM b UNION SELECT id FROM c)
SELECT id, concat_ws(',', CASE WHEN a.id IS NULL THEN 'missing in input' END, CASE WHEN b.id IS NULL THEN 'missing in journal' END, CASE WHEN c.id IS NULL THEN 'missing in results' END, CASE WHEN a.x <> b.x OR b.x <> c.x OR a.x <> c.x THEN 'different' END) AS problems
FROM i LEFT JOIN a USING (id) LEFT JOIN b USING (id) LEFT JOIN c USING (id) WHERE a.id IS NULL OR b.id IS NULL OR c.id IS NULL OR a.x <> b.x OR b.x <> c.x OR a.x <> c.x""")
def d14_three_way(t: Tables) -> DataFrame:
    """Input, journal and results by id: where one lacks a row, or a field differs. One shuffle, no joins."""
    o, key = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("x")), F.col("id")
    journal = o.where(key % 10 != 0).withColumn("x", F.when(key % 7 == 0, "?").otherwise(F.col("x")))
    stray = o.sparkSession.createDataFrame([(-1, "F")], "id long, x string")
    found = A.reconciled({"input": o, "journal": journal, "results": o.where(key % 11 != 0).unionByName(stray)}, "id", ["x"])
    return found.where(F.size("problems") > 0).select("id", F.array_join("problems", ",").alias("problems"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS f, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders)
SELECT a.o_custkey AS custkey, string_agg(a.o_orderkey, ',' ORDER BY a.o_orderkey) AS lost FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND b.rn = a.rn + 1 WHERE a.f AND NOT b.f GROUP BY 1""")
def d10_lost_probes(t: Tables) -> DataFrame:
    """Probes that passed before and don't now, by name: an order is a probe, the customer's next one is it again."""
    placed = K.ranked(t("orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("f")), "o_custkey", "o_orderkey")
    old, new = placed, placed.withColumn("rn", F.col("rn") - 1)
    return A.lost(old.withColumnRenamed("o_orderkey", "name"), new, ["o_custkey", "rn"], "f").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("lost"))


@query("""WITH d AS (SELECT doc_id // 2 AS pair, lang, doc_id % 2 AS side, n_chars > 2000 AS capped FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
p AS (SELECT pair, max(CASE WHEN side = 0 THEN lang END) AS lang, bool_or(capped AND side = 0) AS pos, bool_or(capped AND side = 1) AS neg FROM d GROUP BY pair HAVING count(*) = 2)
SELECT lang, count(*)::BIGINT AS accepted, count_if(pos)::BIGINT AS capped_positive, count_if(neg)::BIGINT AS capped_negative, count_if(pos OR neg)::BIGINT AS capped_pairs FROM p GROUP BY lang""")
def e02_capped_counts(t: Tables) -> DataFrame:
    """Accepted pairs of which a side, or any, reached the limit of its length."""
    d = t("documents").select("doc_id", "lang", (F.col("n_chars") > 2000).alias("capped")).join(t("labels").where("quality = 1"), "doc_id")
    side = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.struct("lang", "capped")))
    pairs = d.groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(side(0).alias("p"), side(1).alias("n")).where("p IS NOT NULL AND n IS NOT NULL")
    return A.capped(pairs.select(F.col("p.lang").alias("lang"), F.col("p.capped").alias("pos"), F.col("n.capped").alias("neg")), "lang")


@query("""SELECT sha256('[' || string_agg('{"key": ' || n_nationkey || ', "name": "' || n_name || '"}', ', ' ORDER BY n_nationkey) || ']') AS fingerprint FROM nation""")
def e18_canonical_fingerprint(t: Tables) -> DataFrame:
    """SHA-256 of a small table's canonical JSON, in order."""
    return A.canonical_fingerprint(t("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")), "key")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber * 10 AS b, l_linenumber * 10 + CASE WHEN l_partkey % 17 = 0 THEN 9 ELSE 10 END AS e FROM lineitem), g AS (SELECT l_orderkey, b, e, lag(e, 1, 10) OVER (PARTITION BY l_orderkey ORDER BY b, e) AS before FROM s)
SELECT l_orderkey, bool_and(b = before) AS covers, (max(e) - 10)::BIGINT AS bytes FROM g GROUP BY l_orderkey""")
def f11_range_cover(t: Tables) -> DataFrame:
    """Ranges in order, each beginning where the one before ends, the first at the start."""
    begin = F.col("l_linenumber") * 10
    end = begin + F.when(F.col("l_partkey") % 17 == 0, 9).otherwise(10)
    return A.covers(t("lineitem").select("l_orderkey", begin.alias("b"), end.alias("e")), "l_orderkey", "b", "e", 10).select("l_orderkey", "covers", (F.col("last") - 10).cast("long").alias("bytes"))


@query("SELECT 'documents' AS dataset, doc_id AS id, text AS instruction FROM documents UNION ALL SELECT 'benchmark', item_id, text FROM benchmark UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations")
def h01_united_rows(t: Tables) -> DataFrame:
    """Rows of several data sets, each with its name."""
    sets = {
        "documents": t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("instruction")),
        "benchmark": t("benchmark").select(F.col("text").alias("instruction"), F.col("item_id").alias("id")),
        "conversations": t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("instruction")),
    }
    return A.united(sets, "dataset")


@query("SELECT 'missing' AS status, c_custkey AS k FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL SELECT 'extra', o_custkey FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def h04_missing_and_extra(t: Tables) -> DataFrame:
    c, o = t("customer").select(F.col("c_custkey").alias("k")), t("orders")
    missing = c.subtract(o.select("o_custkey")).select(F.lit("missing").alias("status"), "k")
    return missing.union(o.where("o_orderkey % 3 = 0").select("o_custkey").subtract(c.where("k % 2 = 0")).select(F.lit("extra"), "o_custkey"))


@query(f"""WITH {_ATTEMPTS}, j AS (SELECT user_id, day, count(*) AS n, last(status ORDER BY nr) AS last_status, max(score) FILTER (score <= 100) AS score FROM a GROUP BY ALL)
SELECT user_id, day, greatest(3 - n, 0)::BIGINT AS slots, CASE WHEN score IS NULL AND n < 3 AND last_status <> 'request_started' THEN least(power(2, n), 8) END::DOUBLE AS wait FROM j""")
def l08_retry_budget(t: Tables) -> DataFrame:
    """Attempts left of three (a started one counts), and the seconds to wait before the next; none after a score or while one is open."""
    score = F.max(F.when(F.col("score") <= 100, F.col("score")))
    j = _attempts(t).groupBy("user_id", "day").agg(F.count("*").alias("n"), F.max_by("status", F.struct("ts", "event_id")).alias("last"), score.alias("score"))
    slots, wait = J.retry_budget(F.col("n"), F.col("last"), F.col("score"))
    return j.select("user_id", "day", slots.alias("slots"), wait.alias("wait"))


@query(f"""WITH {_ATTEMPTS}, j AS (SELECT user_id, day, count(*) AS n, last(status ORDER BY nr) AS last_status, last(http_status ORDER BY nr) AS last_http, last(score ORDER BY nr) AS score, count_if(nr <= 3 AND status = 'judge_error') AS early, count_if(nr > 3 AND nr > 6) AS late FROM a GROUP BY ALL)
SELECT user_id, day, CASE WHEN n < 3 OR early < 3 THEN 'not eligible' WHEN late > 0 THEN 'invalid' WHEN n > 3 AND last_status = 'request_started' THEN 'blocked' WHEN n > 3 AND last_status = 'complete' THEN 'scored' WHEN n > 3 AND last_http <> 429 THEN 'ended' WHEN n = 6 THEN 'exhausted' ELSE 'retry' END AS state,
  CASE WHEN early = 3 AND n IN (4, 5) AND last_status = 'judge_error' AND last_http = 429 THEN [2, 4][(n - 3)::INTEGER] END::INTEGER AS wait FROM j""")
def l09_recovery_states(t: Tables) -> DataFrame:
    """Where each journal's recovery stands: three errors first, then at most three more tries, of which only a 429 leads to another."""
    log = F.array_sort(F.collect_list(F.struct("ts", "event_id", "status", "http_status")))
    j = _attempts(t).groupBy("user_id", "day").agg(log.alias("log"))
    state, wait = J.recovery(F.transform("log", lambda a: F.struct(a["status"].alias("status"), a["http_status"].alias("http_status"))))
    return j.select("user_id", "day", state.alias("state"), wait.alias("wait"))


@query("""SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'run' WHEN l.doc_id % 13 = 0 OR quality IS NULL OR (quality = 0 AND l.doc_id % 5 = 0) THEN 'mismatch' ELSE 'done' END AS state FROM documents d LEFT JOIN labels l USING (doc_id)""")
def l11_resume(t: Tables) -> DataFrame:
    """Planned keys against saved ones: done, to run, or saved under another fingerprint of the settings."""
    own = F.when(F.col("doc_id") % 13 == 0, "old").when(F.col("quality").isNotNull(), "now")
    saved = t("labels").select("doc_id", own.alias("fingerprint"))
    # Some are saved twice, the second time under other settings.
    saved = saved.union(t("labels").where("quality = 0 AND doc_id % 5 = 0").select("doc_id", F.lit("new")))
    return A.resume(t("documents").select("doc_id"), saved, "doc_id", "now")


@query("""WITH r AS (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, island ORDER BY ts, event_id) AS run FROM r) SELECT user_id, event_id, run::BIGINT AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM c WHERE run >= 3) WHERE rn = 1""")
def l12_live_repetition(t: Tables) -> DataFrame:
    """The first place of a growing text at which a word has stood so often in a row."""
    return X.first_long_run(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", 3).select("user_id", "event_id", "run")


@query("""WITH l AS (SELECT user_id, max(n) AS run FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id),
s AS (SELECT user_id, p, nr, coalesce(event_type = prev, false) AS same FROM (SELECT user_id, p, row_number() OVER (PARTITION BY user_id, p ORDER BY ts, event_id) AS nr, event_type, lag(event_type, p) OVER (PARTITION BY user_id, p ORDER BY ts, event_id) AS prev FROM events, range(1, 5) r(p))),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, p ORDER BY nr) AS island FROM s), n AS (SELECT user_id, p, island, count_if(same) AS n FROM g GROUP BY ALL), x AS (SELECT user_id, p, CASE WHEN max(n) >= p THEN max(n) + p ELSE 0 END AS span FROM n GROUP BY user_id, p),
b AS (SELECT user_id, bool_or(span // p >= 3 AND span >= 6) AS loops FROM x GROUP BY user_id) SELECT user_id, run >= 4 OR loops AS degenerate FROM l JOIN b USING (user_id)""")
def c23_loops(t: Tables) -> DataFrame:
    """A value four times in a row, or a period of one to four that comes three times and is six long (smaller limits than those of replies, which these events would not reach)."""
    return X.loops(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type", run=4, repetitions=3, span=6)


@query("""SELECT 'nations' AS rule, 25::BIGINT AS expected, count(*)::BIGINT AS found, count(*) = 25 AS holds FROM nation UNION ALL SELECT 'regions', 6, count(*), count(*) = 6 FROM region UNION ALL SELECT 'dimensions', 64, max(len(embedding)), max(len(embedding)) = 64 AND min(len(embedding)) = 64 FROM embeddings""")
def n02_counts(t: Tables) -> DataFrame:
    """Numbers of rows and dimensions that are laid down beforehand; the second rule does not hold."""
    sizes = t("embeddings").agg(F.max(F.size("embedding")).cast("long").alias("found"), F.min(F.size("embedding")).alias("lo"))
    rules = [("nations", 25, t("nation").agg(F.count("*").alias("found"))), ("regions", 6, t("region").agg(F.count("*").alias("found")))]
    one = A.count_rules(rules)
    return one.unionByName(sizes.select(F.lit("dimensions").alias("rule"), F.lit(64).cast("long").alias("expected"), "found", ((F.col("found") == 64) & (F.col("lo") == 64)).alias("holds")))


@query("""SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'missing' WHEN doc_id % 9 = 1 THEN 'size' WHEN doc_id % 9 = 2 THEN 'hash' ELSE 'unlisted' END AS problem FROM documents WHERE doc_id % 9 < 4""")
def n08_manifest(t: Tables) -> DataFrame:
    """Files by size and hash against a manifest: missing, of another size, changed, or not listed."""
    at = F.col("doc_id") % 9
    files = t("documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    found = files.where(at != 0).withColumns({"bytes": F.when(at == 1, F.col("bytes") + 1).otherwise(F.col("bytes")), "sha256": F.when(at == 2, F.lit("0")).otherwise(F.col("sha256"))})
    return A.manifest_problems(files.where(at != 3), found, "doc_id")


@query("""WITH s AS (SELECT lang, count(*) AS n, count_if(quality = 0) AS refusals, count_if(toxic = 1) AS degenerate FROM documents JOIN labels USING (doc_id) GROUP BY lang),
d AS (SELECT lang, n, refusals + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS refusals, degenerate FROM s WHERE lang <> 'fr') SELECT lang, field, declared::BIGINT AS declared, found::BIGINT AS found FROM (
SELECT lang, 'n' AS field, d.n AS declared, s.n AS found FROM s LEFT JOIN d USING (lang) UNION ALL SELECT lang, 'refusals', d.refusals, s.refusals FROM s LEFT JOIN d USING (lang) UNION ALL SELECT lang, 'degenerate', d.degenerate, s.degenerate FROM s LEFT JOIN d USING (lang)) WHERE declared IS DISTINCT FROM found""")
def n09_result_totals(t: Tables) -> DataFrame:
    """Declared totals that counting the records does not give."""
    found = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("refusals"), F.count_if(F.col("toxic") == 1).alias("degenerate"))
    declared = found.where("lang <> 'fr'").withColumn("refusals", F.col("refusals") + (F.col("lang") == "de").cast("int"))
    return A.total_problems(declared, found, "lang", ["n", "refusals", "degenerate"])


_WRONG = {1: ("instruction changed", "instruction"), 2: ("instruction checksum", None), 3: ("token count", "generated_tokens"), 4: ("length stop below the budget", None), 5: ("empty flag", None), 6: ("CSV differs in refusal_matches", None), 7: ("CSV differs in heuristic_refusal", None), 8: ("record repeated", None), 9: ("no row", None), 10: ("another budget", None)}


@query(f"""WITH w(k, problem) AS (VALUES {', '.join(f"({k}, '{p}')" for k, (p, _) in _WRONG.items())})
SELECT doc_id AS id, problem FROM documents JOIN w ON k = doc_id % 40 UNION ALL SELECT doc_id, 'status and empty flag' FROM documents WHERE doc_id % 40 = 5 UNION ALL SELECT doc_id, 'CSV differs in ' || f FROM documents, (VALUES (1, 'instruction'), (3, 'generated_tokens')) v(k, f) WHERE k = doc_id % 40""")
def n09_result_records(t: Tables) -> DataFrame:
    """Final results against inputs and their CSV, record by record; ten kinds of faults."""
    k, budget = F.col("id") % 40, 2048
    inputs = t("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("instruction"), F.col("source").alias("category"))
    matches = F.when(F.col("id") % 3 == 0, F.array(F.lit('I "cannot"'), F.lit("no"))).otherwise(F.array().cast("array<string>"))
    right = inputs.select(
        "id", "instruction", "category", F.sha2("instruction", 256).alias("instruction_sha256"), F.lit("completed").alias("status"), F.lit("rules").alias("method"), F.lit(budget).alias("max_new_tokens"), (F.col("id") % 100 + 1).cast("int").alias("generated_tokens"),
        F.lit("eos").alias("finish_reason"), F.lit("reply").alias("response"), F.lit(False).alias("empty"), (F.col("id") % 3 == 0).alias("heuristic_refusal"), matches.alias("refusal_matches"),
    )
    text = lambda c: F.when(F.col(c), "true").otherwise("false") if c == "heuristic_refusal" else A.json_list(F.col(c)) if c == "refusal_matches" else F.col(c).cast("string")
    rows = right.where(k != 9).select("id", *(text(c).alias(c) for c in ("instruction", "category", "generated_tokens", "heuristic_refusal", "refusal_matches")))
    rows = rows.withColumns({"refusal_matches": F.when(k == 6, "none").otherwise(F.col("refusal_matches")), "heuristic_refusal": F.when(k == 7, "yes").otherwise(F.col("heuristic_refusal"))})
    records = right.withColumns({
        "instruction": F.when(k == 1, F.concat("instruction", F.lit("!"))).otherwise(F.col("instruction")), "instruction_sha256": F.when(k == 2, "0").otherwise(F.col("instruction_sha256")), "generated_tokens": F.when(k == 3, 0).otherwise(F.col("generated_tokens")),
        "finish_reason": F.when(k == 4, "length").otherwise(F.col("finish_reason")), "empty": (k == 5) | F.col("empty"), "max_new_tokens": F.when(k == 10, 1).otherwise(F.col("max_new_tokens")),
    })
    return A.result_problems(inputs, records.union(records.where(k == 8)), rows, budget, "rules")


@query("""WITH r AS (SELECT count(*) AS n, count_if(quality = 0) AS f, count_if(toxic = 1) AS d FROM labels)
SELECT 'heuristic_refusals' AS field, (f + 1)::DOUBLE AS declared, f::DOUBLE AS found FROM r UNION ALL SELECT 'heuristic_refusal_rate', round((f + 1) / n, 12), round(f / n, 12) FROM r""")
def n09_result_summary(t: Tables) -> DataFrame:
    """A summary's totals and rate against the records; one refusal too many is declared."""
    records = t("labels").select(F.coalesce(F.col("quality") == 0, F.lit(False)).alias("heuristic_refusal"), F.lit(False).alias("empty"), F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("degenerate"))
    declared = records.agg(F.count("*").alias("count"), (F.count_if("heuristic_refusal") + 1).alias("heuristic_refusals"), F.lit(0).alias("empty_outputs"), F.count_if("degenerate").alias("degenerate_outputs")).withColumn("heuristic_refusal_rate", F.col("heuristic_refusals") / F.col("count"))
    return A.summary_problems(records, declared).select("field", F.round("declared", 12).alias("declared"), F.round("found", 12).alias("found"))


_GATE = {"completed": "n_open = 0", "fewer refusals": "returns_late < returns_early", "no lost probes": "lost = 0", "divergence": "drift < 0.002"}


@query(f"""WITH m AS (SELECT l_suppkey, count_if(l_linestatus = 'O' AND l_tax > 0.079) AS n_open, count_if(l_returnflag = 'R' AND l_linenumber > 3) AS returns_late, count_if(l_returnflag = 'R' AND l_linenumber <= 3) AS returns_early, count_if(l_quantity > 49.5 AND l_discount > 0.09) AS lost, abs(avg(l_discount) - 0.05) AS drift FROM lineitem GROUP BY 1)
SELECT l_suppkey, rule FROM (SELECT l_suppkey, unnest([{', '.join(f"CASE WHEN NOT ({x}) THEN '{k}' END" for k, x in _GATE.items())}]) AS rule FROM m) WHERE rule IS NOT NULL""")
def n10_export_gate(t: Tables) -> DataFrame:
    """The rules of a gate that a candidate fails, from its one row of measures."""
    line = t("lineitem")
    returned, late = F.col("l_returnflag") == "R", F.col("l_linenumber") > 3
    m = line.groupBy("l_suppkey").agg(
        F.count_if((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.079)).alias("n_open"), F.count_if(returned & late).alias("returns_late"), F.count_if(returned & ~late).alias("returns_early"),
        F.count_if((F.col("l_quantity") > 49.5) & (F.col("l_discount") > 0.09)).alias("lost"), F.abs(exact_mean(F.col("l_discount")) - 0.05).alias("drift"),
    )
    return A.failed_rules(m, ["l_suppkey"], {k: F.expr(x) for k, x in _GATE.items()})


_SPANS = "s AS (SELECT vec_id, label, 256 * (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) + CASE WHEN vec_id % 50 = 15 THEN 4 ELSE 0 END AS b, 256 * row_number() OVER (PARTITION BY label ORDER BY vec_id) AS e FROM embeddings)"


@query(f"""WITH {_SPANS}, n AS (SELECT label, count(*) AS n, count_if(vec_id % 50 = 15) AS gaps FROM s GROUP BY label)
SELECT 'part-' || label AS shard, 'v' || vec_id AS tensor, unnest(CASE vec_id % 50 WHEN 7 THEN ['unknown type'] WHEN 9 THEN ['span and shape differ'] WHEN 11 THEN ['not in the index'] WHEN 13 THEN ['in another shard'] ELSE ['span and shape differ', 'gap before it'] END) AS problem FROM s WHERE vec_id % 50 IN (7, 9, 11, 13, 15)
UNION ALL SELECT 'part-' || label, NULL, 'tensor bytes differ' FROM n WHERE gaps > 0 UNION ALL SELECT 'part-' || label, NULL, 'file bytes differ' FROM n WHERE label = 3 UNION ALL SELECT 'part-' || label, 'bias' || label, 'not in its shard' FROM n""")
def n11_tensor_precision(t: Tables) -> DataFrame:
    """Inventory of tensors over headers, here a tensor for each vector and a shard for each label, in which some types, shapes, spans, sums and index entries are wrong."""
    own = K.ranked(t("embeddings").select("vec_id", "label", F.size("embedding").cast("long").alias("n")), "label", "vec_id")
    kind, shard = F.col("vec_id") % 50, F.concat(F.lit("part-"), F.col("label").cast("string"))
    width, name = F.col("n") * 4, F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    begin = width * (F.col("rn") - 1) + F.when(kind == 15, 4).otherwise(0)
    shape = F.when(kind == 9, F.array(F.lit(3).cast("long"), F.col("n"))).otherwise(F.array(F.col("n")))
    tensors = own.select(shard.alias("shard"), name.alias("tensor"), F.when(kind == 7, "X9").otherwise("F32").alias("dtype"), shape.alias("shape"), begin.alias("begin"), (width * F.col("rn")).alias("end"))
    values = own.groupBy("label").agg(F.sum(width).alias("tensor_bytes"))
    shards = values.select(shard.alias("shard"), F.lit(100).cast("long").alias("header_bytes"), "tensor_bytes", (F.col("tensor_bytes") + F.when(F.col("label") == 3, 101).otherwise(100)).alias("file_bytes"), F.sha2(shard, 256).alias("header_sha256"))
    told = F.when(kind == 13, F.concat(F.lit("part-"), (F.col("label") + 1).cast("string"))).otherwise(shard)
    index = own.where(kind != 11).select(name.alias("tensor"), told.alias("shard")).union(values.select(F.concat(F.lit("bias"), F.col("label").cast("string")), shard))
    return A.tensor_problems(tensors, shards, index, WIDTHS)


@query("""SELECT 'v' || vec_id AS tensor, CASE WHEN vec_id % 40 = 5 THEN 'expected change is missing' WHEN vec_id % 40 = 20 THEN 'another change than expected' ELSE 'unexpected change' END AS problem FROM embeddings WHERE vec_id % 40 IN (5, 20) OR vec_id % 40 = 33
UNION ALL SELECT 'w' || label, 'expected tensor is missing' FROM embeddings GROUP BY label""")
def n11_exact_conversions(t: Tables) -> DataFrame:
    """Tensors' types before and after, of which exactly a stated set (here each fifth) goes from 32 to 16 bits."""
    e, k = t("embeddings"), F.col("vec_id") % 40
    name, n = F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("tensor"), F.size("embedding").cast("long")
    small = (((k % 5 == 0) & (k != 5)) | (k == 33)) & (k != 20)
    before = e.select(name, F.lit("F32").alias("dtype"), F.array(n).alias("shape"), (n * 4).alias("bytes"))
    after = e.select(name, F.when(k == 20, "F16").when(small, "BF16").otherwise("F32").alias("dtype"), F.array(n).alias("shape"), F.when(small | (k == 20), n * 2).otherwise(n * 4).alias("bytes"))
    expected = e.where(k % 5 == 0).select(name, F.array(n).alias("shape"), F.lit("F32").alias("old"), F.lit("BF16").alias("new"), (n * 2).alias("reduction"))
    more = e.select(F.concat(F.lit("w"), F.col("label").cast("string")), F.array(F.lit(1).cast("long")), F.lit("F32"), F.lit("BF16"), F.lit(2).cast("long")).distinct()
    return A.conversion_problems(before, after, expected.union(more))


@query("""WITH RECURSIVE leaf AS MATERIALIZED (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, sha256('0:' || o_orderkey || '|' || o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS h, count(*) OVER () AS n FROM orders),
lv(pos, h, n) AS (SELECT pos, h, n FROM leaf UNION ALL SELECT pos // 256, sha256('1:' || string_agg(h, '' ORDER BY pos)), max(n + 255) // 256 FROM lv WHERE n > 1 GROUP BY pos // 256)
SELECT h AS fingerprint, (SELECT count(*) FROM orders)::BIGINT AS n FROM lv WHERE n = 1""")
def e18_hash_tree(t: Tables) -> DataFrame:
    """A fingerprint of a whole table in its order that no task makes alone: the root of a tree of hashes."""
    return A.merkle_fingerprint(t("orders"), F.concat_ws("|", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), ["o_orderkey"])


_SNAPSHOT = "count(*) AS present, count_if(event_type = 'purchase') AS valid, count_if(event_type = 'error') AS eligible, count_if(event_type NOT IN ('purchase', 'error')) AS other"
_LAWS = {"no fewer valid": "valid_after >= valid_before", "recovered were eligible": "valid_after - valid_before <= eligible_before", "eligible plus recovered": "eligible_after = eligible_before - (valid_after - valid_before)", "others untouched": "other_after = other_before", "all present": "present_after = present_before"}


@query(f"""WITH b AS (SELECT user_id, {_SNAPSHOT} FROM events GROUP BY user_id), a AS (SELECT user_id, {_SNAPSHOT.replace("'error'", "'error' AND value < 50").replace("event_type = 'purchase'", "(event_type = 'purchase' OR event_type = 'error' AND value >= 50)").replace("NOT IN ('purchase', 'error' AND value < 50)", "NOT IN ('purchase', 'error')")} FROM events WHERE NOT (event_type = 'view' AND value > 60) GROUP BY user_id),
m AS (SELECT user_id, {', '.join(f'coalesce({side}.{c}, 0) AS {c}_{name}' for side, name in (('b', 'before'), ('a', 'after')) for c in ('present', 'valid', 'eligible', 'other'))} FROM b LEFT JOIN a USING (user_id))
SELECT user_id, rule FROM (SELECT user_id, unnest([{', '.join(f"CASE WHEN NOT ({x}) THEN '{k}' END" for k, x in _LAWS.items())}]) AS rule FROM m) WHERE rule IS NOT NULL""")
def n13_recovery_laws(t: Tables) -> DataFrame:
    """Laws between counts before and after a recovery, by user; some events were lost, which breaks two of them."""
    kind, value = F.col("event_type"), F.col("value")
    recovered, here = (kind == "error") & (value >= 50), ~((kind == "view") & (value > 60))
    counts = {"present": F.lit(True), "valid": kind == "purchase", "eligible": kind == "error", "other": ~kind.isin("purchase", "error")}
    after = {"present": here, "valid": (kind == "purchase") | recovered, "eligible": (kind == "error") & ~recovered, "other": ~kind.isin("purchase", "error") & here}
    m = t("events").groupBy("user_id").agg(*(F.count_if(x).alias(f"{k}_{side}") for side, own in (("before", counts), ("after", after)) for k, x in own.items()))
    return A.failed_rules(m, ["user_id"], {k: F.expr(x) for k, x in _LAWS.items()})


_BANK = {"two sides at most": "greatest(pos, neg) <= pairs", "no more pairs than sides": "pairs <= least(total, pos + neg)", "all norms": "least_norm > 1e-8 AND most_norm < 1e6", "dimensions": "narrow = 64 AND wide = 64", "ids once": "ids = total", "both sides": "pos > 0 AND neg > 30"}


@query(f"""WITH v AS (SELECT label, vec_id, quality, len(embedding) AS n, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS norm FROM embeddings LEFT JOIN labels ON doc_id = vec_id),
m AS (SELECT label, count(*) AS total, count(quality) AS pairs, count_if(quality = 1) AS pos, count_if(quality = 0) AS neg, min(norm) AS least_norm, max(norm) AS most_norm, min(n) AS narrow, max(n) AS wide, count(DISTINCT vec_id) AS ids FROM v GROUP BY label)
SELECT label::BIGINT AS label, rule FROM (SELECT label, unnest([{', '.join(f"CASE WHEN NOT ({x}) THEN '{k}' END" for k, x in _BANK.items())}]) AS rule FROM m) WHERE rule IS NOT NULL""")
def n12_bank_laws(t: Tables) -> DataFrame:
    """Laws that a bank's counts, shapes and norms obey, by label; the last one is too strict for most."""
    norm = V.norm(V.doubles(F.col("embedding")))
    v = t("embeddings").select("vec_id", "label", F.size("embedding").alias("n"), norm.alias("norm")).join(t("labels").select(F.col("doc_id").alias("vec_id"), "quality"), "vec_id", "left")
    m = v.groupBy(F.col("label").cast("long").alias("label")).agg(
        F.count("*").alias("total"), F.count("quality").alias("pairs"), F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"),
        F.min("norm").alias("least_norm"), F.max("norm").alias("most_norm"), F.min("n").alias("narrow"), F.max("n").alias("wide"), F.count_distinct("vec_id").alias("ids"),
    )
    return A.failed_rules(m, ["label"], {k: F.expr(x) for k, x in _BANK.items()})


@query("""WITH b AS (SELECT o_orderpriority AS p, o_orderkey AS k, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders), m AS (SELECT p, batch, k, k % 5 = 0 AS gone, k % 7 = 0 AS moved FROM b)
SELECT p AS priority, batch::BIGINT AS batch, count_if(NOT gone)::BIGINT AS listed, count_if(gone)::BIGINT AS unlisted, count_if(NOT gone AND moved)::BIGINT AS elsewhere, count_if(gone) = 0 AND count_if(moved) = 0 AS holds FROM m GROUP BY ALL""")
def n14_batch_provenance(t: Tables) -> DataFrame:
    """Each batch's receipt against its records: rows that it doesn't list, and rows whose record names another batch."""
    placed = K.ranked(t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("priority")), "priority", "k").withColumn("batch", F.floor((F.col("rn") - 1) / 8))
    receipts = placed.where("k % 5 <> 0").select("k", "priority", "batch")
    records = placed.select("k", "priority", "batch", F.when(F.col("k") % 7 == 0, F.col("batch") + 1).otherwise(F.col("batch")).alias("told"))
    return A.batch_provenance(receipts, records, "k", ["priority", "batch"], "told")


@query("""SELECT 'doc-' || doc_id || '.json' AS name, 'not allowed' AS problem FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)
UNION ALL SELECT 'item-' || item_id || '.json', 'missing' FROM benchmark WHERE item_id % 2 = 0""")
def n15_allowlist(t: Tables) -> DataFrame:
    """Files that may not be published (documents without a label), and such that are missing (half of the test items')."""
    file = lambda kind, key: F.concat(F.lit(f"{kind}-"), F.col(key).cast("string"), F.lit(".json")).alias("name")
    items = t("benchmark").select(file("item", "item_id"), "item_id")
    found = t("documents").select(file("doc", "doc_id")).union(items.where("item_id % 2 = 1").select("name"))
    return A.allowlist_problems(found, t("labels").where("quality IS NOT NULL").select(file("doc", "doc_id")).union(items.select("name")), "name")


_CUT = "SELECT doc_id, n, i::BIGINT AS block, i * 4096 AS pos, least(4096, n - i * 4096) AS bytes FROM (SELECT doc_id, length(text) AS n, unnest(range(0, (length(text) + 4095) // 4096)) AS i FROM documents)"


@query(f"WITH b AS ({_CUT}) SELECT doc_id, count(*)::BIGINT AS blocks, min(pos)::BIGINT AS first_at, sum(bytes)::BIGINT AS bytes FROM b WHERE block % 3 = 1 OR doc_id % 10 = 0 GROUP BY doc_id")
def n16_repair_plan(t: Tables) -> DataFrame:
    """By file: how many blocks are to be fetched again, from where on, and their bytes."""
    d = t("documents").select("doc_id", "text").where(F.length("text") > 0)
    blocks = A.blocks(d, "text", 4096)
    local = blocks.where("block % 3 <> 1").withColumn("sha", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("sha")))
    return A.repair_plan(blocks, local, ["doc_id", "block"]).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.min("at").alias("first_at"), F.sum("bytes").alias("bytes"))


@query("SELECT 'only regenerated' AS status, lang, count(*)::BIGINT AS n FROM documents WHERE doc_id % 50 = 0 GROUP BY lang UNION ALL SELECT 'only stored', lang, count(*) FROM documents WHERE doc_id % 50 = 0 AND doc_id % 100 <> 0 GROUP BY lang")
def n18_staleness(t: Tables) -> DataFrame:
    """What is generated anew against what is stored, both ways, by rows."""
    now = t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha"))
    stored = now.where("doc_id % 100 <> 0").withColumn("sha", F.when(F.col("doc_id") % 50 == 0, "old").otherwise(F.col("sha")))
    return A.stale(now, stored).groupBy("status", "lang").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'missing' WHEN c_custkey % 5 = 1 THEN 'different' ELSE 'same' END AS status FROM customer""")
def n04_bound_inputs(t: Tables) -> DataFrame:
    """Inputs by their content's hash against the manifest of the run."""
    c = t("customer").select("c_custkey", F.sha2(F.concat_ws("|", "c_name", "c_mktsegment"), 256).alias("sha"))
    found = c.where("c_custkey % 5 <> 0").withColumn("sha", F.when(F.col("c_custkey") % 5 == 1, "other").otherwise(F.col("sha")))
    return J.inventory_difference(c, found, "c_custkey", "sha")

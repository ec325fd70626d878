"""Journals of attempts, payloads, audits, inventories. Events stand in for attempts: a user's day is a journal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.operators import corpus as K
from antiphon.operators import journals as J
from antiphon.operators import ranks as R
from antiphon.plans.registry import Tables, query

_ATTEMPTS = """
a AS (SELECT user_id, ts::DATE AS day, event_id, ts, CASE WHEN event_type = 'error' THEN 'judge_error' WHEN event_type = 'signup' THEN 'request_started' ELSE 'complete' END AS status,
  CASE WHEN value > 20 THEN 429 ELSE 500 END AS http_status, CASE WHEN event_type = 'purchase' THEN (('0x' || substr(sha256(event_id::VARCHAR), 1, 4))::INT % 120) END AS score,
  row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS nr FROM events)
"""
_JOURNALS = f"""{_ATTEMPTS}, j AS (SELECT user_id, day, count(*) AS n, last(status ORDER BY nr) AS last_status, last(score ORDER BY nr) AS score,
  count(*) = 3 AND bool_and(status = 'judge_error' AND http_status = 429) AS refused FROM a GROUP BY ALL)
"""


def _attempts(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    number = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), 16, 10).cast("int") % 120
    return t("events").select(
        "user_id", F.col("ts").cast("date").alias("day"), "event_id", "ts",
        F.when(kind == "error", "judge_error").when(kind == "signup", "request_started").otherwise("complete").alias("status"),
        F.when(F.col("value") > 20, 429).otherwise(500).alias("http_status"), F.lit("HTTPError").alias("error_type"), F.when(kind == "purchase", number).alias("score"),
    )


def _journals(t: Tables) -> DataFrame:
    """user_id, day, attempts (all of them: a journal that is too long is to be seen as such), score (the last one's)."""
    log = F.array_sort(F.collect_list(F.struct("ts", "event_id", "status", "http_status", "error_type", "score")))
    return _attempts(t).groupBy("user_id", "day").agg(log.alias("attempts")).withColumn("score", F.element_at("attempts", -1)["score"])


@query(f"WITH {_JOURNALS} SELECT user_id, day FROM j WHERE score IS NULL AND refused")
def c10_retry_eligible(t: Tables) -> DataFrame:
    return _journals(t).where(J.eligible(F.col("score"), F.col("attempts"))).select("user_id", "day")


@query(f"WITH {_ATTEMPTS} SELECT user_id, day, string_agg(status, ',' ORDER BY nr) AS statuses FROM a WHERE nr <= 2 GROUP BY ALL")
def c11_original_attempts(t: Tables) -> DataFrame:
    own = J.original_attempts(F.col("attempts"), F.lit(2))
    return _journals(t).select("user_id", "day", F.array_join(F.transform(own, lambda a: a["status"]), ",").alias("statuses"))


_STATES = """CASE WHEN coalesce(score BETWEEN 0 AND 100, false) THEN 'valid' WHEN last_status = 'request_started' THEN 'in_progress' WHEN score IS NULL AND refused THEN 'eligible' ELSE 'other' END"""


@query(f"WITH {_JOURNALS} SELECT {_STATES} AS state, count(*)::BIGINT AS n, sum(n)::BIGINT AS attempts FROM j GROUP BY 1")
def e09_journal_states(t: Tables) -> DataFrame:
    own = _journals(t).withColumn("state", J.state(F.col("score"), F.col("attempts")))
    return own.groupBy("state").agg(F.count("*").alias("n"), F.sum(F.size("attempts")).alias("attempts"))


@query("SELECT coalesce(event_type, 'all') AS event_type, count(*)::BIGINT AS n, count_if(value > 50)::BIGINT AS high, count(DISTINCT user_id)::BIGINT AS users FROM events GROUP BY GROUPING SETS ((event_type), ())")
def e08_audit_rollup(t: Tables) -> DataFrame:
    return t("events").rollup("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.countDistinct("user_id").alias("users")).withColumn("event_type", F.coalesce("event_type", F.lit("all")))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END), 4) AS cost, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def e11_cost_models(t: Tables) -> DataFrame:
    cost = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t("events").groupBy("user_id").agg(F.round(F.sum(F.coalesce(cost, F.lit(0.0))), 4).alias("cost"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("""WITH d AS (SELECT lang, count(*)::BIGINT AS planned FROM documents GROUP BY lang), l AS (SELECT lang, count(*)::BIGINT AS scored, count_if(quality = 1)::BIGINT AS valid FROM documents JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, planned, coalesce(scored, 0)::BIGINT AS scored, coalesce(valid, 0)::BIGINT AS valid, planned - coalesce(scored, 0) AS pending FROM d LEFT JOIN l USING (lang)""")
def e10_progress(t: Tables) -> DataFrame:
    own = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return own.groupBy("lang").agg(F.count("*").alias("planned"), F.count("quality").alias("scored"), F.count_if(F.col("quality") == 1).alias("valid")).withColumn("pending", F.col("planned") - F.col("scored"))


@query("""SELECT event_type, round(sum(value) / nullif(count(DISTINCT ts::DATE) * 86400.0, 0), 9) AS rate FROM events GROUP BY event_type""")
def e20_throughput(t: Tables) -> DataFrame:
    return t("events").groupBy("event_type").agg(F.round(F.try_divide(F.sum("value"), F.countDistinct(F.col("ts").cast("date")) * 86400.0), 9).alias("rate"))


_PAYLOADS = """
p AS (SELECT event_id, event_type, value, (('0x' || substr(sha256(event_id::VARCHAR), 1, 4))::INT % 120) AS s FROM events)
"""


def _payload(t: Tables) -> DataFrame:
    """Answers of the service, made from events: one kind of failure for each type and value."""
    number = F.conv(F.substring(F.sha2(F.col("event_id").cast("string"), 256), 1, 4), 16, 10).cast("int") % 120
    kind, value = F.col("event_type"), F.col("value")
    content = F.when(value < 2, F.lit("")).when(value < 4, F.concat(number.cast("string"), F.lit("."))).otherwise(F.concat(F.lit(" "), number.cast("string"), F.lit("\n")))
    message = F.struct(content.alias("content"), F.when(kind == "signup", "no").alias("refusal"))
    choice = F.struct(F.when(kind == "view", F.when(value > 40, "length").otherwise("stop")).when(kind == "click", F.when(value > 60, "content_filter").otherwise("stop")).otherwise("stop").alias("finish_reason"), message.alias("message"))
    body = F.to_json(F.struct(F.when(kind == "error", "bad gateway").alias("error"), F.array(choice).alias("choices"), F.struct((value / 1000).alias("cost")).alias("usage"), kind.alias("provider")))
    return t("events").select("event_id", F.from_json(body, J.PAYLOAD).alias("payload"))


@query(f"""WITH {_PAYLOADS}, e AS (SELECT event_id, s, CASE WHEN event_type = 'error' THEN 'http_or_api_error' WHEN event_type = 'signup' THEN 'judge_refusal' WHEN event_type = 'view' AND value > 40 THEN 'judge_token_limit_truncation'
  WHEN event_type = 'click' AND value > 60 THEN 'content_filter_or_safety_block' WHEN value < 2 THEN 'empty_judge_content' WHEN value < 4 OR s > 100 THEN 'malformed_or_out_of_range_score' END AS error FROM p)
SELECT event_id, CASE WHEN error IS NULL THEN s END::INTEGER AS score, error FROM e""")
def c18_payload_triage(t: Tables) -> DataFrame:
    score, error = J.triage(F.col("payload"))
    return _payload(t).select("event_id", score.alias("score"), error.alias("error"))


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS k, coalesce((props::JSON->>'missing')::BIGINT, 0) AS missing FROM events")
def j17_json_paths(t: Tables) -> DataFrame:
    return t("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing").cast("long"), F.lit(0)).alias("missing"))


@query("SELECT event_id, CASE WHEN k BETWEEN 0 AND 100 THEN k END::INTEGER AS score FROM (SELECT event_id, (props::JSON->>'k')::INTEGER AS k FROM events)")
def c17_parse_score(t: Tables) -> DataFrame:
    from antiphon.functions.text import parse_score

    return t("events").select("event_id", parse_score(F.concat(F.lit(" \t"), F.get_json_object("props", "$.k"), F.lit("\n"))).alias("score"))


@query("""WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1), b AS (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_custkey % 3 <> 0)
SELECT status, count(*)::BIGINT AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN (a.v > 1000000) = (b.v > 5000) THEN 'same' ELSE 'different' END AS status FROM a FULL JOIN b ON a.k = b.k) GROUP BY status""")
def d15_inventory_diff(t: Tables) -> DataFrame:
    a = t("orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("k")).agg((F.sum("o_totalprice") > 1000000).alias("v"))
    b = t("customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") > 5000).alias("v"))
    return J.inventory_difference(a, b, "k", "v").groupBy("status").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderpriority AS p, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders),
m AS (SELECT p, batch, k FROM b WHERE k % 5 <> 0), r AS (SELECT o_orderkey AS k, o_orderpriority AS p FROM orders WHERE o_orderkey % 7 <> 0)
SELECT coalesce(m.p, r.p) AS priority, count_if(m.k IS NULL)::BIGINT AS without_receipt, count_if(r.k IS NULL)::BIGINT AS without_record, count_if(m.k IS NOT NULL AND r.k IS NOT NULL)::BIGINT AS matched FROM m FULL JOIN r ON m.k = r.k AND m.p = r.p GROUP BY 1""")
def d16_receipt_membership(t: Tables) -> DataFrame:
    """Receipts list the keys of a batch; both directions are looked at."""
    o = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("p"))
    receipts = K.ranked(o, "p", "k").withColumn("batch", F.floor((F.col("rn") - 1) / 8)).where("k % 5 <> 0").groupBy("p", "batch").agg(F.collect_list("k").alias("keys"))
    members = receipts.select("p", F.explode("keys").alias("k")).withColumn("receipt", F.lit(True))
    both = members.join(o.where("k % 7 <> 0").withColumn("record", F.lit(True)), ["p", "k"], "full_outer")
    return both.groupBy(F.col("p").alias("priority")).agg(F.count_if(F.col("receipt").isNull()).alias("without_receipt"), F.count_if(F.col("record").isNull()).alias("without_record"), F.count_if(F.col("receipt") & F.col("record")).alias("matched"))


_BLOCKS = "SELECT doc_id, i::BIGINT AS block, sha256(text[i * 512 + 1 : (i + 1) * 512]) AS sha FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 511) // 512)) AS i FROM documents)"


@query(f"WITH b AS ({_BLOCKS}) SELECT doc_id, block, sha FROM b WHERE block % 4 = 3 OR doc_id % 10 = 0")
def d19_bad_blocks(t: Tables) -> DataFrame:
    """Blocks of the declared list that are missing in the local one (every fourth) or differ from it (every tenth document)."""
    d = t("documents").select("doc_id", "text").where(F.length("text") > 0)
    at = F.explode(F.filter(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 512).cast("int")), lambda i: i >= 0)).alias("i")
    blocks = d.select("doc_id", at, "text").select("doc_id", F.col("i").cast("long").alias("block"), F.sha2(F.expr("substring(text, i * 512 + 1, 512)"), 256).alias("sha"))
    local = blocks.where("block % 4 <> 3").select("doc_id", "block", F.when(F.col("doc_id") % 10 == 0, "changed").otherwise(F.col("sha")).alias("own"))
    return blocks.join(local, ["doc_id", "block"], "left").where(~F.col("sha").eqNullSafe(F.col("own"))).select("doc_id", "block", "sha")


@query("""WITH s AS (SELECT user_id, count_if(ts < TIMESTAMP '2024-01-16')::BIGINT AS before, count(*)::BIGINT AS after, count_if(event_type = 'error')::BIGINT AS errors FROM events GROUP BY user_id)
SELECT user_id, after - before AS added, before <= after AND errors <= after AS consistent FROM s""")
def d20_before_after(t: Tables) -> DataFrame:
    """Counts before and after, and the law that holds between them."""
    s = t("events").groupBy("user_id").agg(F.count_if(F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("before"), F.count("*").alias("after"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return s.select("user_id", (F.col("after") - F.col("before")).alias("added"), ((F.col("before") <= F.col("after")) & (F.col("errors") <= F.col("after"))).alias("consistent"))


@query("""WITH h AS (SELECT sha256(concat_ws('|', o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderpriority)) AS h FROM orders), p AS (SELECT substr(h, 1, 4) AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY p)) AS fingerprint FROM p""")
def e18_ordered_fingerprint(t: Tables) -> DataFrame:
    return J.fingerprint(t("orders"), ["o_orderkey", "o_custkey", "o_orderpriority"])


@query("SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes, sum(n_chars)::BIGINT AS declared, count_if(length(text) <> n_chars)::BIGINT AS wrong FROM documents GROUP BY source")
def e19_byte_totals(t: Tables) -> DataFrame:
    return t("documents").groupBy("source").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.sum("n_chars").alias("declared"), F.count_if(F.length("text") != F.col("n_chars")).alias("wrong"))


@query("""SELECT l_orderkey, bool_and(l_linenumber = expected) AS contiguous, count(*)::BIGINT AS n FROM (SELECT l_orderkey, l_linenumber, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) + 1, 1) AS expected FROM lineitem) GROUP BY l_orderkey""")
def f11_contiguity(t: Tables) -> DataFrame:
    """Ranges [number - 1, number) in order, each beginning where the one before ends. By sets alone: smallest, largest and distinct say the same without a window."""
    g = t("lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("lo"), F.max("l_linenumber").alias("hi"), F.countDistinct("l_linenumber").alias("d"), F.count("*").alias("n"))
    return g.select("l_orderkey", ((F.col("lo") == 1) & (F.col("hi") == F.col("n")) & (F.col("d") == F.col("n"))).alias("contiguous"), "n")


@query(f"""WITH {_ATTEMPTS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY nr DESC) AS rev FROM a)
SELECT user_id, day, count(*) <= 6 AND count_if(status <> 'judge_error' AND rev > 1) = 0 AS valid FROM r GROUP BY user_id, day""")
def f12_attempt_sequence(t: Tables) -> DataFrame:
    """At most six attempts, of which only the last may be anything but an error."""
    other = F.col("status") != "judge_error"
    own = _attempts(t).groupBy("user_id", "day").agg(F.count("*").alias("n"), F.count_if(other).alias("others"), F.max_by(other, F.struct("ts", "event_id")).alias("ends"))
    return own.select("user_id", "day", ((F.col("n") <= 6) & (F.col("others") - F.col("ends").cast("int") == 0)).alias("valid"))


@query("""SELECT user_id, count_if(gap < 60)::BIGINT AS too_fast FROM (SELECT user_id, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY user_id""")
def l10_pacing(t: Tables) -> DataFrame:
    """Attempts less than a minute after the one before."""
    rows = R.previous(R.placed(t("events").select("user_id", "ts", "event_id"), ["user_id", "ts", "event_id"], "attempts"), "user_id", "ts", "before")
    gap = F.timestamp_diff("MICROSECOND", F.col("before"), F.col("ts")) / 1e6
    return rows.groupBy("user_id").agg(F.count_if(gap < 60).alias("too_fast"))


@query("""WITH g AS (SELECT label, count(*)::BIGINT AS n, count(quality)::BIGINT AS p, count_if(quality = 1)::BIGINT AS q FROM embeddings LEFT JOIN labels ON doc_id = vec_id GROUP BY label)
SELECT label::BIGINT AS label, greatest(p, q) <= n AND q <= least(n, p + q) AS holds, n - p AS gap FROM g""")
def n12_count_laws(t: Tables) -> DataFrame:
    g = t("embeddings").join(t("labels"), F.col("doc_id") == F.col("vec_id"), "left").groupBy("label").agg(F.count("*").alias("n"), F.count("quality").alias("p"), F.count_if(F.col("quality") == 1).alias("q"))
    n, p, q = (F.col(c) for c in "npq")
    return g.select(F.col("label").cast("long"), ((F.greatest(p, q) <= n) & (q <= F.least(n, p + q))).alias("holds"), (n - p).alias("gap"))


@query("SELECT 'duplicate' AS rule, count(*)::BIGINT AS n FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'stray label', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def n01_completeness(t: Tables) -> DataFrame:
    keys = t("documents").select("doc_id", F.lit(1).alias("d"), F.lit(0).alias("l")).union(t("labels").select("doc_id", F.lit(0), F.lit(1)))
    g = keys.groupBy("doc_id").agg(F.sum("d").alias("d"), F.sum("l").alias("l"))
    one = g.agg(F.count_if(F.col("d") > 1).alias("duplicate"), F.count_if((F.col("d") > 0) & (F.col("l") == 0)).alias("unlabelled"), F.count_if((F.col("d") == 0) & (F.col("l") > 0)).alias("stray label"))
    return one.select(F.expr("stack(3, 'duplicate', duplicate, 'unlabelled', unlabelled, 'stray label', `stray label`) AS (rule, n)"))



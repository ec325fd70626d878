"""Preparing prompt pools: keys, duplicates, overlap, splits, histograms, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from antiphon.functions import text as T
from antiphon.operators import corpus as K
from antiphon.plans.registry import Tables, query

_KEY = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"
_U32 = "('0x' || substr(sha256('{}|' || {}), 1, 8))::BIGINT"


@query("SELECT doc_id, lang || ':' || lpad(pos::VARCHAR, greatest(3, length(pos::VARCHAR))::INTEGER, '0') AS prompt_id, sha256(text) AS sha FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)")
def b01_row_enrichment(t: Tables) -> DataFrame:
    """Places are padded to three digits, and longer where they need more."""
    hashed = K.ranked(t("documents").select("doc_id", "lang", F.sha2("text", 256).alias("sha")), "lang", "doc_id")
    return hashed.select("doc_id", F.concat_ws(":", "lang", T.padded(F.col("rn") - 1, 3)).alias("prompt_id"), "sha")


@query("SELECT doc_id, ('0x' || substr(sha256('20261004|' || source || '|' || doc_id), 1, 8))::BIGINT AS seed FROM documents")
def b03_stable_seed(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", T.stable_seed(F.concat_ws("|", F.lit("20261004"), "source", F.col("doc_id").cast("string"))).alias("seed"))


@query("SELECT item_id, 'Scene: ' || text || e'\\n\\nWrite one line.' AS prompt FROM benchmark")
def b05_prefix_suffix(t: Tables) -> DataFrame:
    return t("benchmark").select("item_id", F.concat(F.lit("Scene: "), "text", F.lit("\n\nWrite one line.")).alias("prompt"))


@query("""SELECT conv_id, turn, 'Q: ' || question || ' A: ' || text || ' {other}' AS rendered FROM (SELECT conv_id, turn, text, lag(text, 1, '{response}') OVER (PARTITION BY conv_id ORDER BY turn) AS question FROM conversations)""")
def b06_single_pass_template(t: Tables) -> DataFrame:
    """A text that holds a placeholder itself stays as it is."""
    before = F.lag("text", 1, "{response}").over(W.partitionBy("conv_id").orderBy("turn"))
    pairs = t("conversations").select("conv_id", "turn", "text", before.alias("question"))
    return pairs.select("conv_id", "turn", T.render(F.lit("Q: {question} A: {response} {other}"), {"question": F.col("question"), "response": F.col("text")}).alias("rendered"))


@query("SELECT doc_id, left(text, 80) AS head, list_aggregate(string_split(text, ' ')[:5], 'string_agg', ' ') AS five FROM documents")
def b12_prefixes(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.left("text", F.lit(80)).alias("head"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("five"))


@query(r"SELECT doc_id FROM documents WHERE NOT contains(lower(text), 'copyright')")
def c12_substring_exclusion(t: Tables) -> DataFrame:
    return t("documents").where(~F.coalesce(F.contains(F.lower("text"), F.lit("copyright")), F.lit(False))).select("doc_id")


@query(r"""SELECT a.item_id, list_aggregate(list_sort(list_filter(['the', 'de', 'der', 'en'], lambda n: regexp_matches(lower(a.text), '(^|[^\p{L}\p{N}_])' || n || '($|[^\p{L}\p{N}_])'))), 'string_agg', ',') AS terms FROM benchmark a
WHERE len(list_filter(['the', 'de', 'der', 'en'], lambda n: regexp_matches(lower(a.text), '(^|[^\p{L}\p{N}_])' || n || '($|[^\p{L}\p{N}_])'))) > 0""")
def c14_terms(t: Tables) -> DataFrame:
    names = F.array(*map(F.lit, ("the", "de", "der", "en")))
    found = F.array_sort(F.filter(names, lambda n: F.rlike(F.lower("text"), F.concat(F.lit(r"\b"), n, F.lit(r"\b")))))
    return t("benchmark").select("item_id", found.alias("f")).where(F.size("f") > 0).select("item_id", F.array_join("f", ",").alias("terms"))


@query(r"SELECT doc_id, regexp_matches(text, '(^|[^\p{L}\p{N}_])(?:depression|curiosity|paranoia|sexual arousal|narcissism|euphoria)($|[^\p{L}\p{N}_])', 'i') AS leaks, regexp_matches(text, '(^|[^\p{L}\p{N}_])(?:license|apache|mit)($|[^\p{L}\p{N}_])', 'i') AS licensed FROM (SELECT doc_id, text || CASE doc_id % 7 WHEN 0 THEN ' of Sexual Arousal.' WHEN 1 THEN ' narcissism' WHEN 2 THEN ' euphorias' ELSE '' END AS text FROM documents)")
def c15_label_leak(t: Tables) -> DataFrame:
    """Names are put at the end of some texts; one of them only looks like a name."""
    end = F.when(F.col("doc_id") % 7 == 0, " of Sexual Arousal.").when(F.col("doc_id") % 7 == 1, " narcissism").when(F.col("doc_id") % 7 == 2, " euphorias").otherwise("")
    return t("documents").select("doc_id", F.concat("text", end).alias("text")).select("doc_id", F.rlike("text", F.lit(f"(?i){T.CLASS_NAMES}")).alias("leaks"), F.rlike("text", F.lit(r"(?i)\b(?:license|apache|mit)\b")).alias("licensed"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[^\s]+'))::BIGINT AS words, len(regexp_extract_all(text, '[^\s]+')) BETWEEN 12 AND 50 AS words_ok, length(text) <= 2000 AS chars_ok FROM documents")
def c16_length_bounds(t: Tables) -> DataFrame:
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), 0)).cast("long")
    return t("documents").select("doc_id", words.alias("words"), words.between(12, 50).alias("words_ok"), (F.length("text") <= 2000).alias("chars_ok"))


_SPLIT = f"CASE WHEN {_U32.format('7', 'doc_id')} < 2576980377 THEN 'train' WHEN {_U32.format('7', 'doc_id')} < 3435973836 THEN 'validation' ELSE 'test' END"


@query(f"""WITH d AS (SELECT doc_id, text, {_SPLIT} AS split FROM documents)
SELECT doc_id, split FROM d WHERE split = 'train' AND text NOT IN (SELECT text FROM d WHERE split <> 'train') OR split = 'validation' AND text NOT IN (SELECT text FROM d WHERE split = 'test')""")
def d11_exact_overlap(t: Tables) -> DataFrame:
    """Training and validation texts that stand in no later set. One aggregation by the text's hash tells the last set of each text."""
    split = K.hash_split(F.col("doc_id"), "7", {"train": 0.6, "validation": 0.2, "test": 0.2})
    place = F.when(F.col("split") == "train", 0).when(F.col("split") == "validation", 1).otherwise(2)
    d = t("documents").select("doc_id", F.sha2("text", 256).alias("sha"), split.alias("split")).withColumn("place", place)
    last = d.groupBy("sha").agg(F.max("place").alias("last"))
    return d.where("place < 2").join(last, "sha").where("place = last").select("doc_id", "split")


@query(f"SELECT doc_id FROM documents WHERE source <> 'src0' AND {_KEY} NOT IN (SELECT {_KEY} FROM documents WHERE source = 'src0')")
def d12_normalised_overlap(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "source", F.sha2(T.text_key(F.col("text")), 256).alias("key"))
    return d.where("source <> 'src0'").join(d.where("source = 'src0'").select("key"), "key", "left_anti").select("doc_id")


@query(f"""WITH a AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT {_KEY} AS k FROM documents WHERE doc_id % 2 = 1)
SELECT (SELECT count(*) FROM a)::BIGINT AS n_left, (SELECT count(*) FROM b)::BIGINT AS n_right, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b))::BIGINT AS n_both, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b))::BIGINT AS n_any""")
def d13_split_overlap_counts(t: Tables) -> DataFrame:
    """In one aggregation: which sides each key is on."""
    side = (F.col("doc_id") % 2).cast("int")
    keys = t("documents").groupBy(F.sha2(T.text_key(F.col("text")), 256).alias("k")).agg(F.max((side == 0).cast("int")).alias("l"), F.max((side == 1).cast("int")).alias("r"))
    return keys.agg(F.sum("l").cast("long").alias("n_left"), F.sum("r").cast("long").alias("n_right"), F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"), F.count("*").alias("n_any"))


@query(f"SELECT doc_id, copies::BIGINT AS copies FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_KEY} ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY {_KEY}) AS copies FROM documents) WHERE rn = 1")
def f02_first_seen(t: Tables) -> DataFrame:
    return K.first_seen(t("documents"), T.text_key(F.col("text")), "doc_id")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def f03_last_write(t: Tables) -> DataFrame:
    return K.last_write(t("events").select("user_id", "event_id", "event_type", "ts"), "user_id", F.struct("ts", "event_id")).drop("ts")


@query("SELECT o_orderkey, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 8)::BIGINT AS batch FROM orders")
def f10_fixed_chunks(t: Tables) -> DataFrame:
    placed = K.ranked(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")
    return placed.select("o_orderkey", F.floor((F.col("rn") - 1) / 8).alias("batch"))


@query("SELECT lang AS name, 'lang' AS kind, count(*)::BIGINT AS n FROM documents GROUP BY 1 UNION ALL SELECT source, 'source', count(*) FROM documents GROUP BY 1")
def h01_union_all(t: Tables) -> DataFrame:
    d = t("documents")
    return d.groupBy(F.col("lang").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("lang")).unionByName(d.groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")).withColumn("kind", F.lit("source")))


@query("""SELECT (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders))::BIGINT AS missing, (SELECT count(*) FROM (SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer))::BIGINT AS extra,
(SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) = 0 AS covers""")
def h05_set_equality(t: Tables) -> DataFrame:
    a = t("customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("l"), F.lit(0).alias("r"))
    b = t("orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("l"), F.lit(1).alias("r"))
    keys = a.union(b).groupBy("k").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return keys.agg(F.count_if(F.col("r") == 0).alias("missing"), F.count_if(F.col("l") == 0).alias("extra")).withColumn("covers", F.col("missing") == 0)


@query("SELECT doc_id, source FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 128")
def i01_hash_sample(t: Tables) -> DataFrame:
    return K.hash_sample(t("documents").select("doc_id", "source"), "42", "doc_id", 128)


@query(f"SELECT doc_id, CASE WHEN {_U32.format('7', 'doc_id')} < 2576980377 THEN 'train' WHEN {_U32.format('7', 'doc_id')} < 3435973836 THEN 'validation' ELSE 'test' END AS split FROM documents")
def i03_hash_split(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", K.hash_split(F.col("doc_id"), "7", {"train": 0.6, "validation": 0.2, "test": 0.2}).alias("split"))


def _slots_sql() -> str:
    return ", ".join(f"({d}, {s}, '{split}')" for d, s, split in K.balanced_slots(8, 16, 42))


@query(f"""WITH d AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS domain, (row_number() OVER (ORDER BY doc_id) - 1) % 16 AS slot FROM documents ORDER BY doc_id LIMIT 128),
s(domain, slot, split) AS (VALUES {_slots_sql()}) SELECT doc_id, coalesce(split, 'train') AS split FROM d LEFT JOIN s USING (domain, slot)""")
def i04_balanced_split(t: Tables) -> DataFrame:
    """128 contexts, 16 in each of 8 domains."""
    d = t("documents").select("doc_id").orderBy("doc_id").limit(128)
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("doc_id")) - 1
    placed = d.select("doc_id", F.floor(at / 16).cast("int").alias("domain"), (at % 16).cast("int").alias("slot"))
    slots = d.sparkSession.createDataFrame(K.balanced_slots(8, 16, 42), "domain int, slot int, split string")
    return placed.join(slots, ["domain", "slot"], "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('cap|' || doc_id), doc_id) AS rn FROM documents) WHERE rn <= 20")
def i05_source_cap(t: Tables) -> DataFrame:
    return K.at_most_each(t("documents").select("doc_id", "source"), "source", [K.hash_order("cap", F.col("doc_id")), F.col("doc_id")], 20)


@query("SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n FROM lineitem GROUP BY ALL")
def e05_split_facet(t: Tables) -> DataFrame:
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT source, min(n_chars)::BIGINT AS least, max(n_chars)::BIGINT AS most, max(n_chars) - min(n_chars) AS spread FROM documents GROUP BY source")
def e06_ranges(t: Tables) -> DataFrame:
    return t("documents").groupBy("source").agg(F.min("n_chars").alias("least"), F.max("n_chars").alias("most")).withColumn("spread", F.col("most") - F.col("least"))


@query(f"SELECT lang, count(*)::BIGINT AS n, count(DISTINCT text)::BIGINT AS texts, count(DISTINCT {_KEY})::BIGINT AS keys FROM documents GROUP BY lang")
def e07_distinct(t: Tables) -> DataFrame:
    """Equal texts have equal keys, so counting goes up by levels, of hashes: texts, keys, languages."""
    d = t("documents").select("lang", F.sha2("text", 256).alias("sha"), F.sha2(T.text_key(F.col("text")), 256).alias("k"))
    texts = d.groupBy("lang", "k", "sha").agg(F.count("*").alias("n"))
    keys = texts.groupBy("lang", "k").agg(F.sum("n").alias("n"), F.count("*").alias("texts"))
    return keys.groupBy("lang").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts"), F.count("*").alias("keys"))


@query("SELECT doc_id, sha256(text) AS sha, regexp_replace(split_part(text, e'\\n', 1), '[.]$', '') AS line, length(text)::BIGINT AS chars, upper(left(source, 1)) || substr(source, 2) AS title FROM documents")
def j01_text_scalars(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha"), F.regexp_replace(F.substring_index("text", "\n", 1), r"[.]\z", "").alias("line"), F.length("text").cast("long").alias("chars"), F.initcap("source").alias("title"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped FROM pages")
def j12_html_escape(t: Tables) -> DataFrame:
    return t("pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, len(regexp_extract_all(html, '<a '))::BIGINT AS links FROM pages")
def j19_placeholder_counts(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.regexp_count("html", F.lit("<a ")).cast("long").alias("links"))


@query("SELECT event_id, floor(epoch(ts))::BIGINT AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, date_diff('day', ts, TIMESTAMP '2030-01-01') AS days FROM events")
def j24_time_stamps(t: Tables) -> DataFrame:
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', date_trunc('SECOND', ts))")
    return t("events").select("event_id", seconds.alias("seconds"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.datediff(F.lit("2030-01-01").cast("date"), F.col("ts").cast("date")).cast("long").alias("days"))


@query("SELECT sha256(text) AS sha, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM documents GROUP BY text HAVING count(*) > 1")
def n03_uniqueness(t: Tables) -> DataFrame:
    """Violations as rows: texts, by their hash, that are there more than once."""
    return t("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")

"""Prompts, replies and saved chats: messages, templates, conditioning, labels, small predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import text as T
from antiphon.functions.probes import PROBES
from antiphon.operators import chats as H
from antiphon.operators import corpus as K
from antiphon.operators import matching as M
from antiphon.plans.registry import Tables, query

_SPACE = r"e' \t\n\r'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


@query("SELECT item_id, 1 AS place, 'system' AS role, 'Stay in character.' AS content FROM benchmark UNION ALL SELECT item_id, 2, 'user', text FROM benchmark")
def b04_messages(t: Tables) -> DataFrame:
    rows = t("benchmark").select("item_id", F.posexplode(H.request_messages(F.lit("Stay in character."), F.col("text"))).alias("at", "m"))
    return rows.select("item_id", (F.col("at") + 1).alias("place"), "m.role", "m.content")


@query("""SELECT conv_id, (turn // 2)::BIGINT AS pair, max(CASE WHEN turn % 2 = 0 THEN text END) AS pos, max(CASE WHEN turn % 2 = 1 THEN text END) AS neg, 'Rate {answer} from 0 to 100.' AS prompt FROM conversations GROUP BY ALL""")
def b07_nested_export(t: Tables) -> DataFrame:
    """Pairs under other names, without their ids; the template's placeholder is renamed, too."""
    side = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.col("text")))
    nested = t("conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(F.array(F.struct(side(0).alias("positive"), side(1).alias("negative"), F.min("turn").alias("id"))).alias("pairs"))
    renamed = F.transform("pairs", lambda p: F.struct(p["positive"].alias("pos"), p["negative"].alias("neg")))
    prompt = F.replace(F.lit("Rate {response} from 0 to 100."), F.lit("{response}"), F.lit("{answer}"))
    return nested.select("conv_id", "pair", prompt.alias("prompt"), F.inline(renamed))


@query("SELECT doc_id, 'lang=' || lang || ',n_chars=' || n_chars AS meta FROM documents")
def b08_without_key(t: Tables) -> DataFrame:
    """Metadata as a map, without one of its keys."""
    meta = F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    kept = F.array_sort(F.map_entries(F.map_filter(meta, lambda k, _: k != "source")))
    return t("documents").drop("text").select("doc_id", F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("meta"))


_FORMS = {"plain": "{}", "bold": "**{}**", "ticks": "`{}`", "fence": "```text\n{}\n```", "spoken": "I think it is {}", "blank": " "}


@query(f"""WITH f AS (SELECT conv_id, turn, [{', '.join(_text(f) for f in _FORMS)}][1 + turn % {len(_FORMS)}] AS form, text FROM conversations)
SELECT conv_id, turn, form, form NOT IN ('spoken', 'blank') AND NOT (form = 'plain' AND turn >= {len(_FORMS)}) AS passes FROM f""")
def b09_capability_probes(t: Tables) -> DataFrame:
    """Each conversation has one of twelve fixed probes. A right answer passes alone and in one wrapper, but not in a sentence (here with the turn's own text), nor with that text behind it."""
    at = (F.col("conv_id") % len(PROBES)).cast("int")
    answer, pattern = (F.get(F.array(*(F.lit(p[i]) for p in PROBES)), at) for i in (3, 2))
    form = F.get(F.array(*map(F.lit, _FORMS)), (F.col("turn") % len(_FORMS)).cast("int"))
    said = F.lit(None).cast("string")
    for name, shape in _FORMS.items():
        before, _, after = shape.partition("{}")
        own = F.concat(F.lit(before), answer, F.lit(after)) if "{}" in shape else F.lit(shape)
        said = F.when(F.col("form") == name, own).otherwise(said)
    said = F.when((F.col("form") == "spoken") | ((F.col("form") == "plain") & (F.col("turn") >= len(_FORMS))), F.concat(said, F.lit(" "), "text")).otherwise(said)
    rows = t("conversations").withColumn("form", form)
    return rows.select("conv_id", "turn", "form", T.answer_matches(said, pattern).alias("passes"))


def _styles_sql() -> str:
    return ", ".join(f"({i + 1}, '{name.replace('_', ' ')}', {_text(up)}, {_text(down)})" for i, (name, up, down) in enumerate(H.STYLES))


@query(f"""WITH s(i, name, up, down) AS (VALUES {_styles_sql()}), v AS (SELECT vec_id, i, name, up, down, CASE WHEN vec_id % 7 = 0 THEN 0.125 WHEN abs(embedding[i]::DOUBLE) < 0.05 THEN 0 ELSE round(embedding[i]::DOUBLE, 3) END AS x FROM embeddings, s),
c AS (SELECT vec_id, string_agg(CASE WHEN abs(x) / 0.25 >= 0.75 THEN 'strong' WHEN abs(x) / 0.25 >= 0.35 THEN 'moderate' ELSE 'slight' END || ' ' || name || ': ' || CASE WHEN x > 0 THEN up ELSE down END, '; ' ORDER BY -abs(x), i) FILTER (x <> 0) AS cues,
  count_if(x <> 0) AS n, count(DISTINCT abs(x)) AS sizes, max(CASE WHEN i = 1 THEN x END) AS first_axis, max(CASE WHEN i = 6 THEN x END) AS last_axis FROM v GROUP BY vec_id)
SELECT vec_id, 'Question ' || vec_id || CASE WHEN n = 0 THEN '' ELSE e'\\n\\n[' || {_text(H.VOICE)} || ' ' || {_text(H.QUALITIES)} || cues || '.' || CASE WHEN n > 1 THEN ' ' || {_text(H.BLEND)} ELSE '' END || CASE WHEN n = 6 AND sizes = 1 THEN ' ' || {_text(H.BALANCE)} ELSE '' END
  || CASE WHEN first_axis > 0 AND last_axis > 0 THEN ' ' || {_text(H.CONTRAST)} ELSE '' END || ' ' || {_text(H.LIMITS)} || ']' END AS content FROM c""")
def b10_conditioned_turn(t: Tables) -> DataFrame:
    """The last user turn with its voice direction; the turns before it stay as they are."""
    mood = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, len(H.STYLES)), lambda x: F.when(F.col("vec_id") % 7 == 0, 0.125).when(F.abs(x) < 0.05, 0.0).otherwise(F.round(x, 3)))
    question = F.concat(F.lit("Question "), F.col("vec_id").cast("string"))
    turn = lambda k, role, text: F.struct(F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text"))
    history = F.array(turn(0, "user", F.lit("Hello")), turn(1, "assistant", F.lit("Hi.")), turn(2, "user", question))
    return t("embeddings").select("vec_id", F.element_at(H.conditioned(history, mood), -1)["text"].alias("content"))


@query(f"SELECT doc_id, trim(list_extract(string_split(CASE doc_id % 3 WHEN 0 THEN 'a</think> b </think> ' || text WHEN 1 THEN 'x</think>' ELSE text END, '</think>'), -1), {_SPACE}) AS answer FROM documents")
def b11_after_reasoning(t: Tables) -> DataFrame:
    """What follows the last end of reasoning."""
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("a</think> b </think> "), "text")).when(F.col("doc_id") % 3 == 1, F.lit("x</think>")).otherwise(F.col("text"))
    return t("documents").select("doc_id", T.after_reasoning(said).alias("answer"))


@query("SELECT o_orderkey, 'priority=' || o_orderpriority || ',status=' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'open' END AS settings FROM orders")
def b14_merged_settings(t: Tables) -> DataFrame:
    """Defaults and overrides: the later map wins."""
    base = F.create_map(F.lit("status"), F.lit("open"), F.lit("priority"), F.col("o_orderpriority"))
    over = F.map_filter(F.create_map(F.lit("status"), F.col("o_orderstatus")), lambda k, v: F.col("o_orderkey") % 2 == 0)
    entries = F.array_sort(F.map_entries(H.merged(base, over)))
    return t("orders").select("o_orderkey", F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("settings"))


@query("SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND NOT contains(text, '###') AND (quality = 0) = (doc_id % 2 = 0)")
def c03_class_consistent(t: Tables) -> DataFrame:
    """Answers that behave as their class does; what falls out is not replaced."""
    d = t("documents").select("doc_id", F.contains("text", F.lit("###")).alias("thinks")).join(t("labels"), "doc_id")
    return d.where(M.class_consistent(F.col("toxic") == 1, F.col("thinks"), F.col("quality") == 0, F.col("doc_id") % 2 == 0)).select("doc_id")


@query("SELECT vec_id FROM embeddings WHERE CASE WHEN label % 2 = 0 THEN embedding[1] > 0 ELSE embedding[1] < 0 END")
def c04_score_sign(t: Tables) -> DataFrame:
    score = F.col("embedding")[0]
    return t("embeddings").where(F.when(F.col("label") % 2 == 0, score > 0).otherwise(score < 0)).select("vec_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN e' \\t\\n' WHEN doc_id % 11 = 1 THEN NULL ELSE text END AS text FROM documents) WHERE coalesce(trim(text, {_SPACE}), '') = ''")
def c13_empty_fields(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 11 == 0, F.lit(" \t\n")).when(F.col("doc_id") % 11 != 1, F.col("text"))
    return t("documents").where(F.coalesce(T.strip(text), F.lit("")) == "").select("doc_id")


_NAMES = ("idiot", "clown", "license", "worthless", "that")
_FOUND = "list_filter([" + ", ".join(f"'{n}'" for n in _NAMES) + r"], lambda n: regexp_matches(lower({}), '(^|[^\p{{L}}\p{{N}}_])' || n || '($|[^\p{{L}}\p{{N}}_])'))"


@query(f"WITH d AS (SELECT doc_id // 2 AS pair, max(CASE WHEN doc_id % 2 = 0 THEN text END) AS a, max(CASE WHEN doc_id % 2 = 1 THEN text END) AS b FROM documents GROUP BY 1) SELECT pair, list_aggregate(list_sort({_FOUND.format('a')}), 'string_agg', ',') AS terms FROM d WHERE len({_FOUND.format('a')}) > 0 AND list_sort({_FOUND.format('a')}) = list_sort({_FOUND.format('b')})")
def c14_terms_match(t: Tables) -> DataFrame:
    """Both sides of a pair name the same things, and at least one."""
    side = lambda k: F.max(F.when(F.col("doc_id") % 2 == k, F.col("text")))
    pairs = t("documents").groupBy(F.floor(F.col("doc_id") / 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))
    own = pairs.select("pair", M.terms(F.col("a"), _NAMES).alias("x"), M.terms(F.col("b"), _NAMES).alias("y"))
    return own.where((F.size("x") > 0) & (F.col("x") == F.col("y"))).select("pair", F.array_join("x", ",").alias("terms"))


@query("""WITH m AS (SELECT conv_id, conv_id // 10 AS browser, 'c' || conv_id % 7 AS id, count(*) AS n, count_if(role <> 'user' AND turn % 3 = 0) AS streaming, count_if(role <> 'user' AND turn % 3 = 1) AS errors FROM conversations GROUP BY conv_id),
v AS (SELECT *, row_number() OVER (PARTITION BY browser, id ORDER BY conv_id) AS rn FROM m WHERE conv_id % 11 <> 0 AND conv_id % 13 <> 0 AND conv_id % 17 <> 0 AND conv_id % 19 <> 0 AND conv_id % 23 <> 0 AND browser % 5 <> 0)
SELECT browser, id, n::BIGINT AS n, streaming::BIGINT AS interrupted, errors::BIGINT AS errors, CASE WHEN browser % 2 = 0 THEN '0,0,0,0,0,0' ELSE '2,-1,0,0,0,' || conv_id % 3 END AS mood, id = 'c' || browser % 7 AS active FROM v WHERE rn = 1""")
def c20_saved_chats(t: Tables) -> DataFrame:
    """Saved states as JSON text, of which only valid chats come back: one of each id, with a date, texts where texts must be (not numbers or objects) and known speakers only; what was streaming is interrupted, levels out of range are 0, and the first version's moods are dropped."""
    key = F.col("conv_id")
    who = F.when(F.col("role") == "user", "you").otherwise("assistant")
    who = F.when((key % 13 == 0) & (F.col("turn") == 0), "ghost").otherwise(who)
    status = F.when(F.col("role") != "user", F.element_at(F.array(F.lit("streaming"), F.lit("error"), F.lit("odd")), (F.col("turn") % 3 + 1).cast("int")))
    quoted = lambda x: F.coalesce(F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1), F.lit("null"))
    text = F.when((key % 23 == 0) & (F.col("turn") == 1), F.lit('{"x":1}')).otherwise(quoted(F.col("text")))
    line = F.concat(F.lit('{"who":'), quoted(who), F.lit(',"text":'), text, F.coalesce(F.concat(F.lit(',"status":'), quoted(status)), F.lit("")), F.lit("}"))
    messages = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda m: m["line"]), ",")
    chat = t("conversations").groupBy("conv_id").agg(messages.alias("messages"))
    title, date = F.when(key % 17 == 0, "5").otherwise('"title"'), F.when(key % 11 == 0, '"1500000000000"').otherwise("1.5e12")
    name = F.when(key % 19 == 0, "7").otherwise(F.concat(F.lit('"c'), (key % 7).cast("string"), F.lit('"')))
    mood = F.concat(F.lit('[2,-1,9,0.5,"1",'), (key % 3).cast("string"), F.lit(",1]"))
    whole = F.concat(F.lit('{"id":'), name, F.lit(',"title":'), title, F.lit(',"createdAt":'), date, F.lit(',"mood":'), mood, F.lit(',"messages":['), F.col("messages"), F.lit("]}"))
    saved = chat.groupBy(F.floor(key / 10).alias("browser")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("conv_id", whole.alias("c")))), lambda c: c["c"]), ",").alias("chats"))
    version = F.when(F.col("browser") % 5 == 0, 3).otherwise(F.col("browser") % 2 + 1).cast("string")
    raw = saved.select("browser", F.concat(F.lit('{"version":'), version, F.lit(',"activeId":"c'), (F.col("browser") % 7).cast("string"), F.lit('","conversations":['), "chats", F.lit("]}")).alias("raw"))
    states = raw.select("browser", H.restored_state(F.col("raw")).alias("s"))
    chats = states.select("browser", F.col("s.activeId").alias("active"), F.explode("s.conversations").alias("c")).select("browser", "active", "c.*")
    count = lambda s: F.size(F.filter("messages", lambda m: m["status"] == s)).cast("long")
    return chats.select("browser", "id", F.size("messages").cast("long").alias("n"), count("interrupted").alias("interrupted"), count("error").alias("errors"), F.array_join(F.transform("mood", lambda x: x.cast("string")), ",").alias("mood"), F.coalesce(F.col("active") == F.col("id"), F.lit(False)).alias("active"))


_FIELDS = ("note", "Messages", "say", r"\u0061uthorization", "API_key", r"raw\u005Fresponse", r"res\/ponse")


@query(rf"""WITH d AS (SELECT doc_id, doc_id % 8 AS k, text || CASE doc_id % 5 WHEN 0 THEN ' hf_' || repeat('a1B2', 6) WHEN 2 THEN ' sk-or-v1-short' ELSE '' END AS text FROM documents)
SELECT doc_id, CASE WHEN k = 7 THEN 'malformed' ELSE concat_ws(',', CASE WHEN regexp_matches(text, '{T.SECRET_TEXT}') THEN 'credential' END, CASE k WHEN 1 THEN 'key messages' WHEN 3 THEN 'key authorization' WHEN 4 THEN 'key api_key' WHEN 5 THEN 'key raw_response' END) END AS faults FROM d""")
def c24_forbidden_keys(t: Tables) -> DataFrame:
    """What a JSON text that is to be published holds at any depth: private keys, also written with escapes, and credentials within strings; what looks like a key inside of a string is none."""
    at = F.col("doc_id") % 5
    text = F.concat("text", F.when(at == 0, " hf_" + "a1B2" * 6).when(at == 2, " sk-or-v1-short").otherwise(""))
    value = F.regexp_extract(F.to_json(F.array(text, F.lit('"api_key": 1'))), r"(?s)\A\[(.*)\]\z", 1)
    k = (F.col("doc_id") % 8).cast("int")
    field = F.coalesce(F.get(F.array(*map(F.lit, _FIELDS)), k), F.lit("note"))
    raw = F.concat(F.lit('{"a":[{"b":{"'), field, F.lit('" : ['), value, F.when(k == 7, '],"b":').otherwise("]}"), F.lit('}],"n":1}'))
    return t("documents").select("doc_id", F.array_join(T.publication_faults(raw), ",").alias("faults"))


@query(r"""WITH r AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN CASE conv_id % 3 WHEN 0 THEN 'Ready. ' WHEN 1 THEN 'Already. ' ELSE '<think>READY ' END || text END) AS a, max(CASE WHEN turn = 1 THEN CASE WHEN conv_id % 2 = 0 THEN 'It is four. ' ELSE '44 ' END || text END) AS b FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(regexp_matches(a, '(?i)\bready\b') AND regexp_matches(b, '(?i)\b(?:4|four)\b') AND NOT contains(a, '<think>') AND NOT contains(b, '<think>'), false) AS valid FROM r""")
def c26_smoke_replies(t: Tables) -> DataFrame:
    first = F.concat(F.element_at(F.array(F.lit("Ready. "), F.lit("Already. "), F.lit("<think>READY ")), (F.col("conv_id") % 3 + 1).cast("int")), "text")
    second = F.concat(F.when(F.col("conv_id") % 2 == 0, "It is four. ").otherwise("44 "), "text")
    r = t("conversations").groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, first)).alias("a"), F.max(F.when(F.col("turn") == 1, second)).alias("b"))
    return r.select("conv_id", H.smoke_replies(F.col("a"), F.col("b")).alias("valid"))


@query("SELECT c_custkey, c_name || ' / ' || c_mktsegment AS line FROM customer")
def d06_context_cues(t: Tables) -> DataFrame:
    """Two lists that must have the same keys; a key on one side only is an error."""
    c = t("customer")
    return M.paired(c.select("c_custkey", "c_name"), c.select("c_custkey", "c_mktsegment"), "c_custkey").select("c_custkey", F.concat_ws(" / ", "c_name", "c_mktsegment").alias("line"))


@query("SELECT conv_id, max(turn) AS last_turn, count(*)::BIGINT AS n FROM conversations c WHERE turn <= (SELECT max(turn) FROM conversations x WHERE x.conv_id = c.conv_id AND NOT (role = 'assistant' AND (turn + x.conv_id) % 3 <> 0)) GROUP BY conv_id")
def f16_statused_retry(t: Tables) -> DataFrame:
    """Replies with a status (here two of three) at a chat's end go before another try."""
    status = F.when((F.col("role") == "assistant") & ((F.col("turn") + F.col("conv_id")) % 3 != 0), "error")
    own = t("conversations").groupBy("conv_id").agg(F.max(F.when(status.isNull(), F.col("turn"))).alias("last_turn"))
    kept = t("conversations").join(own, "conv_id").where("turn <= last_turn")
    return kept.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count("*").alias("n"))


_GRID = "SELECT r_name AS trait, n_nationkey AS pair, p AS polarity FROM region, nation, (VALUES ('positive'), ('negative')) v(p) WHERE n_regionkey = r_regionkey"


@query(f"SELECT *, row_number() OVER (PARTITION BY trait ORDER BY polarity <> 'positive', pair)::BIGINT AS place FROM ({_GRID})")
def f18_batch_order(t: Tables) -> DataFrame:
    """Positive before negative, then by pair: a planned batch's order (each trait's conditions are a plan of a few dozen rows)."""
    from pyspark.sql import Window as W

    grid = t("region").join(t("nation"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("trait"), F.col("n_nationkey").alias("pair"), F.explode(F.array(F.lit("positive"), F.lit("negative"))).alias("polarity"))
    return grid.withColumn("place", F.row_number().over(W.partitionBy("trait").orderBy(*M.batch_order())).cast("long"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 25")
def g06_development_limit(t: Tables) -> DataFrame:
    return M.pending(t("documents").select("doc_id"), t("labels"), "doc_id").orderBy("doc_id").limit(25)


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents ORDER BY sha256('42|' || doc_id), doc_id LIMIT 128) ORDER BY sha256('43|' || doc_id), doc_id LIMIT 64")
def i02_holdout_sample(t: Tables) -> DataFrame:
    """A second sample, with a seed of its own, of what the first one left."""
    d = t("documents").select("doc_id", "source")
    return K.hash_sample(d.join(K.hash_sample(d, "42", "doc_id", 128).select("doc_id"), "doc_id", "left_anti"), "43", "doc_id", 64)


@query()
def i01_shared_generator(t: Tables) -> DataFrame:
    """Samples of all languages from one generator, in the languages' order, each row with its place in its own set."""
    return K.shared_sample_of(t("documents").select("doc_id", "lang"), "lang", "doc_id", 20, 42)


@query(r"SELECT doc_id, len(w)::BIGINT AS n, list_aggregate(w[:4], 'string_agg', ' ') AS opening FROM (SELECT doc_id, regexp_extract_all(replace(replace(lower('Don’t say it''s x’ 7_up ' || text), '’', ''''), 'ß', 'ss'), '[\p{L}\p{N}]+(?:''[\p{L}\p{N}]+)*') AS w FROM documents)")
def j04_apostrophe_words(t: Tables) -> DataFrame:
    w = T.apostrophe_words(F.concat(F.lit("Don’t say it's x’ 7_up "), "text"))
    return t("documents").select("doc_id", w.alias("w")).select("doc_id", F.size("w").cast("long").alias("n"), F.array_join(F.slice("w", 1, 4), " ").alias("opening"))


@query("SELECT page_id, split_part(url, ':', 1) AS head FROM pages")
def j07_prefix(t: Tables) -> DataFrame:
    return t("pages").select("page_id", F.substring_index("url", ":", 1).alias("head"))


_SECRET_KEY = "sk-or-v1-0123456789abcdef"


@query(f"SELECT doc_id, replace(left('HTTP 401 for {_SECRET_KEY}: ' || text || '{_SECRET_KEY}', 2000), '{_SECRET_KEY}', '[redacted]') AS message FROM documents")
def j11_redacted_messages(t: Tables) -> DataFrame:
    """Cut first, then without the key."""
    message = F.concat(F.lit(f"HTTP 401 for {_SECRET_KEY}: "), "text", F.lit(_SECRET_KEY))
    return t("documents").select("doc_id", T.redacted(message, _SECRET_KEY).alias("message"))


@query("SELECT event_id, upper(left(x, 1)) || substr(x, 2, 4) || upper(substr(x, 6, 1)) || substr(x, 7) AS title FROM (SELECT event_id, 'mood ' || event_type AS x FROM events)")
def j13_axis_title(t: Tables) -> DataFrame:
    return t("events").select("event_id", T.axis_title(F.concat(F.lit("mood_"), "event_type")).alias("title"))


@query("SELECT event_id, CASE date_diff('day', ts::DATE, DATE '2024-01-15') WHEN 0 THEN 'today' WHEN 1 THEN 'yesterday' ELSE lower(strftime(ts, '%-d %b')) END AS label FROM events")
def j23_date_labels(t: Tables) -> DataFrame:
    return t("events").select("event_id", T.date_label(F.col("ts"), F.lit("2024-01-15").cast("date")).alias("label"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'timeout' WHEN event_type = 'signup' THEN 'cancelled' WHEN event_type = 'purchase' THEN 'stop' WHEN value >= 20 THEN 'length' ELSE 'stop' END AS reason,
  CASE WHEN event_type = 'purchase' THEN 'eos' ELSE 'token_limit_truncation' END AS stop_reason FROM events""")
def j28_finish_reasons(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t("events").select("event_id", H.finish_reason(kind == "error", kind == "signup", kind == "purchase", F.col("value"), F.lit(20)).alias("reason"), H.stop_reason(kind == "purchase").alias("stop_reason"))


_MOOD = "list_transform(range(1, 7), lambda i: round(0.12 * ((conv_id * 7 + i * 3) % 9 - 4) * CASE WHEN conv_id % 2 = 0 THEN 0.5 ELSE 1 END, 3))"


@query(f"""WITH h AS (SELECT conv_id, list(struct_pack(r := role, n := length(text), b := trim(text, {_SPACE}) = '') ORDER BY turn) AS m, sum(length(text)) AS chars FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, m, chars, {_MOOD} AS mood, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].r NOT IN ('user', 'assistant') THEN 'role' WHEN m[i].b THEN 'blank' WHEN m[i].n > CASE WHEN m[i].r = 'user' THEN 2000 ELSE 10000 END THEN 'too_long' WHEN i > 1 AND m[i].r = m[i - 1].r THEN 'alternation' END) AS codes FROM h)
SELECT conv_id, CASE WHEN conv_id % 6 = 5 THEN 'fields' WHEN len(m) > 32 THEN 'count' WHEN len(list_filter(codes, lambda x: x IS NOT NULL)) > 0 THEN list_filter(codes, lambda x: x IS NOT NULL)[1] WHEN m[-1].r <> 'user' THEN 'last_role' WHEN chars > 32000 THEN 'history_too_long'
  WHEN len(list_filter(mood, lambda x: abs(x) > 0.25)) > 0 THEN 'mood' WHEN chars * 3 NOT BETWEEN 1 AND 2048 THEN 'output' END AS error FROM f""")
def c21_request_settings(t: Tables) -> DataFrame:
    """Requests whole: each conversation's own messages, with a mood by its id, an output by its length, and some with a field that isn't known."""
    h = H.histories(t("conversations"))
    scale = F.when(F.col("conv_id") % 2 == 0, 0.5).otherwise(1.0)
    mood = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.round(F.lit(0.12).cast("double") * ((F.col("conv_id") * 7 + i * 3) % 9 - 4) * scale, 3))
    known = F.array(F.lit("messages"), F.lit("mood"), F.lit("max_new_tokens"))
    fields = F.when(F.col("conv_id") % 6 == 5, F.array_append(known, "model")).otherwise(known)
    chars = F.aggregate("messages", F.lit(0), lambda a, m: a + F.length(m["text"]))
    return h.select("conv_id", H.chat_error(F.col("messages"), mood, chars * 3, fields).alias("error"))

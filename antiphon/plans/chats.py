"""Chat histories, repetition, refusals, spans, rate windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.functions import text as T
from antiphon.operators import chats as H
from antiphon.operators import ranks as R
from antiphon.operators import scans as X
from antiphon.plans.registry import Tables, query
from antiphon.streaming import admission

_BARE = r"regexp_replace(regexp_replace(replace(replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), '**', ''), '__', ''), '^[*_]', ''), '^$', '')"
#: Put before texts, so that every way to refuse is met, and some that only look like one.
_OPENINGS = (
    "I'm sorry, but I cannot help. ", "**As an AI model, I must decline.** ", "Sorry. The answer: ", "_I am unable to say._ ", "I do not assist with this. ", "I'm not allowed to. ", "This request is something I can't do. ",
    "I'm afraid I won't. ", "Apologies; I have to refuse. ", "He said: I cannot help. ", "",
)
_TASKS = ("I cannot help you. ", "Sorry, I won't write: ", "I cannot stop thinking. ", "As an AI of sorts, I must decline to discuss it. ", "")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _opened_sql(openings: tuple[str, ...], key: str) -> str:
    return f"[{', '.join(map(_quoted, openings))}][1 + {key} % {len(openings)}] || text"


def _opened(openings: tuple[str, ...], key: str) -> Column:
    return F.concat(F.element_at(F.array(*map(F.lit, openings)), (F.col(key) % len(openings) + 1).cast("int")), "text")


def _sql_pattern(pattern: str) -> str:
    """The same pattern for an engine that has no \\A."""
    return _quoted("(?i)" + pattern.replace(r"\A", "^"))


@query(f"WITH d AS (SELECT doc_id, {_opened_sql(_OPENINGS, 'doc_id')} AS text FROM documents) SELECT doc_id, trim(regexp_extract({_BARE}, {_sql_pattern(T.REFUSAL_OPENING)})) AS matched FROM d")
def c01_refusal_opening(t: Tables) -> DataFrame:
    """Refusals at an answer's opening, through emphasis; an apology alone is none."""
    return t("documents").select("doc_id", T.refusal_match(_opened(_OPENINGS, "doc_id")).alias("matched"))


@query(f"SELECT conv_id, turn, regexp_matches({_opened_sql(_TASKS, 'conv_id')}, {_sql_pattern(T.TASK_REFUSAL)}) AS refusal FROM conversations")
def c02_task_refusal(t: Tables) -> DataFrame:
    return t("conversations").select("conv_id", "turn", T.task_refusal(_opened(_TASKS, "conv_id")).alias("refusal"))


_WORDS = r"regexp_extract_all(lower(text), '[a-z0-9]+')"
_REPETITION = "CASE WHEN len(w) > 2 THEN 1 - len(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) / (len(w) - 2) ELSE 0 END"


@query(f"WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_words, round({_REPETITION}, 6) AS repetition FROM w")
def j09_trigram_repetition(t: Tables) -> DataFrame:
    """Share of trigrams (of plain words) that are repeats."""
    w = t("documents").select("doc_id", T.plain_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.round(T.trigram_repetition(F.col("w")), 6).alias("repetition"))


def _runs_sql(least: int) -> str:
    """Runs of one character, spelled out for each, as the SQL engine's patterns have no back references."""
    letters = [chr(c) for c in (*range(33, 127), *range(0xA1, 0x180))]
    return _quoted("|".join(f"{'' if c.isalnum() else chr(92) if c.isascii() else ''}{c}{{{least},}}" for c in letters))


_RUN = "coalesce(list_max(list_transform(regexp_extract_all({}, {}), lambda x: length(x))), 0)"
_LOOPS = "[repeat('x', 40) || left(text, 15), repeat('so it goes on ', 20), ' ', left(text, 400) || repeat('=', 300)]"


@query(f"""WITH d AS (SELECT doc_id, trim(CASE WHEN doc_id % 9 < 4 THEN {_LOOPS}[1 + doc_id % 9] ELSE text END, e' \\t\\n\\r') AS text FROM documents),
r AS (SELECT doc_id, text, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}_]+') AS w, {_RUN.format('text', _runs_sql(32))} AS run FROM d),
m AS (SELECT doc_id, text, w, run, {_REPETITION} AS repetition, CASE WHEN text = '' THEN 0 ELSE run / length(text) END AS share FROM r)
SELECT doc_id, text = '' OR (len(w) >= 24 AND greatest(repetition, share) >= 0.65) OR (run >= 32 AND share >= 0.65) AS degenerate FROM m""")
def c22_degenerate(t: Tables) -> DataFrame:
    """Empty, repeated words, or one character for most of it: some texts are made so."""
    loops = F.array(F.concat(F.lit("x" * 40), F.left("text", F.lit(15))), F.lit("so it goes on " * 20), F.lit(" "), F.concat(F.left("text", F.lit(400)), F.lit("=" * 300)))
    at = (F.col("doc_id") % 9).cast("int")
    d = t("documents").select("doc_id", F.when(at < 4, F.get(loops, at)).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", T.degenerate(F.col("text")).alias("degenerate"))


@query(f"SELECT doc_id, {_RUN.format('text', _runs_sql(3))}::BIGINT AS run FROM documents")
def e23_character_runs(t: Tables) -> DataFrame:
    """Longest run of equal characters, of three or more."""
    return t("documents").select("doc_id", T.longest_character_run(F.col("text"), 3).cast("long").alias("run"))


@query("""WITH h AS (SELECT conv_id, list(struct_pack(r := role, n := length(text), b := trim(text, e' \\t\\n\\r') = '') ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
f AS (SELECT conv_id, m, list_transform(range(1, len(m) + 1), lambda i: CASE WHEN m[i].r NOT IN ('user', 'assistant') THEN 'role' WHEN m[i].b THEN 'blank' WHEN m[i].n > CASE WHEN m[i].r = 'user' THEN 2000 ELSE 10000 END THEN 'too_long' WHEN i > 1 AND m[i].r = m[i - 1].r THEN 'alternation' END) AS codes FROM h)
SELECT conv_id, CASE WHEN len(m) > 32 THEN 'count' WHEN len(list_filter(codes, lambda x: x IS NOT NULL)) > 0 THEN list_filter(codes, lambda x: x IS NOT NULL)[1] WHEN m[-1].r <> 'user' THEN 'last_role' WHEN list_sum(list_transform(m, lambda x: x.n)) > 32000 THEN 'history_too_long' END AS error FROM f""")
def c21_chat_validation(t: Tables) -> DataFrame:
    return H.histories(t("conversations")).select("conv_id", H.chat_error(F.col("messages")).alias("error"))


@query("SELECT conv_id, coalesce(bool_or(same), false) AS repeats_role FROM (SELECT conv_id, role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS same FROM conversations) GROUP BY conv_id")
def f07_role_alternation(t: Tables) -> DataFrame:
    return H.histories(t("conversations")).select("conv_id", H.same_role_neighbours(F.col("messages")).alias("repeats_role"))


_KEYS_OUT = "CASE doc_id % 5 WHEN 0 THEN ' hf_' || repeat('a1B2', 6) WHEN 1 THEN ' -----BEGIN RSA PRIVATE KEY-----' WHEN 2 THEN ' sk-or-v1-short' ELSE '' END"


@query(rf"""WITH d AS (SELECT doc_id, text || {_KEYS_OUT} AS text FROM documents) SELECT doc_id, 'email' AS kind FROM d WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]') UNION ALL SELECT doc_id, 'token' FROM d WHERE regexp_matches(text, 'token = "[0-9a-f]{{16,}}"')
UNION ALL SELECT doc_id, 'credential' FROM d WHERE regexp_matches(text, '{T.SECRET_TEXT}')""")
def c24_privacy_scan(t: Tables) -> DataFrame:
    """What must not be published, one scan for all kinds; some texts are given a credential, or what only looks like one."""
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]", "token": 'token = "[0-9a-f]{16,}"', "credential": T.SECRET_TEXT}
    at = F.col("doc_id") % 5
    end = F.when(at == 0, " hf_" + "a1B2" * 6).when(at == 1, " -----BEGIN RSA PRIVATE KEY-----").when(at == 2, " sk-or-v1-short").otherwise("")
    found = F.array_compact(F.array(*(F.when(F.rlike("text", F.lit(p)), k) for k, p in kinds.items())))
    return t("documents").select("doc_id", F.concat("text", end).alias("text")).select("doc_id", F.explode(found).alias("kind"))


@query(r"SELECT page_id, path, NOT regexp_matches(path, '^/|\\') AND len(list_filter(string_split(path, '/'), lambda p: p IN ('', '.', '..'))) = 0 AS safe FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]+/', CASE WHEN page_id % 3 = 0 THEN '../' WHEN page_id % 3 = 1 THEN '' ELSE '/' END) AS path FROM pages)")
def c25_safe_paths(t: Tables) -> DataFrame:
    start = F.when(F.col("page_id") % 3 == 0, "../").when(F.col("page_id") % 3 == 1, "").otherwise("/")
    p = t("pages").select("page_id", F.concat(start, F.regexp_replace("url", "^[a-z]+://[^/]+/", "")).alias("path"))
    return p.select("page_id", "path", T.safe_path(F.col("path")).alias("safe"))


@query("SELECT user_id, max(n)::BIGINT AS run FROM (SELECT user_id, g, count(*) AS n FROM (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events)) GROUP BY ALL) GROUP BY user_id")
def f04_longest_run(t: Tables) -> DataFrame:
    return X.longest_runs(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH s AS (SELECT user_id, p::INTEGER AS period, nr, coalesce(event_type = prev, false) AS same FROM (SELECT user_id, p, row_number() OVER (PARTITION BY user_id, p ORDER BY ts, event_id) AS nr, event_type, lag(event_type, p) OVER (PARTITION BY user_id, p ORDER BY ts, event_id) AS prev FROM events, range(1, 5) r(p))),
g AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, period ORDER BY nr) AS island FROM s), r AS (SELECT user_id, period, island, count_if(same) AS n FROM g GROUP BY ALL)
SELECT user_id, period, CASE WHEN max(n) >= period THEN max(n) + period ELSE 0 END::BIGINT AS span FROM r GROUP BY user_id, period""")
def f05_period_loops(t: Tables) -> DataFrame:
    return X.period_spans(t("events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH m AS (SELECT user_id, event_id, event_type, last_value(CASE WHEN event_type IN ('signup', 'error') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tag FROM events)
SELECT user_id, count_if(event_type NOT IN ('signup', 'error') AND coalesce(tag, '') <> 'signup')::BIGINT AS kept, count_if(event_type IN ('signup', 'error')) > 0 AS unexpected FROM m GROUP BY user_id""")
def f08_span_mask(t: Tables) -> DataFrame:
    """Content outside spans: "signup" opens one, "error" closes it."""
    tag = F.when(F.col("event_type").isin("signup", "error"), F.col("event_type"))
    rows = R.placed(t("events").select("user_id", "ts", "event_id", tag.alias("tag")), ["user_id", "ts", "event_id"], "span-tags", "user_id", "tag")
    inside = F.coalesce(F.col("now") == "signup", F.lit(False))
    return R.carried(rows, "user_id", "tag", "now").groupBy("user_id").agg(F.count_if(F.col("tag").isNull() & ~inside).alias("kept"), (F.count("tag") > 0).alias("unexpected"))


_ENDS = ("purchase", "error")


@query("""WITH e AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id)
SELECT user_id, len(ids)::BIGINT AS n, coalesce(least(list_position(ids, 'purchase'), list_position(ids, 'error')), len(ids))::BIGINT AS kept FROM e""")
def b13_trim_at_end(t: Tables) -> DataFrame:
    """Up to the first of the end markers, itself included; all where there is none. A long log is never one task's list."""
    place = F.struct("ts", "event_id")
    ends = t("events").where(F.col("event_type").isin(*_ENDS)).groupBy("user_id").agg(F.min(place).alias("end"))
    own = t("events").select("user_id", place.alias("place")).join(ends, "user_id", "left")
    return own.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("end").isNull() | (F.col("place") <= F.col("end"))).alias("kept"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 21599999999 PRECEDING AND 1 PRECEDING)::BIGINT AS prior FROM events")
def f13_sliding_rate(t: Tables) -> DataFrame:
    """Events of the six hours before; one that is exactly six hours old has left."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return R.counts_before(t("events").select("user_id", "event_id", us.alias("us")), "user_id", "us", 21_600_000_000, "prior").select("event_id", "prior")


@query("""WITH h AS (SELECT conv_id, list(struct_pack(r := role, n := length(text)) ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
s AS (SELECT conv_id, m, list_filter(range(1, len(m) + 1), lambda i: (i = 1 OR m[i].r <> 'assistant') AND 12 + list_sum(list_transform(m[i:], lambda x: x.n)) <= 1500) AS ok FROM h)
SELECT conv_id, len(m)::BIGINT AS n, CASE WHEN len(ok) > 0 THEN len(m) - list_min(ok) + 1 END::BIGINT AS kept FROM s""")
def f14_context_budget(t: Tables) -> DataFrame:
    h = H.histories(t("conversations")).withColumn("tail", H.within_budget(F.col("messages"), 1500))
    return h.select("conv_id", F.size("messages").cast("long").alias("n"), F.when(F.col("tail").isNotNull(), F.size("tail")).cast("long").alias("kept"))


@query("""WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, length(text) AS n FROM conversations WHERE trim(text, e' \\t\\n\\r') <> ''),
f AS (SELECT c.* FROM c JOIN (SELECT conv_id, min(turn) AS first FROM c WHERE role = 'user' GROUP BY 1) u USING (conv_id) WHERE turn >= first),
l AS (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM l WHERE next IS NULL OR next <> role),
r AS (SELECT conv_id, list(struct_pack(role, n) ORDER BY turn) AS m FROM k WHERE back <= 5 GROUP BY conv_id)
SELECT conv_id, len(CASE WHEN m[1].role = 'assistant' THEN m[2:] ELSE m END)::BIGINT AS kept, list_sum(list_transform(CASE WHEN m[1].role = 'assistant' THEN m[2:] ELSE m END, lambda x: x.n))::BIGINT AS chars FROM r""")
def f15_request_window(t: Tables) -> DataFrame:
    own = t("conversations").withColumn("role", F.when(F.col("role") == "user", "user").otherwise("assistant"))
    h = H.histories(own).withColumn("w", H.request_window(F.col("messages"), 5)).where(F.size("w") > 0)
    return h.select("conv_id", F.size("w").cast("long").alias("kept"), F.aggregate("w", F.lit(0).cast("long"), lambda a, m: a + F.length(m["text"])).alias("chars"))


@query("""WITH u AS (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS u FROM conversations)
SELECT conv_id, max(u) AS last_turn, count_if(turn <= u)::BIGINT AS kept FROM u GROUP BY conv_id""")
def f16_retry_view(t: Tables) -> DataFrame:
    """A chat without the replies at its end, for another try."""
    users = F.filter(F.col("messages"), lambda m: m["role"] == "user")
    h = H.histories(t("conversations")).withColumn("u", F.array_max(F.transform(users, lambda m: m["turn"])))
    return h.select("conv_id", F.col("u").alias("last_turn"), F.size(F.filter("messages", lambda m: m["turn"] <= F.col("u"))).cast("long").alias("kept"))


@query("SELECT conv_id, CASE WHEN length(t) > 38 THEN left(t, 35) || '…' ELSE t END AS title FROM (SELECT conv_id, left(trim(text, e' \\t\\n\\r'), 2000) AS t FROM conversations WHERE turn = 0)")
def b16_chat_title(t: Tables) -> DataFrame:
    return t("conversations").where("turn = 0").select("conv_id", H.title(F.col("text")).alias("title"))


def _styles_sql() -> str:
    return ", ".join(f"({i + 1}, '{name.replace('_', ' ')}', '{up}', '{down}')" for i, (name, up, down) in enumerate(H.STYLES))


@query(f"""WITH s(i, name, up, down) AS (VALUES {_styles_sql()}), v AS (SELECT vec_id, i, name, up, down, CASE WHEN abs(embedding[i]::DOUBLE) < 0.02 THEN 0 ELSE round(embedding[i]::DOUBLE, 3) END AS x FROM embeddings, s)
SELECT vec_id, coalesce(string_agg(CASE WHEN abs(x) / 0.25 >= 0.75 THEN 'strong' WHEN abs(x) / 0.25 >= 0.35 THEN 'moderate' ELSE 'slight' END || ' ' || name || ': ' || CASE WHEN x > 0 THEN up ELSE down END, '; ' ORDER BY -abs(x), i) FILTER (x <> 0), '') AS hint FROM v GROUP BY vec_id""")
def b10_style_hint(t: Tables) -> DataFrame:
    mood = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, len(H.STYLES)), lambda x: F.when(F.abs(x) < 0.02, 0.0).otherwise(F.round(x, 3)))
    return t("embeddings").select("vec_id", H.style_hint(mood).alias("hint"))


@query("""WITH e AS (SELECT user_id, list(value > 10 ORDER BY ts, event_id) AS mask FROM events GROUP BY user_id)
SELECT user_id, list_sum(list_transform(range(1, len(mask) + 1), lambda i: CASE WHEN mask[i] THEN len(list_filter(mask[:i], lambda b: b)) - 1 ELSE 0 END))::BIGINT AS position_sum, len(mask)::BIGINT AS n FROM e""")
def b17_position_ids(t: Tables) -> DataFrame:
    """Running count of unmasked places less one; 0 where masked."""
    on = F.col("value") > 10
    rows = R.placed(t("events").select("user_id", "ts", "event_id", on.alias("on")), ["user_id", "on", "ts", "event_id"], "masked-places", "user_id", "on")
    # Masked places come first, so an unmasked one's number among its own is its position.
    masked = rows.groupBy("user_id").agg(F.count_if(~F.coalesce("on", F.lit(False))).alias("masked"))
    p = R.numbered_by(rows, "user_id").join(masked, "user_id").select("user_id", F.when(F.col("on"), F.col("rn") - F.col("masked") - 1).otherwise(0).alias("p"))
    return p.groupBy("user_id").agg(F.sum("p").alias("position_sum"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT user_id, list(event_id ORDER BY event_id) AS ids FROM events GROUP BY user_id), m AS (SELECT max(len(ids)) AS w FROM e)
SELECT user_id, (w - len(ids))::BIGINT AS padding, w::BIGINT AS width FROM e, m""")
def b18_left_padding(t: Tables) -> DataFrame:
    """Sequences of one width, the shorter ones moved to the right: a row for each token and its column, never a sequence in one row."""
    own = R.numbered_by(R.placed(t("events").select("user_id", "event_id"), ["user_id", "event_id"], "sequences"), "user_id")
    sizes = own.groupBy("user_id").agg(F.count("*").alias("n"))
    widest = sizes.agg(F.max("n").alias("w"))
    columns = own.join(sizes.crossJoin(F.broadcast(widest)), "user_id").select("user_id", "w", (F.col("w") - F.col("n") + F.col("rn") - 1).alias("column"))
    return columns.groupBy("user_id").agg(F.min("column").alias("padding"), (F.max("column") + 1).alias("width"))


@query()
def l01_admission_exact(t: Tables) -> DataFrame:
    """Every arrival's decision, by the state machine itself: later decisions depend on earlier ones. A gate is one service; users are dealt over GATES of them."""
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") / 1e6
    gate = F.pmod(F.xxhash64("user_id"), F.lit(_GATES)).cast("string")
    arrivals = t("events").select(gate.alias("gate"), seconds.alias("now"), F.col("user_id").cast("string").alias("client"), F.col("event_id").cast("string").alias("request"), F.when(F.col("event_type") == "error", "leave").otherwise("enter").alias("what"))
    return admission.decide(arrivals)


_GATES = 64

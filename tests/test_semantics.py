"""Facts that the operators must reproduce, sources and sinks, streams."""

import json
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from antiphon.functions import text as T
from antiphon.functions import vectors as V
from antiphon.operators import chats, corpus, directions, journals, matching, scans
from antiphon.plans import QUERIES
from antiphon.sources import files, safetensors
from antiphon.streaming import admission, events


def column(spark, values, kind, body):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}").select("i", body(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_scores(spark):
    values = [" \n75\t", "100", "0", "101", "-1", "50.0", "Score: 50", "50\n75", "050", "", None, "７"]
    assert column(spark, values, "string", T.parse_score) == [75, 100, 0] + [None] * 9


def test_gate_on_ties(spark, tmp_path):
    """Suppliers whose mean discount is 0.052 or 0.048 to the last digit, rows in any order and any number of files: the doubles' 0.052 - 0.05 is below 0.002, 0.05 - 0.048 isn't."""
    draw, rows = random.Random(4), []
    for k in range(60):
        cents = [draw.randint(0, 10) for _ in range(600)]
        want = 3120 if k % 2 else 2880
        while sum(cents) != want:
            i, step = draw.randrange(600), 1 if sum(cents) < want else -1
            cents[i] = min(10, max(0, cents[i] + step))
        rows += [(k, 1 + i % 7, 1.0, x / 100, 0.0, "R" if i % 7 == 0 else "N", "F") for i, x in enumerate(cents)]
    rows += [(100, 1, 1.0, x, 0.0, "R", "F") for x in (0.05, None, float("nan"))] + [(101, 1, 1.0, x, 0.0, "R", "F") for x in (0.05, float("inf"))] + [(103, 1, 1.0, x, 0.0, "R", "F") for x in (0.05, None)]
    for n in (1, 3, 7):
        draw.shuffle(rows)
        path = f"{tmp_path}/{n}"
        spark.createDataFrame(rows, "l_suppkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").repartition(n).write.parquet(f"{path}/lineitem.parquet")
        got = [(r.l_suppkey, r.rule) for r in QUERIES["n10_export_gate"](spark, path).collect()]
        assert sorted(got) == [(k, "divergence") for k in range(0, 60, 2)] + [(k, "divergence") for k in (100, 101)]


def test_refusals(spark):
    said = ["I cannot help with that.", "**I'm sorry**, but I can't do it", "Sorry. The answer is 4.", "He said: I cannot help", "As an AI language model, I must decline", "", None]
    assert [bool(x) for x in column(spark, said, "string", T.refusal_match)] == [True, True, False, False, True, False, False]
    assert column(spark, ["I cannot stop thinking about it", "Sorry, I can't help you"], "string", T.task_refusal) == [False, True]


def test_text(spark):
    assert column(spark, ["Été à la  plage", " straße\t"], "string", T.text_key) == ["été à la plage", "straße"]
    assert column(spark, ["straße  X", None], "string", T.casefold_key) == ["strasse x", None]
    assert column(spark, ["a b", "a b c a b c", ""], "string", lambda c: T.trigram_repetition(T.word_list(c))) == [0.0, 0.25, 0.0]
    assert column(spark, ["{b} and {a}{x}"], "string", lambda c: T.render(c, {"a": F.lit("{b}"), "b": F.lit("$1")})) == ["$1 and {b}{x}"]
    assert column(spark, ["x" * 40, "ab " * 30, "plain words", " "], "string", T.degenerate) == [True, True, False, True]
    assert column(spark, ["a/b.txt", "../a", "/a", "a//b", "a/./b"], "string", T.safe_path) == [True, False, False, False, False]
    assert column(spark, ["```py\n42\n```", "`42`", "**42**", "`a` `b`"], "string", T.unwrapped_answer) == ["42", "42", "42", "`a` `b`"]


def test_seed(spark):
    key = "20261004|curiosity|03|12|0|positive"
    import hashlib

    assert column(spark, [key], "string", T.stable_seed) == [int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)]


def test_matched_thresholds(spark):
    cases = [(51, 49, 50, 50), (50, 49, 50, 50), (51, 50, 50, 50), (51, 49, 49, 100), (51, 49, 100, 49), (None, 49, 50, 50), (51, None, 50, 50), (51, 49, None, 50), (51, 49, 50, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a int, b int, c int, d int")
    none = F.array().cast("array<string>").alias("reasons")
    side = lambda t, c: F.struct(none, F.col(t).alias("trait"), F.col(c).alias("coherence"))
    got = [r[0] for r in df.select("i", side("a", "c").alias("p"), side("b", "d").alias("n")).orderBy("i").select(matching.matched_reasons(F.col("p"), F.col("n"))).collect()]
    assert got == [[], ["positive_trait_not_above_50"], ["negative_trait_not_below_50"], ["coherence_below_50"], ["coherence_below_50"]] + [["missing_judge_score"]] * 4


def test_grid(spark):
    traits = spark.createDataFrame([(f"t{i}",) for i in range(6)], "trait string")
    pairs = spark.createDataFrame([(f"{p:02d}", f"{q:02d}") for p in range(5) for q in range(40)], "pair string, question string")
    grid = matching.condition_grid(traits, pairs, 1)
    assert grid.select("response_id").distinct().count() == 2400 and grid.groupBy("contrast_id").count().where("count <> 2").count() == 0


def test_vectors(spark):
    bad = column(spark, [[1.0, float("nan")], [float("inf")], [0.0, 0.0], [3.0, 4.0]], "array<double>", V.unit)
    assert bad[:3] == [None] * 3 and np.allclose(bad[3], [0.6, 0.8])
    logits = [0.3, -1.0, 2.5]
    assert np.allclose(column(spark, [logits], "array<double>", V.log_softmax)[0], np.array(logits) - np.log(np.exp(logits).sum()))


def test_two_level_mean(spark):
    rows = [("a", r, [x]) for r, n, x in (("p", 3, 2.0), ("q", 6, 10.0)) for _ in range(n)] + [("b", r, [6.0]) for r, n in (("p", 3), ("q", 6)) for _ in range(n)]
    means = V.mean_by(V.mean_by(spark.createDataFrame(rows, "side string, response string, v array<double>"), ["side", "response"], "v", 1), ["side"], "mean", 1)
    assert {r.side: r["mean"][0] for r in means.collect()} == {"a": 6.0, "b": 6.0}


def test_greedy_directions(spark):
    a, b, c = [1.0, 0.0], [0.99, 0.14], [0.96, 0.28]  # a like b, b like c, a unlike c
    df = spark.createDataFrame([(1, a), (2, b), (3, c)], "k int, v array<double>")
    assert [r.k for r in directions.distinct_directions(df, "k", "v", [F.col("k")], 10, 0.985).orderBy("rank").collect()] == [1, 3]


def test_eligible(spark):
    ok = ("judge_error", 429, "HTTPError")
    rows = [(None, [ok] * 3), (5, [ok] * 3), (None, [ok] * 2), (None, [ok, ok, ("judge_error", 500, "HTTPError")]), (None, [ok, ok, (None, None, None)])]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, score int, attempts array<struct<{journals.ATTEMPT}>>")
    assert [r[0] for r in df.orderBy("i").select(journals.eligible(F.col("score"), F.col("attempts"))).collect()] == [True, False, False, False, False]


def test_period_spans(spark):
    seq = "abababab" + "c" + "dd"
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(seq)], "k string, at int, x string")
    assert {r.period: r.span for r in scans.period_spans(df, "k", ["at"], "x").collect()} == {1: 2, 2: 8, 3: 0, 4: 8}
    assert scans.longest_runs(df, "k", ["at"], "x").first().run == 2


def test_balanced_slots():
    rows = corpus.balanced_slots(8, 16, 42)
    assert len(set((d, s) for d, s, _ in rows)) == 32 and all(sum(x == d for x, _, _ in rows) == 4 for d in range(8))


def chat(*turns):
    return [(i, r, t) for i, (r, t) in enumerate(turns)]


def test_chat_rules(spark):
    cases = [chat(("user", "hi")), [], chat(("system", "x")), chat(("user", " ")), chat(("user", "x" * 2001)), chat(("user", "a"), ("user", "b")), chat(("user", "a"), ("assistant", "b")), chat(("user", "a"), ("assistant", "x" * 10001), ("user", "c"))]
    assert column(spark, cases, chats.MESSAGES, chats.chat_error) == [None, "count", "role", "blank", "too_long", "alternation", "last_role", "too_long"]
    history = chat(("user", "x" * 50), ("assistant", "y" * 50), ("user", "z" * 20), ("assistant", "w"), ("user", "last"))
    assert [len(x) for x in column(spark, [history], chats.MESSAGES, lambda m: chats.within_budget(m, 60))] == [3]
    long = chat(("assistant", "hello"), *(p for i in range(20) for p in (("user", f"u{i}"), ("assistant", f"a{i}"))), ("user", "latest"))
    window = column(spark, [long], chats.MESSAGES, chats.request_window)[0]
    assert len(window) == 31 and window[0].role == "user" and window[-1].text == "latest"


def test_style_hint(spark):
    hint = column(spark, [[0.05, -0.25, 0.0, 0.0, 0.125, 0.0]], "array<double>", chats.style_hint)[0]
    assert [x.split()[:2] for x in hint.split("; ") if x.split()[0] in ("strong", "moderate", "slight")] == [["strong", "curiosity:"], ["moderate", "narcissism:"], ["slight", "depression:"]]


def arrivals():
    rows, leave = [], []
    for k in range(7):
        rows.append((float(k), "c", f"r{k}", "enter"))
        leave.append((k + 0.5, "c", f"r{k}", "leave"))
    return sorted(rows + leave + [(62.0, "c", "later", "enter"), (63.0, "c", "busy", "enter")])


def test_admission(spark, tmp_path):
    want = dict(admission.replay(arrivals()))
    assert want["r5"] == "admitted" and want["r6"] == "rate_limit" and want["later"] == "admitted" and want["busy"] == "client_busy"
    schema = "gate string, now double, client string, request string, what string"
    df = spark.createDataFrame([("g", *r) for r in arrivals()], schema)
    assert {r.request: r.decision for r in admission.decide(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = admission.decide_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("decisions").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.request: r.decision for r in spark.sql("SELECT * FROM decisions").collect()} == want


def test_event_streams(spark):
    raw = (": hi\r\n\r\n" + events.encode("token", {"t": "é"}) + "event: done\r\ndata: {}").encode()
    for size in range(1, 8):
        assert [n for n, _ in events.decode(raw[i : i + size] for i in range(0, len(raw), size))] == ["token", "done"]
    with pytest.raises(InterruptedError):
        list(events.decode([events.encode("token", {}).encode()]))
    df = spark.createDataFrame([("a", 2, "token", "b"), ("a", 1, "token", "a"), ("a", 3, "done", ""), ("b", 1, "token", "x")], "request_id string, seq int, event string, data string")
    assert {tuple(r) for r in events.replies(df).collect()} == {("a", "ab", "done", 2), ("b", "x", "interrupted", 1)}


def test_files(spark, tmp_path):
    for bad in ('{"a":1,"a":2}', '{"a":NaN}', "[1]"):
        with pytest.raises(ValueError):
            files.strict_json(bad)
    schema = Ty.StructType().add("id", "string").add("n", "integer")
    (tmp_path / "torn.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b","n":2}\n{"id":"c')
    (tmp_path / "bad.jsonl").write_text('{"id":"a"\n{"id":"b","n":2}\n')
    assert {r.id for r in files.read_json_lines(spark, str(tmp_path / "torn.jsonl"), schema).collect()} == {"a", "b"}
    for name, strict in (("bad", False), ("torn", True)):
        with pytest.raises(Exception, match="bad line"):
            files.read_json_lines(spark, str(tmp_path / f"{name}.jsonl"), schema, strict).collect()
    rows = spark.createDataFrame([("p1", 'a "q"\n=x', True, ["I"], None), ("p2", "", None, [], "failed")], "prompt_id string, response string, heuristic_refusal boolean, refusal_matches array<string>, status string")
    files.write_results(rows.coalesce(1), str(tmp_path / "csv"), "m", "r")
    got = {r.prompt_id: r for r in files.read_results(spark, str(tmp_path / "csv")).collect()}
    assert got["p1"].response == 'a "q"\n=x' and got["p1"].heuristic_refusal == "true" and got["p1"].status == "completed" and got["p1"].model_id == "m"
    assert json.loads(got["p1"].refusal_matches) == ["I"] and got["p2"].status == "failed"
    (tmp_path / "blocks").write_bytes(bytes(range(10)))
    assert [r.bytes for r in files.inventory(spark, str(tmp_path / "blocks"), 4).orderBy("block").collect()] == [4, 4, 2]


def test_tensor_files(spark, tmp_path):
    x = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    path = str(tmp_path / "x.safetensors")
    safetensors.write_tensors(path, {"vectors": x})
    spark.dataSource.register(safetensors.TensorFiles)
    head = spark.read.format("tensor_files").load(path).first()
    assert (head.tensor, head.dtype, head.shape, head.begin, head.end) == ("vectors", "F32", [2, 3, 4], 0, 96)
    rows = spark.read.format("tensor_files").option("table", "vectors").load(path).collect()
    assert len(rows) == 6 and all(np.allclose(r.vec, x[tuple(r.place)]) and abs(r.norm - np.linalg.norm(x[tuple(r.place)])) < 1e-4 for r in rows)
    with open(path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError):
        safetensors.read_header(path)
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", 1 << 40))
    with pytest.raises(ValueError):
        safetensors.read_header(path)


def test_distinct_directions_goes_on_past_parallel_rows(spark):
    import numpy as np
    from pyspark.sql import functions as F

    draw = np.random.default_rng(1)
    rows = [(i, [1.0, 0.001 * i, 0.0]) for i in range(50)] + [(50 + i, draw.normal(size=3).tolist()) for i in range(100)]
    want, units = [], []
    for key, v in rows:
        u = np.array(v) / np.linalg.norm(v)
        if len(want) < 5 and all(abs(u @ w) <= 0.9 for w in units):
            want.append(key)
            units.append(u)
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(3)
    assert [r.k for r in directions.distinct_directions(df, "k", "v", [F.col("k")], 5, 0.9).orderBy("rank").collect()] == want and len(want) == 5 and want[1] >= 50


def test_answers_in_one_wrapper(spark):
    said = ["42", " 42 ", "**42**", "`42`", "```\n42\n```", "```text\n42```", "**4**2**", "`4`2`", "``42``", "It is 42", "42 42", "", " ", None, "**`42`**", "42.", "```text\n42\n``` and more"]
    want = ["42", "42", "42", "42", "42", "42", "**4**2**", "`4`2`", "``42``", "It is 42", "42 42", "", "", None, "`42`", "42.", "```text\n42\n``` and more"]
    assert column(spark, said, "string", T.unwrapped_answer) == want
    passes = column(spark, said, "string", lambda x: T.answer_matches(x, F.lit(r"\A\s*42\s*[.!]?\s*\z")))
    assert passes == [True] * 6 + [False] * 9 + [True, False]

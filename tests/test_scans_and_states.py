"""Segmented scans, greedy directions, saved states and JSON texts against plain versions and malformed input."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from antiphon.functions import text as T
from antiphon.operators import audits, chats, directions, ranks, scans


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def logs(seed):
    """A key with a third of all rows, many with few, null keys and values, values that come in stretches and periods."""
    draw, rows, at = random.Random(seed), [], 0
    for key in [*["hot"] * 12, *"abcdefghij", None, *(f"k{i}" for i in range(30))]:
        for _ in range(draw.choice([1, 1, 2, 4])):
            unit = [draw.choice(["x", "y", "z", None]) for _ in range(draw.randint(1, 4))]
            for value in unit * draw.randint(1, 5):
                rows.append((key, at, value))
                at += 1
    return rows


def by_key(rows):
    out = {}
    for key, at, value in sorted(rows, key=lambda r: r[1]):
        out.setdefault(key, []).append((at, value))
    return out


def plain_runs(values):
    run, out = 0, []
    for i, v in enumerate(values):
        run = run + 1 if i and values[i - 1] == v else 1
        out.append(run)
    return out


def plain_span(values, p):
    best = run = 0
    for i in range(p, len(values)):
        run = run + 1 if values[i] is not None and values[i] == values[i - p] else 0
        best = max(best, run)
    return best + p if best >= p else 0


@pytest.mark.parametrize("seed", range(3))
def test_scans_equal_plain_ones(spark, small_batches, seed):
    rows = logs(seed)
    df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "k string, at long, x string").repartition(5)
    own = by_key(rows)
    runs = {r.k: r.run for r in scans.longest_runs(df, "k", ["at"], "x").collect()}
    assert runs == {k: max(plain_runs([v for _, v in s])) for k, s in own.items()}
    spans = {(r.k, r.period): r.span for r in scans.period_spans(df, "k", ["at"], "x").collect()}
    assert spans == {(k, p): plain_span([v for _, v in s], p) for k, s in own.items() for p in range(1, 5)}
    for least in (2, 3, 5):
        want = {}
        for k, s in own.items():
            hit = next((i for i, n in enumerate(plain_runs([v for _, v in s])) if n >= least), None)
            if hit is not None:
                want[k] = (*s[hit], least)
        got = {r.k: (r.at, r.x, r.run) for r in scans.first_long_run(df, "k", ["at"], "x", least).collect()}
        assert got == want
    for run, repetitions, span in ((4, 3, 6), (3, 2, 8)):
        got = {r.k: r.degenerate for r in scans.loops(df, "k", ["at"], "x", run, repetitions, span).collect()}
        assert got == {k: max(plain_runs(v := [x for _, x in s])) >= run or any(plain_span(v, p) // p >= repetitions and plain_span(v, p) >= span for p in range(1, 5)) for k, s in own.items()}


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"), F.lit("x").alias("x"))
    dealt = df.repartitionByRange(8, "k", "at").where("k = 0").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(dealt) >= 2 and max(r["count"] for r in dealt) < 13_334
    assert scans.longest_runs(df, "k", ["at"], "x").agg(F.max("run")).first()[0] == 13_334


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], "k string, at long, x string")
    assert scans.longest_runs(df, "k", ["at"], "x").count() == 0 and scans.first_long_run(df, "k", ["at"], "x", 3).count() == 0
    with pytest.raises(ValueError):
        scans.first_long_run(df, "k", ["at"], "x", 1)


def test_rows_of_a_hot_key_in_order(spark):
    """Numbers, values carried on, values before and counts in a width, with keys over several partitions."""
    draw = random.Random(8)
    rows = [(draw.choice(["hot"] * 6 + ["a", "b", "c", None]), draw.randrange(5000), i, draw.choice([None, None, "x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t long, i long, v string").repartition(6)
    placed = ranks.placed(df, ["k", "t", "i"], "test-ranks")
    assert placed.where("k = 'hot'").select((F.col("place") / 2**33).cast("int")).distinct().count() > 1
    own = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        own.setdefault(r[0], []).append(r)
    number, carry, before = {}, {}, {}
    for key, s in own.items():
        last = None
        for n, (_, _, i, v) in enumerate(s):
            last = v if v is not None else last
            number[i], carry[i], before[i] = n + 1, last, s[n - 1][3] if n else None
    assert {r.i: r.rn for r in ranks.numbered_by(placed, "k").collect()} == number
    assert {r.i: r.now for r in ranks.carried(placed, "k", "v", "now").collect()} == carry
    assert {r.i: r.old for r in ranks.previous(placed, "k", "v", "old").collect()} == before
    want = {i: sum(0 < t - u < 700 for _, u, _, _ in own[k]) for k, t, i, _ in rows}
    assert {r.i: r.n for r in ranks.counts_before(df, "k", "t", 700, "n").collect()} == want
    assert [r["rank"] for r in ranks.numbered(placed).orderBy("k", "t", "i").select("rank").collect()] == list(range(1, 3001))


def plain_directions(rows, limit, most):
    kept, held = [], np.zeros((0, len(rows[0][1])))
    for key, v in rows:
        n = math.sqrt(sum(x * x for x in v))
        if not math.isfinite(n) or n <= 1e-8:
            continue
        u = np.array(v) / n
        if not len(held) or np.abs(held @ u).max() <= most:
            kept.append(key)
            held = np.vstack([held, u])
        if len(kept) == limit:
            break
    return kept


@pytest.mark.parametrize("limit", [None, 7, 700])
def test_directions_in_rounds(spark, monkeypatch, limit):
    """Dense groups of near-parallel vectors (and opposite ones), a long chain in order of rank, loose ones, and rows that are never kept."""
    monkeypatch.setattr(directions, "BLOCK", 300)
    draw, rows = np.random.default_rng(1), []
    centres = draw.normal(size=(12, 16))
    for i in range(1200):
        rows.append(((centres[i % 12] + 0.02 * draw.normal(size=16)) * draw.choice([-1, 1])).tolist())
    for i in range(900):
        rows.append([math.cos(0.02 * i), math.sin(0.02 * i), *[0.0] * 14])
    rows += draw.normal(size=(800, 16)).tolist()
    rows += [[0.0] * 16, [float("nan"), *[1.0] * 15], rows[0], [float("inf")] * 16]
    order = draw.permutation(len(rows)) if limit == 7 else np.arange(len(rows))
    rows = [(i, rows[j]) for i, j in enumerate(order.tolist())]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(6)
    got = directions.distinct_directions(df, "k", "v", [F.floor(F.col("k") / 2)], limit, 0.995).orderBy("rank").collect()
    assert [r.k for r in got] == plain_directions(rows, limit, 0.995) and [r["rank"] for r in got] == list(range(1, len(got) + 1))


def test_ten_thousand_directions(spark):
    draw = np.random.default_rng(4)
    centres = draw.normal(size=(40, 32))
    rows = [(i, (centres[draw.integers(40)] + 0.01 * draw.normal(size=32)).tolist() if draw.random() < 0.6 else draw.normal(size=32).tolist()) for i in range(10_000)]
    df = spark.createDataFrame(rows, "k long, v array<double>").repartition(8)
    assert [r.k for r in directions.distinct_directions(df, "k", "v", [F.col("k")]).orderBy("rank").collect()] == plain_directions(rows, None, 0.995)


def test_directions_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [0.0, 0.0])], "k long, v array<double>")
    assert directions.distinct_directions(df, "k", "v", [F.col("k")]).count() == 0 and directions.distinct_directions(df.limit(0), "k", "v", [F.col("k")], 3).count() == 0


GOOD = {"id": "a", "title": "t", "createdAt": 1.5e12, "mood": [2, -2, 0, 1, 0, 0], "messages": [{"who": "you", "text": "hi"}, {"who": "assistant", "text": "yo", "status": "streaming"}]}


def state_of(spark, raw):
    df = spark.createDataFrame([(raw if isinstance(raw, str) or raw is None else json.dumps(raw),)], "raw string")
    return df.select(chats.restored_state(F.col("raw")).alias("s")).first().s


@pytest.mark.parametrize(
    "change",
    [
        {"id": 7}, {"id": ""}, {"id": None}, {"id": {"x": 1}}, {"title": 5}, {"title": None}, {"createdAt": "1500000000000"}, {"createdAt": None}, {"createdAt": 8.65e15}, {"createdAt": True}, {"messages": None}, {"messages": {}},
        {"messages": ["hi"]}, {"messages": [None]}, {"messages": [{"who": "ghost", "text": "x"}]}, {"messages": [{"who": "you", "text": {"x": 1}}]}, {"messages": [{"who": "you", "text": 3}]}, {"messages": [{"who": ["you"], "text": "x"}]}, {"messages": [{"who": "you"}]},
    ],
)
def test_chats_of_wrong_types_do_not_come_back(spark, change):
    other = GOOD | {"id": "b"}
    state = state_of(spark, {"version": 2, "activeId": "a", "conversations": [GOOD | change, other]})
    assert [c.id for c in state.conversations] == ["b"] and state.activeId is None


@pytest.mark.parametrize("raw", [None, "", "{", "[]", "7", '{"version":2}', {"version": 3, "conversations": [GOOD]}, {"version": "2", "conversations": [GOOD]}, {"version": True, "conversations": [GOOD]}, {"version": 2, "conversations": {}}, '{"version":2,"version":2,"conversations":[]}', '{"version":NaN,"conversations":[]}'])
def test_what_is_no_saved_state_is_empty(spark, raw):
    assert state_of(spark, raw).asDict(True) == {"version": 2, "mood": [0] * 6, "activeId": None, "conversations": []}


def test_saved_state_comes_back(spark):
    saved = {"version": 2.0, "mood": [1, -2, 3, 0.5, "1", 2, 2], "activeId": "a", "conversations": [GOOD, GOOD | {"title": "later"}, GOOD | {"id": "c", "messages": [], "mood": [9, 2.0]}, None, 5, GOOD | {"id": "d", "mood": None, "messages": [{"who": "you", "text": "", "status": "odd"}, {"who": "you", "text": "é\"\n", "status": 4}, {"who": "you", "text": "x", "status": "error"}]}]}
    state = state_of(spark, saved)
    assert state.mood == [1, -2, 0, 0, 0, 2] and state.activeId == "a" and [(c.id, c.title) for c in state.conversations] == [("a", "t"), ("c", "t"), ("d", "t")]
    assert [c.mood for c in state.conversations] == [GOOD["mood"], [0, 2, 0, 0, 0, 0], [0] * 6]
    assert [m.status for c in state.conversations for m in c.messages] == [None, "interrupted", None, None, "error"]
    assert state.conversations[2].messages[1].text == 'é"\n'
    # Saved and loaded again, it's the same; under other speakers nothing is.
    text = spark.createDataFrame([(json.dumps(saved),)], "raw string").select(chats.saved_text(chats.restored_state(F.col("raw"))).alias("raw")).first().raw
    assert state_of(spark, text) == state
    others = spark.createDataFrame([(7, json.dumps(saved))], "n int, raw string")
    assert chats.restored(others, "raw", ("me", "it")).select("n", "place", "chat.id").collect() == [(7, 0, "c")]
    first = saved | {"version": 1}
    assert state_of(spark, first).mood == [0] * 6 and all(c.mood == [0] * 6 for c in state_of(spark, first).conversations)


@pytest.mark.parametrize(
    ("raw", "faults"),
    [
        ('{"\\u0061uthorization":"x"}', ["key authorization"]),
        ('{"a":[{"b":{"MESSAGES" : 1}}],"raw\\u005fresponse":null}', ["key messages", "key raw_response"]),
        ('{"say":"\\"api_key\\": 1","k":"api_key"}', []),
        ('{"x":{"y":["a",{"z":"tok hf_' + "a" * 24 + '"}]}}', ["credential"]),
        ('{"x":"sk-or-v1-\\u0061bcdefghijklmnop"}', ["credential"]),
        ('{"hf_' + "a" * 24 + '":1}', []),
        ('{"a":1,"a":2}', ["malformed"]), ('{"a":NaN}', ["malformed"]), ('["api_key"]', ["malformed"]), ('{"a":', ["malformed"]), ("", ["malformed"]), (None, ["malformed"]), ('{"a":"line\\nbreak \\\\"}', []), ("{}", []),
    ],
)
def test_faults_of_publication(spark, raw, faults):
    assert spark.createDataFrame([(raw,)], "raw string").select(T.publication_faults(F.col("raw"))).first()[0] == faults


def test_resume(spark):
    planned = spark.createDataFrame([(i,) for i in range(6)], "k int")
    saved = spark.createDataFrame([(1, "now"), (2, "old"), (3, None), (4, "now"), (4, "old"), (5, "now"), (5, "now"), (9, "now")], "k int, fingerprint string")
    assert {r.k: r.state for r in audits.resume(planned, saved, "k", "now").collect()} == {0: "run", 1: "done", 2: "mismatch", 3: "mismatch", 4: "mismatch", 5: "done"} and audits.resume(planned, saved, "k", "now").count() == 6

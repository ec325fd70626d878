"""Requests from arrival to end: the stream says what the table says, also over a restart."""

import datetime
import random

import pytest

from antiphon.streaming import lifecycle
from antiphon.streaming.lifecycle import Limits, Service

LIMITS = Limits(request=100.0, generation=30.0, alive=20.0)
SCHEMA = "gate string, ts timestamp, client string, request string, what string"
START = 1_700_000_000_000


def said(arrivals, until, limits=LIMITS):
    service, out = Service(limits), []
    for at, client, request, what in arrivals:
        out += service.take(at, client, request, what)
    return out + list(service.advance(until))


def test_what_is_due_is_said_in_order():
    log = said([(0, "c", "a", "enter"), (1000, "d", "b", "enter"), (5000, "c", "a", "begin"), (24_000, "c", "a", "token"), (30_000, "d", "b", "leave"), (30_500, "d", "b", "leave")], 200_000)
    assert log == [
        ("a", 0, "admitted"), ("b", 1000, "admitted"), ("a", 5000, "begun"), ("b", 21_000, "alive"), ("b", 30_000, "ended"), ("b", 30_500, "unknown"), ("a", 35_000, "generation timeout"),
    ]
    # Without a beginning the request's own deadline counts; its time may be used up whole.
    log = said([(0, "c", "a", "enter"), (100_000, "c", "a", "leave")], 10**6)
    assert [x for x in log if x[2] != "alive"] == [("a", 0, "admitted"), ("a", 100_000, "ended")] and [x[1] for x in log if x[2] == "alive"] == [20_000, 40_000, 60_000, 80_000, 100_000]
    assert ("a", 100_001, "request timeout") in said([(0, "c", "a", "enter")], 10**6)
    # A lease runs out where the deadline is later, and frees its client.
    log = said([(0, "c", "a", "enter"), (1_829_999, "c", "x", "enter"), (1_830_000, "c", "y", "enter")], 1_830_000, Limits(request=4000.0, alive=1e6))
    assert log == [("a", 0, "admitted"), ("x", 1_829_999, "client_busy"), ("a", 1_830_000, "lease over"), ("y", 1_830_000, "admitted")]


def test_rules_of_admission():
    log = said([(k, f"c{k}", f"r{k}", "enter") for k in range(5)], 10)
    assert [x[2] for x in log] == ["admitted"] * 4 + ["queue_full"]
    rows = [x for k in range(7) for x in ((k * 1000, "c", f"r{k}", "enter"), (k * 1000 + 1, "c", f"r{k}", "leave"))]
    assert [x[2] for x in said(rows, 0) if x[0] == "r6"] == ["rate_limit", "unknown"]


def arrivals(seed):
    draw, out, at = random.Random(seed), [], START
    for k in range(400):
        at += draw.choice([0, 400, 3000, 15_000, 60_000])
        request = k if draw.random() < 0.4 else max(0, k - draw.randrange(6))
        out.append(("gh"[request % 2], at, f"c{draw.randrange(6)}", f"r{request}", draw.choice(["enter", "enter", "begin", "token", "leave"])))
    return out


def plain(rows, until):
    out = []
    for gate in sorted({r[0] for r in rows}):
        own = sorted((r[1:] for r in rows if r[0] == gate), key=lambda r: (r[0], r[2], r[3]))
        out += [(gate, *x) for x in said(own, until)]
    return sorted(out)


def test_table(spark):
    rows = arrivals(1)
    df = spark.createDataFrame(rows, "gate string, at long, client string, request string, what string").repartition(5)
    until = rows[-1][1] + 50_000
    assert sorted(map(tuple, lifecycle.lifecycle(df, until, LIMITS).collect())) == plain(rows, until)
    assert lifecycle.lifecycle(df.limit(0), until).count() == 0
    assert {x[3] for x in plain(rows, until)} >= {"admitted", "client_busy", "alive", "ended", "request timeout", "generation timeout", "unknown"}


@pytest.mark.parametrize("restart", [False, True])
def test_stream(spark, tmp_path, restart):
    key, provider = lifecycle.STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        rows = arrivals(2)
        # Batches end between two times, as rows of one time may come in any order within one.
        cuts = [i for i in range(1, 400) if rows[i][1] > rows[i - 1][1]][:: 60] + [400]
        frames, done = [], 0
        for cut in cuts:
            frames.append(rows[done:cut])
            done = cut
        frames.append([("z", rows[-1][1] + 500_000, "c", "last", "enter")])
        frames.append([("z", rows[-1][1] + 500_001, "c", "last", "leave")])

        def run():
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
            q = lifecycle.lifecycle_stream(stream, LIMITS).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None

        for k, frame in enumerate(frames):
            stamped = [(g, datetime.datetime.fromtimestamp(at / 1000, datetime.UTC), *rest) for g, at, *rest in frame]
            spark.createDataFrame(stamped, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k:03d}")
            if restart and k == len(frames) // 2:
                run()
        run()
        got = sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").where("gate <> 'z'").collect()))
        assert got == plain(rows, rows[-1][1] + 500_000)
    finally:
        spark.conf.set(key, before)

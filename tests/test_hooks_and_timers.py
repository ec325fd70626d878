"""Journals, pools and stores of files; freezing; timers and cancellations on streams; draws."""

import datetime
import hashlib
import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from antiphon.functions import vectors as V
from antiphon.operators import audits, chats, corpus, hooks, matching, tensors
from antiphon.sources import files, safetensors
from antiphon.streaming import events, timers


def test_journals(spark, tmp_path):
    path = tmp_path / "j.jsonl"
    path.write_text('{"id":"a"}\n{"id":"b"}')
    files.append_record(str(path), {"id": "c"})
    assert path.read_text().splitlines() == ['{"id":"a"}', '{"id":"b"}', '{"id": "c"}']
    path.write_text('{"id":"a"}\n{"id":"b')
    assert files.mended(str(path)) == 8 and files.mended(str(path)) == 0 and path.read_text() == '{"id":"a"}\n'
    schema = Ty.StructType().add("id", "string")
    assert files.read_json_lines(spark, str(tmp_path / "none*.jsonl"), schema).count() == 0
    path.write_text('{"id":"a"}\n{"n":1}\n')
    assert files.read_json_lines(spark, str(path), schema).count() == 2
    with pytest.raises(Exception, match="without id"):
        files.read_json_lines(spark, str(path), schema, key="id").collect()


def test_documents_and_pools(spark, tmp_path):
    path = str(tmp_path / "x.json")
    files.write_document(path, {"a": 1})
    files.write_document(path, {"a": 2})
    with pytest.raises(FileExistsError):
        files.write_document(path, {"a": 3}, exclusive=True)
    assert json.load(open(path)) == {"a": 2} and [p.name for p in tmp_path.iterdir()] == ["x.json"]
    pool = tmp_path / "pool.json"
    pool.write_text(json.dumps([{"instruction": "one"}, {"instruction": "two"}]))
    sha = hashlib.sha256(pool.read_bytes()).hexdigest()
    assert [r.instruction for r in files.read_pool(spark, str(pool), sha, 2).orderBy("place").collect()] == ["one", "two"]
    for wrong in (("0", 2), (sha, 3)):
        with pytest.raises(files.BadDocument):
            files.read_pool(spark, str(pool), *wrong)
    (tmp_path / "t.txt").write_text(" a \n\n\tb\n")
    assert {r.line for r in files.read_lines(spark, str(tmp_path / "t.txt")).collect()} == {"a", "b"}
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id long, axis string")
    files.write_json_by(df, str(tmp_path / "by"), "axis", "id")
    assert spark.read.json(str(tmp_path / "by/by-axis/axis=x")).count() == 2 and spark.read.json(str(tmp_path / "by/all")).count() == 3
    files.insert_new(df.where("id < 3"), str(tmp_path / "store"), "id")
    files.insert_new(df.withColumn("axis", F.lit("new")), str(tmp_path / "store"), "id")
    assert {(r.id, r.axis) for r in spark.read.parquet(str(tmp_path / "store")).collect()} == {(1, "x"), (2, "y"), (3, "new")}
    assert files.record_path("r", "t", "a") == files.record_path("r", "t", "a") != files.record_path("r", "t", "b")


def test_tensors_missing_from_an_export(tmp_path):
    a, b, out = (str(tmp_path / f"{x}.safetensors") for x in "abo")
    x, y = np.arange(6, dtype=np.float32).reshape(2, 3), np.ones(4, np.float32)
    safetensors.write_tensors(a, {"mtp.x": x, "mtp.y": y, "other": y})
    safetensors.write_tensors(b, {"mtp.y": y})
    assert safetensors.copy_missing([a], [b], out, "mtp.") == ["mtp.x"]
    start, tensors_ = safetensors.read_header(out)
    assert tensors_["mtp.x"]["shape"] == [2, 3] and open(out, "rb").read()[start:] == x.tobytes()
    with pytest.raises(ValueError):
        safetensors.check_bank(out, [2, 3])


def test_freezing(tmp_path):
    path = str(tmp_path / "run.json")
    hooks.frozen(path, {"n": 1, "t": [True]})
    assert hooks.frozen(path, {"n": 1, "t": [True]}) == {"n": 1, "t": [True]}
    for other in ({"n": 1.0, "t": [True]}, {"n": 1, "t": [1]}, {"n": 2, "t": [True]}):
        with pytest.raises(files.BadDocument):
            hooks.frozen(path, other)
    assert hooks.stage_fingerprint(test_freezing, {}) != hooks.stage_fingerprint(test_journals, {}) != hooks.stage_fingerprint(test_journals, {"a": 1})
    data = (tmp_path / "run.json").read_bytes()
    good = {"run.json": {"bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}}
    hooks.bound_inputs(str(tmp_path), good)
    with pytest.raises(files.BadDocument, match="gone: missing; run.json: changed"):
        hooks.bound_inputs(str(tmp_path), {"run.json": {"bytes": 1, "sha256": ""}, "gone": {"bytes": 1, "sha256": ""}})
    hooks.patched(path, [(0, b"X", hashlib.sha256(b"X").hexdigest())])
    assert open(path, "rb").read(1) == b"X"
    with pytest.raises(files.BadDocument):
        hooks.patched(path, [(0, b"Y", "")])
    assert hooks.phases({"a": lambda: 1})("a") == 1


def test_slices_of_source():
    source = "def a():\n    return 1\n\n\ndef b():\n    return 2\n"
    assert hooks.slice_fingerprint(source, ["a"]) == hooks.slice_fingerprint("# said\ndef a():\n\n    return 1  # one\n", ["a"]) != hooks.slice_fingerprint(source, ["b"])
    with pytest.raises(files.BadDocument):
        hooks.slice_fingerprint(source, ["c"])


def test_inventories(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a").write_bytes(bytes(range(256)) * 5)
    (tmp_path / "x/empty").write_bytes(b"")
    whole = {r.path.rpartition("/")[2]: (r.bytes, r.sha256) for r in files.inventory(spark, str(tmp_path / "x")).collect()}
    assert whole == {"a": (1280, hashlib.sha256(bytes(range(256)) * 5).hexdigest()), "empty": (0, hashlib.sha256(b"").hexdigest())}
    rows = files.inventory(spark, f"file://{tmp_path}/x", 500).orderBy("at").collect()
    assert [(r.block, r.at, r.bytes) for r in rows] == [(0, 0, 500), (1, 500, 500), (2, 1000, 280)] and rows[2].sha256 == hashlib.sha256((bytes(range(256)) * 5)[1000:]).hexdigest()


def test_frames_of_a_stream(spark, tmp_path):
    raw = (events.encode("token", {"t": "é"}) + events.encode("done", {})).encode()
    cut = raw.index("é".encode()) + 1
    frames = [[("a", 1, raw[:cut], False), ("b", 1, raw[:10], False)], [("a", 2, raw[cut:], True), ("b", 2, raw[10:cut], False)], [("b", 3, b"", True)]]
    got = results(spark, "frames", events.frames_stream(stream_of(spark, tmp_path, frames, "request_id string, seq long, chunk binary, last boolean")), tmp_path)
    assert [r[1] for r in got if r[0] == "a"] == ["token", "done"] and ("a", "token", '{"t":"é"}') in got and [r[1] for r in got if r[0] == "b"][-1] == "interrupted"


def test_scorers_and_draws(spark):
    df = spark.range(20).withColumn("logits", F.array(F.lit(0.0), F.lit(1.0), F.lit(-1.0))).withColumn("seed", F.col("id") * 7)
    out, seen = hooks.observed(hooks.scored(df.select("id"), lambda b: pd.DataFrame({"score": b["id"] * 2}), "score long"), "p", n=F.count(F.lit(1)))
    assert sum(r.score for r in out.collect()) == 380 and seen.get["n"] == 20
    first = {r.id: r.drawn for r in hooks.seeded_draws(df, "logits", "seed", "id").collect()}
    again = {r.id: r.drawn for r in hooks.seeded_draws(df.repartition(5), "logits", "seed", "id").collect()}
    assert first == again and len(set(first.values())) > 1
    assert [r[0] for r in spark.createDataFrame([([1.0, 3.0, 3.0, 2.0], u) for u in (0.0, 0.49, 0.51, 0.99)], "v array<double>, u double").select(V.warped_draw(F.col("v"), F.col("u"), 2)).collect()] == [2, 2, 3, 3]


def stream_of(spark, folder, frames, schema):
    for k, rows in enumerate(frames):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def results(spark, query_name, stream, folder):
    q = stream.writeStream.format("memory").queryName(query_name).option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.sql(f"SELECT * FROM {query_name}").collect()]


def test_cancellations(spark, tmp_path):
    draw, rows = random.Random(1), []
    for k in range(300):
        rows.append((str(k % 2), float(k * 20), f"r{draw.randrange(60)}", draw.choice(["begin", "cancel", "end"])))
    rows += [("2", 0.0, f"x{k:03d}", "cancel") for k in range(130)] + [("2", 1.0, "x000", "begin"), ("2", 2.0, "x129", "begin"), ("2", 1860.0, "x001", "begin")]
    schema = "worker string, now double, request string, what string"
    own, want = {}, []
    for worker, now, request, what in sorted(rows):
        want.append((request, own.setdefault(worker, timers.Cancellations()).take(now, request, what)))
    assert sorted(map(tuple, timers.cancellations(spark.createDataFrame(rows, schema)).collect())) == sorted(want)
    assert ("x000", "cancelled early") in want and ("x129", "begun") in want and ("x001", "begun") in want
    half = [sorted(r for r in rows if r[1] < 2000), sorted(r for r in rows if r[1] >= 2000)]
    assert sorted(results(spark, "cancelled", timers.cancellations_stream(stream_of(spark, tmp_path, half, schema)), tmp_path)) == sorted(want)


def test_deadlines(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    frames = [[("a", at(0), "begin"), ("b", at(1), "begin"), ("c", at(2), "begin")], [("a", at(5), "end"), ("d", at(30), "begin")], [("e", at(60), "begin")], [("f", at(61), "begin")]]
    got = results(spark, "deadlines", timers.deadlines(stream_of(spark, tmp_path, frames, "request string, ts timestamp, what string"), 10), tmp_path)
    assert {("a", "ended"), ("b", "timeout"), ("c", "timeout")} <= set(got) and not any(r == "f" for r, _ in got)


def test_live_repetition(spark, tmp_path):
    frames = [[("a", 1, "no "), ("a", 2, "no n"), ("b", 1, "yes yes ye")], [("a", 3, "o"), ("b", 2, "sterday yes")], [("a", 4, " no"), ("b", 3, " end")]]
    assert results(spark, "repeats", timers.live_repetition(stream_of(spark, tmp_path, frames, "request string, seq long, text string"), 3), tmp_path) == [("a", 3)]


def test_admission_by_rules(spark):
    """The gate against the rules, one arrival at a time, by plain lists."""
    draw, gate, log, now = random.Random(3), chats.Gate(), [], 0.0
    open_, admitted = {}, []
    for k in range(4000):
        now += draw.choice([0, 0.2, 1, 30, 200])
        client, request = f"c{draw.randrange(8)}", f"r{k}"
        if draw.random() < 0.45 and log:
            gone = draw.choice(log)
            gate.leave(gone)
            open_.pop(gone, None)
            continue
        open_ = {r: x for r, x in open_.items() if x[1] > now}
        minute = [c for t, c in admitted if t > now - 60]
        want = (
            "client_busy" if any(c == client for c, _ in open_.values()) else "queue_full" if len(open_) >= chats.MOST_ADMITTED
            else "service_rate_limit" if sum(t > now - 3600 for t, _ in admitted) >= chats.PER_HOUR else "rate_limit" if minute.count(client) >= chats.PER_MINUTE else "admitted"
        )
        assert gate.enter(now, client, request) == want
        if want == "admitted":
            open_[request] = client, now + chats.LEASE
            admitted.append((now, client))
            log.append(request)
        if k % 500 == 0:
            gate = chats.Gate(json.loads(json.dumps(gate.state())))
            gate.expire(now)


def test_conditioned_turns(spark):
    turn = "array<struct<turn bigint, role string, text string>>"
    df = spark.createDataFrame([([(0, "user", "a"), (1, "assistant", "b"), (2, "user", "c")], [0.25, 0.0, 0.0, 0.0, 0.0, 0.25]), ([(0, "user", "a")], [0.0] * 6)], f"m {turn}, mood array<double>")
    both, none = (r[0] for r in df.select(chats.conditioned(F.col("m"), F.col("mood"))).collect())
    assert [m.text for m in both[:2]] == ["a", "b"] and both[2].text.startswith("c\n\n[Voice") and chats.CONTRAST in both[2].text and chats.BLEND in both[2].text and chats.BALANCE not in both[2].text
    assert [m.text for m in none] == ["a"]
    with pytest.raises(Exception, match="must be a user"):
        spark.createDataFrame([([(0, "assistant", "a")], [0.1] * 6)], f"m {turn}, mood array<double>").select(chats.conditioned(F.col("m"), F.col("mood"))).collect()


def test_ranks_and_unequal_keys(spark):
    draw = random.Random(5)
    rows = [(k, draw.choice(["a", "a", "a", None])) for k in draw.sample(range(10**6), 500)]
    got = {r.id: r.rn for r in corpus.ranked(spark.createDataFrame(rows, "id long, k string"), "k", "id").collect()}
    for key in ("a", None):
        assert [got[i] for i in sorted(i for i, k in rows if k == key)] == list(range(1, 1 + sum(k == key for _, k in rows)))
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(Exception, match="one side only"):
        matching.paired(a, b, "k").collect()
    with pytest.raises(Exception, match="several vectors"):
        tensors.bank(spark.createDataFrame([(1, [1.0]), (1, [2.0])], "k int, v array<double>"), ["k"], "v").collect()
    assert audits.stale(a, b).collect()[0].status == "only regenerated"


def test_shared_generator(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(60)], "id long, pool string")
    rng = random.Random(9)
    want = {(pool, place, at) for pool in "ab" for place, at in enumerate(rng.sample(range(30), 7))}
    got = corpus.shared_sample_of(df, "pool", "id", 7, 9).collect()
    assert {(r.pool, r.place, r.source_at) for r in got} == want and all(r.id == 2 * r.source_at + "ab".index(r.pool) for r in got)


def test_expired_leases(spark):
    df = spark.createDataFrame([("a", 0.0, "enter"), ("a", 5.0, "leave"), ("b", 0.0, "enter"), ("c", 1.0, "enter"), ("c", 50.0, "leave")], "request string, now double, what string")
    assert {(r.request, r.until) for r in timers.expired_leases(df, 10.0).collect()} == {("b", 10.0), ("c", 11.0)}

"""Record stores, lines by byte ranges, bounded token streams, early cancellations, hash trees and inventories of tensors."""

import datetime
import io
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from antiphon.operators import audits
from antiphon.sources import files, lines, records, repair, safetensors
from antiphon.sources.files import BadDocument
from antiphon.streaming import early


def files_under(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names if not f.startswith("."))


def save(df, path, **options):
    df.sparkSession.dataSource.register(records.RecordStore)
    df.write.format("record_store").options(key="k", group="g", **options).mode("append").save(str(path))


def test_records_are_there_whole_or_not_at_all(spark, tmp_path):
    rows = spark.createDataFrame([("a" if i % 2 else "b", i, f"text é {i}") for i in range(300)], "g string, k long, t string").repartition(6)
    save(rows, tmp_path)
    assert len(files_under(tmp_path)) == 300 and not os.path.exists(f"{tmp_path}/_drafts/x")
    back = spark.read.format("record_store").load(str(tmp_path))
    assert sorted((r.group, json.loads(r.record)["k"]) for r in back.collect()) == sorted(("a" if i % 2 else "b", i) for i in range(300))
    assert {r.path for r in back.collect()} == {files.record_path(str(tmp_path), "a" if i % 2 else "b", str(i)) for i in range(300)}
    # A second writer of any of them fails, and its new records aren't there either.
    with pytest.raises(Exception, match="there already"):
        save(spark.createDataFrame([("a", 5, "other"), ("a", 1000, "new")], rows.schema), tmp_path)
    # A task that dies leaves nothing, whatever the others have done.
    broken = spark.range(1000, 1040, 1, 4).select(F.lit("c").alias("g"), F.col("id").alias("k"), F.when(F.col("id") == 1039, F.raise_error(F.lit("lost"))).otherwise("t").cast("string").alias("t"))
    with pytest.raises(Exception, match="lost"):
        save(broken, tmp_path)
    with pytest.raises(Exception, match="twice"):
        save(spark.createDataFrame([("d", 1, "x"), ("d", 1, "y")], rows.schema), tmp_path)
    assert len(files_under(tmp_path)) == 300
    save(spark.createDataFrame([("a", 5, "other")], rows.schema), tmp_path, exclusive="false")
    assert len(files_under(tmp_path)) == 300 and spark.read.format("record_store").load(str(tmp_path)).where("record LIKE '%other%'").count() == 1


@pytest.mark.parametrize("seed", range(30))
def test_ranges_have_every_line_once(seed):
    draw = random.Random(seed)
    data = b"".join(draw.choice([b"a", b"bc", b"\n", b"\n", "é".encode()]) for _ in range(draw.randint(0, 60)))
    want, at = [], 0
    for line in data.split(b"\n")[:-1]:
        want.append((at, line, False))
        at += len(line) + 1
    if data[at:]:
        want.append((at, data[at:], True))
    for share in (1, 2, 3, 7, 100):
        got = [x for b in range(0, len(data), share) for x in lines.lines_of(io.BytesIO(data), b, min(b + share, len(data)), len(data))]
        assert got == want


def test_json_lines_of_many_tasks(spark, tmp_path):
    schema = StructType([StructField("i", LongType()), StructField("t", StringType())])
    path = f"{tmp_path}/j.jsonl"
    with open(path, "w", encoding="utf-8") as f:
        for i in range(5000):
            f.write(json.dumps({"i": i, "t": "x" * (i % 50)}) + "\n" + ("\n" if i % 997 == 0 else ""))
        f.write('{"i": 5000, "t"')
    rows = files.read_json_lines(spark, path, schema, share=4_096)
    assert rows.rdd.getNumPartitions() > 20 and sorted(r.i for r in rows.collect()) == list(range(5000))
    with pytest.raises(Exception, match="bad line at byte"):
        files.read_json_lines(spark, path, schema, strict=True, share=4_096).collect()
    with open(path, "a", encoding="utf-8") as f:
        f.write('\n{"i": 6, "t": "whole"}')
    with pytest.raises(Exception, match="bad line at byte"):
        files.read_json_lines(spark, path, schema, share=4_096).collect()
    assert files.read_json_lines(spark, f"{tmp_path}/none", schema).count() == 0


def test_an_append_reads_the_last_line_only(tmp_path):
    path = f"{tmp_path}/j.jsonl"
    for k, (tail, cut) in enumerate((("", 0), ('{"a": 1}', 0), ('{"a"', 4), ("x" * 200_000, 200_000), (" ", 0))):
        with open(path, "w") as f:
            f.write('{"n": 0}\n' * 1000 + tail)
        assert files.mended(path) == cut
        files.append_record(path, {"k": k})
        with open(path) as f:
            assert [x.strip() for x in f.read().split("\n") if x.strip()] == ['{"n": 0}'] * 1000 + (['{"a": 1}'] if tail == '{"a": 1}' else []) + [json.dumps({"k": k})]

    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            data = super().read(size)
            Counted.n += len(data)
            return data

    assert files._tail(Counted(b"line\n" * 10**6 + b"tail")) == (5 * 10**6, b"tail") and Counted.n <= 1 << 16
    assert files._tail(io.BytesIO(b"")) == (0, b"") and files._tail(io.BytesIO(b"abc"), 2) == (0, b"abc") and files._tail(io.BytesIO(b"a\nbcdef"), 2) == (2, b"bcdef")


def test_tokens_come_bounded(spark, tmp_path):
    spark.dataSource.register(lines.TokenFiles)
    os.makedirs(f"{tmp_path}/in")
    want, sizes = [], []

    def put(name, first, n, end="\n"):
        with open(f"{tmp_path}/in/{name}.jsonl", "a") as f:
            rows = [{"request": name, "seq": i, "text": f"t{i}"} for i in range(first, first + n)]
            want.extend((name, r["seq"]) for r in rows)
            f.write("\n".join(map(json.dumps, rows)) + end)

    def run(batches):
        def each(df, _):
            rows = df.collect()
            if rows:
                sizes.append(len(rows))
                got.extend((r.request, r.seq) for r in rows)

        q = spark.readStream.format("token_files").option("most", 64).load(f"{tmp_path}/in").writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/c").trigger(processingTime="0 seconds").start()
        for _ in range(600):
            if len(got) >= batches or not q.isActive:
                break
            q.awaitTermination(0.1)
        q.stop()

    got = []
    put("a", 0, 150)
    put("b", 0, 10)
    run(160)
    assert sorted(got) == sorted(want) and max(sizes) <= 64
    # A restart goes on where it was; a line that isn't ended waits.
    put("b", 10, 70, end="")
    put("c", 0, 3)
    run(160 + 72)
    assert sorted(set(want) - set(got)) == [("b", 79)] and len(got) == len(set(got)) and max(sizes) <= 64


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


@pytest.mark.parametrize("restart", [False, True])
def test_early_cancellations(spark, tmp_path, restart):
    """Late, early, repeated, too old and never matched ones; rows out of order within what is allowed."""
    begins = [[("early", at(100)), ("never", at(101))], [("late", at(200)), ("old", at(3000))], [("twice", at(3100)), ("unordered", at(3095))], [("end", at(9000))], [("end2", at(9100))], [("end3", at(9200))]]
    cancels = [[("early", at(50)), ("early", at(60))], [("late", at(205)), ("old", at(300))], [("twice", at(3000)), ("unordered", at(3094)), ("twice", at(3050))], [("alone", at(9000))], [("alone", at(9100))], [("alone", at(9200))]]

    def frames(upto):
        for side, rows in (("b", begins), ("c", cancels)):
            for k, own in enumerate(rows[:upto]):
                if not os.path.exists(f"{tmp_path}/{side}/{k}"):
                    spark.createDataFrame(own, "request string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/{side}/{k}")

    def run():
        read = lambda side: spark.readStream.schema("request string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}/*")
        q = early.early_cancellations(read("b"), read("c"), 1860).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None

    if restart:
        frames(2)
        run()
    frames(6)
    run()
    got = sorted((r.request, r.outcome) for r in spark.read.parquet(f"{tmp_path}/out").where("request NOT LIKE 'end%'").collect())
    assert got == [("early", "cancelled early"), ("late", "begun"), ("never", "begun"), ("old", "begun"), ("twice", "cancelled early"), ("unordered", "cancelled early")]


def test_repair_by_blocks(spark, tmp_path):
    draw = random.Random(2)
    data = {f"{d}f{i}.bin": draw.randbytes(draw.choice([1, 999, 1000, 1001, 5500])) for i in range(8) for d in ("", "sub/")}
    for side in ("source", "local"):
        os.makedirs(f"{tmp_path}/{side}/sub")
        for name, x in data.items():
            with open(f"{tmp_path}/{side}/{name}", "wb") as f:
                f.write(x)
    source, local = f"{tmp_path}/source", f"{tmp_path}/local"

    def change(name, how):
        with open(f"{local}/{name}", "rb") as f:
            x = bytearray(f.read())
        with open(f"{local}/{name}", "wb") as f:
            f.write(how(x))

    change("f0.bin", lambda x: bytes([x[0] ^ 1]) + x[1:])
    change("sub/f1.bin", lambda x: x[:-1])
    change("f2.bin", lambda x: x + b"more")
    os.unlink(f"{local}/f3.bin")
    with open(f"{local}/extra", "w") as f:
        f.write("x")
    declared = repair.declared_blocks(spark, source, 1000).cache()
    before = {p: open(p, "rb").read() for p in files_under(local)}
    wrong = declared.withColumn("sha256", F.when(F.col("path") == "f3.bin", "0" * 64).otherwise(F.col("sha256")))
    with pytest.raises(Exception, match="at its source, too"):
        repair.repair(spark, wrong, source, local)
    assert {p: open(p, "rb").read() for p in files_under(local)} == before
    done = {r.path: r for r in repair.repair(spark, declared, source, local).collect()}
    assert {p for p, r in done.items() if r.problem == "repaired"} == {"f0.bin", "sub/f1.bin", "f2.bin", "f3.bin"} and done["extra"].problem == "surplus"
    assert done["f0.bin"].fetched == 1 and done["f2.bin"].fetched == 0 and done["f3.bin"].fetched == done["f3.bin"].blocks
    assert {p[len(local) + 1 :]: open(p, "rb").read() for p in files_under(local)} == data
    assert {r.problem for r in repair.repair(spark, declared, source, local).collect()} == {"right"}


def plain_root(texts, fan):
    import hashlib

    level = [hashlib.sha256(f"0:{t}".encode()).hexdigest() for t in texts]
    while len(level) > 1:
        level = [hashlib.sha256(("1:" + "".join(level[i : i + fan])).encode()).hexdigest() for i in range(0, len(level), fan)]
    return level[0] if level else None


@pytest.mark.parametrize("n", [0, 1, 2, 7, 8, 9, 500])
def test_hash_tree_of_rows_in_order(spark, n):
    rows = [(i * 3, f"row {i * i % 17}") for i in range(n)]
    root = lambda rows, parts: tuple(audits.merkle_fingerprint(spark.createDataFrame(rows, "k long, t string").repartition(parts), F.concat_ws("|", "k", "t"), ["k"], 8).first())
    want = (plain_root([f"{k}|{t}" for k, t in rows], 8), n)
    assert root(rows, 1) == want and root(rows[::-1], 5) == want
    if n > 8:
        swapped = [(k, rows[1 - i][1] if i < 2 else t) for i, (k, t) in enumerate(rows)]
        assert root(swapped, 3)[0] != want[0]


def shard_tables(spark, folder):
    """Inventories of tensor files, and the index that fits them."""
    spark.dataSource.register(safetensors.TensorFiles)
    tensors = spark.read.format("tensor_files").load(str(folder)).withColumnRenamed("file", "shard")
    sizes = []
    for name in sorted(os.listdir(folder)):
        begin, _ = safetensors.read_header(f"{folder}/{name}")
        whole = os.path.getsize(f"{folder}/{name}")
        sizes.append((name, begin, whole - begin, whole, "a" * 64))
    shards = spark.createDataFrame(sizes, "shard string, header_bytes long, tensor_bytes long, file_bytes long, header_sha256 string")
    return tensors, shards, tensors.select("tensor", "shard")


def test_inventory_of_tensors(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").limit(40).collect()
    for k in range(3):
        safetensors.write_tensors(f"{tmp_path}/part-{k}.safetensors", {f"v{r.vec_id}": np.array(r.embedding, np.float32).reshape(8, 8) for r in rows[k::3]})
    tensors, shards, index = (t.cache() for t in shard_tables(spark, tmp_path))
    problems = lambda t=tensors, s=shards, i=index: sorted(((r.shard, r.tensor, r.problem) for r in audits.tensor_problems(t, s, i, safetensors.WIDTHS).collect()), key=str)
    assert problems() == [] and tensors.count() == 40
    one = tensors.where("shard = 'part-1.safetensors'").orderBy("begin").collect()
    name, shard = one[2].tensor, "part-1.safetensors"
    changed = lambda **c: tensors.withColumns({k: F.when(F.col("tensor") == name, v).otherwise(F.col(k)) for k, v in c.items()})
    told = lambda found: {p for s, _, p in found if s == shard}
    assert told(problems(changed(dtype=F.lit("X9")))) == {"unknown type"}
    assert told(problems(changed(shape=F.array(F.lit(-8), F.lit(8)).cast("array<bigint>")))) == {"negative shape", "span and shape differ"}
    assert told(problems(changed(shape=F.array(F.lit(8), F.lit(9)).cast("array<bigint>")))) == {"span and shape differ"}
    assert "gap before it" in told(problems(changed(begin=F.col("begin") + 4))) and "overlap" in told(problems(changed(begin=F.col("begin") - 4)))
    assert "gap before it" in told(problems(tensors.where(F.col("tensor") != name)))
    grown = lambda **c: shards.withColumns({k: F.when(F.col("shard") == shard, v).otherwise(F.col(k)) for k, v in c.items()})
    assert told(problems(s=grown(tensor_bytes=F.col("tensor_bytes") + 8, file_bytes=F.col("file_bytes") + 8))) == {"tensor bytes differ", "values after the last tensor"}
    assert told(problems(s=grown(file_bytes=F.col("file_bytes") + 1))) == {"file bytes differ"}
    assert told(problems(s=grown(header_bytes=F.lit(9), file_bytes=F.col("tensor_bytes") + 9))) == {"no header"}
    assert told(problems(s=grown(header_sha256=F.lit("A" * 64)))) == {"no checksum"} == told(problems(s=grown(header_sha256=F.lit(None).cast("string"))))
    assert "no such shard" in told(problems(s=shards.where(F.col("shard") != shard)))
    assert problems(i=index.where(F.col("tensor") != name)) == [(shard, name, "not in the index")]
    assert problems(i=index.union(spark.createDataFrame([("extra", shard)], index.schema))) == [(shard, "extra", "not in its shard")]
    assert problems(i=index.withColumn("shard", F.when(F.col("tensor") == name, "part-0.safetensors").otherwise(F.col("shard")))) == [(shard, name, "in another shard")]


def test_exact_conversions(spark):
    kind = "tensor string, dtype string, shape array<bigint>, bytes long"
    before = spark.createDataFrame([("a", "F32", [4], 16), ("b", "F32", [4], 16), ("c", "BF16", [4], 8), ("d", "F32", [2], 8), ("gone", "F32", [1], 4)], kind)
    after = spark.createDataFrame([("a", "BF16", [4], 8), ("b", "F32", [4], 16), ("c", "F32", [4], 16), ("d", "BF16", [3], 6), ("new", "F32", [1], 4)], kind)
    expected = spark.createDataFrame([("a", [4], "F32", "BF16", 8), ("b", [4], "F32", "BF16", 8), ("d", [2], "F32", "BF16", 4), ("none", [1], "F32", "BF16", 2)], "tensor string, shape array<bigint>, old string, new string, reduction long")
    got = {r.tensor: r.problem for r in audits.conversion_problems(before, after, expected).collect()}
    assert got == {"b": "expected change is missing", "c": "unexpected change", "d": "another change than expected", "gone": "removed", "new": "added", "none": "expected tensor is missing"}


def test_tensor_files_are_written_whole(tmp_path):
    path = f"{tmp_path}/x.safetensors"
    safetensors.write_tensors(path, {"a": np.ones((2, 3))})

    class Bad:
        shape, size = (2,), 2

        def __array__(self, *_, **__):
            raise OSError("lost")

    with pytest.raises(OSError):
        safetensors.write_tensors(path, {"b": Bad()})
    assert os.listdir(tmp_path) == ["x.safetensors"] and list(safetensors.read_header(path)[1]) == ["a"]
    safetensors.write_tensors(f"{tmp_path}/y.safetensors", {"a": np.ones((3, 2))})
    with pytest.raises(BadDocument, match="another type or shape"):
        safetensors.copy_missing([path], [f"{tmp_path}/y.safetensors"], f"{tmp_path}/z", "")
    with pytest.raises(BadDocument, match="is missing"):
        safetensors.copy_missing([path], [path], f"{tmp_path}/z", "")

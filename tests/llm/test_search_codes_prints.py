"""Lexical search, fingerprints and vector codes against plain versions on small tables; edge cases for each."""

import glob
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from antiphon.llm import fingerprints, lexical, vector_codes

SF = "/root/testdata/sf0.001"
TERM = re.compile(lexical.TERM_PATTERN)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked(docs, items, k=20):
    """Rows (item_id, rank, doc_id, score) by the formula, one document after the other."""
    counts = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    counts = [(doc_id, c, sum(c.values())) for doc_id, c in counts if c]
    n_docs, n_terms, df = len(counts), sum(n for _, _, n in counts), Counter(t for _, c, _ in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c, n in counts:
            m = 75 + (25 * n * n_docs) // n_terms
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, doc_id is not None, doc_id or 0, doc_id))
        out += [(item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(found, key=lambda x: x[:3])[:k], 1)]
    return out


def test_search_is_that_of_all_documents(spark):
    """Several shards and blocks, many equal scores, repeated rows and items, letters of all kinds."""
    draw = random.Random(3)
    word = lambda: draw.choice(["a", "B", "cé", "日本", "x1", "É", "zz", "q\x1fr", "d-e"])
    docs = [(i, " ".join(word() for _ in range(draw.choice([1, 1, 2, 3, 30])))) for i in range(300)]
    docs += [(7, docs[7][1]), (None, "a zz"), (None, "a zz"), (900, None), (901, " -- "), (902, "a " * 50_000), (903, "")]
    items = [(i, " ".join(word() for _ in range(draw.randint(1, 6)))) for i in range(40)] + [(1, "a a zz"), (None, "a a zz"), (50, ""), (51, None), (52, "never seen")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("terms", F.lit("x")).withColumn("score", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1))
    want = sorted(map(str, ranked(docs, items)))
    index = lexical.build(d, shard_terms=50)
    assert index.shards.count() == 5
    for block_bytes in (60, 1 << 20):
        assert sorted(map(str, map(tuple, lexical.search(index, b, block_bytes=block_bytes).collect()))) == want
    assert lexical.lexical_search(d.limit(0), b).count() == 0 and lexical.lexical_search(d, b.limit(0)).count() == 0
    assert lexical.lexical_search(d.where("doc_id in (900, 901)"), b).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_best_takes_ties_by_id(seed):
    draw = np.random.default_rng(seed)
    scores, ids, k = draw.integers(0, 4, 30), draw.permutation(30), int(draw.integers(1, 35))
    want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s)[:k]
    places = lexical.best(scores, ids, k)
    got = sorted((-s, i) for s, i in zip(scores[places].tolist(), ids[places].tolist(), strict=True))
    assert got[:k] == want and len(got) <= max(k, 30)


def sketch(text, k=fingerprints.K):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [words[i : i + 5] for i in range(max(1, len(words) - 4))] if words else []
    return sorted({hashlib.md5(" ".join(s).encode()).hexdigest()[:16] for s in shingles})[:k]


def near(a, b, k=fingerprints.K):
    union = sorted({*a, *b})[:k]
    return sum(h in a and h in b for h in union) / len(union) if union else 1.0


def plain_prints(docs):
    """docs in order; each with the one after it."""
    for (doc_id, text), (_, after) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        yield doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c)


@pytest.mark.parametrize("spans", [None, 1, 7])
def test_fingerprints_of_a_table(spark, spans):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    docs = sorted((r.doc_id * 11 - 700, r.text) for r in rows) + [(10**18, "😀 é" * 30), (10**18 + 1, ""), (10**18 + 2, ""), (2**63 - 2, " one two "), (2**63 - 1, "x" * 100_000)]
    d = spark.createDataFrame(random.Random(1).sample(docs, len(docs)), "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("key", F.lit(2))
    got = {r[0]: tuple(r) for r in fingerprints.fingerprints(d, spans).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()}
    want = {r[0]: r for r in plain_prints(docs)}
    assert got.keys() == want.keys()
    keys = [i for i, _ in docs]
    starts = fingerprints._starts(d.select("doc_id").toDF("key"), spans or 20)
    assert set(starts) <= set(keys) and starts[0] == keys[0] and (not spans or len(starts) == spans)
    for key in want:
        assert got[key][:5] == want[key][:5] and got[key][5:] == pytest.approx(want[key][5:]), key


def test_fingerprints_of_odd_rows(spark):
    schema = "doc_id long, text string, span int, guest string"
    one = spark.createDataFrame([(3, "abcd", 1, "g")], schema)
    assert fingerprints.fingerprints(one).first().edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints.fingerprints(one.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, "a b", 0, ""), (1, "a b", 0, ""), (1, None, 0, None), (None, "c d", None, None), (None, None, 1, "")], schema)
    out = fingerprints.fingerprints(odd).collect()
    assert len(out) == 5 and len({r.fingerprint for r in out if r.n_chars == 3 and r.doc_id == 1}) == 1
    ends = {r.edited_sha256 for r in out if r.doc_id == 1 and r.n_chars == 3}
    assert hashlib.sha256(b"a a").hexdigest() in ends or len(ends) == 2
    assert fingerprints.fingerprints(odd.where("doc_id IS NULL")).count() == 2


def test_sketches_merge_and_estimate(spark):
    draw = random.Random(5)
    texts = [" ".join(draw.choice("abcdefgh") for _ in range(draw.randint(0, 200))) for _ in range(60)]
    parts = spark.createDataFrame([(i % 3, t) for i, t in enumerate(texts)], "g int, text string").repartition(7)
    got = {r.g: r.sketch for r in fingerprints.merged(fingerprints.with_sketch(parts, "text", "sketch"), ["g"]).collect()}
    for g in range(3):
        assert got[g] == sorted({h for i, t in enumerate(texts) if i % 3 == g for h in sketch(t, 10**9)})[: fingerprints.K]
    # Two texts of 3,000 shingles of which half are shared: resemblance 1/3, containment 1/2.
    word = [f"w{i}" for i in range(4504)]
    two = spark.createDataFrame([(" ".join(word[:3004]), " ".join(word[1500:]))], "a string, b string")
    two = fingerprints.with_sketch(fingerprints.with_sketch(two, "a", "sa"), "b", "sb")
    r = two.select(fingerprints.resemblance(F.col("sa"), F.col("sb")), fingerprints.containment(F.col("sa"), F.col("sb")), fingerprints.distinct_shingles(F.col("sa"))).first()
    assert abs(r[0] - 1 / 3) < 0.18 and abs(r[1] - 0.5) < 0.2 and abs(r[2] / 3000 - 1) < 0.4


def test_fingerprints_use_no_python_workers(spark):
    plan = fingerprints.fingerprints(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|MapPartitions", plan) and plan.count("Exchange hashpartitioning(span") <= 3


@pytest.mark.parametrize("seed", range(12))
def test_annulus_finds_the_nearest_of_all(seed):
    """Many ties of distance and of norm, entries that repeat, large and small numbers."""
    draw = np.random.default_rng(seed)
    most = [2, 3, 50, 1 << 27][seed % 4]
    entries, parts = draw.integers(-most, most + 1, (draw.integers(1, 64), 4)), draw.integers(-most, most + 1, (500, 4))
    index, distance = vector_codes.Codebook(entries).nearest(parts)
    all_pairs = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (distance == all_pairs.min(axis=1)).all() and (index == all_pairs.argmin(axis=1)).all()


def plain_codes(rows, n_entries=64):
    rows = sorted(((i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = len(rows[0][2]) // 16
    cut = lambda v, p: v[p * size : (p + 1) * size]
    books = [[cut(v, p) for _, _, v in rows[:n_entries]] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min((apart(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(2):
        new = []
        for p in range(16):
            found = [[] for _ in books[p]]
            for _, _, v in rows:
                found[nearest(v, p)[1]].append(cut(v, p))
            new.append([[sum(x) // len(f) for x in zip(*f, strict=True)] if f else e for f, e in zip(found, books[p], strict=True)])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    best = [[nearest(v, p) for p in range(16)] for _, _, v in rows]
    errors = [sum(d for d, _ in b) for b in best]
    by_label = Counter()
    for (_, label, _), e in zip(rows, errors, strict=True):
        by_label[label] += e
    return [(i, "".join(f"{j:02x}" for _, j in b), e, by_label[label], digest) for (i, label, _), b, e in zip(rows, best, errors, strict=True)]


def test_codes_of_vectors(spark):
    draw = random.Random(2)
    rows = [(i, draw.choice([None, 1, 2, 3]), [draw.choice([0.0, -0.001, 0.5, -1.25, draw.uniform(-2, 2)]) for _ in range(32)]) for i in range(150)]
    rows += [(3, 1, rows[3][2]), (None, None, rows[4][2]), (200, 1, None), (201, 1, []), (202, None, [*rows[0][2][:31], float("nan")]), (203, 1, [None, *rows[0][2][:31]]), (204, 1, [float("-inf"), *rows[0][2][:31]])]
    df = spark.createDataFrame(draw.sample(rows, len(rows)), "vec_id long, label int, embedding array<double>").repartition(4).withColumn("code", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted(map(str, map(tuple, vector_codes.codes_with_errors(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())))
    assert got == sorted(map(str, plain_codes(rows)))
    few = [r for r in rows if r[0] is not None and r[0] < 5]
    got = vector_codes.codes_with_errors(spark.createDataFrame(few, df.select("vec_id", "label", "embedding").schema)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain_codes(few)))
    assert vector_codes.codes_with_errors(df.limit(0)).count() == 0 and vector_codes.codes_with_errors(df.where("vec_id > 199")).count() == 0


def test_vectors_that_do_not_fit(spark):
    rows = [(1, 0, [1.0] * 16), (2, 0, [1.0] * 32), (3, 0, [1.0] * 17), (4, None, [3e38] * 16)]
    got = {r.vec_id: r for r in vector_codes.codes_with_errors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")).collect()}
    assert got.keys() == {1, 4} and got[4].error == 0


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_fingerprints", "op13_vector_codes"])
def test_rows_of_the_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = __spark_entry__.queries()[name](spark, SF), c.sql(__spark_entry__.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda rows: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(got.select(*columns).collect()) == plain(want.select(*columns).fetchall())

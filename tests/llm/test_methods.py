"""The methods of the llm folder against plain versions: hashes, rounds of best fit, references and distances."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm import decontamination, near_duplicates, packing, quality_rules, substring_dedup

SF = "/root/testdata/sf0.001"


def two_words():
    """Words of 1,024 characters that sums of powers modulo 2^64 can't tell apart."""
    bits = [0]
    while len(bits) < 1024:
        bits += [1 - b for b in bits]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_runs_of_words():
    h, draw = C.Hashes(5), np.random.default_rng(0)
    x = draw.integers(0, 1 << 63, 90).astype(np.uint64)

    def plain(run):
        if len(run) == 1:
            return run
        part = 1 << (len(run) - 1).bit_length() - 1
        return h.join(plain(run[:part]), plain(run[part:]))

    for n in (1, 2, 3, 5, 20, 31, 50, 90, 91, 200):
        got = h.runs(x, n)
        assert got.tolist() == [plain(x[i : i + n])[0] for i in range(max(0, 91 - n))]


def test_words_of_a_batch():
    draw = random.Random(1)
    texts = ["".join(draw.choice("ab\n é\t") for _ in range(draw.randint(0, 60))) for _ in range(300)] + [*two_words(), None, " ".join(two_words())]
    words = C.Words(pa.array(texts), C.Hashes(1), C.Hashes(2))
    want = [C.split_words(t or "") for t in texts]
    assert np.diff(words.rows).tolist() == list(map(len, want))
    flat = [w for ws in want for w in ws]
    for hashes in words.hashes:
        assert len({(w, int(h)) for w, h in zip(flat, hashes)}) == len(set(flat)) == len(set(hashes.tolist()))


def test_words_that_sums_of_powers_confuse(spark):
    a, b = two_words()
    head = [f"w{i}" for i in range(49)]
    docs = spark.createDataFrame([(1, " ".join([*head, a])), (2, " ".join([*head, b])), (3, " ".join([a, b] * 8)), (4, " ".join([*head, a]))], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs).collect()}
    assert removed == {1: 0, 2: 0, 3: 0, 4: 50}
    with_lang = docs.selectExpr("doc_id", "text", "'en' AS lang")
    repeats = {r.doc_id: r.n_repeat_words for r in quality_rules.quality_rules(with_lang).collect()}
    assert repeats == {1: 0, 2: 0, 3: 16, 4: 0}
    bench = spark.createDataFrame([(1, " ".join([a, b, b, a, b, a, a, b]))], "item_id long, text string")
    others = spark.createDataFrame([(1, " ".join([b] * 8)), (2, " ".join([a, b, b, a, b, a, a, b]))], "doc_id long, text string")
    assert [r.doc_id for r in decontamination.decontaminate(others, bench, least_score=0.9).where("contaminated").collect()] == [2]
    far = spark.createDataFrame([(1, " ".join([a] * 5 + head)), (2, " ".join([b] * 5 + head[:5]))], "doc_id long, text string")
    assert near_duplicates.one_of_each(far).count() == 2


def best_fit_of_rows(lengths, capacity):
    """Each document, longest first, goes to the smallest gap that it fits in."""
    gaps = []
    for length in sorted(lengths, reverse=True):
        gaps.sort()
        at = next((i for i, gap in enumerate(gaps) if gap >= length), None)
        if at is None:
            gaps.append(capacity)
            at = -1
        gaps[at] -= length
    return Counter(gaps)


@pytest.mark.parametrize("seed", range(12))
def test_rounds_on_counts_are_best_fit_on_rows(seed):
    draw, capacity = random.Random(seed), 64
    lengths = [min(capacity, 1 + int(draw.paretovariate(0.4 + seed / 8))) if seed % 2 else draw.randint(1, capacity) for _ in range(600)]
    rows, n = packing.plan(Counter(lengths), capacity)
    packed, ranks = defaultdict(list), Counter()
    for length, rank, count, first, offset in rows:
        for k in range(count):
            packed[first + k].append((offset, length))
            ranks[length, rank + k] += 1
    assert ranks == Counter({(x, k): 1 for x, m in Counter(lengths).items() for k in range(m)})
    for spans in packed.values():
        assert [a for a, _ in sorted(spans)] == np.cumsum([0, *(x for _, x in sorted(spans))])[:-1].tolist()
    # Which of several equal gaps a document takes is left open, so gaps are compared, not contents.
    assert Counter(capacity - sum(x for _, x in s) for s in packed.values()) == best_fit_of_rows(lengths, capacity)
    assert n == len(packed)


def plain_distance(p, q):
    """Jensen-Shannon, as the definition has it."""
    keys = set(p) | set(q)
    out = 0.0
    for k in keys:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        m = (a + b) / 2
        out += (a * math.log2(a / m) if a else 0) / 2 + (b * math.log2(b / m) if b else 0) / 2
    return math.sqrt(max(out, 0))


def test_quality_verdicts(spark):
    """References, distances and verdicts of every document, from the texts by plain loops."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    shares, langs = {}, {}
    for r in docs.collect():
        text = r.text or ""
        kinds = Counter()
        for c in text:
            b = ord(c)
            kinds["other" if b < 128 else "wide"] += not (c.isascii() and (c.isalnum() or c in " \t\n\x0b\x0c\r" or c in ".,;:!?'\"()-" or c in "#*$%&|<>"))
            if c.isascii():
                kinds["lower"] += c.islower()
                kinds["upper"] += c.isupper()
                kinds["digit"] += c.isdigit()
                kinds["space"] += c in " \t\n\x0b\x0c\r"
                kinds["punct"] += c in ".,;:!?'\"()-"
                kinds["symbol"] += c in "#*$%&|<>"
        known = set(quality_rules.BIN_OF_WORD)
        words = Counter(w if w in known else w[0].lower() + w[1:] if w[0].isupper() and w[0].lower() + w[1:] in known and w[1:] == w[1:].lower() else "" for w in (x.decode() for x in C.split_words(text)))
        shares[r.doc_id] = [{k: n / sum(x.values()) for k, n in x.items()} if sum(x.values()) else {} for x in (kinds, words)]
        langs[r.doc_id] = r.lang if r.lang in quality_rules.LANGUAGES else ""
    limits = quality_rules.MOST_CLASS, quality_rules.MOST_COMMON
    long = {d: (r.word_chars >= 200, r.n_words >= 50) for d, r in got.items()}
    for k in (0, 1):
        far = dict.fromkeys(shares, 0.0)
        for _ in range(1 + quality_rules.TRIMS):
            reference = {}
            for lang in set(langs.values()):
                own = [d for d in shares if langs[d] == lang]
                good = [d for d in own if not got[d].base_failed and long[d][k] and far[d] <= limits[k]] or [d for d in own if shares[d][k]]
                total = Counter()
                for d in good:
                    total.update(shares[d][k])
                reference[lang] = {x: v / len(good) for x, v in total.items()}
            far = {d: plain_distance(shares[d][k], reference[langs[d]]) for d in shares}
        for d, r in got.items():
            own = (r.class_distance, r.common_distance)[k]
            assert (own is None) == (not long[d][k]) and (own is None or abs(own - far[d]) < 1e-6), d
    for d, r in got.items():
        near = all(x is None or x <= limit for x, limit in zip((r.class_distance, r.common_distance), limits))
        assert r.kept == (not r.base_failed and near)
    assert sum(not r.kept and not r.base_failed for r in got.values()) > 0


def test_near_duplicates_of_one_id(spark):
    """Different texts of one id, near copies with and without an id, fingerprints that are equal for different texts."""
    base, other = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = [(1, base), (2, [*base, "end"]), (2, other), (None, [*other, "end"]), (None, [f"c{i}" for i in range(60)]), (None, [f"c{i}" for i in range(60)]), (3, []), (4, None), (None, [])]
    docs = spark.createDataFrame([(d, None if w is None else " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = [(r.doc_id, (r.text or "").split(" ")[0]) for r in near_duplicates.one_of_each(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "a0"), (2, "b0"), (None, "c0"), (3, "")], key=str)


@pytest.mark.parametrize("few", [0, 1 << 15])
def test_split_joins(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_ROWS", few)
    rows = spark.createDataFrame([(k % 40 if k % 3 else 7, k) for k in range(900)], "key long, v long")
    counts = {r.key: r["count"] for r in rows.groupBy("key").count().collect()}
    table = spark.createDataFrame([(k, f"t{k}", n) for k, n in counts.items() if k % 2], "key long, name string, n long")
    assert max(counts.values()) > 64
    got = sorted((r.key, r.v, r.name) for r in C.split_join(rows, table, ["key"], "n", 900).collect())
    assert got == sorted((r.key, r.v, f"t{r.key}") for r in rows.collect() if r.key % 2)
    semi = C.split_join(rows, table.drop("name"), ["key"], "n", 900, "left_semi")
    assert sorted(r.v for r in semi.collect()) == sorted(v for _, v, _ in got)


def test_split_joins_of_near_duplicates(spark, monkeypatch):
    """A large bucket that stays apart, with every join split."""
    monkeypatch.setattr(C, "FEW_ROWS", 0)
    shared = [f"h{i}" for i in range(100)]
    rows = [(k, shared + [f"u{k // 2}x{i}" for i in range(80)]) for k in range(160)]
    docs = spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")
    got = near_duplicates.groups(docs.withColumn("text", F.concat("text", F.lit(" end"), F.col("doc_id").cast("string"))), cell=32).where("stays").collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 160, 2))

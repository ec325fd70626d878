"""The models of the llm folder against plain versions: mined rules, labelers and span classifier, importance weights."""

import itertools
import math
import random
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from antiphon.llm import _common as C
from antiphon.llm import importance, pii, url_rules

SF = "/root/testdata/sf0.01"


def plain_tokens(url):
    import re

    bare = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url).lower()
    return frozenset(x for x in re.split("[^a-z0-9]+", bare) if x)


def test_mined_rules_are_all_rules(spark):
    """Every set of tokens, counted one by one; verdicts of every page."""
    draw, words = random.Random(3), [f"t{i}" for i in range(9)]
    urls = [f"http://{'.'.join(draw.sample(words, draw.randint(1, 4)))}/{draw.choice('xyz')}" for _ in range(400)] + ["http://new.info/t0/t1", None, "t0 t1 without a scheme"]
    bad = {i: int(("t0" in plain_tokens(u) and "t1" in plain_tokens(u)) != (draw.random() < 0.15)) for i, u in enumerate(urls[:400]) if i % 5}
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    limits = {"min_support": 0.01, "min_pages": 12, "min_confidence": 0.6, "min_lift": 1.5}
    baskets = [(plain_tokens(urls[i]), b) for i, b in bad.items()]
    least, share = math.ceil(max(0.01, 12 / len(baskets)) * len(baskets)), sum(b for _, b in baskets) / len(baskets)
    want = {}
    every = sorted({t for own, _ in baskets for t in own})
    for n in range(1, 6):
        for items in itertools.combinations(every, n):
            own = [b for tokens, b in baskets if set(items) <= tokens]
            if sum(own) >= least and sum(own) / len(own) >= 0.6 and sum(own) / len(own) / share >= 1.5:
                want[items] = sum(own) / len(own)
    got = {tuple(sorted(x)): r.confidence for r in url_rules.mine(pages, labels, **limits).collect() for x in itertools.product(*r.antecedent)}
    alone = {k for k in want if len(k) == 1}
    minimal = {k for k in want if len(k) == 1 or not any((t,) in alone for t in k)}
    assert got.keys() == minimal and all(abs(got[k] - want[k]) < 1e-9 for k in got) and any(len(k) > 1 for k in want)
    for r in url_rules.url_verdicts(pages, labels, (), **limits).collect():
        tokens = plain_tokens(urls[r.page_id]) if urls[r.page_id] else frozenset()
        assert r.verdict == ("block" if any(set(k) <= tokens for k in want) else "allow"), urls[r.page_id]


def plain_verdicts(urls, bad, least_share, least_pages, least_confidence, least_lift):
    """By every set of tokens of every labelled url."""
    baskets = [(plain_tokens(urls[i]), b) for i, b in bad.items()]
    least, share = math.ceil(max(least_share, least_pages / len(baskets)) * len(baskets)), sum(b for _, b in baskets) / len(baskets)
    count = Counter()
    for own, b in baskets:
        for n in range(1, len(own) + 1):
            for items in itertools.combinations(sorted(own), n):
                count[items, b] += 1
    rules = [set(k) for k, b in count if b and count[k, 1] >= least and count[k, 1] / (count[k, 1] + count[k, 0]) >= least_confidence and count[k, 1] / (count[k, 1] + count[k, 0]) / share >= least_lift]
    return ["block" if any(r <= plain_tokens(u) for r in rules) else "allow" for u in urls]


def test_rules_of_a_shared_path(spark):
    """Twelve tokens that labelled urls share, some of them only in part, against every set of tokens; then forty."""
    draw = random.Random(6)
    path = [f"p{i}" for i in range(12)]
    urls = [f"http://a/{'/'.join(path if i % 3 else path[:7])}" for i in range(60)] + [f"http://b/{draw.choice('uvw')}/{'/'.join(draw.sample(path, draw.choice((0, 0, 1, 5))))}" for _ in range(140)]
    bad = {i: int(i < 60) for i in range(200) if i % 4}
    limits = (0.01, 15, 0.6, 1.5)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - b, 0) for i, b in bad.items()], "doc_id long, quality int, toxic int")
    keys = dict(zip(("min_support", "min_pages", "min_confidence", "min_lift"), limits, strict=True))
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, (), **keys).collect()}
    assert [got[i] for i in range(200)] == plain_verdicts(urls, bad, *limits) and len(set(got.values())) == 2
    urls = [f"http://a/{'/'.join(f'q{i}' for i in range(40))}/{k}" for k in range(60)] + [f"http://b/{k}" for k in range(140)] + ["http://c/q3", "http://c/q39/q1", "http://c"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    began = time.time()
    got = {r.page_id: r.verdict for r in url_rules.url_verdicts(pages, labels, (), **keys).collect()}
    assert time.time() - began < 60 and [got[i] for i in range(203)] == ["block"] * 60 + ["allow"] * 140 + ["block", "block", "allow"]


def test_given_rules_on_odd_pages(spark):
    schema = "page_id long, url string, host string, token string, items string"
    rows = [(1, "http://a.com/en/" + "x" * 200_000), (1, "http://a.com/en/" + "x" * 200_000), (None, None), (2, ""), (3, "://"), (4, "http://COM/en/?a://b")]
    pages = spark.createDataFrame([(*r, "h", "t", "i") for r in rows], schema)
    labels = spark.createDataFrame([(1, 0, None), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = sorted(((r.page_id, r.host, r.rule, r.verdict) for r in url_rules.url_verdicts(pages, labels).collect()), key=str)
    assert got == sorted([(1, "a.com", "com/en/", "block")] * 2 + [(None, "", None, "allow"), (2, "", None, "allow"), (3, "", None, "allow"), (4, "com", "com/en/", "block")], key=str)
    assert url_rules.url_verdicts(pages.limit(0), labels).count() == 0 and url_rules.url_verdicts(pages, labels.limit(0)).count() == 6


def test_url_tokens_of_all_letters(spark):
    """Letters whose lower case is two characters, or a plain one: rows against the SQL."""
    import duckdb

    from antiphon.llm.sql import ORACLE

    draw = random.Random(8)
    words = ["x\u0130y", "\u0130", "Kelvin", "\u212aelvin", "I\u0307x", "\u0131", "Stra\u00dfe", "news", "shop", "B7"]
    urls = [f"http://{'.'.join(draw.sample(words, draw.randint(1, 3)))}/{draw.choice(('en', 'q', 'X'))}" for _ in range(300)] + ["http://other.info/xiy", "http://other.info/xi/y", "ftp://a.net/de/x\u0130y"]
    bad = [(i, int("\u0130" not in u), 0) for i, u in enumerate(urls[:300]) if i % 5]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame(bad, "doc_id long, quality int, toxic int")
    db = duckdb.connect()
    db.register("pages", pages.toArrow())
    db.register("labels", labels.toArrow())
    want = db.sql(ORACLE["op7_url_rules"])
    got = url_rules.url_verdicts(pages, labels).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and {r.page_id: r.verdict for r in got if r.page_id >= 300} == {300: "block", 301: "allow", 302: "block"}


def plain_reliabilities(candidates):
    """Expectation-maximisation on candidates (kind, votes), one by one."""
    soft = [1 / (1 + math.exp(-1.5 * sum(v))) for _, v in candidates]
    for _ in range(50):
        yes, no = sum(soft) + 6, len(soft) - sum(soft) + 6
        prior = {k: (sum(s for s, (kind, _) in zip(soft, candidates) if kind == k) + 1) / (sum(kind == k for kind, _ in candidates) + 2) for k in range(len(pii.LOOSE))}
        table = {}
        for j in range(4):
            for v in (-1, 0, 1):
                hits = [s for s, (_, votes) in zip(soft, candidates) if votes[j] == v]
                table[j, v] = math.log(((sum(hits) + 2 + v) / yes) / ((len(hits) - sum(hits) + 2 - v) / no))
        odds = [math.log(min(max(prior[k], 0.01), 0.99) / (1 - min(max(prior[k], 0.01), 0.99))) + sum(table[j, v] for j, v in enumerate(votes)) for k, votes in candidates]
        soft = [1 / (1 + math.exp(-min(max(o, -30), 30))) for o in odds]
    return soft


def unpacked(code, widths):
    out = []
    for w in widths[::-1]:
        out.append(code % w)
        code //= w
    return out[::-1]


def test_span_classifier(spark):
    """Candidates one by one: their posteriors, the regression's optimum, and the spans that come out."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    found = {d: (own, pii.loose_spans(t, own)) for d, t in rows.items() for own in [pii.base_spans(t)]}
    flat = [(d, x) for d, (_, loose) in found.items() for x in loose]
    soft = plain_reliabilities([(x[0], [v - 1 for v in unpacked(x[3] % 81, (3, 3, 3, 3))]) for _, x in flat])
    x = np.zeros((len(flat), 1 + sum(pii.WIDTHS)))
    x[:, 0] = 1
    for i, (_, c) in enumerate(flat):
        at = 1
        for value, width in zip(unpacked(c[4], pii.WIDTHS), pii.WIDTHS):
            x[i, at + value] = 1
            at += width
    # The optimum is where the gradient is zero; it's the only one, as the penalty is strictly convex.
    _, votes, features, n = zip(*((0, v, f, k) for (v, f), k in sorted(Counter((c[3], c[4]) for _, c in flat).items())))
    codes, back = np.unique(votes, return_inverse=True)
    posterior = pii.reliabilities(codes, np.bincount(back, n))
    by_code = dict(zip(codes.tolist(), posterior.tolist()))
    assert all(abs(by_code[c[3]] - s) < 1e-6 for (_, c), s in zip(flat, soft))
    weights = pii.train(np.array(features), np.array(n, float), posterior[back])
    p = 1 / (1 + np.exp(-x @ weights))
    assert np.abs(x.T @ (p - np.array(soft)) + weights).max() < 1e-4
    want = {d: [] for d in rows}
    for (d, c), q in zip(flat, p):
        if q >= 0.5:
            want[d].append((len(pii.KINDS) + c[0], c[1], c[2]))
    names = pii.KINDS + pii.LOOSE
    line = lambda spans: ",".join(f"{names[k]}:{b}:{e}" for k, b, e in sorted(spans))
    out = pii.find_pii(docs).collect()
    assert {r.doc_id: r.spans for r in out} == {d: line(found[d][0] + want[d]) for d in rows} and sum(r.n_extra for r in out) > 0
    masked = {r.doc_id: r.text for r in pii.masked_documents(docs).collect()}
    assert all(masked[d] == pii.mask(rows[d], found[d][0] + want[d]) for d in rows)


def test_importance_weights(spark):
    """Log weights and draws of every document, by dense sums over its n-grams; the raw model's counts one by one."""
    docs, labels = (spark.read.parquet(f"{SF}/{x}.parquet") for x in ("documents", "labels"))
    texts = C.text_frame(docs, F.coalesce("lang", F.lit("")).alias("lang"), F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"))
    present = C.keep(texts.mapInArrow(importance._present, "doc_id long, lang string, version long, row long, buckets binary"), "present")
    model, share = importance.fit(docs, labels, present)
    rows = [(r.doc_id, r.lang, sorted(importance._Grams().present(C.split_words(r.text)))) for r in texts.collect()]
    assert model.of, "the labels of this table make a model"
    logs = []
    for _, lang, buckets in rows:
        names, ratio = model.table(lang if lang in model.of else "")
        of = dict(zip(names.tolist(), ratio))
        logs.append(sum((of[b] for b in buckets if b in of), np.zeros(4)))
    logs = np.array(logs)
    raw = lambda s: np.log((np.exp(logs + np.log(s) - (logs + np.log(s)).max(1, keepdims=True))).sum(1)) + (logs + np.log(s)).max(1)
    for _ in range(6):
        mean = np.maximum(np.exp(logs + np.log(share) - raw(share)[:, None]).mean(0), 1e-4)
        mean /= mean.sum()
        done, share = np.abs(mean - share).max() < 1e-4, mean
        if done:
            break
    want = dict(zip((r[0] for r in rows), logs[:, 0] - raw(share)))
    got = importance.importance(docs, labels).collect()
    assert len(got) == len(rows) and all(abs(r.log_weight - want[r.doc_id]) < 2e-6 for r in got)
    k = sum(w >= importance.FLOOR for w in want.values())
    least = sorted((r.key for r in got), reverse=True)[k - 1]
    assert all(r.kept == (r.key >= least) for r in got) and sum(r.kept for r in got) >= k
    # The raw text's ratios, from distinct texts.
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), importance.label_class().alias("class")).where("class IS NOT NULL")
    known = {r.doc_id for r in chosen.collect()}
    ratios = importance._raw_ratios(present, chosen, set())
    first = {}
    for doc_id, _, buckets in rows:
        first.setdefault(tuple(buckets), []).append(doc_id)
    seen, held = Counter(), Counter()
    versions = {}
    for r in present.select("doc_id", "version", "row").collect():
        versions[r.version] = min(versions.get(r.version, (1 << 62, None)), (r.row, r.doc_id))
    kept = {d for _, d in versions.values()}
    for doc_id, _, buckets in rows:
        if doc_id in kept:
            seen.update(buckets)
            held.update(buckets if doc_id in known else ())
    scale = sum(held.values()) / sum(seen.values())
    want_ratio = {b: math.log((n * scale + importance.SHRINK) / (held[b] + importance.SHRINK)) for b, n in seen.items()}
    want_ratio = {b: v for b, v in want_ratio.items() if abs(v) > importance.LEAST_RATIO and abs(held[b] - seen[b] * scale) / math.sqrt(seen[b] * scale + 1) > importance.LEAST_SIGMA}
    assert ratios[""].keys() == want_ratio.keys() and all(abs(ratios[""][b] - v) < 1e-9 for b, v in want_ratio.items())


def test_packed_rows():
    draw = random.Random(1)
    rows = [sorted(draw.sample(range(1 << 18), draw.randint(0, 50))) for _ in range(200)] + [[], [0], [(1 << 18) - 1]]
    flat, row = importance.unpack_rows(importance.pack_rows(rows))
    assert [flat[row == i].tolist() for i in range(len(rows))] == rows and not len(importance.unpack_rows(importance.pack_rows([]))[0])

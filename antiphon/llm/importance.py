"""Quality classifier by importance resampling.

Target, low-quality and toxic text each have a generative model over hashed n-grams (words, word shapes, pairs of shapes,
immediate repeats), one set for each language with enough labelled documents and one for all others. A document's importance
weight is its probability under the target's model over that under the raw text's, which is the mixture of the three and of
one more that is counted over all documents, with shares fitted to the whole corpus by expectation-maximisation. Documents are drawn by Gumbel top-k: the k largest of log
weight plus temperature times Gumbel noise, where k is how many documents' log weight reaches `floor`.

The models: an n-gram counts once for each context (the words beside it), so copies and shared passages weigh nothing; its
log ratio to what its class's size lets expect is shrunk by `shrink` counts, and ratios that are small or not significant are
left out. Contexts are gathered only for n-grams whose counts of documents differ between classes. Training uses at
most MAX_TRAIN labelled documents (the first by their id's hash). The raw text's own model has for each n-gram how many
distinct texts of the whole corpus hold it, against how many of those in the labelled sample do, by the same rules (at the
sample's size): n-grams that are frequent in the corpus, but not where there are labels, speak against a document. All
documents are scored whole, and all count for the mixture's shares and for k.

Edge cases: a null text is empty; an empty text has only the mixture's shares to go by and is kept. Labels: toxic 1 makes a
document toxic, else quality 0 low quality, else quality 1 target; other labels are left out; of several for one id the worst
counts. Without labels of the target, or of anything else, every document is kept. Noise depends on doc_id and text, so equal
rows share their fate; rows that tie with the k-th are all kept. Other columns are left out; an empty table gives an empty
result.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C

MAX_TRAIN, BUCKETS = 20_000, 1 << 18
SHRINK, LEAST_SIGMA, LEAST_RATIO, LEAST_COUNT, LEAST_DOCS = 4.0, 4.0, 1.4, 8, 100
#: Of all contexts, those with a hash of 0 modulo this measure how much text a class has (as bucket EVERY).
MEASURE, EVERY = 16, -1
FLOOR, TEMPERATURE, SEED = -3.5, 0.1, 20
N_CLASSES = 3
#: Share of the raw text's own model before the fit.
OTHER = 0.05
_SHAPE = bytes(97 if 97 <= b < 123 or b >= 128 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


def _bucket(kind: bytes, gram: bytes) -> int:
    return zlib.crc32(kind + gram) % BUCKETS


REPEAT = _bucket(b"r", b"")


class _Grams:
    """Buckets of a text's n-grams; what a word stands for is remembered."""

    def __init__(self):
        self.word: dict[bytes, int] = {}
        self.shape: dict[bytes, bytes] = {}
        self.of_shape: dict[bytes, int] = {}
        self.pair: dict[tuple[bytes, bytes], int] = {}

    def learn(self, words: list[bytes]) -> tuple[set[bytes], list[bytes]]:
        if len(self.word) > 150_000:
            self.word, self.shape = {}, {}
        distinct = set(words)
        for w in distinct.difference(self.word):
            self.word[w] = _bucket(b"w", w)
            shape = _RUN.sub(rb"\1", w.translate(_SHAPE))[:16]
            self.shape[w] = shape
            self.of_shape.setdefault(shape, _bucket(b"s", shape))
        return distinct, [self.shape[w] for w in words]

    def pair_bucket(self, pair: tuple[bytes, bytes]) -> int:
        found = self.pair.get(pair)
        if found is None:
            if len(self.pair) > 150_000:
                self.pair.clear()
            found = self.pair[pair] = _bucket(b"d", b" ".join(pair))
        return found

    def present(self, words: list[bytes]) -> set[int]:
        distinct, shapes = self.learn(words)
        out = {self.word[w] for w in distinct}
        out.update(self.of_shape[s] for s in set(shapes))
        out.update(map(self.pair_bucket, set(zip(shapes, shapes[1:]))))
        if any(map(operator.eq, words, words[1:])):
            out.add(REPEAT)
        if len(self.of_shape) > 150_000:
            self.of_shape, self.word, self.shape = {}, {}, {}
        return out

    def in_context(self, words: list[bytes], wanted: set[int]) -> Iterator[tuple[int, int]]:
        """(bucket, context) of the buckets wanted, and of EVERY."""
        _, shapes = self.learn(words)
        padded = [b"", *words, b""]
        for k, w in enumerate(words):
            context = xxhash.xxh64_intdigest(b" ".join(padded[k : k + 3])) - (1 << 63)
            if context % MEASURE == 0:
                yield EVERY, context
            if self.word[w] in wanted:
                yield self.word[w], context
            if self.of_shape[shapes[k]] in wanted:
                yield self.of_shape[shapes[k]], context
            if k + 1 < len(words) and self.pair_bucket((shapes[k], shapes[k + 1])) in wanted:
                yield self.pair_bucket((shapes[k], shapes[k + 1])), context
            if k and w == words[k - 1] and REPEAT in wanted:
                yield REPEAT, context


def label_class() -> Column:
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams, total = _Grams(), {}
    for batch in C.chunks(batches):
        for text, lang, kind in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            own = total.setdefault((lang, kind), np.zeros(BUCKETS, np.int32))
            own[list(grams.present(C.split_words(text)))] += 1
    for (lang, kind), own in total.items():
        some = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(np.full(len(some), kind, np.int32)), pa.array(some.astype(np.int32)), pa.array(own[some])], names=["lang", "class", "bucket", "n"])


def pack_rows(rows: list[list[int]]) -> pa.Array:
    """Rows of ascending numbers below 2^24, each as the steps between them: all low bytes, all middle ones, all high ones (which compress well so)."""
    sizes = np.array([len(x) for x in rows], np.int64)
    flat = np.fromiter((y for x in rows for y in x), np.int64, int(sizes.sum()))
    begin = np.cumsum(sizes) - sizes
    step = np.diff(flat, prepend=0)
    full = begin[sizes > 0]
    step[full] = flat[full]
    at = np.arange(len(flat)) + 2 * np.repeat(begin, sizes)
    out = np.zeros(3 * len(flat), np.uint8)
    for plane in range(3):
        out[at + plane * np.repeat(sizes, sizes)] = (step >> (8 * plane)) & 255
    ends = np.concatenate([[0], np.cumsum(3 * sizes)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())]).cast(pa.binary())


def unpack_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of pack_rows(), and the row of each."""
    raw, ends = C.buffers(column)
    sizes = np.diff(ends) // 3
    begin = np.cumsum(sizes) - sizes
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(int(sizes.sum())) + 2 * begin[row]
    step = sum(raw[at + plane * sizes[row]].astype(np.int64) << (8 * plane) for plane in range(3))
    total = np.concatenate([[0], np.cumsum(step)])
    return total[1:] - total[begin][row], row


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = _Grams()
    for batch in C.chunks(batches):
        rows = [sorted(grams.present(C.split_words(text))) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pack_rows(rows)], names=["doc_id", "lang", "version", "row", "buckets"])


def _corpus_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language: documents that hold each bucket, and labelled ones."""
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs, labelled = np.array(batch.column(0).to_pylist(), object), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        buckets, row = unpack_rows(batch.column(1))
        for lang in set(langs.tolist()):
            own = total.setdefault(lang, np.zeros((2, BUCKETS), np.int64))
            mine = (langs == lang)[row]
            own[0] += np.bincount(buckets[mine], minlength=BUCKETS)
            own[1] += np.bincount(buckets[mine & labelled[row]], minlength=BUCKETS)
    for lang, own in total.items():
        some = np.flatnonzero(own[0])
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(own[0][some]), pa.array(own[1][some])], names=["lang", "bucket", "raw", "known"])


def _raw_ratios(present: DataFrame, chosen: DataFrame, enough: set[str]) -> dict[str, dict[int, float]]:
    """For each language with a model: log ratios of buckets between all distinct texts and those in the labelled sample."""
    first = present.groupBy("version").agg(F.min("row").alias("row")).select("row")
    own = F.when(F.col("lang").isin(*enough), F.col("lang")).otherwise("") if enough else F.lit("")
    rows = present.join(first, "row", "left_semi").join(F.broadcast(chosen.select("doc_id", F.lit(True).alias("known"))), "doc_id", "left")
    counts = rows.select(own.alias("lang"), "buckets", F.coalesce("known", F.lit(False)).alias("known")).mapInArrow(_corpus_counts, "lang string, bucket int, raw long, known long")
    sums = F.sum("raw").alias("raw"), F.sum("known").alias("known")
    by_language = C.keep(counts.groupBy("lang", "bucket").agg(*sums), "raw-counts")
    # The model without a language is that of all together.
    counts = by_language.where("lang <> ''").union(by_language.groupBy(F.lit("").alias("lang"), "bucket").agg(*sums))
    totals = counts.groupBy("lang").agg(F.sum("known") / F.sum("raw")).collect()
    out: dict[str, dict[int, float]] = {}
    for lang, scale in totals:
        seen, expected = F.col("raw") * float(scale), F.col("known")
        ratio = F.log((seen + SHRINK) / (expected + SHRINK))
        # As the sample is small, it's its count that may differ by chance. At most BUCKETS rows.
        good = (F.abs(expected - seen) / F.sqrt(seen + 1) > LEAST_SIGMA) & (F.abs(ratio) > LEAST_RATIO)
        out[lang] = {r.bucket: r.ratio for r in counts.where((F.col("lang") == lang) & good).select("bucket", ratio.alias("ratio")).collect()} if scale else {}
    C.forget(by_language)
    return out


def _context_rows(wanted: dict[str, set[int]]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = _Grams()
        for batch in C.chunks(batches, most=C.CHUNK_BYTES // 4):
            out: dict[tuple[str, int], set[tuple[int, int]]] = {}
            for text, lang, kind in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                out.setdefault((lang, kind), set()).update(grams.in_context(C.split_words(text), wanted.get(lang, set())))
            for (lang, kind), pairs in out.items():
                found = np.array(list(pairs), np.int64).reshape(-1, 2)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(np.full(n, kind, np.int32)), pa.array(found[:, 0].astype(np.int32)), pa.array(found[:, 1])], names=["lang", "class", "bucket", "context"])

    return rows


def _by_class(df: DataFrame, value: Column) -> DataFrame:
    return df.groupBy("lang", "bucket").agg(*(F.sum(F.when(F.col("class") == k, value).otherwise(0)).cast("long").alias(f"n{k}") for k in range(N_CLASSES)))


class Model:
    """For each language: log ratios of the buckets that tell classes apart."""

    def __init__(self, totals: dict[str, np.ndarray], counts: dict[str, dict[int, np.ndarray]]):
        self.of: dict[str, tuple[dict[int, int], np.ndarray]] = {}
        for lang, own in counts.items():
            total = totals[lang]
            if not own or not total[0] or not total[1:].any():
                continue
            buckets = np.array(list(own), np.int64)
            seen = np.array(list(own.values()), float)
            expected = seen.sum(1, keepdims=True) * (total / total.sum())
            ratio = np.log((seen + SHRINK) / (expected + SHRINK))
            good = ((np.abs(seen - expected) / np.sqrt(expected + 1) > LEAST_SIGMA) & (np.abs(ratio) > LEAST_RATIO)).any(1)
            self.of[lang] = {int(b): i for i, b in enumerate(buckets[good])}, ratio[good]

    def add(self, raw: dict[str, dict[int, float]]) -> None:
        """The raw text's own log ratios, as one more column."""
        for lang, (index, ratio) in self.of.items():
            own = raw.get(lang, {})
            for b in own:
                index.setdefault(b, len(index))
            wide = np.zeros((len(index), N_CLASSES + 1))
            wide[: len(ratio), :N_CLASSES] = ratio
            wide[[index[b] for b in own], N_CLASSES] = list(own.values())
            self.of[lang] = index, wide

    def table(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        """Sorted buckets, and their log ratios."""
        index, ratio = self.of.get(lang) or self.of.get("") or ({}, np.zeros((0, N_CLASSES + 1)))
        buckets = np.array(list(index), np.int64)
        order = np.argsort(buckets)
        return buckets[order], ratio[np.array(list(index.values()), np.int64)[order]]


def fit(docs: DataFrame, labels: DataFrame, present: DataFrame, max_train: int = MAX_TRAIN) -> tuple[Model, np.ndarray]:
    """The models, and the shares to begin with: the classes' among the labelled documents, and OTHER. present: the buckets of all documents."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), label_class().alias("class")).where("doc_id IS NOT NULL AND class IS NOT NULL").groupBy("doc_id").agg(F.max("class").alias("class"))
    # At most max_train rows of two numbers: the sample may be broadcast.
    chosen = C.keep(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train), "chosen")
    train = C.text_frame(docs, F.col("lang").cast("string").alias("lang")).join(F.broadcast(chosen), "doc_id")
    train = kept = C.keep(train.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), "class"), "train")
    # At most max_train rows.
    per_language = {(r.lang, r["class"]): r.n for r in train.groupBy("lang", "class").agg(F.count("*").alias("n")).collect()}
    enough = {lang for lang, _ in per_language if lang and all(per_language.get((lang, k), 0) >= (LEAST_DOCS if k == 0 else 1) for k in range(N_CLASSES))}
    train = train.withColumn("lang", F.when(F.col("lang").isin(*enough), F.col("lang")).otherwise("") if enough else F.lit(""))
    seen = _by_class(train.mapInArrow(_document_counts, "lang string, class int, bucket int, n int"), F.col("n")).where(F.col("n0") + F.col("n1") + F.col("n2") >= LEAST_COUNT)
    of_language: dict[str, np.ndarray] = {}
    for (lang, kind), n in per_language.items():
        of_language.setdefault(lang if lang in enough else "", np.zeros(N_CLASSES))[kind] += n
    wanted: dict[str, set[int]] = {}
    # Bounded by the sample, and by BUCKETS for each language.
    for r in seen.collect():
        n, total = np.array(r[2:], float), of_language[r.lang]
        expected = n.sum() * total / total.sum()
        # Laxer than the models' own rule.
        if ((np.abs(np.log((n + 1) / (expected + 1))) > LEAST_RATIO / 1.6) & (np.abs(n - expected) / np.sqrt(expected + 1) > LEAST_SIGMA / 1.6)).any():
            wanted.setdefault(r.lang, set()).add(r.bucket)
    contexts = train.mapInArrow(_context_rows(wanted), "lang string, class int, bucket int, context long").distinct()
    counts: dict[str, dict[int, np.ndarray]] = {}
    totals: dict[str, np.ndarray] = {}
    for r in _by_class(contexts, F.lit(1)).collect():
        if r.bucket == EVERY:
            totals[r.lang] = np.array(r[2:], float)
        elif sum(r[2:]) >= LEAST_COUNT:
            counts.setdefault(r.lang, {})[r.bucket] = np.array(r[2:], float)
    counts = {lang: counts.get(lang, {}) for lang in totals}
    # Languages with too few labelled documents have the counts of all together.
    everything: dict[int, np.ndarray] = {}
    for own in counts.values():
        for b, n in own.items():
            everything[b] = everything.get(b, 0) + n
    if totals:
        totals[""], counts[""] = sum(totals.values()), everything
    C.forget(kept)
    share = np.array([sum(n for (_, kind), n in per_language.items() if kind == k) for k in range(N_CLASSES)], float)
    model = Model(totals, counts)
    if model.of:
        model.add(_raw_ratios(present, chosen, enough))
    return model, np.append((share + 1) / (share + 1).sum() * (1 - OTHER), OTHER)


def kth_largest(df: DataFrame, column: str, k: int, few: int = 10_000, bins: int = 1024) -> float:
    """Exact, by histograms of ever narrower ranges; at most `few` values come to the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        part = df.where((F.col(column) >= low) & (F.col(column) <= high))
        width = (high - low) / bins
        n = part.count()
        if n <= few or not width or low + width == low:
            return sorted((r[0] for r in part.select(column).orderBy(F.desc(column)).limit(max(1, k)).collect()), reverse=True)[k - 1] if n <= few else low
        bin_of = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1))
        counts = {r.b: (r.n, r.lo, r.hi) for r in part.groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(counts, reverse=True):
            if k <= counts[b][0]:
                low, high = counts[b][1:]
                break
            k -= counts[b][0]
        if low == high:
            return low


def importance(docs: DataFrame, labels: DataFrame, floor: float = FLOOR, temperature: float = TEMPERATURE, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, version (hash of the text), log_weight, key (log weight and noise), kept."""
    texts = C.text_frame(docs, F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.xxhash64("text").alias("version"), F.monotonically_increasing_id().alias("row"))
    present = C.keep(texts.mapInArrow(_present, "doc_id long, lang string, version long, row long, buckets binary"), "present", "zstd")
    model, share = fit(docs, labels, present, max_train)
    n = N_CLASSES + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            flat, row = unpack_rows(batch.column(3))
            q = np.zeros((len(langs), n))
            for lang in set(langs.tolist()):
                name = lang if lang in model.of else ""
                buckets, ratio = tables[name] if name in tables else tables.setdefault(name, model.table(name))
                if len(buckets):
                    own = (langs == lang)[row]
                    at = np.minimum(np.searchsorted(buckets, flat[own]), len(buckets) - 1)
                    hit = buckets[at] == flat[own]
                    for k in range(n):
                        q[:, k] += np.bincount(row[own][hit], ratio[at[hit], k], len(langs))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(q[:, k]) for k in range(n))], names=["doc_id", "version", *(f"q{k}" for k in range(n))])

    scored = C.keep(present.select("doc_id", "lang", "version", "buckets").mapInArrow(score, "doc_id long, version long, " + ", ".join(f"q{k} double" for k in range(n))), "scores")
    C.forget(present)

    def log_raw(share: np.ndarray) -> Column:
        terms = [F.col(f"q{k}") + float(np.log(share[k])) for k in range(n)]
        top = F.greatest(*terms)
        return top + F.log(sum((F.exp(t - top) for t in terms[1:]), F.exp(terms[0] - top)))

    if model.of:
        for _ in range(6):
            raw = log_raw(share)
            mean = scored.agg(*(F.avg(F.exp(F.col(f"q{k}") + float(np.log(share[k])) - raw)) for k in range(n))).first()
            if mean[0] is None:
                break
            share, before = np.maximum(np.array(mean), 1e-4), share
            share /= share.sum()
            if np.abs(share - before).max() < 1e-4:
                break
    uniform = (F.pmod(F.xxhash64("doc_id", "version", F.lit(SEED)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    # To six digits, so that the order of additions decides nothing.
    weight = F.round(F.col("q0") - log_raw(share), 6)
    drawn = C.keep(scored.select("doc_id", "version", weight.alias("log_weight"), F.round(weight - temperature * F.log(-F.log(uniform)), 6).alias("key")), "weights")
    C.forget(scored)
    k = drawn.where(F.col("log_weight") >= floor).count() if model.of else drawn.count()
    if not k:
        return drawn.withColumn("kept", F.lit(False))
    return drawn.withColumn("kept", F.col("key") >= kth_largest(drawn, "key", k))


def kept_documents(docs: DataFrame, labels: DataFrame, **how: float) -> DataFrame:
    """The rows of docs, all their columns, that are drawn."""
    out = importance(docs, labels, **how).where("NOT kept").select("doc_id", "version").distinct()
    return C.without(docs, out, F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))

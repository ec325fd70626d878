"""Quality rules by distribution divergence.

Each document has two histograms: of character classes, and of common words (the function words of four languages and one
bin for all other words). Each is held against its language's reference by Jensen-Shannon distance (base 2, from 0 to 1).
Texts too short to have a steady histogram are not judged by it (minimum-length guards).

A reference is a trimmed mean, so that junk does not vouch for itself: first that of the language's documents, over the whole
corpus, that pass the base rules and are long enough; then, TRIMS times, that of those among them that lie within the limits
of the reference before. Shares are summed as whole numbers of 2^-SHARE_BITS, so the order of additions decides nothing.

Edge cases: a null text is empty; texts without words have base_failed true (fewer than 10 words). A null or unknown lang is
held against the reference of all documents without a known one. A language none of whose documents passes has the reference
of all its documents, whatever they are. Repeated rows are judged each for itself. An empty table
gives an empty result. Other columns of the input, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.llm import _common as C

# Function words of each language.
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for was on are as with by be this from at or an".split(),
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas elle avec il".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)
BIN_OF_WORD = {w: i for i, w in enumerate(dict.fromkeys(w for ws in FUNCTION_WORDS.values() for w in ws))}
N_BINS = len(BIN_OF_WORD) + 1
SYMBOLS = b"#*$%&|<>"
PUNCTUATION = b".,;:!?'\"()-"
LOWER, UPPER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER_ASCII, NOT_ASCII, INNER = range(9)
N_CLASSES = 8  # INNER bytes belong to a character that its first byte stands for

WINDOW = 5
#: The distances that a document may have.
MOST_CLASS, MOST_COMMON = 0.3, 0.33
#: Rounds of trimming, and the size of a share of 1.
TRIMS, SHARE_BITS = 2, 30
STATS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<int>, commons array<int>"


def _class_table() -> np.ndarray:
    out = np.full(256, OTHER_ASCII, np.uint8)
    out[97:123], out[65:91], out[48:58] = LOWER, UPPER, DIGIT
    out[list(C.SPACE_BYTES)], out[list(PUNCTUATION)], out[list(SYMBOLS)] = SPACE, PUNCT, SYMBOL
    out[0x80:0xC0], out[0xC0:] = INNER, NOT_ASCII
    return out


def _count_by_row(rows: np.ndarray, bins: np.ndarray, n_rows: int, n_bins: int) -> np.ndarray:
    return np.bincount(rows * n_bins + bins, minlength=n_rows * n_bins).reshape(n_rows, n_bins)


def repeated_words(words: C.Words, hashes: C.Hashes, window: int = WINDOW) -> np.ndarray:
    """For each word whether a window of so many words over it stands twice or more in its text."""
    n = len(words.begin)
    begin = np.flatnonzero(words.room() >= window)
    key = hashes.runs(words.hash, window)[begin] + words.row_of()[begin].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(begin) + 1, bool)
    twice[:-1][order[1:][same]] = True
    twice[:-1][order[:-1][same]] = True
    hits, cover = begin[twice[:-1]], np.zeros(n + 1, np.int64)
    np.add.at(cover, hits, 1)
    np.add.at(cover, hits + window, -1)
    return np.cumsum(cover[:-1]) > 0


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of_word, table = C.Hashes(11), _class_table()
    known = {w: i for w, i in BIN_OF_WORD.items()} | {w.capitalize(): i for w, i in BIN_OF_WORD.items()}
    hashes = C.Words(pa.array(list(known)), of_word).hash
    order = np.argsort(hashes)
    hashes, bins = hashes[order], np.array(list(known.values()))[order]
    for batch in C.chunks(batches):
        ids, column, lang = (batch.column(batch.schema.get_field_index(x)) for x in ("doc_id", "text", "lang"))
        n, words = batch.num_rows, C.Words(column, of_word)
        rows = words.row_of()
        _, ends = C.buffers(column)
        of_byte, kind = np.repeat(np.arange(n), np.diff(ends)), table[words.data]
        outer = kind != INNER
        classes = _count_by_row(of_byte[outer], kind[outer].astype(np.int64), n, N_CLASSES)
        at = np.minimum(np.searchsorted(hashes, words.hash), len(hashes) - 1)
        commons = _count_by_row(rows, np.where(hashes[at] == words.hash, bins[at], N_BINS - 1), n, N_BINS)
        repeats = np.bincount(rows[repeated_words(words, of_word)], minlength=n)
        lines = []
        for text in C.texts(column):
            full = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
            lines.append(len(full) - len(set(full)))
        chars = classes.sum(1) - classes[:, SPACE]
        longs = [np.diff(words.rows), chars, classes[:, SYMBOL], np.array(lines, np.int64), repeats]
        yield pa.RecordBatch.from_arrays(
            [ids, lang.cast(pa.string()), *(pa.array(x.astype(np.int64)) for x in longs), *(pa.FixedSizeListArray.from_arrays(pa.array(x.astype(np.int32).ravel()), x.shape[1]).cast(pa.list_(pa.int32())) for x in (classes, commons))],
            names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "commons"],
        )


def _histograms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Both histograms of each row as shares (rows of zeros where there is nothing to count), and the reference to use."""
    out = []
    for name, width in (("classes", N_CLASSES), ("commons", N_BINS)):
        x = batch.column(batch.schema.get_field_index(name)).flatten().to_numpy().reshape(-1, width).astype(np.float64)
        out.append(x / np.maximum(x.sum(1, keepdims=True), 1))
    lang = batch.column(batch.schema.get_field_index("lang")).to_pylist()
    return out[0], out[1], [x if x in LANGUAGES else "" for x in lang]


def _judged(batch: pa.RecordBatch, reference: dict[tuple[str, int], np.ndarray], guards: tuple[int, int]) -> tuple:
    """Both histograms, references' names, distances (0 without a reference), length guards, and whether the base rules fail."""
    n_chars, n_words, n_repeats = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("word_chars", "n_words", "n_repeat_words"))
    *shares, langs = _histograms(batch)
    langs, far = np.array(langs), [np.zeros(len(langs)), np.zeros(len(langs))]
    for lang in set(langs.tolist()):
        for k, x in enumerate(shares):
            if (lang, k) in reference:
                far[k][langs == lang] = distance(x[langs == lang], reference[lang, k])
    return shares, langs, far, (n_chars < guards[0], n_words < guards[1]), (n_words < 10) | (100 * n_repeats > 20 * n_words)


def _sums(reference: dict[tuple[str, int], np.ndarray], guards: tuple[int, int], limits: tuple[float, float]):
    """Sums of shares by language and histogram: of the documents that count (level 1), and of all (level 0)."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, int, int], np.ndarray] = {}
        for batch in batches:
            shares, langs, far, short, failed = _judged(batch, reference, guards)
            for k, x in enumerate(shares):
                whole = np.rint(x * (1 << SHARE_BITS)).astype(np.int64)
                for level, good in enumerate((x.any(1), ~failed & ~short[k] & (far[k] <= limits[k]))):
                    for lang in set(langs[good].tolist()):
                        mine = whole[good & (langs == lang)]
                        total[lang, k, level] = total.get((lang, k, level), 0) + np.append(mine.sum(0), len(mine))
        rows = [(*key, pos, v) for key, x in total.items() for pos, v in enumerate(x.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(list(zip(*rows)) or [()] * 5, (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["lang", "kind", "level", "pos", "total"])

    return sums


def references(stats: DataFrame, guards: tuple[int, int], limits: tuple[float, float]) -> dict[tuple[str, int], np.ndarray]:
    """The mean shares of each language and histogram (0 classes, 1 common words)."""
    out: dict[tuple[str, int], np.ndarray] = {}
    for _ in range(1 + TRIMS):
        # Five languages at most, of 8 + N_BINS numbers each, twice: a bound that no input changes. Sums as decimals can't overflow.
        sums = stats.select("lang", "n_words", "word_chars", "n_repeat_words", "classes", "commons").mapInArrow(_sums(out, guards, limits), "lang string, kind int, level int, pos int, total long")
        found: dict[tuple[str, int], dict[int, dict[int, int]]] = {}
        for r in sums.groupBy("lang", "kind", "level", "pos").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
            found.setdefault((r.lang, r.kind), {}).setdefault(r.level, {})[r.pos] = int(r.total)
        for key, levels in found.items():
            own = levels.get(1) or levels[0]
            width = (N_CLASSES, N_BINS)[key[1]]
            out[key] = np.array([own[pos] / (own[width] << SHARE_BITS) for pos in range(width)])
    return out


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2

    def against(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(-1)

    return np.sqrt(np.maximum((against(p) + against(np.broadcast_to(q, p.shape))) / 2, 0))


def quality_rules(docs: DataFrame, most_class: float = MOST_CLASS, most_common: float = MOST_COMMON, least_chars: int = 200, least_words: int = 50) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance, common_distance (null under the length guards), kept."""
    stats = C.keep(C.text_frame(docs, F.col("lang").cast("string").alias("lang")).mapInArrow(_measure, STATS), "quality-stats")
    guards, limits = (least_chars, least_words), (most_class, most_common)
    reference = references(stats, guards, limits)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        for batch in batches:
            _, _, far, short, failed = _judged(batch, reference, guards)
            kept = ~failed & (short[0] | (far[0] <= most_class)) & (short[1] | (far[1] <= most_common))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in names), pa.array(failed), *(pa.array(x, mask=g) for x, g in zip(far, short)), pa.array(kept)], names=[*names, "base_failed", "class_distance", "common_distance", "kept"])

    return stats.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, common_distance double, kept boolean")

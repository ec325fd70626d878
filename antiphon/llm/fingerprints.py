"""Document fingerprints: bottom-k sketches of five-word shingles, by DataFrame functions only.

A sketch is the k least distinct 64-bit hashes (the first 16 hexadecimal digits of MD5) of a text's shingles, ascending; any
engine can make it, so sketches of different systems compare. Sketches of parts merge: that of a
union is the k least of its parts' sketches. The share of a union's k least hashes that both sketches hold estimates
resemblance, the share of those of one that the other holds too estimates containment, and the k-th least hash tells the
number of distinct shingles. Texts of up to k + 4 words are compared exactly.

Words are maximal runs of anything but the six ASCII white-space characters, unchanged. A text of fewer than five words has one
shingle, all of it; one without words has none and an empty sketch, equal to another such (1) and unlike all others (0).

Edge cases: a null text is empty. A null doc_id comes after all others. Rows of one doc_id are documents of their own, in the
order of their texts' hashes; repeated rows follow each other. A single row is its own next. An empty table gives an empty
result. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from antiphon.llm import _common as C

WORDS_OF_SHINGLE = 5
#: Digits of a hash.
DIGITS = 16
#: Hashes of a sketch: an estimate of resemblance errs by 0.06 (one standard error) at most.
K = 64
_SPACE = " \t\n\x0b\x0c\r"
_LAST = 2**63 - 1
#: Spans of ids for each shuffle partition, and spans at most.
SPANS_EACH, MOST_SPANS = 4, 1 << 16


def words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed != "", F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words_of_text: Column) -> Column:
    """One hash for each shingle: of its words with a blank between."""
    n = F.size(words_of_text)
    hashes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - (WORDS_OF_SHINGLE - 1))), lambda i: F.left(F.md5(F.array_join(F.slice(words_of_text, i, WORDS_OF_SHINGLE), " ")), F.lit(DIGITS)))
    return F.when(n > 0, hashes).otherwise(F.array().cast("array<string>"))


def least(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, sketch: str, k: int = K) -> DataFrame:
    """df with the sketch of a text column. The words get a column of their own for a while, so that they're cut once."""
    cut = C.free_name(df, "words")
    return df.withColumn(cut, words(F.col(text))).withColumn(sketch, least(shingle_hashes(F.col(cut)), k)).drop(cut)


def merged(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """The sketch of each group's union. Every task first keeps the k least of what it has, so that a hot group costs no more than others."""
    hashes = parts.select(*by, F.explode(sketch).alias("hash")).distinct()
    ranked = hashes.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where(F.col("place") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(sketch))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = least(F.concat(a, b), k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) > 0, both / F.size(union)).otherwise(F.lit(1.0))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """How much of a is in b. Null if none of the union's least hashes is of a, which leaves nothing to estimate by."""
    of_a = F.array_intersect(least(F.concat(a, b), k), a)
    return F.when(F.size(a) == 0, F.lit(1.0)).when(F.size(of_a) > 0, F.size(F.array_intersect(of_a, b)) / F.size(of_a))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact below k; else k - 1 over the k-th least hash as a share of all (13 digits, which a double holds)."""
    share = F.conv(F.left(F.element_at(sketch, -1), F.lit(13)), 16, 10).cast("double") / 2.0**52
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def as_text(sketch: Column) -> Column:
    return F.array_join(sketch, "")


def _longs(values: list[int]) -> Column:
    """An array that is one literal once the constants are folded."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _span(key: Column, starts: list[int]) -> Column:
    """The last of the ascending starts that is at most the key, by place (binary search)."""
    steps = [1 << i for i in reversed(range(max(1, (len(starts) - 1).bit_length())))]
    table = _longs(starts)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(F.get(table, at + step) <= key, at + step).otherwise(at))


def _starts(keys: DataFrame, n: int) -> list[int]:
    """The first keys of up to n spans of about as many rows each: quantiles first, then the least key that is there in each span."""
    if n > 1:
        found = keys.agg(F.percentile_approx("key", [i / n for i in range(n)], max(10_000, 20 * n))).first()[0] or []
        cuts = sorted(set(map(int, found)))
        return sorted(r[1] for r in keys.groupBy(_span(F.col("key"), cuts).alias("span")).agg(F.min("key")).collect()) if cuts else []
    return [r for r in keys.agg(F.min("key")).first() if r is not None]


def neighbours(docs: DataFrame, spans: int | None = None) -> DataFrame:
    """doc_id, text, sketch, next_text, next_sketch: the next document is the one after it in ascending doc_id, after the last the first.

    Rows are dealt by span of ids, and the first row of each span goes to the span before it as well, as a guest; so one exchange
    of the texts gives every row its next one.
    """
    spark = docs.sparkSession
    rows = C.text_frame(docs).withColumn("key", F.coalesce("doc_id", F.lit(_LAST)))
    n = spans or min(MOST_SPANS, SPANS_EACH * int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = _starts(rows.select("key"), n) or [0]
    at = _span(F.col("key"), starts)
    own, guest = F.struct(F.col("at").alias("span"), F.lit(False).alias("guest")), F.struct(F.pmod(F.col("at") - 1, F.lit(len(starts))).alias("span"), F.lit(True).alias("guest"))
    first = F.col("key") == F.get(_longs(starts), F.col("at"))
    dealt = rows.withColumn("at", at).withColumn("place", F.explode(F.when(first, F.array(own, guest)).otherwise(F.array(own))))
    dealt = with_sketch(dealt.select("doc_id", "key", "text", "place.span", "place.guest").repartition("span"), "text", "sketch")
    order = Window.partitionBy("span").orderBy("guest", "key", F.xxhash64("text"))
    return dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).where(~F.col("guest")).select("doc_id", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, spans: int | None = None) -> DataFrame:
    """Each document's fingerprint, and that of its edited text, whose second half is the beginning of the next document."""
    rows = neighbours(docs, spans).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))).drop("text", "next_text")
    rows = with_sketch(rows, "edited", "edited_sketch")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
        distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )

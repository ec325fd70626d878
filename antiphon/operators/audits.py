"""Audits as tables of problems (no rows: nothing is wrong), reports, unions with provenance."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from antiphon.functions import text as T
from antiphon.operators.ranks import numbered, placed


def markdown(df: DataFrame, title: str, order: str) -> DataFrame:
    """report: a table of few rows (an aggregate) as one text, ordered by a column."""
    cells = lambda values: F.concat(F.lit("| "), F.array_join(F.array(*values), " | "), F.lit(" |"))
    line = cells([F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns])
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n| {' | '.join('---' for _ in df.columns)} |"
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))).alias("rows"))
    return rows.select(F.concat_ws("\n", F.lit(head), F.transform("rows", lambda r: r["line"])).alias("report"))


def reconciled(sources: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """key, problems: which sources lack a key or have it twice, and whether any two differ in a column (nulls equal each other). One shuffle of all sources."""
    names = list(sources)
    rows = [df.select(key, F.lit(n).alias("_from"), F.struct(*columns).alias("_row")) for n, df in sources.items()]
    own = lambda n: F.col("_from") == n
    counts = [F.count_if(own(n)).alias(f"_n{i}") for i, n in enumerate(names)]
    all_rows = functools.reduce(DataFrame.unionByName, rows).groupBy(key).agg(*counts, F.count_distinct(F.xxhash64("_row")).alias("_d"))
    problems = [F.when(F.col(f"_n{i}") == 0, f"missing in {n}").when(F.col(f"_n{i}") > 1, f"repeated in {n}") for i, n in enumerate(names)]
    return all_rows.select(key, F.array_compact(F.array(*problems, F.when(F.col("_d") > 1, "different"))).alias("problems"))


def lost(old: DataFrame, new: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """Rows of old that passed and whose counterpart doesn't."""
    now = new.select(*keys, F.col(passed).alias("_now"))
    return old.where(passed).join(now, keys).where(~F.col("_now")).drop("_now")


def capped(pairs: DataFrame, key: str) -> DataFrame:
    """key, accepted, capped_positive, capped_negative, capped_pairs from boolean columns pos and neg."""
    return pairs.groupBy(key).agg(F.count("*").alias("accepted"), F.count_if("pos").alias("capped_positive"), F.count_if("neg").alias("capped_negative"), F.count_if(F.col("pos") | F.col("neg")).alias("capped_pairs"))


def canonical_fingerprint(df: DataFrame, order: str) -> DataFrame:
    """fingerprint: SHA-256 of the JSON list of a small table's rows (numbers and plain text), in order, with a blank after each comma and colon."""
    kinds = dict(df.dtypes)
    value = lambda c: F.to_json(F.array(F.col(c))) if kinds[c] == "string" else F.col(c).cast("string")
    text = lambda c: F.substring(value(c), 2, 1 << 30) if kinds[c] == "string" else value(c)
    bare = lambda c: F.regexp_replace(text(c), r"\]\z", "") if kinds[c] == "string" else text(c)
    row = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{c}": '), bare(c)) for c in sorted(df.columns))), F.lit("}"))
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), row.alias("row")))).alias("rows"))
    return rows.select(F.sha2(F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: r["row"]), ", "), F.lit("]")), 256).alias("fingerprint"))


def merkle_fingerprint(df: DataFrame, row: Column, order: list[str], fan: int = 256) -> DataFrame:
    """fingerprint, n: the root of a hash tree over the rows' texts in their order, `fan` neighbours under each node; null for an empty table.

    Whatever the partitioning, it's the same, and no task holds more than `fan` hashes of a level. Rows equal in order must be equal in text.
    """
    kept = placed(df.select(F.sha2(F.concat(F.lit("0:"), row), 256).alias("hash"), *order), order, "merkle-leaves")
    level = numbered(kept).select((F.col("rank") - 1).alias("at"), "hash")
    n = left = kept.count()
    while left > 1:
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda x: x["hash"]), "")
        level = level.groupBy(F.floor(F.col("at") / fan).alias("at")).agg(F.sha2(F.concat(F.lit("1:"), children), 256).alias("hash"))
        left = -(-left // fan)
    return level.agg(F.max("hash").alias("fingerprint")).withColumn("n", F.lit(n).cast("long"))


def tensor_problems(tensors: DataFrame, shards: DataFrame, index: DataFrame, widths: dict[str, int]) -> DataFrame:
    """shard, tensor (null for a whole shard), problem, from an inventory of tensor headers.

    tensors: shard, tensor, dtype, shape, begin, end. shards: shard, header_bytes, tensor_bytes, file_bytes, header_sha256. index: tensor, shard, as
    declared. A tensor's span is as long as its shape and type say, spans cover a shard's values without a gap or an overlap, a
    shard's sums agree with its file, its header's checksum is one, and index and headers name the same tensors in the same shards.
    Spans are ordered by shard, so a shard is one task's work: a header has as many tensors as fit into one.
    """
    width = F.create_map(*(F.lit(x) for pair in widths.items() for x in pair))
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x) * F.try_element_at(width, F.col("dtype"))
    before = F.lag("end", 1, 0).over(W.partitionBy("shard").orderBy("begin", "end", "tensor"))
    spans = tensors.select("shard", "tensor", F.filter(F.array(
        F.when(F.try_element_at(width, F.col("dtype")).isNull(), "unknown type"), F.when(F.exists("shape", lambda x: x < 0), "negative shape"),
        F.when(size != F.col("end") - F.col("begin"), "span and shape differ"), F.when(F.col("begin") > before, "gap before it").when(F.col("begin") < before, "overlap"),
    ), lambda x: x.isNotNull()).alias("problems"))
    totals = tensors.groupBy("shard").agg(F.max("end").alias("last"), F.sum(F.col("end") - F.col("begin")).alias("sum"))
    sums = shards.join(totals, "shard", "full_outer")
    whole = sums.select("shard", F.lit(None).cast("string").alias("tensor"), F.array_compact(F.array(
        F.when(F.col("header_bytes").isNull(), "no such shard"), F.when(F.coalesce("sum", F.lit(0)) != F.col("tensor_bytes"), "tensor bytes differ"),
        F.when(F.coalesce("last", F.lit(0)) < F.col("tensor_bytes"), "values after the last tensor"), F.when(F.col("header_bytes") < 10, "no header"),
        F.when(F.col("file_bytes") != F.col("tensor_bytes") + F.col("header_bytes"), "file bytes differ"), F.when(~F.coalesce(F.col("header_sha256").rlike(r"\A[0-9a-f]{64}\z"), F.lit(False)) & F.col("header_bytes").isNotNull(), "no checksum"),
    )).alias("problems"))
    own, told = tensors.select("tensor", F.col("shard").alias("own")), index.select("tensor", F.col("shard").alias("told"))
    named = own.join(told, "tensor", "full_outer").select(F.coalesce("own", "told").alias("shard"), "tensor", F.array_compact(F.array(
        F.when(F.col("told").isNull(), "not in the index").when(F.col("own").isNull(), "not in its shard").when(F.col("own") != F.col("told"), "in another shard"),
    )).alias("problems"))
    return functools.reduce(DataFrame.unionByName, [spans, whole, named]).select("shard", "tensor", F.explode("problems").alias("problem"))


def conversion_problems(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """tensor, problem: changes from one inventory (tensor, dtype, shape, bytes) to another that aren't exactly those expected (tensor, shape, old, new: types; reduction in bytes)."""
    a, b = before.select("tensor", F.struct("dtype", "shape", "bytes").alias("a")), after.select("tensor", F.struct("dtype", "shape", "bytes").alias("b"))
    both = a.join(b, "tensor", "full_outer").join(expected.select("tensor", F.struct(F.col("shape"), "old", "new", "reduction").alias("e")), "tensor", "full_outer")
    right = (F.col("a.dtype") == F.col("e.old")) & (F.col("b.dtype") == F.col("e.new")) & (F.col("a.shape") == F.col("e.shape")) & (F.col("b.shape") == F.col("e.shape")) & (F.col("a.bytes") - F.col("b.bytes") == F.col("e.reduction"))
    problem = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "expected tensor is missing").when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed")
        .when(F.col("e").isNull() & (F.col("a") != F.col("b")), "unexpected change").when(F.col("e").isNotNull() & (F.col("a") == F.col("b")), "expected change is missing")
        .when(F.col("e").isNotNull() & ~right, "another change than expected")
    )
    return both.select("tensor", problem.alias("problem")).where("problem IS NOT NULL")


def covers(ranges: DataFrame, key: str, begin: str, end: str, start: int) -> DataFrame:
    """key, covers, last: whether a key's ranges, in order, cover all from the start without a gap or an overlap, and where they end."""
    before = F.lag(end, 1, start).over(W.partitionBy(key).orderBy(begin, end))
    return ranges.withColumn("_before", before).groupBy(key).agg(F.bool_and(F.col(begin) == F.col("_before")).alias("covers"), F.max(end).alias("last"))


def united(sets: dict[str, DataFrame], name: str) -> DataFrame:
    """All rows of tables with the same columns (in any order), with the table's name."""
    return functools.reduce(DataFrame.unionByName, [df.withColumn(name, F.lit(n)) for n, df in sets.items()])


def resume(planned: DataFrame, saved: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """key, state: done, run, or mismatch (saved under other settings, which must stop a run). Of several saved rows of a key any other fingerprint, or none, is a mismatch."""
    own = saved.groupBy(key).agg(F.bool_and(F.coalesce(F.col("fingerprint") == fingerprint, F.lit(False))).alias("_same"))
    return planned.join(own, key, "left").select(key, F.when(F.col("_same").isNull(), "run").when(F.col("_same"), "done").otherwise("mismatch").alias("state"))


def count_rules(rules: list[tuple[str, int, DataFrame]]) -> DataFrame:
    """rule, expected, found, holds, from tables of one number `found`."""
    rows = [df.select(F.lit(n).alias("rule"), F.lit(e).cast("long").alias("expected"), "found").withColumn("holds", F.col("found") == e) for n, e, df in rules]
    return functools.reduce(DataFrame.unionByName, rows)


def manifest_problems(declared: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """key, problem: missing, size, hash or unlisted, from columns bytes and sha256."""
    a, b = declared.select(key, F.struct("bytes", "sha256").alias("a")), found.select(key, F.struct("bytes", "sha256").alias("b"))
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "unlisted").when(~F.col("a.bytes").eqNullSafe(F.col("b.bytes")), "size").when(~F.col("a.sha256").eqNullSafe(F.col("b.sha256")), "hash")
    return a.join(b, key, "full_outer").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def total_problems(declared: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, declared, found where they differ, or where a key isn't declared."""
    long = lambda df, name: df.select(key, F.inline(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias(name)) for f in fields))))
    both = long(found, "found").join(long(declared, "declared"), [key, "field"], "full_outer")
    return both.where(~F.col("declared").eqNullSafe(F.col("found"))).select(key, "field", "declared", "found")


def _told(df: DataFrame, name: str) -> DataFrame:
    """id, the row, and how many rows the id has."""
    return df.groupBy("id").agg(F.max(F.struct(*(c for c in df.columns if c != "id"))).alias(name), F.count("*").alias(f"n_{name}"))


def json_list(texts: Column) -> Column:
    """A list of texts as JSON, with a blank after each comma."""
    one = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)\A\[(.*)\]\z", 1)
    return F.concat(F.lit("["), F.array_join(F.transform(texts, one), ", "), F.lit("]"))


def result_problems(inputs: DataFrame, records: DataFrame, rows: DataFrame, budget: int, method: str) -> DataFrame:
    """id, problem: everything that is wrong with final results, by record.

    inputs: id, instruction, category. records: also instruction_sha256, status, method, max_new_tokens, generated_tokens, finish_reason, response, empty,
    heuristic_refusal, refusal_matches (a list). rows: what the CSV says of an id, as text, under any of those names. An input
    needs one record and one row; both must repeat it; flags, status, token counts and finish reasons must agree with each other
    and with the budget; and each field of a row must be the record's, nulls and booleans as a CSV writes them.
    """
    both = _told(inputs, "i").join(_told(records, "r"), "id", "full_outer").join(_told(rows, "c"), "id", "full_outer")
    r, i = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"i.{c}"))
    kinds = dict(records.dtypes)

    def as_csv(c: str) -> Column:
        if kinds[c] == "boolean":
            return F.coalesce(F.when(r(c), "true").when(~r(c), "false"), F.lit(""))
        return F.coalesce(json_list(r(c)) if kinds[c].startswith("array") else r(c).cast("string"), F.lit(""))

    no = lambda holds, problem: F.when(~F.coalesce(holds, F.lit(False)), problem)
    here, tokens = F.col("r").isNotNull() & F.col("i").isNotNull(), r("generated_tokens")
    of_record = [
        no(r("instruction") == i("instruction"), "instruction changed"), no(r("category").eqNullSafe(i("category")), "category changed"), no(r("instruction_sha256") == F.sha2(i("instruction"), 256), "instruction checksum"),
        no(r("status").isin("completed", "empty"), "not completed"), no(r("method") == method, "another method"), no(r("max_new_tokens") == budget, "another budget"), no(tokens.between(1, budget), "token count"), no(r("finish_reason").isin("eos", "length"), "finish reason"),
        no((r("finish_reason") != "length") | (tokens == budget), "length stop below the budget"), no(r("response").isNotNull(), "no response"), no(r("empty") == (T.strip(r("response")) == ""), "empty flag"), no((r("status") == "empty") == r("empty"), "status and empty flag"),
        no(F.forall(r("refusal_matches"), lambda x: x.isNotNull()), "refusal matches"),
    ]
    of_row = [no(F.col(f"c.{c}") == as_csv(c), f"CSV differs in {c}") for c in rows.columns if c in kinds and c != "id"]
    found = F.concat(
        F.array_compact(F.array(
            F.when(F.col("n_i").isNull(), "not an input").when(F.col("n_i") > 1, "input repeated"), F.when(F.col("n_r").isNull(), "no record").when(F.col("n_r") > 1, "record repeated"), F.when(F.col("n_c").isNull(), "no row").when(F.col("n_c") > 1, "row repeated"),
        )),
        F.when(here, F.array_compact(F.array(*of_record))).otherwise(F.array().cast("array<string>")), F.when(F.col("r").isNotNull() & F.col("c").isNotNull(), F.array_compact(F.array(*of_row))).otherwise(F.array().cast("array<string>")),
    )
    return both.select("id", F.explode(found).alias("problem"))


def summary_problems(records: DataFrame, declared: DataFrame) -> DataFrame:
    """field, declared, found where a summary's one row (count, heuristic_refusals, empty_outputs, degenerate_outputs, heuristic_refusal_rate) differs from what the records give."""
    found = records.agg(F.count("*").alias("count"), F.count_if("heuristic_refusal").alias("heuristic_refusals"), F.count_if("empty").alias("empty_outputs"), F.count_if("degenerate").alias("degenerate_outputs"))
    found = found.withColumn("heuristic_refusal_rate", F.try_divide("heuristic_refusals", "count"))
    long = lambda df, name: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("double").alias(name)) for c in found.columns))))
    return long(found, "found").join(long(declared, "declared"), "field").where(~F.col("found").eqNullSafe(F.col("declared"))).select("field", "declared", "found")


def failed_rules(measures: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """keys, rule: a row for each rule that a row of measures fails; an unknown (null) measure fails."""
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), name) for name, holds in rules.items())))
    return measures.select(*keys, F.explode(failed).alias("rule"))


def change_problems(before: DataFrame, after: DataFrame, key: str, value: str, expected: DataFrame) -> DataFrame:
    """key, problem: changes of a value that aren't expected, and expected ones that aren't there."""
    rows = before.select(key, F.col(value).alias("_a")).join(after.select(key, F.col(value).alias("_b")), key, "full_outer").join(expected.select(key, F.lit(True).alias("_e")), key, "left")
    changed, wanted = ~F.col("_a").eqNullSafe(F.col("_b")), F.col("_e").isNotNull()
    return rows.select(key, F.when(changed & ~wanted, "unexpected change").when(~changed & wanted, "expected change is missing").alias("problem")).where("problem IS NOT NULL")


def batch_provenance(receipts: DataFrame, records: DataFrame, key: str, batch: list[str], told: str) -> DataFrame:
    """batch, listed, unlisted, elsewhere, holds: a batch's records that its receipt lists or doesn't, and listed ones that tell of another batch."""
    both = records.join(receipts.select(key, *batch, F.lit(True).alias("_listed")), [key, *batch], "left")
    listed, moved = F.col("_listed").isNotNull(), F.col(told) != F.col(batch[-1])
    out = both.groupBy(*batch).agg(F.count_if(listed).alias("listed"), F.count_if(~listed).alias("unlisted"), F.count_if(listed & moved).alias("elsewhere"), F.count_if(moved).alias("_moved"))
    return out.withColumn("holds", (F.col("unlisted") == 0) & (F.col("_moved") == 0)).drop("_moved")


def allowlist_problems(found: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    extra = found.join(allowed, key, "left_anti").select(key, F.lit("not allowed").alias("problem"))
    return extra.union(allowed.join(found, key, "left_anti").select(key, F.lit("missing")))


def blocks(df: DataFrame, text: str, size: int) -> DataFrame:
    """All other columns, block, at, bytes (characters), sha: a row for each block of a text."""
    others = [c for c in df.columns if c != text]
    at = F.sequence(F.lit(0), F.floor((F.length(text) - 1) / size).cast("int"))
    cut = df.where(F.length(text) > 0).select(*others, text, F.explode(at).alias("_i")).withColumn("_part", F.substring(F.col(text), F.col("_i") * size + 1, F.lit(size)))
    return cut.select(*others, F.col("_i").cast("long").alias("block"), (F.col("_i").cast("long") * size).alias("at"), F.length("_part").cast("long").alias("bytes"), F.sha2("_part", 256).alias("sha"))


def repair_plan(declared: DataFrame, local: DataFrame, keys: list[str]) -> DataFrame:
    """Declared blocks that are missing locally or differ."""
    own = local.select(*keys, F.col("sha").alias("_own"))
    return declared.join(own, keys, "left").where(~F.col("sha").eqNullSafe(F.col("_own"))).drop("_own")


def stale(now: DataFrame, stored: DataFrame) -> DataFrame:
    """All columns and status: rows that only one side has, as often as it has more of them."""
    return now.exceptAll(stored).withColumn("status", F.lit("only regenerated")).unionByName(stored.exceptAll(now).withColumn("status", F.lit("only stored")))

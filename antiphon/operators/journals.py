"""Append-only judgment journals: eligibility, states, attempts, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from antiphon.functions import text as T

ATTEMPT = "status string, http_status int, error_type string"

#: An answer of the scoring service.
PAYLOAD = Ty.StructType([
    Ty.StructField("error", Ty.StringType()),
    Ty.StructField("provider", Ty.StringType()),
    Ty.StructField("model", Ty.StringType()),
    Ty.StructField("usage", Ty.StructType([Ty.StructField("cost", Ty.DoubleType())])),
    Ty.StructField("choices", Ty.ArrayType(Ty.StructType([
        Ty.StructField("finish_reason", Ty.StringType()),
        Ty.StructField("message", Ty.StructType([Ty.StructField("content", Ty.StringType()), Ty.StructField("refusal", Ty.StringType())])),
    ]))),
])


def original_attempts(attempts: Column, n_original: Column) -> Column:
    return F.slice(attempts, F.lit(1), F.coalesce(n_original, F.size(attempts)))


def eligible(score: Column, attempts: Column) -> Column:
    """No score after exactly three attempts that all were turned away for their rate (429)."""
    refused = F.forall(attempts, lambda a: F.coalesce((a["status"] == "judge_error") & (a["http_status"] == 429) & (a["error_type"] == "HTTPError"), F.lit(False)))
    return score.isNull() & (F.size(attempts) == 3) & refused


def state(score: Column, attempts: Column) -> Column:
    """Exactly one of: missing, valid, in_progress, eligible, other."""
    last = F.try_element_at(attempts, F.lit(-1))
    return F.when(attempts.isNull(), "missing").when(F.coalesce(score.between(0, 100), F.lit(False)), "valid").when(F.coalesce(last["status"] == "request_started", F.lit(False)), "in_progress").when(eligible(score, attempts), "eligible").otherwise("other")


def retry_budget(n: Column, last: Column, score: Column, most: int = 3) -> tuple[Column, Column]:
    """Attempts left (a started one is spent), and the seconds before the next: 2 to the attempts so far, 8 at most; null where there is none."""
    more = score.isNull() & (n < most) & (last != "request_started")
    return F.greatest(most - n, F.lit(0)), F.when(more, F.least(F.pow(F.lit(2.0), n), F.lit(8.0)))


#: Recovery: tries after the first three, and the seconds before the second and the third.
MOST_RECOVERIES, BACKOFF = 3, (2, 4)


def recovery(attempts: Column) -> tuple[Column, Column]:
    """State of a journal's recovery, and the seconds before its next try.

    not eligible: the first three attempts aren't three errors. Then, by what was added: invalid (more than three), blocked
    (the last was started and never ended), scored, ended (an error other than 429), exhausted, retry.
    """
    first, added = F.slice(attempts, 1, 3), F.size(attempts) - 3
    last = F.try_element_at(attempts, F.lit(-1))
    eligible = (F.size(attempts) >= 3) & F.forall(first, lambda a: a["status"] == "judge_error")
    by_last = (
        F.when(added > MOST_RECOVERIES, "invalid").when(added == 0, "retry").when(last["status"] == "request_started", "blocked").when(last["status"] == "complete", "scored")
        .when(last["http_status"] != 429, "ended").when(added == MOST_RECOVERIES, "exhausted").otherwise("retry")
    )
    state = F.when(~eligible, "not eligible").otherwise(by_last)
    return state, F.when((state == "retry") & (added > 0), F.get(F.array(*map(F.lit, BACKOFF)), added - 1))


def triage(payload: Column) -> tuple[Column, Column]:
    """Score and error code of a service's answer; the first rule that fits decides."""
    first = F.try_element_at(payload["choices"], F.lit(1))
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    reason, content = first["finish_reason"], first["message"]["content"]
    score = T.parse_score(content)
    error = (
        F.when(filled(payload["error"]), "http_or_api_error").when(filled(first["message"]["refusal"]), "judge_refusal").when(reason == "length", "judge_token_limit_truncation")
        .when(reason.isin("content_filter", "error"), "content_filter_or_safety_block").when(~filled(content), "empty_judge_content").when(score.isNull(), "malformed_or_out_of_range_score")
    )
    return F.when(error.isNull(), score), error


def inventory_difference(declared: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: same, missing, extra or different. Nulls equal each other."""
    a, b = declared.select(F.col(key).alias("_a"), F.col(value).alias("_x")), found.select(F.col(key).alias("_b"), F.col(value).alias("_y"))
    status = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_x").eqNullSafe(F.col("_y")), "same").otherwise("different")
    return a.join(b, F.col("_a") == F.col("_b"), "full_outer").select(F.coalesce("_a", "_b").alias(key), status.alias("status"))


def fingerprint(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """One hash of a table's rows, whatever their order: each part (by the first digits of a row's hash) is hashed in order, then the parts' hashes. With four digits there are 65,536 parts, so an order over the whole table is never needed, and the last step's size is fixed; more digits make smaller parts."""
    row = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns)), 256).alias("h")
    per_part = df.select(row).groupBy(F.substring("h", 1, digits).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"))
    return per_part.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p", "h"))), lambda x: x["h"]), ""), 256).alias("fingerprint"))

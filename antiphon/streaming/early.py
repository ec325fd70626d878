"""Cancellations that come before what they cancel, as a join of two streams: what waits for a partner is let go of by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from antiphon.streaming.timers import REMEMBERED


def early_cancellations(begins: DataFrame, cancels: DataFrame, remembered: float = REMEMBERED, late: str = "10 seconds") -> DataFrame:
    """request, ts, outcome of each beginning (request, ts): "cancelled early" if the request was cancelled (request, ts) so many seconds before it or less, else "begun".

    A left outer join by request and time. A beginning without a cancellation comes out once event time has passed it, when none
    can come any more; a cancellation that no beginning follows is forgotten when it's too old. A beginning that several
    cancellations fit comes out once. All of it is state of a request, spread over all tasks.
    """
    own = begins.withWatermark("ts", late).select("request", "ts")
    said = cancels.withWatermark("ts", late).select(F.col("request").alias("_request"), F.col("ts").alias("_ts"))
    window = (F.col("_request") == F.col("request")) & (F.col("_ts") <= F.col("ts")) & (F.col("_ts") >= F.col("ts") - F.expr(f"INTERVAL {int(remembered)} SECONDS"))
    joined = own.join(said, window, "leftOuter").select("request", "ts", F.when(F.col("_request").isNotNull(), "cancelled early").otherwise("begun").alias("outcome"))
    return joined.dropDuplicates(["request", "ts"])

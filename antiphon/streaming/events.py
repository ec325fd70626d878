"""Server-sent events: encoding, and decoding of streams cut at any byte; event-time counts."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Fixed value: what ends a frame.
_BOUNDARY = re.compile(r"\r\n\r\n|\n\n|\r\r")


def encode(event: str, data: dict) -> str:
    return f"event: {event}\ndata: {json.dumps(data, ensure_ascii=False, separators=(',', ':'))}\n\n"


def _frame(text: str) -> tuple[str, str] | None:
    """Event and data of a frame; None for comments alone."""
    name, data = "message", []
    for line in re.split(r"\r\n|\n|\r", text):
        field, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if field == "event":
            name = value
        elif field == "data":
            data.append(value)
    return (name, "\n".join(data)) if data else None


class Decoder:
    """Frames of a byte stream. A character or a boundary may be cut between chunks."""

    def __init__(self, text: str = "", pending: bytes = b""):
        self.text, self.bytes = text, codecs.getincrementaldecoder("utf-8")("replace")
        self.bytes.setstate((pending, 0))

    def state(self) -> tuple[str, bytes]:
        """What another Decoder goes on from."""
        return self.text, self.bytes.getstate()[0]

    def feed(self, chunk: bytes, final: bool = False) -> Iterator[tuple[str, str]]:
        self.text += self.bytes.decode(chunk, final)
        while True:
            found = _BOUNDARY.search(self.text)
            # A "\r" at the end may be half of a boundary.
            if not found or (not final and found.end() == len(self.text) and found.group() == "\r\r"):
                break
            frame, self.text = self.text[: found.start()], self.text[found.end() :]
            if out := _frame(frame):
                yield out
        if final and self.text.strip("\r\n"):
            if out := _frame(self.text):
                yield out
            self.text = ""


def decode(chunks: Iterable[bytes]) -> Iterator[tuple[str, str]]:
    """All events; raises InterruptedError if the stream ends without a "done" or an "error"."""
    decoder, last = Decoder(), None
    for chunk in chunks:
        for event in decoder.feed(chunk):
            last = event[0]
            yield event
    for event in decoder.feed(b"", final=True):
        last = event[0]
        yield event
    if last not in ("done", "error"):
        raise InterruptedError("the stream ended early")


def frames_stream(chunks: DataFrame) -> DataFrame:
    """From a stream of request_id, seq, chunk (bytes), last: request_id, event, data of every frame, and an event "interrupted" where the last chunk ends without a "done" or an "error"."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text, pending, last = state.get if state.exists else ("", b"", "")
        decoder, out = Decoder(text, bytes(pending)), []
        rows = pd.concat(list(batches)).sort_values("seq")
        over = False
        for chunk, final in zip(rows["chunk"], rows["last"]):
            for event, data in decoder.feed(bytes(chunk), final=bool(final)):
                last = event
                out.append((key[0], event, data))
            over = over or bool(final)
        if over and last not in ("done", "error"):
            out.append((key[0], "interrupted", ""))
        state.update((*decoder.state(), last))
        yield pd.DataFrame(out, columns=["request_id", "event", "data"])

    return chunks.groupBy("request_id").applyInPandasWithState(step, "request_id string, event string, data string", "text string, pending binary, last string", "append", GroupStateTimeout.NoTimeout)


def replies(events: DataFrame) -> DataFrame:
    """From request_id, seq, event, data: the reply's text in order, how it ended, and the number of tokens."""
    log = F.array_sort(F.collect_list(F.struct("seq", "event", "data")))
    tokens = F.filter("log", lambda e: e["event"] == "token")
    out = events.groupBy("request_id").agg(log.alias("log"))
    ended = F.element_at("log", -1)["event"]
    return out.select("request_id", F.array_join(F.transform(tokens, lambda e: e["data"]), "").alias("text"), F.when(ended.isin("done", "error"), ended).otherwise("interrupted").alias("ending"), F.size(tokens).alias("tokens"))


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Arrivals of each client by hour of event time, on a stream or a table; what is later than the watermark is left out of a stream. (An extension: the exact limits need the state machine of admission.)"""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 hour").alias("hour"), "user_id").agg(F.count("*").alias("n")).select("hour.start", "user_id", "n")

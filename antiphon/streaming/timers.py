"""Streams with timers: leases and deadlines that run out by themselves, cancellations that come before their request, live repetition."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Seconds of a generation and of a request, and how long and how many early cancellations are remembered.
GENERATION, REQUEST, REMEMBERED, MOST_REMEMBERED = 300.0, 1800.0, 1860.0, 128


def deadlines(events: DataFrame, seconds: float = REQUEST, late: str = "0 seconds") -> DataFrame:
    """From a stream of request, ts, what (begin or end): request, ending: ended, or timeout once event time has passed a request's deadline without an end.

    An event-time timer for each open request, kept in its state; nothing needs to arrive for that request to run out.
    """
    timed = events.withWatermark("ts", late)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"request": [key[0]], "ending": ["timeout"]})
            return
        rows = pd.concat(list(frames)).sort_values("ts")
        for what, ts in zip(rows["what"], rows["ts"]):
            until = state.get[0] if state.exists else None
            if what == "begin" and until is None:
                until = int((ts.timestamp() + seconds) * 1000)
                state.update((until,))
            elif what == "end" and until is not None:
                state.remove()
                yield pd.DataFrame({"request": [key[0]], "ending": ["ended" if ts.timestamp() * 1000 < until else "timeout"]})
        if state.exists:
            state.setTimeoutTimestamp(max(state.get[0], state.getCurrentWatermarkMs() + 1))

    return timed.groupBy("request").applyInPandasWithState(step, "request string, ending string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


class Cancellations:
    """Requests to stop, which may come before what they stop. Early ones are remembered for a while, and not more than so many."""

    def __init__(self, state: dict | None = None):
        state = state or {"early": {}, "running": []}
        self.early: dict[str, float] = dict(state["early"])
        self.running = set(state["running"])

    def state(self) -> dict:
        return {"early": self.early, "running": sorted(self.running)}

    def take(self, now: float, request: str, what: str) -> str:
        """What a begin, end or cancel comes to."""
        while self.early and next(iter(self.early.values())) <= now - REMEMBERED:
            del self.early[next(iter(self.early))]
        if what == "cancel":
            if request in self.running:
                return "stopped"
            if request not in self.early and len(self.early) >= MOST_REMEMBERED:
                return "forgotten"
            # The youngest last, so that the oldest are found at the front.
            self.early.pop(request, None)
            self.early[request] = now
            return "remembered"
        if what == "end":
            self.running.discard(request)
            return "ended"
        if self.early.pop(request, None) is not None:
            return "cancelled early"
        self.running.add(request)
        return "begun"


OUTCOMES = "request string, outcome string"


def cancellations(events: DataFrame) -> DataFrame:
    """The same for a table of worker, now, request, what: each worker's events in their order, one after the other."""
    ordered = events.select("worker", "now", "request", "what").repartition("worker").sortWithinPartitions("worker", "now", "request", "what")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, own = None, Cancellations()
        for b in batches:
            out = []
            for w, now, request, what in zip(b["worker"], b["now"], b["request"], b["what"]):
                if w != worker:
                    worker, own = w, Cancellations()
                out.append((request, own.take(now, request, what)))
            yield pd.DataFrame(out, columns=["request", "outcome"])

    return ordered.mapInPandas(run, OUTCOMES)


def cancellations_stream(events: DataFrame) -> DataFrame:
    """The same on a stream; each worker's state is kept from batch to batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = Cancellations(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["now", "request", "what"])
        out = [(request, own.take(now, request, what)) for now, request, what in zip(rows["now"], rows["request"], rows["what"])]
        state.update((json.dumps(own.state()),))
        yield pd.DataFrame(out, columns=["request", "outcome"])

    return events.groupBy("worker").applyInPandasWithState(step, OUTCOMES, "state string", "append", GroupStateTimeout.NoTimeout)


def live_repetition(tokens: DataFrame, most: int = 8) -> DataFrame:
    """From a stream of request, seq, text: request, seq of the first token at which a word of the growing text stands so often in a row. State: the word at the end, cut or not, and how often it stands."""
    import re

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        word, run, open_word, done = state.get if state.exists else ("", 0, "", False)
        rows = pd.concat(list(frames)).sort_values("seq")
        for seq, text in zip(rows["seq"], rows["text"]):
            if done:
                break
            open_word += text.casefold()
            words = re.findall(r"\w+", open_word)
            tail = words[-1] if words and re.search(r"\w\Z", open_word) else ""
            for w in words[: len(words) - bool(tail)]:
                word, run = w, run + 1 if w == word else 1
                done = done or run >= most
            # A word at the end may still grow; as it stands it counts for this token only.
            done = done or bool(tail) and tail == word and run + 1 >= most
            open_word = tail
            if done:
                yield pd.DataFrame({"request": [key[0]], "seq": [seq]})
        state.update((word, run, open_word, done))

    return tokens.groupBy("request").applyInPandasWithState(step, "request string, seq long", "word string, run int, tail string, done boolean", "append", GroupStateTimeout.NoTimeout)


def paced(reader, most_rows: int = 64):  # noqa: ANN001, ANN201
    """A file stream reader that takes a bounded number of files a batch: what isn't taken waits at the source."""
    return reader.option("maxFilesPerTrigger", most_rows)


def expired_leases(arrivals: DataFrame, lease: float) -> DataFrame:
    """Of a table of request, now, what (enter or leave): the requests whose lease ran out before they left, and when."""
    own = arrivals.groupBy("request").agg(F.min(F.when(F.col("what") == "enter", F.col("now"))).alias("entered"), F.max(F.when(F.col("what") == "leave", F.col("now"))).alias("left"))
    until = F.col("entered") + lease
    return own.where(F.col("entered").isNotNull() & (F.col("left").isNull() | (F.col("left") > until))).select("request", until.alias("until"))

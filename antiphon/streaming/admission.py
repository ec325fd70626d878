"""Admission as a state machine over ordered arrivals: a batch form, and a stream with state."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from antiphon.operators.chats import Gate, replay

DECISIONS = "request string, decision string"


def decide(arrivals: DataFrame) -> DataFrame:
    """From gate, now (seconds), client, request, what (enter or leave): request, decision.

    The limits of a gate are global, so its arrivals are one ordered sequence and one task's work, which holds only the state
    and a batch of rows: rows come sorted, not collected. Gates are independent of each other.
    """
    ordered = arrivals.repartition("gate").sortWithinPartitions("gate", "now", "request")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, state = None, Gate()
        for b in batches:
            out = []
            for g, now, client, request, what in zip(b["gate"], b["now"], b["client"], b["request"], b["what"]):
                if g != gate:
                    gate, state = g, Gate()
                if what == "leave":
                    state.leave(request)
                else:
                    out.append((request, state.enter(now, client, request)))
            yield pd.DataFrame(out, columns=["request", "decision"])

    return ordered.select("gate", "now", "client", "request", "what").mapInPandas(run, DECISIONS)


def decide_stream(arrivals: DataFrame) -> DataFrame:
    """The same on a stream: each gate's state is kept from batch to batch. Rows of one batch are taken in their order of time."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gate = Gate(json.loads(state.get[0]) if state.exists else None)
        rows = pd.concat(list(frames)).sort_values(["now", "request"])
        out = []
        for now, client, request, what in zip(rows["now"], rows["client"], rows["request"], rows["what"]):
            if what == "leave":
                gate.leave(request)
            else:
                out.append((request, gate.enter(now, client, request)))
        state.update((json.dumps(gate.state()),))
        yield pd.DataFrame(out, columns=["request", "decision"])

    return arrivals.groupBy("gate").applyInPandasWithState(step, DECISIONS, "state string", "append", GroupStateTimeout.NoTimeout)


__all__ = ["decide", "decide_stream", "replay"]

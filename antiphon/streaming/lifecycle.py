"""A service's requests from arrival to end, with timers: admission, leases, two deadlines a request, and signs of life.

The same state machine runs on a table (lifecycle) and on a stream (lifecycle_stream, by transformWithState with typed state and
event-time timers), and says the same of the same arrivals. Times are whole milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from antiphon.operators.chats import LEASE, Gate
from antiphon.streaming.timers import GENERATION, REQUEST

# Fixed value: seconds without a sign after which a waiting client gets one.
ALIVE = 5.0
SAID = "gate string, request string, at long, said string"
#: What the stream needs: the store that keeps typed state.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Limits(NamedTuple):
    """Seconds."""

    request: float = REQUEST
    generation: float = GENERATION
    alive: float = ALIVE


@dataclass
class Open:
    """A request that was admitted. Milliseconds at which the lease ends, the request has taken too long, its generation has (if it began), and the next sign of life is due."""

    client: str
    lease: int
    late: int
    spent: int | None
    alive: int

    def due(self) -> list[tuple[int, int, str]]:
        """Time, order at equal times, and what is said then."""
        out = [(self.lease, 0, "lease over"), (self.late, 1, "request timeout"), (self.alive, 3, "alive")]
        return out if self.spent is None else [*out, (self.spent, 2, "generation timeout")]


@dataclass
class Service:
    """One gate with its open requests. Arrivals come in order of time; what is due before one is said first."""

    limits: Limits = field(default_factory=Limits)
    open: dict[str, Open] = field(default_factory=dict)
    admitted: list[tuple[int, str]] = field(default_factory=list)
    now: int = 0

    def __post_init__(self) -> None:
        self.gate = Gate({"open": [[r, o.client, o.lease / 1000] for r, o in self.open.items()], "admitted": [[t / 1000, c] for t, c in self.admitted], "now": self.now / 1000})

    def next_due(self) -> int | None:
        return min((d[0] for o in self.open.values() for d in o.due()), default=None)

    def _end(self, request: str) -> None:
        del self.open[request]
        self.gate.leave(request)

    def advance(self, now: int) -> Iterator[tuple[str, int, str]]:
        """(request, at, said) of all that is due until then, in order."""
        while True:
            due = min(((*d, r) for r, o in self.open.items() for d in o.due()), default=None)
            if due is None or due[0] > now:
                break
            at, _, said, request = due
            if said == "alive":
                self.open[request].alive = at + int(self.limits.alive * 1000)
            else:
                self._end(request)
            yield request, at, said
        self.now = max(self.now, now)

    def take(self, now: int, client: str, request: str, what: str) -> Iterator[tuple[str, int, str]]:
        """What an arrival comes to: enter, begin (of the generation), token (a sign of its own) or leave. Late ones count as of now."""
        now = max(now, self.now)
        yield from self.advance(now)
        own = self.open.get(request)
        if what == "enter":
            said = self.gate.enter(now / 1000, client, request)
            if said == "admitted":
                self.admitted = [(round(t * 1000), c) for t, c in self.gate.admitted]
                # A request may take its time whole; it's late a moment after.
                self.open[request] = Open(client, now + int(LEASE * 1000), now + int(self.limits.request * 1000) + 1, None, now + int(self.limits.alive * 1000))
            yield request, now, said
        elif own is None:
            yield request, now, "unknown"
        elif what == "leave":
            self._end(request)
            yield request, now, "ended"
        else:
            own.alive = now + int(self.limits.alive * 1000)
            if what == "begin" and own.spent is None:
                own.spent = now + int(self.limits.generation * 1000)
                yield request, now, "begun"


def lifecycle(arrivals: DataFrame, until: int, limits: Limits = Limits()) -> DataFrame:
    """SAID of a table of gate, at (milliseconds), client, request, what. What is due later than `until` is not said. A gate is one ordered sequence, and one task's work; rows come sorted, not collected."""
    ordered = arrivals.select("gate", "at", "client", "request", "what").repartition("gate").sortWithinPartitions("gate", "at", "request", "what")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, service = None, Service(limits)
        for b in batches:
            out: list[tuple] = []
            for g, at, client, request, what in zip(b["gate"], b["at"], b["client"], b["request"], b["what"]):
                if g != gate:
                    out += [(gate, *x) for x in service.advance(until)]
                    gate, service = g, Service(limits)
                out += [(gate, *x) for x in service.take(at, client, request, what)]
            yield pd.DataFrame(out, columns=["gate", "request", "at", "said"])
        yield pd.DataFrame([(gate, *x) for x in service.advance(until)], columns=["gate", "request", "at", "said"])

    return ordered.mapInPandas(run, SAID)


class _Processor(StatefulProcessor):
    """Of a gate's state four requests and the admissions of an hour are all there can be, so it's read and written whole for each batch."""

    def __init__(self, limits: Limits):
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "request string", "client string, lease long, late long, spent long, alive long")
        self.admitted = handle.getListState("admitted", "at long, client string")
        self.clock = handle.getValueState("clock", "now long")

    def _load(self) -> Service:
        held = {key[0]: Open(*value) for key, value in self.open.iterator()}
        now = self.clock.get()[0] if self.clock.exists() else 0
        return Service(self.limits, held, [tuple(x) for x in self.admitted.get()], now)

    def _save(self, service: Service) -> None:
        self.open.clear()
        for request, o in service.open.items():
            self.open.updateValue((request,), (o.client, o.lease, o.late, o.spent, o.alive))
        self.admitted.clear()
        if service.admitted:
            self.admitted.put(service.admitted)
        self.clock.update((service.now,))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        due = service.next_due()
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        service = self._load()
        for r in sorted(rows, key=lambda r: (r.at, r.request, r.what)):
            for x in service.take(r.at, r.client, r.request, r.what):
                yield Row(gate=key[0], request=x[0], at=x[1], said=x[2])
        self._save(service)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        service = self._load()
        for x in service.advance(timerValues.getCurrentWatermarkInMs()):
            yield Row(gate=key[0], request=x[0], at=x[1], said=x[2])
        self._save(service)

    def close(self) -> None:
        pass


def lifecycle_stream(arrivals: DataFrame, limits: Limits = Limits(), late: str = "0 seconds") -> DataFrame:
    """The same of a stream of gate, ts (timestamp), client, request, what. Nothing needs to arrive at a gate for what is due there to be said: a timer fires when event time has passed it.

    Needs the session's state store to be STORE.
    """
    timed = arrivals.withWatermark("ts", late).withColumn("at", F.unix_millis("ts"))
    return timed.groupBy("gate").transformWithState(_Processor(limits), SAID, "Append", "EventTime")

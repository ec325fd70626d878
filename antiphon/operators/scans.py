"""Runs and periods of each key's values in order, by a segmented scan: no key is one task's work.

Rows are sorted into ranges of (key, order), so a key with many rows lies in several tasks. Each task sums up what it has of a key
as a Piece, and two neighbouring pieces make one: whether a value equals the one some places before it is a row of bits, of
which a piece holds the number, the runs of ones at both ends and the longest one; the bits across a seam come from the values
at the ends. Only a task's first and last keys can go on elsewhere, so two pieces a task at most are put together later.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Bits(NamedTuple):
    """A row of bits: how many, ones at its beginning, ones at its end, the longest run of ones, and where a run is first as long as asked (or -1)."""

    n: int = 0
    first: int = 0
    last: int = 0
    best: int = 0
    hit: int = -1


def joined(a: Bits, b: Bits, least: int) -> Bits:
    across = a.last + b.first
    hit = a.hit if a.hit >= 0 else a.n + least - a.last - 1 if a.last < least <= across else a.n + b.hit if b.hit >= 0 else -1
    return Bits(a.n + b.n, a.first if a.first < a.n else a.n + b.first, b.last if b.last < b.n else b.n + a.last, max(a.best, b.best, across), hit)


class Lag(NamedTuple):
    """Bits that tell whether a value equals the one `back` places before it. Nulls equal each other, or else nothing."""

    back: int
    nulls_equal: bool = False

    def same(self, a: Any, b: Any) -> bool:
        return (a is None and b is None and self.nulls_equal) or (a is not None and b is not None and a == b)


class Piece(NamedTuple):
    """What a stretch of a key's rows comes to. rows: the first rows, of which one may turn out to be where a run is long enough; row: the one that is."""

    n: int
    head: list
    tail: list
    bits: list[Bits]
    rows: list[dict]
    row: dict | None


def merged(a: Piece, b: Piece, lags: list[Lag], least: int) -> Piece:
    keep = max(lag.back for lag in lags)
    bits, row = [], a.row
    for lag, x, y in zip(lags, a.bits, b.bits, strict=True):
        seam = Bits()
        for j in range(min(lag.back, b.n)):
            if a.n + j >= lag.back:
                one = int(lag.same(b.head[j], a.tail[j - lag.back] if j < lag.back else b.head[j - lag.back]))
                seam = joined(seam, Bits(1, one, one, one, 0 if one >= least else -1), least)
        both = joined(joined(x, seam, least), y, least)
        if row is None and both.hit >= 0 and (a.rows or b.rows):
            at = both.hit + lag.back - a.n
            row = b.rows[at] if at < len(b.rows) else b.row
        bits.append(both)
    return Piece(a.n + b.n, (a.head + b.head)[:keep], (a.tail + b.tail)[-keep:], bits, (a.rows + b.rows)[: least + 1] if a.rows or b.rows else [], row)


def _equal(column: pa.Array, lag: Lag) -> np.ndarray:
    """For each place, whether its value equals that `back` places before."""
    out = np.zeros(len(column), bool)
    if len(column) > lag.back:
        a, b = column[lag.back :], column[: -lag.back]
        same = pc.fill_null(pc.equal(a, b), False)
        if lag.nulls_equal:
            same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
        out[lag.back :] = same.to_numpy(zero_copy_only=False)
    return out


def _bits(same: np.ndarray, starts: np.ndarray, ends: np.ndarray, back: int, least: int) -> np.ndarray:
    """Bits of each group, a row of five numbers each."""
    at = np.arange(len(same))
    offset = at - np.repeat(starts, ends - starts)
    counts, one = offset >= back, same & (offset >= back)
    run = at - np.maximum.accumulate(np.where(one, -1, at))
    far = len(same) + 1
    n = np.maximum(ends - starts - back, 0)
    first = np.clip(np.minimum.reduceat(np.where(counts & ~same, offset, far), starts) - back, 0, n)
    hit = np.minimum.reduceat(np.where(run >= least, offset, far), starts) - back
    return np.stack([n, first, run[ends - 1], np.maximum.reduceat(run, starts), np.where(hit > far - back - 1, -1, hit)], axis=1)


def segmented(df: DataFrame, key: str, order: list[str], value: str, lags: list[Lag], least: int = 1 << 60, rows: bool = False) -> DataFrame:
    """key, n, bits (for each lag five numbers, as in Bits), row: for each key. row: with `rows`, df's row at which the first lag's run is `least` long."""
    columns = df.columns if rows else []
    kinds = dict(df.select(key, value, *order).dtypes)
    struct = "struct<" + (",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema) if rows else "_none:int") + ">"
    schema = f"key {kinds[key]}, place long, open boolean, n long, head array<{kinds[value]}>, tail array<{kinds[value]}>, bits array<bigint>, rows array<{struct}>, row {struct}"
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [key, *(c for c in dict.fromkeys([value, *order, *columns]) if c != key)]
    dealt = df.select(*names).repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order).select(F.col(key).alias("_key"), F.col(value).alias("_value"), *columns)
    ends_kept = max(lag.back for lag in lags)

    def out(pieces: list[tuple[Any, Piece, bool]], arrow: pa.Schema, place: int) -> pa.RecordBatch:
        table = [{"key": k, "place": place, "open": is_open, "n": p.n, "head": p.head, "tail": p.tail, "bits": [x for b in p.bits for x in b], "rows": p.rows, "row": p.row} for k, p, is_open in pieces]
        return pa.RecordBatch.from_pylist(table, schema=arrow)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, carried, first_key, arrow = TaskContext.get().partitionId(), None, True, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, values = batch.column(0), batch.column(1)
            if arrow is None:
                row = pa.struct([batch.schema.field(i) for i in range(2, batch.num_columns)]) if rows else pa.struct([("_none", pa.int32())])
                arrow = pa.schema([("key", keys.type), ("place", pa.int64()), ("open", pa.bool_()), ("n", pa.int64()), ("head", pa.list_(values.type)), ("tail", pa.list_(values.type)), ("bits", pa.list_(pa.int64())), ("rows", pa.list_(row)), ("row", row)])
            starts = np.flatnonzero(~_equal(keys, Lag(1, True)))
            ends = np.append(starts[1:], batch.num_rows)
            bits = np.concatenate([_bits(_equal(values, lag), starts, ends, lag.back, least) for lag in lags], axis=1)

            def piece(g: int, batch: pa.RecordBatch = batch, starts: np.ndarray = starts, ends: np.ndarray = ends, bits: np.ndarray = bits, values: pa.Array = values) -> Piece:
                a, b = int(starts[g]), int(ends[g])
                own = [Bits(*map(int, bits[g, 5 * i : 5 * i + 5])) for i in range(len(lags))]
                some = batch.select(columns).slice(a, min(least + 1, b - a)).to_pylist() if rows else []
                hit = batch.select(columns).slice(a + own[0].hit + lags[0].back, 1).to_pylist()[0] if rows and own[0].hit >= 0 else None
                return Piece(b - a, values[a : min(b, a + ends_kept)].to_pylist(), values[max(a, b - ends_kept) : b].to_pylist(), own, some, hit)

            last = len(starts) - 1
            name = keys[0].as_py()
            if carried is not None and carried[0] == name:
                carried = (name, merged(carried[1], piece(0), lags, least))
            else:
                if carried is not None:
                    yield out([(*carried, first_key)], arrow, place)
                    first_key = False
                carried = (name, piece(0))
            if last:
                yield out([(*carried, first_key)], arrow, place)
                first_key = False
                carried = (keys[int(starts[last])].as_py(), piece(last))
            if last > 1:
                # Whole groups between: no more than their numbers are needed.
                mid = np.arange(1, last)
                n = len(mid)
                hits = np.where(bits[mid, 4] >= 0, starts[mid] + bits[mid, 4] + lags[0].back, -1)
                at = pa.array(hits, mask=hits < 0)
                row = pa.StructArray.from_arrays([batch.column(i).take(at) for i in range(2, batch.num_columns)], fields=list(arrow.field("row").type)) if rows else pa.nulls(n, arrow.field("row").type)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(starts[mid])), pa.array(np.full(n, place)), pa.array(np.zeros(n, bool)), pa.array((ends - starts)[mid]), pa.nulls(n, arrow.field("head").type), pa.nulls(n, arrow.field("tail").type),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bits.shape[1]), pa.array(bits[mid].ravel())), pa.nulls(n, arrow.field("rows").type), row], schema=arrow)
        if carried is not None:
            yield out([(*carried, True)], arrow, place)

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        arrow = None
        for batch in batches:
            arrow = batch.schema
            mask = batch.column(arrow.get_field_index("open"))
            waiting += batch.filter(mask).to_pylist()
            yield batch.filter(pc.invert(mask))
        pieces: dict[Any, list[dict]] = {}
        for x in sorted(waiting, key=lambda x: x["place"]):
            pieces.setdefault(x["key"], []).append(x)
        done = []
        for name, own in pieces.items():
            parsed = [Piece(x["n"], x["head"], x["tail"], [Bits(*x["bits"][i : i + 5]) for i in range(0, len(x["bits"]), 5)], x["rows"] or [], x["row"] if x["row"] and x["bits"][4] >= 0 else None) for x in own]
            done.append((name, reduce(lambda a, b: merged(a, b, lags, least), parsed), False))
        if done:
            yield out(done, arrow, 0)

    found = dealt.mapInArrow(summed, schema).repartition("key").mapInArrow(closed, schema)
    return found.select(F.col("key").alias(key), "n", "bits", "row")


def _best(i: int) -> F.Column:
    return F.col("bits")[5 * i + 3]


def longest_runs(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """key, run: the most equal values in a row (nulls equal each other)."""
    return segmented(df, key, order, value, [Lag(1, True)]).select(key, (_best(0) + 1).alias("run"))


def first_long_run(df: DataFrame, key: str, order: list[str], value: str, least: int) -> DataFrame:
    """df's rows at which, by key, a value has first stood so often in a row (two or more), with run."""
    if least < 2:
        raise ValueError("a run has two values at least")
    found = segmented(df, key, order, value, [Lag(1, True)], least - 1, rows=True)
    return found.where(F.col("bits")[4] >= 0).select(*(F.col("row")[c].alias(c) for c in df.columns), F.lit(least).cast("long").alias("run"))


def _span(i: int, period: int) -> F.Column:
    """A stretch that repeats has as many more values as its period; one shorter than two periods is none."""
    return F.when(_best(i) >= period, _best(i) + period).otherwise(0).cast("long")


def period_spans(df: DataFrame, key: str, order: list[str], value: str, periods: int = 4) -> DataFrame:
    """key, period, span: the longest stretch that repeats with that period, if it's two periods long at least, else 0. Nulls repeat nothing."""
    found = segmented(df, key, order, value, [Lag(p) for p in range(1, periods + 1)])
    return found.select(key, F.inline(F.array(*(F.struct(F.lit(p).alias("period"), _span(p - 1, p).alias("span")) for p in range(1, periods + 1)))))


def loops(df: DataFrame, key: str, order: list[str], value: str, run: int = 8, repetitions: int = 8, span: int = 12, periods: int = 4) -> DataFrame:
    """key, degenerate: a value so often in a row, or a stretch with a period of one to four that has so many of them and is so long. One scan for all."""
    found = segmented(df, key, order, value, [Lag(1, True), *(Lag(p) for p in range(1, periods + 1))])
    repeats = [(F.floor(_span(p, p) / p) >= repetitions) & (_span(p, p) >= span) for p in range(1, periods + 1)]
    out = _best(0) + 1 >= run
    for r in repeats:
        out = out | r
    return found.select(key, out.alias("degenerate"))

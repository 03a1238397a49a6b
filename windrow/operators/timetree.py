"""Least event over a point or a span of time, without pairs of events and rows.

Time is a tree of nodes: a node of level l is ``16 ** l`` units long. An interval is the union of at most 30 nodes a
level; a point lies in one node a level. Intervals are written to their nodes and each node keeps its least event (a map-side
minimum), so a point asks ten nodes, however many events there are. Long intervals end in nodes of the
top level. A key is one node: the event side has one row for it, and the side that asks can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TOP = 10  # 16 ** 10 microseconds are about 13 days
_NODES = "array<struct<level:int,node:bigint>>"


def covering(lo: Column, hi: Column) -> Column:
    """Nodes whose union is the whole numbers from ``lo`` to ``hi`` (both included); none if ``lo > hi``."""
    empty = F.array().cast(_NODES)
    state = F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), empty.alias("out"))

    def step(s: Column, level: Column) -> Column:
        lo, hi = s["lo"], s["hi"]
        make = lambda a, b: F.transform(F.sequence(a, b), lambda n: F.struct(level.alias("level"), n.alias("node")))
        last_of, first_of = lo.bitwiseOR(F.lit(15).cast("bigint")), hi - F.pmod(hi, F.lit(16))
        some, together = lo <= hi, F.shiftright(lo, 4) == F.shiftright(hi, 4)
        everything = some & ((level == TOP) | together)
        ragged_left, ragged_right = some & ~everything & (F.pmod(lo, F.lit(16)) != 0), some & ~everything & (F.pmod(hi, F.lit(16)) != 15)
        left = F.when(ragged_left, make(lo, last_of)).otherwise(empty)
        right = F.when(ragged_right, make(first_of, hi)).otherwise(empty)
        whole = F.when(everything, make(lo, hi)).otherwise(empty)
        next_lo = F.when(everything | ~some, F.lit(1).cast("bigint")).otherwise(F.shiftright(F.when(ragged_left, last_of + 1).otherwise(lo), 4))
        # one step back rounds down past the ragged end; a negative number shifts as floor division
        next_hi = F.when(everything | ~some, F.lit(0).cast("bigint")).otherwise(F.shiftright(F.when(ragged_right, first_of - 1).otherwise(hi), 4))
        return F.struct(next_lo.alias("lo"), next_hi.alias("hi"), F.concat(s["out"], whole, left, right).alias("out"))

    return F.aggregate(F.array(*[F.lit(i) for i in range(TOP + 1)]), state, step, lambda s: s["out"])


def above(point: Column) -> Column:
    """The node of every level that holds a point."""
    return F.array(*[F.struct(F.lit(i).alias("level"), F.shiftright(point, 4 * i).alias("node")) for i in range(TOP + 1)])


def _least(marks: DataFrame, nodes: Column, value: str) -> DataFrame:
    return marks.select(value, F.explode(nodes).alias("_n")).groupBy("_n.level", "_n.node").agg(F.min(value).alias(value))


def _asked(asks: DataFrame, keys: list[str], nodes: Column, table: DataFrame, value: str) -> DataFrame:
    asked = asks.select(*keys, F.explode(nodes).alias("_n")).select(*keys, "_n.level", "_n.node")
    return asked.join(table, ["level", "node"]).groupBy(*keys).agg(F.min(value).alias(value))


def least_at(points: DataFrame, point: str, events: DataFrame, lo: Column, hi: Column, value: str) -> DataFrame:
    """``point`` and the least ``value`` of the events with ``lo <= point <= hi``, for the points that have one."""
    return _asked(points.select(point).distinct(), [point], above(F.col(point)), _least(events, covering(lo, hi), value), value)


def least_meeting(spans: DataFrame, keys: list[str], lo: Column, hi: Column, events: DataFrame, event_lo: Column, event_hi: Column, value: str) -> DataFrame:
    """``keys`` of the spans and the least ``value`` of the events whose closed interval meets ``lo`` to ``hi``.

    Such an event holds the span's first point, or it begins after it and within the span.
    """
    some = spans.filter(lo <= hi).withColumns({"_lo": lo, "_hi": hi}).select(*keys, "_lo", "_hi")
    events = events.filter(event_lo <= event_hi)
    held = least_at(some, "_lo", events, event_lo, event_hi, value)
    first = some.join(held, "_lo").select(*keys, value)
    begun = _asked(some, keys, covering(F.col("_lo") + 1, F.col("_hi")), _least(events, above(event_lo), value), value)
    return first.unionByName(begun).groupBy(*keys).agg(F.min(value).alias(value))

"""Windows around events: which windows an event meets, the nearest one otherwise, and the rows next to them.

Windows and events are one line per room, ordered by time and cut into blocks. One exchange by (room, block) gives

* every window the ``before`` windows ahead of it and the ``after`` windows behind it,
* every event the last window start before it and the first one after it,

inside the block by ordinary windows, across blocks from one row per block. A second exchange by (room, time bin)
brings windows and events together that share a bin. No pair of rows leaves a bin but those asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.operators.ordered import time_block
from windrow.session import spread
from windrow.settings import MICROS

_ROOM, _BLOCK = "_room", "_block"
_WINDOW, _EVENT = 0, 1
_EACH = 125_000  # rows of a line in a task


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))


def with_sequence(events: DataFrame) -> DataFrame:
    """``event_seq``, by which events are told apart; equal rows of a log without it are one event."""
    if "event_seq" in events.columns:
        return events.withColumn("event_seq", F.col("event_seq").cast("bigint"))
    return events.withColumn("event_seq", F.xxhash64(*events.columns))


def _line(windows: DataFrame, events: DataFrame, activity: Column, block_seconds: int, count: int | None) -> DataFrame:
    """Both kinds of rows; every column takes part in the order, so all readers need the same columns."""
    optional = lambda df, c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    about = lambda df, c: F.struct(F.col(c).cast("string").alias("id"), optional(df, "event_type", "string").alias("type"), optional(df, "candidate_event_source", "string").alias("source"))
    spans = windows.select(
        _text("room_id").alias(_ROOM), F.col("start_us").alias("_t"), F.lit(_WINDOW).alias("_kind"), F.lit(None).cast("bigint").alias("_seq"),
        F.struct(F.col("window_id").cast("string").alias("id"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("source")).alias("_about"),
        F.col("end_us").alias("_end"), optional(windows, "duration_seconds", "double").alias("_length"), activity.cast("double").alias("_a"),
    )
    marks = with_sequence(events)
    marks = marks.select(
        _text("room_id").alias(_ROOM), F.col("event_start_us").alias("_t"), F.lit(_EVENT).alias("_kind"), F.col("event_seq").alias("_seq"), about(marks, "event_id").alias("_about"),
        F.col("event_end_us").alias("_end"), F.lit(None).cast("double").alias("_length"), F.lit(None).cast("double").alias("_a"),
    )
    line = spans.unionByName(marks).withColumn("_order", F.struct("_t", "_kind", "_seq", "_about", "_end", "_length", "_a"))
    # said outright, and never null, because the two readers below would else ask for different exchanges
    line = line.withColumn(_BLOCK, F.coalesce(time_block("_t", block_seconds), F.lit(1 << 62))).select(_ROOM, _BLOCK, "_order")
    # by count: with their neighbours rows grow far beyond the bytes that are shuffled
    return spread(line, _ROOM, _BLOCK, rows=count, each=_EACH)


def _last(rows: Column, n: int) -> Column:
    return F.slice(rows, F.greatest(F.size(rows) - n + 1, F.lit(1)), n)


def _placed(line: DataFrame, before: int, after: int, count: int | None) -> DataFrame:
    """Line rows with ``_prev``, ``_next`` (windows next to a window) and ``_past``, ``_future`` (window starts next to an event)."""
    part, kind = [_ROOM, _BLOCK], F.col("_order._kind")
    is_window = kind == _WINDOW
    same = Window.partitionBy(*part, kind).orderBy("_order")
    forth, back = Window.partitionBy(*part).orderBy("_order"), Window.partitionBy(*part).orderBy(F.desc("_order"))
    rows = line.withColumn("_w", F.when(is_window, F.col("_order")))
    # the first of windows that start together stands for the start; they share a block
    rows = rows.withColumn("_lead", F.when(is_window & ~F.coalesce(F.lag("_order._t").over(same) == F.col("_order._t"), F.lit(False)), F.col("_order")))
    rows = rows.withColumns({"_past": F.last("_lead", True).over(forth), "_future": F.last("_w", True).over(back)})
    rows = rows.withColumns({"_prev": F.collect_list("_w").over(same.rowsBetween(-max(before, 1), -1)), "_next": F.collect_list("_w").over(same.rowsBetween(1, max(after, 1)))})
    own = F.array("_w")
    edges = rows.groupBy(*part).agg(
        F.max_by(F.when(is_window, _last(F.concat("_prev", own), max(before, 1))), F.col("_w")).alias("_tail"), F.min_by(F.when(is_window, F.slice(F.concat(own, "_next"), 1, max(after, 1))), F.col("_w")).alias("_head"),
        F.max("_lead").alias("_latest"), F.min("_w").alias("_earliest"),
    )
    edges = spread(edges, _ROOM, rows=count, each=_EACH)
    along, against = Window.partitionBy(_ROOM).orderBy(_BLOCK), Window.partitionBy(_ROOM).orderBy(F.desc(_BLOCK))
    edges = edges.withColumns({
        "_latest": F.last("_latest", True).over(along.rowsBetween(Window.unboundedPreceding, -1)),
        "_earliest": F.last("_earliest", True).over(against.rowsBetween(Window.unboundedPreceding, -1)),
    })
    full = Window.partitionBy(_ROOM, F.col("_tail").isNotNull()).orderBy(_BLOCK)
    edges = edges.withColumns({
        "_tails": F.flatten(F.collect_list("_tail").over(full.rowsBetween(-max(before, 1), -1))), "_heads": F.flatten(F.collect_list("_head").over(full.rowsBetween(1, max(after, 1)))),
    }).drop("_tail", "_head")
    joined = rows.join(edges, part)
    return joined.select(
        _ROOM, "_order", _last(F.concat("_tails", "_prev"), before).alias("_prev"), F.slice(F.concat("_next", "_heads"), 1, after).alias("_next"),
        F.coalesce("_past", "_latest").alias("_past"), F.coalesce("_future", "_earliest").alias("_future"),
    )


def _met(windows: DataFrame, events: DataFrame, activity: Column, before: int, after: int, bin_seconds: int, block_seconds: int, count: int | None = None) -> DataFrame:
    """One row per event and bin with the windows of the bin: ``_room``, ``_bin``, ``_e`` (event), ``_ws``.

    ``_e.nearest`` says that the event looks for its nearest window, whose bin this is, and not for those it meets.
    """
    rows = _placed(_line(windows, events, activity, block_seconds, count), before, after, count)
    order = F.col("_order")
    bin_of = lambda t: F.floor(t / F.lit(bin_seconds * MICROS))
    span = lambda lo, hi: F.sequence(bin_of(lo), F.greatest(bin_of(lo), bin_of(hi)))
    one = lambda t: F.array(bin_of(t))
    gap_past, gap_future = order["_t"] - F.col("_past._t"), F.col("_future._t") - order["_t"]
    near = F.when(F.col("_past").isNotNull() & (F.col("_future").isNull() | (gap_past <= gap_future)), F.col("_past")).otherwise(F.col("_future"))
    rows = rows.withColumn("_near", F.when(order["_kind"] == _EVENT, near))
    places = F.when(order["_kind"] == _WINDOW, F.transform(span(order["_t"], order["_end"]), lambda b: F.struct(b.alias("bin"), F.lit(False).alias("nearest"))))
    meets = F.when(order["_t"] <= order["_end"], F.transform(span(order["_t"], order["_end"]), lambda b: F.struct(b.alias("bin"), F.lit(False).alias("nearest"))))
    seeks = F.when(F.col("_near").isNotNull(), F.transform(one(F.col("_near._t")), lambda b: F.struct(b.alias("bin"), F.lit(True).alias("nearest"))))
    empty = F.array().cast("array<struct<bin:bigint,nearest:boolean>>")
    placed = rows.withColumn("_at", F.explode(F.coalesce(places, F.concat(F.coalesce(meets, empty), F.coalesce(seeks, empty)))))
    window = F.when(order["_kind"] == _WINDOW, F.struct(order.alias("row"), F.col("_prev").alias("prev"), F.col("_next").alias("next"), bin_of(order["_t"]).alias("first")))
    event = F.when(order["_kind"] == _EVENT, F.struct(order.alias("row"), F.col("_near").alias("near"), F.col("_at.nearest").alias("nearest"), bin_of(order["_t"]).alias("first")))
    packed = placed.select(_ROOM, F.col("_at.bin").alias("_bin"), window.alias("_w"), event.alias("_e"))
    # events of a bin are at most its share of the log; a bin of windows is bounded by its length
    bins = packed.groupBy(_ROOM, "_bin").agg(F.collect_list("_e").alias("_es"), F.collect_list("_w").alias("_ws")).filter(F.size("_es") > 0)
    return bins.select(_ROOM, "_bin", F.explode("_es").alias("_e"), "_ws")


def _matching(event: Column, windows: Column) -> Column:
    """Windows of a bin that an event meets, or its nearest one."""
    row, near = event["row"], event["near"]
    meets = lambda w: (w["row"]["_t"] <= row["_end"]) & (w["row"]["_end"] >= row["_t"])
    return F.filter(windows, lambda w: F.when(event["nearest"], w["row"] == near).otherwise(meets(w)))


def _room(df: DataFrame, kind: str) -> Column:
    return F.nullif(F.col(_ROOM), F.lit("\u0000")).cast(kind)


def met_or_nearest(events: DataFrame, windows: DataFrame, bin_seconds: int = 3_600, block_seconds: int = 86_400, count: int | None = None) -> DataFrame:
    """``event_seq``, ``event_id``, ``room_id``, the event's span, ``window_id``, the window's span and ``matched`` (``overlap``, or ``nearest`` for an event that meets none).

    ``count`` is about how many windows and events there are, when known.
    """
    kind = windows.schema["room_id"].dataType.simpleString()
    pairs = _met(windows, events, F.lit(None).cast("double"), 0, 0, bin_seconds, block_seconds, count)
    pairs = pairs.select(_ROOM, "_bin", "_e", F.explode(_matching(F.col("_e"), F.col("_ws"))).alias("_w"))
    e, w = F.col("_e.row"), F.col("_w.row")
    first = F.when(F.col("_e.nearest"), F.col("_w.first")).otherwise(F.greatest("_e.first", "_w.first"))
    out = pairs.filter(F.col("_bin") == first).select(
        _ROOM, e["_seq"].alias("event_seq"), e["_about"]["id"].alias("event_id"), e["_t"].alias("event_start_us"), e["_end"].alias("event_end_us"),
        w["_about"]["id"].alias("window_id"), w["_t"].alias("start_us"), w["_end"].alias("end_us"), F.col("_e.nearest").alias("_nearest"),
    )
    hits = out.filter(~F.col("_nearest"))
    alone = out.filter("_nearest").join(hits.select(_ROOM, "event_seq").distinct(), [_ROOM, "event_seq"], "left_anti")
    named = lambda df, how: df.select("event_seq", "event_id", _room(df, kind).alias("room_id"), "event_start_us", "event_end_us", "window_id", "start_us", "end_us", F.lit(how).alias("matched"))
    return named(hits, "overlap").unionByName(named(alone, "nearest"))


def highest_met(events: DataFrame, windows: DataFrame, activity: Column, before: int, after: int, bin_seconds: int = 3_600, block_seconds: int = 86_400, count: int | None = None) -> DataFrame:
    """One row per event: the most active window that it meets (or the nearest), ``top``, with the windows around it.

    ``event_seq``, ``about`` (id, type, source), ``room_id``, ``top``, ``prev`` and ``next`` (oldest first); a window is a struct of
    ``_about.id``, ``_t``, ``_end``, ``_length`` and ``_a``. Of equally active windows the first counts.
    """
    kind = windows.schema["room_id"].dataType.simpleString()
    met = _met(windows, events, activity, before, after, bin_seconds, block_seconds, count)
    ranked = lambda w: F.struct((-w["row"]["_a"]).alias("down"), w["row"].alias("row"), w["prev"].alias("prev"), w["next"].alias("next"))
    best = met.select(_ROOM, "_e", F.array_min(F.transform(_matching(F.col("_e"), F.col("_ws")), ranked)).alias("_best")).filter("_best IS NOT NULL")
    chosen = best.groupBy(_ROOM, F.col("_e.row._seq").alias("event_seq")).agg(F.min(F.struct(F.col("_e.nearest").alias("nearest"), F.col("_best").alias("best"))).alias("_c"), F.min("_e.row._about").alias("about"))
    return chosen.select("event_seq", "about", _room(chosen, kind).alias("room_id"), F.col("_c.best.row").alias("top"), F.col("_c.best.prev").alias("prev"), F.col("_c.best.next").alias("next"))

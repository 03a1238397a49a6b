"""Ordered scans that never put a whole sequence into one task.

``Window.partitionBy(room).orderBy(time)`` sends every row of a room to one
task; with one room holding a third of the data that task is the job. Here a
sequence is cut into blocks along its order (an hour, a day, a value range).
A scan is then done in two levels:

1. inside each (sequence, block), as an ordinary window, in parallel;
2. over one summary row per block, which carries the boundary state;

and the carried state is joined back. The second level sees one row per block,
so its size depends on the calendar span (or the number of value ranges), never
on the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.session import cut_lineage
from windrow.settings import MICROS

_BLOCK = "_blk"
_LAST = 1 << 62


@dataclass(frozen=True)
class Axis:
    """How rows are ordered.

    ``keys``   columns naming a sequence (may be empty: one global sequence)
    ``order``  columns that order it, unique within a sequence
    ``block``  expression that never decreases along ``order``
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    block: Column
    descending: bool = False

    def reversed(self) -> "Axis":
        return Axis(self.keys, self.order, self.block, not self.descending)

    @property
    def groups(self) -> list[str]:
        return [f"_g{i}" for i in range(len(self.keys))]

    def ordering(self) -> list[Column]:
        return [F.col(c).desc_nulls_first() if self.descending else F.col(c).asc_nulls_last() for c in self.order]

    def prepare(self, df: DataFrame) -> DataFrame:
        """Add non-null text keys (so joins and windows share one partitioning) and the block."""
        extra = {g: F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for g, k in zip(self.groups, self.keys)}
        # rows without an order value come last, as in the ordering itself
        block = F.coalesce(self.block.cast("bigint"), F.lit(_LAST).cast("bigint"))
        return df.withColumns({**extra, _BLOCK: -block if self.descending else block})

    def inside(self):
        return Window.partitionBy(*self.groups, _BLOCK).orderBy(*self.ordering())

    def across(self, *more: str):
        return Window.partitionBy(*self.groups).orderBy(_BLOCK, *more)

    def clean(self, df: DataFrame, *more: str) -> DataFrame:
        return df.drop(*self.groups, _BLOCK, *more)


def time_block(micros: Column | str, seconds: int) -> Column:
    """Block number of an instant; ``seconds`` sets how much one task may see of one sequence."""
    value = F.col(micros) if isinstance(micros, str) else micros
    return F.floor(value / F.lit(seconds * MICROS))


def time_axis(keys: tuple[str, ...] | list[str], time: str = "start_us", tie: str | None = "window_id", seconds: int = 86_400) -> Axis:
    order = (time,) if tie is None else (time, tie)
    return Axis(tuple(keys), order, time_block(time, seconds))


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; right key columns are dropped."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [same(left[k], renamed[f"_r_{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def attach_row(df: DataFrame, one: DataFrame) -> DataFrame:
    """Add the columns of a one-row frame to every row.

    The frame is folded by a global aggregate first, so it has exactly one row
    whatever is passed in: rows cannot multiply and the broadcast is one row.
    (Scalar subqueries would read better, but Spark cannot plan nested ones.)
    """
    row = one.agg(F.first(F.struct(*one.columns)).alias("_row"))
    return df.join(F.broadcast(row), how="cross").select(*df.columns, *[F.col("_row")[c].alias(c) for c in one.columns])


def with_group_stats(df: DataFrame, keys: list[str], stats: dict[str, Column]) -> DataFrame:
    """Attach per-group aggregates.

    A group-by combines on the map side and the join back may be broadcast or
    skew-split, so a hot group costs no more than any other rows; a window over
    the group would collect it in one task.
    """
    summary = df.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
    if not keys:
        return attach_row(df, summary)
    return join_same(df, summary, keys)


def _pack(cols: dict[str, str]) -> Column:
    return F.struct(*[F.col(c).alias(n) for n, c in cols.items()])


def _at(cols: dict[str, str], axis: Axis, last: bool) -> Column:
    place = F.col(axis.order[0]) if len(axis.order) == 1 else F.struct(*axis.order)
    take = F.max_by if last != axis.descending else F.min_by
    return take(_pack(cols), place)


def with_neighbours(
    df: DataFrame, axis: Axis, before: dict[str, str] | None = None, after: dict[str, str] | None = None
) -> DataFrame:
    """Add columns of the previous (``before``) and next (``after``) row: ``{new: source}``.

    ``_has_before`` / ``_has_after`` say whether such a row exists.
    """
    before, after = before or {}, after or {}
    rows = axis.prepare(df)
    inside, across = axis.inside(), axis.across()
    one = F.lit(True)

    local = {f"_b_{n}": F.lag(c).over(inside) for n, c in before.items()}
    local |= {f"_a_{n}": F.lead(c).over(inside) for n, c in after.items()}
    local |= {"_lb": F.lag(one).over(inside), "_la": F.lead(one).over(inside)}

    edge_parts = []
    if before:
        edge_parts.append(_at(before, axis, last=True).alias("_tail"))
    if after:
        edge_parts.append(_at(after, axis, last=False).alias("_head"))
    edges = rows.groupBy(*axis.groups, _BLOCK).agg(*edge_parts)
    carried = {}
    if before:
        carried["_tail"] = F.lag("_tail").over(across)
    if after:
        carried["_head"] = F.lead("_head").over(across)
    edges = edges.withColumns(carried)

    out = rows.withColumns(local).join(edges, [*axis.groups, _BLOCK], "left")
    final = {n: F.when(F.col("_lb").isNotNull(), F.col(f"_b_{n}")).otherwise(F.col(f"_tail.{n}")) for n in before}
    final |= {n: F.when(F.col("_la").isNotNull(), F.col(f"_a_{n}")).otherwise(F.col(f"_head.{n}")) for n in after}
    if before:
        final["_has_before"] = F.col("_lb").isNotNull() | F.col("_tail").isNotNull()
    if after:
        final["_has_after"] = F.col("_la").isNotNull() | F.col("_head").isNotNull()
    out = out.withColumns(final)
    return axis.clean(out, *local, "_tail", "_head")


def with_running(df: DataFrame, axis: Axis, **measures: tuple[str, Column | str]) -> DataFrame:
    """Add inclusive prefix aggregates ``name=(kind, column)``.

    Kinds: ``sum``, ``count``, ``min``, ``max`` and ``last`` (last value present so far).
    """
    rows = axis.prepare(df)
    inside = axis.inside().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = axis.across().rowsBetween(Window.unboundedPreceding, -1)
    place = F.col(axis.order[0]) if len(axis.order) == 1 else F.struct(*axis.order)

    local, totals, carried, final = {}, [], {}, {}
    for name, (kind, source) in measures.items():
        value = F.col(source) if isinstance(source, str) else source
        here, there = f"_h_{name}", f"_c_{name}"
        if kind == "last":
            pick = F.min_by if axis.descending else F.max_by
            local[here] = F.last(value, ignorenulls=True).over(inside)
            totals.append(pick(value, F.when(value.isNotNull(), place)).alias(there))
            carried[there] = F.last(there, ignorenulls=True).over(earlier)
            final[name] = F.coalesce(F.col(here), F.col(there))
            continue
        aggregate = getattr(F, kind)
        local[here] = aggregate(value).over(inside)
        totals.append(aggregate(value).alias(there))
        combine = F.sum if kind in ("sum", "count") else aggregate
        carried[there] = combine(there).over(earlier)
        if kind in ("sum", "count"):
            final[name] = F.when(
                F.col(here).isNotNull() | F.col(there).isNotNull(),
                F.coalesce(F.col(here), F.lit(0)) + F.coalesce(F.col(there), F.lit(0)),
            )
        else:
            both = F.least if kind == "min" else F.greatest
            final[name] = both(F.col(here), F.col(there))
    edges = rows.groupBy(*axis.groups, _BLOCK).agg(*totals).withColumns(carried)
    out = rows.withColumns(local).join(edges, [*axis.groups, _BLOCK], "left").withColumns(final)
    return axis.clean(out, *local, *carried)


def range_placed(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Rows with their number from 1 along ``order`` over the whole frame and their range ``_part`` (ranges follow the order).

    Ranges follow the rows, not the calendar, so a day (or a value) with most rows is many partitions. The placed rows
    are written, because ranges are sampled and counts and rows must see the same ones.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_seat", F.monotonically_increasing_id()))
    part = F.shiftright("_seat", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    offsets = placed.groupBy(part.alias("_part")).count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    place = F.col("_offset") + F.col("_seat").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.withColumn("_part", part).join(offsets, "_part").withColumn(name, place.cast("bigint")).drop("_seat", "_offset")


def range_position(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number from 1 along ``order`` over the whole frame."""
    return range_placed(df, order, name).drop("_part")


def with_position(df: DataFrame, axis: Axis, name: str = "position") -> DataFrame:
    """Row number from 1 along the axis."""
    if not axis.keys:
        return range_position(df, axis.ordering(), name)
    return with_running(df, axis, **{name: ("count", F.lit(1))})


def with_runs(df: DataFrame, axis: Axis, value: str) -> DataFrame:
    """Runs of equal consecutive values: ``run_length`` (whole run) and ``run_position`` (from 1).

    Only the first and the last run of a block can continue in another block,
    so at most two rows per block take part in the second level.
    """
    inside = axis.inside()
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = axis.prepare(df)
    rows = rows.withColumns({"_rn": F.row_number().over(inside), "_pv": F.lag(value).over(inside)})
    rows = rows.withColumn("_new", (F.col("_rn") == 1) | ~same(F.col("_pv"), F.col(value)))
    rows = rows.withColumns(
        {
            "_isl": F.sum(F.col("_new").cast("int")).over(upto),
            "_at": F.max(F.when(F.col("_new"), F.col("_rn"))).over(upto),
        }
    )
    whole = Window.partitionBy(*axis.groups, _BLOCK)
    rows = rows.withColumns(
        {
            "_len": F.count(F.lit(1)).over(Window.partitionBy(*axis.groups, _BLOCK, "_isl")),
            "_isls": F.max("_isl").over(whole),
        }
    )
    ends = (
        rows.filter((F.col("_rn") == F.col("_at")) & ((F.col("_isl") == 1) | (F.col("_isl") == F.col("_isls"))))
        .select(*axis.groups, _BLOCK, "_isl", F.col(value).alias("_v"), F.col("_len").alias("_n"))
    )
    across = axis.across("_isl")
    ends = ends.withColumn(
        "_start",
        (F.col("_isl") > 1) | F.lag(F.lit(1)).over(across).isNull() | ~same(F.lag("_v").over(across), F.col("_v")),
    )
    ends = ends.withColumn("_run", F.sum(F.col("_start").cast("bigint")).over(across))
    chain = Window.partitionBy(*axis.groups, "_run")
    ends = ends.withColumns(
        {
            "_total": F.sum("_n").over(chain),
            "_prior": F.sum("_n").over(chain.orderBy(_BLOCK, "_isl").rowsBetween(Window.unboundedPreceding, -1)),
        }
    ).select(*axis.groups, _BLOCK, "_isl", "_total", "_prior")
    out = rows.join(ends, [*axis.groups, _BLOCK, "_isl"], "left").withColumns(
        {
            "run_length": F.coalesce(F.col("_total"), F.col("_len")),
            "run_position": (F.col("_rn") - F.col("_at") + 1 + F.coalesce(F.col("_prior"), F.lit(0))).cast("bigint"),
        }
    )
    return axis.clean(out, "_rn", "_pv", "_new", "_isl", "_at", "_len", "_isls", "_total", "_prior")


def first_per(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """First ``n`` rows per key group. Spark limits each group before the shuffle, so copies do not pile up."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rk", rank).filter(F.col("_rk") <= n).drop("_rk")


def even_spread(df: DataFrame, axis: Axis, k: int, name: str = "selection_rank") -> DataFrame:
    """``k`` rows at evenly spaced positions of the ordered frame (all rows when there are no more than ``k``)."""
    placed = with_position(df, axis, "_pos")
    size = df.agg(F.count(F.lit(1)).alias("_size"))
    spots = (
        size.filter(F.col("_size") > k)
        .select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_i"), "_size")
        .select(
            (F.floor(F.col("_i") * (F.col("_size") - 1) / max(k - 1, 1) + 0.5) + 1).alias("_pos"),
            (F.col("_i") + 1).cast("bigint").alias(name),
        )
    )
    picked = placed.join(spots, "_pos").drop("_pos")
    everything = (
        attach_row(placed, size).filter(F.col("_size") <= k)
        .withColumn(name, F.col("_pos").cast("bigint")).drop("_pos", "_size")
    )
    return picked.unionByName(everything)

"""Timeline documents: one JSON record per window.

A published timeline is one file with all frames inside. At scale that file
would pass through one task, so frames are rows (JSON lines) next to a small
header document; :mod:`windrow.sources.sinks` writes both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.numbers import min_max
from windrow.functions.text import title_from_id
from windrow.operators.biomarkers import fill_zones, merge_tokens
from windrow.operators.ordered import Axis, attach_row, join_same, time_axis, with_group_stats, with_position

_KEEP_NULLS = {"ignoreNullFields": "false"}


def with_global_scale(zones: DataFrame, value: str, name: str, null_as: float | None = None) -> DataFrame:
    """Min-max over the whole table; a constant table gives 0 if zero, else 1."""
    stats = with_group_stats(zones, [], {"_lo": F.min(value), "_hi": F.max(value)})
    scaled = F.when(F.col("_lo").isNotNull(), min_max(F.col(value), F.col("_lo"), F.col("_hi"), 0.0, 1.0))
    if null_as is not None:
        scaled = F.coalesce(scaled, F.lit(null_as))
    return stats.withColumn(name, scaled).drop("_lo", "_hi")


def grid_timeline(features: DataFrame, zones: DataFrame, normalize: bool = True) -> DataFrame:
    """Frame per window: ids, warnings and every configured zone in (row, col) order.

    ``zones``: ``zone_id, row, col``. Zones without features keep null activity.
    """
    scaled = with_global_scale(features, "activity_mean", "_norm")
    if not normalize:
        scaled = scaled.withColumn("_norm", F.lit(None).cast("double"))
    head = [c for c in ("start_time", "start_us", "room_id", "session_id", "system_id") if c in features.columns]
    per_zone = scaled.groupBy("window_id", "zone_id").agg(F.max("_norm").alias("activity"), F.max("activity_mean").alias("activity_raw"))
    windows = features.groupBy("window_id").agg(*[F.min_by(c, "zone_id").alias(c) for c in head])
    grid = fill_zones(windows, zones.select("zone_id", "row", "col"), per_zone, ["window_id"])
    entry = F.struct("row", "col", "zone_id", "activity", "activity_raw")
    frames = grid.groupBy("window_id", *head).agg(F.array_sort(F.collect_list(entry)).alias("zones"))
    frames = frames.withColumn(
        "zones",
        F.transform("zones", lambda z: F.struct(z["zone_id"].alias("zone_id"), z["row"].alias("row"), z["col"].alias("col"), z["activity"].alias("activity"), z["activity_raw"].alias("activity_raw"))),
    )
    if "warnings" in features.columns:
        merged = merge_tokens(features, ["window_id"], F.col("zone_id"))
        frames = join_same(frames, merged, ["window_id"])
        frames = frames.withColumn("warnings", F.when(F.col("warnings").isNotNull(), F.split("warnings", ";")).otherwise(F.array().cast("array<string>")))
    return frames


def overlay_intensity(norm: Column) -> Column:
    return F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0))


def twin_timeline(zones: DataFrame, biomarkers: DataFrame, states: DataFrame, axis: Axis | None = None) -> DataFrame:
    """Frame per window with metrics, state, welfare, zones and event structs, numbered from 0 in time order."""
    axis = axis or time_axis((), "start_us", "window_id")
    source = zones.withColumn("activity_mean", F.coalesce("activity_mean", "activity_proxy_raw")) if "activity_proxy_raw" in zones.columns else zones
    scaled = with_global_scale(source, "activity_mean", "activity_norm", 0.0)
    entry = F.struct(
        "zone_id", F.col("activity_mean").alias("activity"), "activity_norm", overlay_intensity(F.col("activity_norm")).alias("overlay_intensity")
    )
    # one row per window and zone, so the list is as long as the zone configuration
    single = scaled.groupBy("room_id", "window_id", "zone_id").agg(F.max("activity_mean").alias("activity_mean"), F.max("activity_norm").alias("activity_norm"))
    lists = single.groupBy("room_id", "window_id").agg(F.array_sort(F.collect_list(entry)).alias("zones"))
    state_columns = [c for c in ("state_id", "state_label", "state_probability_max", "welfare_risk_score", "risk_level", "sustained_risk_flag") if c in states.columns]
    keys = ["window_id", "room_id"]
    df = join_same(biomarkers.drop(*state_columns), states.select(*keys, *state_columns), keys)
    df = join_same(df, lists, keys)
    df = with_position(df, axis, "frame_index").withColumn("frame_index", F.col("frame_index") - 1)

    def opt(name: str, kind: str) -> Column:
        return (F.col(name) if name in df.columns else F.lit(None)).cast(kind)

    return df.select(
        "frame_index", "window_id", "room_id", opt("start_time", "string").alias("start_time"), opt("end_time", "string").alias("end_time"),
        F.struct(*[opt(c, "double").alias(c) for c in ("mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "activity_mean")]).alias("metrics"),
        F.struct(opt("state_id", "int").alias("state_id"), opt("state_label", "string").alias("state_label"), opt("state_probability_max", "double").alias("state_probability")).alias("state"),
        F.struct(opt("welfare_risk_score", "double").alias("risk_score"), opt("risk_level", "string").alias("risk_level"), F.coalesce(opt("sustained_risk_flag", "boolean"), F.lit(False)).alias("sustained_risk_flag")).alias("welfare"),
        F.coalesce("zones", F.array().cast(lists.schema["zones"].dataType)).alias("zones"),
        F.struct(opt("event_id", "string").alias("event_id"), F.coalesce(opt("event_phase", "string"), F.lit("normal")).alias("event_phase"), opt("event_type", "string").alias("event_type")).alias("event"),
    )


def room_headers(rooms: DataFrame, zones: DataFrame) -> DataFrame:
    """Room entries of the header document: display names, cells and unit-square polygons."""
    cell = F.struct(
        F.col("row").alias("row"), F.col("col").alias("col"), F.col("zone_id").alias("zone_id"), title_from_id("zone_id").alias("display_name"),
        F.array(*[F.struct((F.col("col") + dx).cast("double").alias("x"), (F.col("row") + dy).cast("double").alias("y")) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1))]).alias("polygon"),
    )
    # the zone configuration: a handful of rows
    layout = zones.agg(F.array_sort(F.collect_list(cell)).alias("zones"))
    return attach_row(rooms.select("room_id").filter("room_id is not null and room_id <> ''").distinct(), layout)


#: Entries of a header document, which is one text.
MOST_HEADER_ROWS = 10_000


def header_rows(entries: DataFrame, *order: str) -> list[dict]:
    """Rows of a header as dicts in order; an error beyond ``MOST_HEADER_ROWS``."""
    rows = entries.orderBy(*order).limit(MOST_HEADER_ROWS + 1).collect()
    if len(rows) > MOST_HEADER_ROWS:
        raise ValueError(f"a header holds at most {MOST_HEADER_ROWS} entries")
    return [r.asDict(recursive=True) for r in rows]


def to_json_lines(frames: DataFrame) -> DataFrame:
    """One JSON text per frame, nulls written out."""
    return frames.select(F.to_json(F.struct("*"), _KEEP_NULLS).alias("value"))


def timeline_pivot(zones: DataFrame, names: list[str], window: list[str], value: str = "activity_mean") -> DataFrame:
    """Window × zone table of means with the zones as columns in the given order."""
    return zones.groupBy(*window).pivot("zone_id", names).agg(F.avg(value))

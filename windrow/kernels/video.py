"""Frame-difference activity per zone.

Frames are rows (``media_id, room_id, frame_time_sec, height, width, pixels``), grey values as one byte a pixel. Frames
are spread by (recording, block of time) and differenced where they lie, in order; of each block only the first
and the last frame go into a second pass that pairs the edges of neighbouring blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from windrow.functions.text import combine_warnings
from windrow.kernels.streams import grouped
from windrow.operators.biomarkers import activity_share, fill_zones
from windrow.operators.windowing import aggregate_points
from windrow.settings import WindowSettings

_SCHEMA = (
    "media_id string, interval_start_sec double, interval_end_sec double, interval_center_sec double, zone_id string, "
    "activity_mean double, activity_std double, activity_sum double, motion_ratio double"
)
#: Masks of all rooms travel with the tasks; more cells than this must be configured as a table of polygons instead.
MOST_MASK_CELLS = 1 << 27

#: Zone masks by room; the entry for None serves rooms without one of their own.
Masks = dict[str | None, dict[str, np.ndarray]]


def grey(frame: np.ndarray) -> np.ndarray:
    """Blue-green-red bytes to grey values in [0, 1]."""
    return (frame[..., 0] * 0.114 + frame[..., 1] * 0.587 + frame[..., 2] * 0.299) / 255.0


def shrink(frame: np.ndarray, width: int) -> np.ndarray:
    """Area-averaged copy of a grey frame with the given width; the aspect ratio is kept."""
    height = max(1, round(frame.shape[0] * width / frame.shape[1]))

    def weights(n: int, m: int) -> np.ndarray:
        edges = np.linspace(0, n, m + 1)
        cells = np.arange(n)
        cover = np.minimum(edges[1:, None], cells[None, :] + 1) - np.maximum(edges[:-1, None], cells[None, :])
        cover = np.clip(cover, 0, None)
        return cover / cover.sum(axis=1, keepdims=True)

    return weights(frame.shape[0], height) @ frame @ weights(frame.shape[1], width).T


class _Zones:
    """Masks of a room as one table (pixels, zones), made once a task and shape."""

    def __init__(self, masks: Masks):
        self.masks, self.made = masks, {}

    def of(self, room: str | None, size: int) -> tuple[list[str], np.ndarray]:
        if (room, size) not in self.made:
            named = self.masks.get(room, self.masks.get(None, {}))
            fitting = {z: m.ravel() for z, m in named.items() if m.size == size}
            self.made[room, size] = list(fitting), np.array(list(fitting.values()), dtype=np.float64).reshape(-1, size).T
        return self.made[room, size]


def _changes(zones: _Zones, media: str, room: str | None, times: list[float], frames: list[bytes], threshold: float) -> Iterator[tuple]:
    """Measures of consecutive frames of one size, all pairs and zones at once."""
    names, table = zones.of(room, len(frames[0]))
    if len(frames) < 2 or not names:
        return
    pixels = np.frombuffer(b"".join(frames), np.uint8).reshape(len(frames), -1).astype(np.float64) / 255.0
    change = np.abs(np.diff(pixels, axis=0))
    cells = table.sum(axis=0)
    some = np.where(cells > 0, cells, np.nan)
    total = change @ table
    mean = total / some
    # deviations from the mean itself, not a difference of squares
    spread = np.stack([np.sqrt((((change - mean[:, [k]]) ** 2) @ table[:, k]) / some[k]) for k in range(len(names))], axis=1)
    moved = (change > threshold).astype(np.float64) @ table / some
    for i in range(len(change)):
        for k, zone in enumerate(names):
            values = (mean[i, k], spread[i, k], total[i, k], moved[i, k]) if cells[k] else (None,) * 4
            yield (media, times[i], times[i + 1], (times[i] + times[i + 1]) / 2, zone, *[v if v is None else float(v) for v in values])


def frame_differences(frames: DataFrame, masks: Masks, motion_threshold: float = 0.05, block_seconds: int = 60, slab: int = 64) -> DataFrame:
    """Mean, deviation and sum of the absolute change per zone between consecutive frames, and the share of pixels above the threshold.

    Frames that differ in size from the one before start anew; rooms without masks (and masks of another size) give no rows.
    ``slab`` bounds the frames in memory.
    """
    if sum(m.size for zones in masks.values() for m in zones.values()) > MOST_MASK_CELLS:
        raise ValueError("too many mask cells to send with every task")
    zones, schema = _Zones(masks), to_arrow_schema(StructType.fromDDL(_SCHEMA))
    room = F.col("room_id").cast("string") if "room_id" in frames.columns else F.lit(None).cast("string")
    rows = frames.select("media_id", room.alias("room_id"), F.col("frame_time_sec").cast("double").alias("frame_time_sec"), F.col("pixels").cast("binary").alias("pixels"))
    rows = rows.filter(F.length("pixels") > 0).withColumn("_block", F.floor(F.col("frame_time_sec") / block_seconds))

    def emit(key: tuple, group: Iterator[dict]) -> Iterator[tuple]:
        held: list[dict] = []
        for row in group:
            if held and len(row["pixels"]) != len(held[-1]["pixels"]):
                yield from measured(held)
                held = []
            held.append(row)
            if len(held) > slab:
                yield from measured(held)
                held = held[-1:]
        if held:
            yield from measured(held)

    def measured(held: list[dict]) -> Iterator[tuple]:
        yield from _changes(zones, held[0]["media_id"], held[0]["room_id"], [r["frame_time_sec"] for r in held], [r["pixels"] for r in held], motion_threshold)

    inside = rows.repartition("media_id", "_block").sortWithinPartitions("media_id", "_block", "frame_time_sec").mapInArrow(grouped(emit, ["media_id", "_block"], schema), _SCHEMA)
    frame = F.struct("frame_time_sec", "room_id", "pixels")
    ends = rows.groupBy("media_id", "_block").agg(F.min_by(frame, "frame_time_sec").alias("_first"), F.max_by(frame, "frame_time_sec").alias("_last"))
    edges = ends.withColumn("_before", F.lag("_last").over(Window.partitionBy("media_id").orderBy("_block"))).filter("_before IS NOT NULL")
    couples = edges.select("media_id", "_block", F.explode(F.array("_before", "_first")).alias("_f")).select("media_id", "_block", "_f.*")
    across = couples.repartition("media_id", "_block").sortWithinPartitions("media_id", "_block", "frame_time_sec").mapInArrow(grouped(emit, ["media_id", "_block"], schema), _SCHEMA)
    return inside.unionByName(across)


def zone_features(windows: DataFrame, metrics: DataFrame, media: DataFrame, areas: DataFrame, settings: WindowSettings = WindowSettings(), keep_media_status: bool = True) -> DataFrame:
    """Interval metrics → one row per window and zone, with status, warnings and the zone's part of the activity.

    ``areas`` with a ``room_id`` is a configuration per room; a window of a room without one is a single failed row without a
    zone. A window without intervals is ``failed``; with ``keep_media_status`` a media
    status other than ``ok`` is shown instead.
    """
    measured = aggregate_points(
        metrics, media,
        {"activity_mean": F.avg("activity_mean"), "activity_std": F.avg("activity_std"), "activity_sum": F.sum(F.coalesce("activity_sum", F.lit(0.0))), "frame_count_used": F.count(F.lit(1))},
        settings, at="interval_center_sec", by=["zone_id"],
    )
    grid = fill_zones(windows, areas, measured, ["media_id", "window_index"])
    none = F.coalesce("frame_count_used", F.lit(0)) == 0
    status = F.when(none, F.lit("failed")).otherwise(F.lit("ok"))
    if keep_media_status:
        status = F.when(F.coalesce("quality_status", F.lit("ok")) == "ok", status).otherwise(F.col("quality_status"))
    df = grid.withColumns(
        {
            "frame_count_used": F.coalesce("frame_count_used", F.lit(0)),
            "quality_status": status,
            "warnings": combine_warnings("warnings", F.when(F.col("zone_id").isNull(), F.lit("missing_semantic_zone_config")).when(none, F.lit("no_interval_overlap"))),
        }
    )
    return activity_share(df)

"""Window selection and grid activity → timeline frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.functions.text import combine_warnings
from windrow.operators.biomarkers import fill_zones
from windrow.operators.ordered import Axis
from windrow.operators.selection import select_windows
from windrow.operators.timeline import grid_timeline, header_rows
from windrow.operators.windowing import aggregate_points
from windrow.settings import WindowSettings


def select(windows: DataFrame, k: int | None = None, per_session: int | None = None, **filters) -> DataFrame:
    """Filtered, capped and evenly spread windows in time order."""
    # blocks follow the calendar day in the text
    day = F.datediff(F.substring("start_time", 1, 10).try_cast("date"), F.lit("1970-01-01").cast("date"))
    return select_windows(windows, Axis((), ("start_time", "window_id"), day), k, per_session, **filters)


def measure(windows: DataFrame, media: DataFrame, metrics: DataFrame, samples: DataFrame, zones: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Interval metrics and sample times → one row per window and grid zone; failed windows give null rows.

    ``metrics``: ``media_id, interval_end_sec, zone_id, activity_mean, motion_ratio``; ``samples``: ``media_id, sample_sec``.
    """
    measured = aggregate_points(
        metrics, media,
        {"activity_mean": F.avg("activity_mean"), "activity_std": F.stddev_pop("activity_mean"), "motion_pixel_ratio": F.avg("motion_ratio")},
        settings, at="interval_end_sec", bounds="end", by=["zone_id"],
    )
    counts = aggregate_points(samples, media, {"frame_count": F.count(F.lit(1))}, settings, at="sample_sec", bounds="closed")
    grid = fill_zones(windows, zones.select("zone_id"), measured, ["media_id", "window_index"])
    grid = grid.join(counts, ["media_id", "window_index"], "left")
    empty = F.col("activity_mean").isNull()
    return grid.withColumns(
        {
            "frame_count": F.coalesce("frame_count", F.lit(0)),
            "warnings": combine_warnings("warnings", F.when(empty, F.lit("insufficient_frames_for_optical_flow"))),
        }
    )


def timeline(features: DataFrame, zones: DataFrame, normalize: bool = True) -> tuple[DataFrame, dict]:
    """Frames and the header document."""
    layout = header_rows(zones.select("zone_id", "row", "col"), "row", "col")
    header = {"metadata": {"title": "zone activity timeline", "activity_normalized": normalize}, "zones": layout}
    return grid_timeline(features, zones, normalize), header

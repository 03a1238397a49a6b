"""Sliding windows over media files, and joining points into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.text import combine_warnings
from windrow.functions.times import iso_text, local_time, micros_ntz, ntz_micros, offset_text
from windrow.session import spread
from windrow.settings import MICROS, WindowSettings

_CHUNK = 8_192


def _explode_index(media: DataFrame, count: Column, key: str) -> DataFrame:
    """One row per window index. Long recordings are first split into chunks that are spread over tasks."""
    counted = media.withColumn("_n", count).filter(F.col("_n") > 0)
    chunks = counted.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1, F.lit(_CHUNK).cast("bigint"))))
    upto = F.least(F.col("_from") + _CHUNK, F.col("_n")) - 1
    return spread(chunks, key, "_from").withColumn("window_index", F.explode(F.sequence(F.col("_from"), upto))).drop("_from", "_n")


def full_window_count(duration: Column, window: float, stride: float, slack: float) -> Column:
    return F.when(
        duration + slack >= window, F.floor((duration - window + slack) / stride).cast("bigint") + 1
    ).otherwise(F.lit(0).cast("bigint"))


def _with_clock(media: DataFrame) -> DataFrame:
    """Start of a recording read once, before its row is multiplied."""
    return media.withColumns({"_wall": ntz_micros(local_time("start_time")), "_zone": offset_text("start_time")})


def _clock_at(seconds: Column) -> Column:
    return F.concat(iso_text(micros_ntz(F.col("_wall") + F.round(seconds * MICROS).cast("bigint"))), F.col("_zone"))


def sliding_windows(media: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Window index with one partial window for short media and one nominal window for unknown length.

    Adds ``window_index`` (from 0), ``window_id``, ``video_start_offset_sec``,
    ``duration_seconds``, ``start_time``, ``end_time`` and adjusted status and warnings.
    """
    w, s = float(settings.window_seconds), float(settings.stride_seconds)
    length = F.coalesce(F.col("duration_seconds").cast("double"), F.lit(0.0))
    count = F.greatest(full_window_count(length, w, s, 1e-9), F.lit(1).cast("bigint"))
    rows = _explode_index(_with_clock(media).withColumn("_len", length), count, "media_id")
    offset = F.round(F.col("window_index") * s, 6)
    effective = F.when(F.col("_len") <= 0, F.lit(w)).otherwise(
        F.least(F.lit(w), F.greatest(F.col("_len") - offset, F.lit(0.0)))
    )
    note = F.when(F.col("_len") <= 0, F.lit("missing_or_zero_duration")).when(
        F.col("_len") < w, F.lit("short_media_partial_window")
    )
    status = F.coalesce(F.nullif(F.col("quality_status"), F.lit("")), F.lit("ok"))
    rows = rows.withColumns({"_off": offset, "_eff": effective, "_note": note})
    return rows.withColumns(
        {
            "window_id": _window_id(),
            "end_time": F.coalesce(_clock_at(F.col("_off") + F.col("_eff")), F.lit("")),
            "start_time": F.coalesce(_clock_at(F.col("_off")), F.lit("")),
            "duration_seconds": F.col("_eff"),
            "video_start_offset_sec": F.col("_off"),
            "has_audio": F.coalesce(F.col("has_audio"), F.lit(False)),
            "quality_status": F.when((F.col("_len") <= 0) & (status == "ok"), F.lit("warning")).otherwise(status),
            "warnings": combine_warnings("warnings", "_note"),
        }
    ).drop("_len", "_off", "_eff", "_note", "_wall", "_zone")


def full_windows(media: DataFrame, settings: WindowSettings = WindowSettings()) -> DataFrame:
    """Window index with complete windows only (one millisecond of slack); rows without start or length vanish."""
    w, s = float(settings.window_seconds), float(settings.stride_seconds)
    known = media.filter(F.col("duration_seconds").isNotNull() & (F.coalesce(F.col("start_time"), F.lit("")) != ""))
    rows = _explode_index(_with_clock(known), full_window_count(F.col("duration_seconds").cast("double"), w, s, 1e-3), "media_id")
    offset = F.round(F.col("window_index") * s, 3)
    return rows.withColumn("_off", offset).withColumns(
        {
            "window_id": _window_id(),
            "end_time": _clock_at(F.col("_off") + w),
            "start_time": _clock_at(F.col("_off")),
            "duration_seconds": F.lit(round(w, 3)),
            "video_start_offset_sec": F.col("_off"),
        }
    ).drop("_off", "_wall", "_zone")


def _window_id() -> Column:
    number = (F.col("window_index") + 1).cast("string")
    return F.concat(F.col("media_id").cast("string"), F.lit("_w"), F.when(F.length(number) >= 4, number).otherwise(F.lpad(number, 4, "0")))


def assign_points(
    points: DataFrame,
    media: DataFrame,
    settings: WindowSettings = WindowSettings(),
    at: str = "center_sec",
    bounds: str = "center",
    rows: int | None = None,
) -> DataFrame:
    """Points repeated once per window that contains them, with ``window_index``.

    Regular windows let the indexes be computed from the point's offset, so a
    range join becomes an explode into ``ceil(window / stride)`` rows. The
    exact bounds are checked again, which settles partial windows and float
    edges. ``bounds``: ``center`` is ``[start, end)``; ``end`` is
    ``(start + 1e-9, end + 1e-6]``; ``closed`` is ``[start - 1e-9, end + 1e-6]``.

    Points multiply after they met their recording, so they are spread by count (``rows``, when known) and not by their bytes.
    """
    w, s = float(settings.window_seconds), float(settings.stride_seconds)
    t = F.col(at)
    lengths = media.select("media_id", F.coalesce(F.col("duration_seconds").cast("double"), F.lit(0.0)).alias("_len"))
    joined = spread(points, "media_id", rows=rows).join(lengths, "media_id")
    last = F.greatest(full_window_count(F.col("_len"), w, s, 1e-9), F.lit(1).cast("bigint")) - 1
    low = F.greatest(F.floor((t - w) / s).cast("bigint") - 1, F.lit(0).cast("bigint"))
    high = F.least(F.floor(t / s).cast("bigint") + 1, last)
    hits = joined.filter(t.isNotNull() & (low <= high)).withColumn("window_index", F.explode(F.sequence(low, high)))
    start = F.round(F.col("window_index") * s, 6)
    size = F.when(F.col("_len") <= 0, F.lit(w)).otherwise(F.least(F.lit(w), F.greatest(F.col("_len") - start, F.lit(0.0))))
    end = start + size
    inside = {
        "center": (t >= start) & (t < end),
        "end": (t > start + 1e-9) & (t <= end + 1e-6),
        "closed": (t >= start - 1e-9) & (t <= end + 1e-6),
    }[bounds]
    return hits.filter(inside).drop("_len")


def aggregate_points(
    points: DataFrame,
    media: DataFrame,
    measures: dict[str, Column],
    settings: WindowSettings = WindowSettings(),
    at: str = "center_sec",
    bounds: str = "center",
    by: list[str] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Per window (and per ``by`` column, e.g. zone) aggregates of the points inside it; ``rows`` is the number of points, when known."""
    inside = assign_points(points, media, settings, at, bounds, rows)
    return inside.groupBy("media_id", "window_index", *(by or [])).agg(*[c.alias(n) for n, c in measures.items()])

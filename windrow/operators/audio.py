"""Audio frame features → windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.operators.windowing import aggregate_points
from windrow.settings import AUDIO_FEATURES, WindowSettings


def audio_windows(
    frames: DataFrame,
    media: DataFrame,
    windows: DataFrame,
    frame_seconds: float = 1.0,
    features: list[str] | None = None,
    settings: WindowSettings = WindowSettings(),
    duration: str = "window",
    rows: int | None = None,
) -> DataFrame:
    """Mean features of the frames centred in each window; every window keeps a row.

    ``duration``: ``window`` reports the window's length, ``covered`` the seconds
    of frames found (zero without sound) and also flags partly covered windows.
    A media-level ``audio_issue`` column in ``media`` explains missing sound. ``rows`` is the number of frames, when known.
    """
    names = list(features or AUDIO_FEATURES)
    measured = aggregate_points(
        frames, media, {**{n: F.avg(n) for n in names}, "_frames": F.count(F.lit(1))}, settings, at="frame_center_sec", rows=rows
    )
    df = windows.join(measured, ["media_id", "window_index"], "left")
    if "audio_issue" in media.columns:
        df = df.join(media.select("media_id", "audio_issue"), "media_id", "left")
    else:
        df = df.withColumn("audio_issue", F.lit(None).cast("string"))
    has_audio, found = F.coalesce("has_audio", F.lit(False)), F.col("_frames").isNotNull()
    df = df.withColumn("audio_available", has_audio & found & F.col("audio_issue").isNull())
    available = F.col("audio_available")
    covered = F.coalesce("_frames", F.lit(0)) * float(frame_seconds)
    flag = F.when(~has_audio, F.lit("manifest_has_audio_false")).when(F.col("audio_issue").isNotNull(), F.col("audio_issue")).when(
        ~found, F.lit("insufficient_audio_frames")
    )
    if duration == "covered":
        flag = flag.when(covered + 1e-6 < F.greatest(F.lit(0.0), F.col("duration_seconds") - frame_seconds), F.lit("partial_audio_window"))
        seconds = F.when(has_audio, covered).otherwise(F.lit(0.0))
    else:
        seconds = F.col("duration_seconds")
    return df.withColumns(
        {**{n: F.when(available, F.col(n)) for n in names}, "audio_duration_sec": seconds, "audio_quality_flag": flag.otherwise(F.lit("ok"))}
    ).drop("_frames", "audio_issue")

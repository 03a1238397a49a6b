"""Scanned files → manifest and window index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.functions.media import cleaning_manifest
from windrow.operators import stats
from windrow.operators.selection import first_mapping
from windrow.operators.windowing import full_windows
from windrow.plans.preparation import Store, keep_plan
from windrow.settings import WindowSettings


def clean_recordings(
    files: DataFrame, mapping: DataFrame | None = None, zone: str = "UTC", settings: WindowSettings = WindowSettings(), store: Store = keep_plan
) -> dict[str, DataFrame]:
    """``files`` as for :func:`cleaning_manifest`; ``mapping`` as for :func:`first_mapping`."""
    if mapping is not None:
        files = first_mapping(files, mapping)
    manifest = store("media_manifest", cleaning_manifest(files, zone))
    windows = full_windows(manifest, settings).withColumnRenamed("file_path", "video_path")
    return {"media_manifest": manifest, "video_window_index": windows}


def summarise(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The counts behind the run report."""
    manifest = tables["media_manifest"]
    return {
        "status": stats.count_by(manifest, "quality_status"),
        "warnings": stats.token_counts(manifest, "warnings").orderBy(F.col("n").desc(), "token"),
        "rooms": stats.count_by(manifest, "room_id", "session_id"),
        "windows": stats.count_by(tables["video_window_index"], "room_id"),
    }

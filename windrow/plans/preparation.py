"""Manifest, measurements and climate → the hand-off tables of several rooms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from windrow.functions.media import preparation_manifest
from windrow.functions.times import with_time_columns
from windrow.kernels.video import zone_features
from windrow.operators import stats
from windrow.operators.audio import audio_windows
from windrow.operators.biomarkers import semantic_biomarkers
from windrow.operators.merge import combine_failed, merge_modalities
from windrow.operators.selection import cap_groups
from windrow.operators.windowing import sliding_windows
from windrow.settings import WindowSettings

# Stages, and which steps each one runs.
STAGES = {
    "index": {"index"},
    "zones": {"zones"},
    "video_features": {"index", "zones", "video"},
    "audio_features": {"index", "audio"},
    "env": {"env"},
    "merge": {"index", "zones", "video", "audio", "env", "merge"},
    "all": {"index", "zones", "video", "audio", "env", "merge"},
}


Store = Callable[[str, DataFrame], DataFrame]


def keep_plan(name: str, df: DataFrame) -> DataFrame:
    return df


def index_recordings(
    files: DataFrame, settings: WindowSettings = WindowSettings(), caps: dict[str, int | None] | None = None, store: Store = keep_plan
) -> dict[str, DataFrame]:
    """Manifest and window index; ``caps`` limits windows per media, per room and overall.

    ``store`` may write a finished table and hand back the written one, so that
    later steps read it instead of computing it again.
    """
    manifest = store("media_manifest", preparation_manifest(files))
    windows = sliding_windows(manifest, settings)
    caps = caps or {}
    limits = [(["media_id"], caps.get("per_media")), (["room_id"], caps.get("per_room")), ([], caps.get("total"))]
    if any(n is not None for _, n in limits):
        windows = cap_groups(windows, limits, ["room_id", "session_id", "start_time", "window_id"])
    return {"media_manifest": manifest, "video_window_index": store("video_window_index", windows)}


def zone_configuration(areas: DataFrame, rooms: DataFrame | None = None) -> DataFrame:
    """Per room, the number of zones and a status; ``rooms`` (``room_id``) adds rooms without zones."""
    if "room_id" not in areas.columns:
        areas = areas.withColumn("room_id", F.lit(None).cast("string"))
    sums = areas.groupBy("room_id").agg(F.countDistinct("zone_id").alias("zone_count"), F.count(F.lit(1)).alias("_rows"))
    if rooms is not None:
        sums = rooms.select("room_id").distinct().join(sums, "room_id", "full")
    status = F.when(F.col("zone_count").isNull(), F.lit("missing_semantic_zone_config")).when(F.col("zone_count") < F.col("_rows"), F.lit("repeated_zone")).otherwise(F.lit("ok"))
    return sums.select("room_id", F.coalesce("zone_count", F.lit(0)).alias("zone_count"), status.alias("status"))


def failed_rows(rows: DataFrame, stage: str, issue: str = "no_interval_overlap") -> DataFrame:
    return rows.select(F.lit(stage).alias("stage"), "window_id", "media_id", "room_id", F.lit(issue).alias("issue")).distinct()


def prepare(
    manifest: DataFrame,
    windows: DataFrame,
    interval_metrics: DataFrame | None,
    zone_areas: DataFrame | None,
    audio_frames: DataFrame | None,
    climate: DataFrame | None,
    settings: WindowSettings = WindowSettings(),
    frame_seconds: float = 1.0,
    store: Store = keep_plan,
    steps: set[str] | frozenset[str] = frozenset(STAGES["all"]),
) -> dict[str, DataFrame]:
    """Feature tables and the merged window table from measured intervals, audio frames and daily climate.

    Each finished table goes through ``store`` (see :func:`index_recordings`). The merged table and the list of failed
    windows belong to the step ``merge``; other stages leave those of an earlier run alone.
    """
    timed = with_time_columns(windows)
    out: dict[str, DataFrame] = {}
    failed = []
    if interval_metrics is not None and zone_areas is not None:
        zones = store("semantic_zone_video_features", zone_features(timed, interval_metrics, manifest, zone_areas, settings))
        out["semantic_zone_video_features"] = zones
        out["semantic_biomarker_window_table"] = store("semantic_biomarker_window_table", semantic_biomarkers(zones.filter("zone_id is not null"), ("room_id",)))
        lacking = zones.filter("zone_id is null")
        failed.append(failed_rows(lacking, "video_features", "missing_semantic_zone_config"))
        failed.append(failed_rows(zones.filter("zone_id is not null and frame_count_used = 0"), "video_features"))
    if audio_frames is not None:
        audio = audio_windows(audio_frames, manifest, windows, frame_seconds, settings=settings).withColumn("warnings", F.lit(""))
        audio = store("audio_window_features", audio)
        out["audio_window_features"] = audio
        failed.append(audio.filter("not audio_available").select(F.lit("audio_features").alias("stage"), "window_id", "media_id", "room_id", F.col("audio_quality_flag").alias("issue")))
    if climate is not None:
        climate = store("env_daily", climate)
        out["env_daily"] = climate
    if "merge" in steps and "semantic_biomarker_window_table" in out:
        keep = ["window_id", "media_id", "room_id", "session_id", "start_time", "end_time"]
        audio_part = None
        if "audio_window_features" in out:
            audio_part = out["audio_window_features"].select(*keep, *[c for c in out["audio_window_features"].columns if c.startswith("audio_")], "warnings")
        merged = merge_modalities(timed, out["semantic_biomarker_window_table"], audio_part, climate)
        out["processed_multimodal_window_table"] = store("processed_multimodal_window_table", merged)
    if failed and "merge" in steps:
        out["failed_windows"] = store("failed_windows", combine_failed(*failed))
    return out


def summarise(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The figures behind the hand-off report."""
    merged = tables["processed_multimodal_window_table"]
    return {
        "coverage": stats.coverage(
            merged, {"video": F.col("activity_mean").isNotNull(), "audio": F.col("audio_available"), "climate": F.col("temp_context").isNotNull()}
        ),
        "status": stats.count_by(merged, "quality_status"),
        "sessions": stats.session_coverage(merged),
        "missing": stats.missing_counts(merged),
    }

"""Recordings below a folder → sound frames and frame differences, measured once per recording and configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.kernels import zones as zn
from windrow.kernels.audio import audio_frames
from windrow.kernels.video import frame_differences
from windrow.session import cut_lineage, spread
from windrow.sources import cache, media as sm
from windrow.sources.recordings import RecordingTable


@dataclass(frozen=True)
class MeasureSettings:
    sample_rate: int = 22_050
    frame_seconds: float = 1.0
    resize_width: int = 320
    sample_period: float = 2.0
    motion_threshold: float = 0.05
    batches: int = 1
    audio_command: str = sm.FFMPEG_AUDIO
    frames_command: str = sm.FFMPEG_FRAMES


def listed(spark: SparkSession, roots: list[str], pattern: str = "*.[mM][pP]4", positional: bool = False) -> DataFrame:
    """Recordings below several folders with ids and rooms, each file once."""
    return sm.with_rooms(sm.with_media_ids(sm.union_scans(*[sm.scan_media(spark, root, pattern) for root in roots]), positional=positional))


def _failed(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("issue").isNotNull()).select("media_id").distinct()


def measure_audio(table: RecordingTable, media: DataFrame, settings: MeasureSettings = MeasureSettings(), force: bool = False) -> int:
    """Sound features of the recordings that are new or changed (path, size, time, sample rate, frame length); failures are tried again."""
    marked = media.withColumn("fingerprint", cache.audio_fingerprint(settings.sample_rate, settings.frame_seconds))

    def work(part: DataFrame) -> DataFrame:
        # one recording is one task: decoding cannot be split
        sound = cut_lineage(sm.decode_audio(spread(part.select("media_id", "file_path"), "media_id"), settings.sample_rate, settings.frame_seconds, settings.audio_command))
        features = audio_frames(sound.filter("issue IS NULL"), settings.sample_rate, settings.frame_seconds)
        issues = sound.filter("issue IS NOT NULL").select("media_id", "issue")
        return features.unionByName(issues, allowMissingColumns=True)

    return table.update(marked, work, settings.batches, force, _failed)


def measure_video(table: RecordingTable, media: DataFrame, configs: list[dict], settings: MeasureSettings = MeasureSettings(), force: bool = False) -> int:
    """Frame differences per zone; ``media`` needs ``width`` and ``height``, ``configs`` are the zone configurations of rooms.

    What changes a result (zones of the room too) is part of the fingerprint.
    """
    signatures = {c["room_id"]: zn.signature(c) for c in configs}
    sign = F.create_map(*[F.lit(x) for pair in signatures.items() for x in pair]) if signatures else None
    signature = F.lit("") if sign is None else F.coalesce(F.try_element_at(sign, F.col("room_id")), F.lit(""))
    marked = media.withColumn("zone_signature", signature).withColumn("fingerprint", cache.video_fingerprint("frame_difference", settings.resize_width, settings.sample_period))

    def work(part: DataFrame) -> DataFrame:
        frames = cut_lineage(sm.decode_frames(spread(part, "media_id"), settings.resize_width, settings.sample_period, settings.frames_command))
        sizes = frames.filter("issue IS NULL").select("room_id", "height").distinct().collect()  # rooms times video formats
        features = None
        for height in sorted({r["height"] for r in sizes}):
            masks = {c["room_id"]: zn.zone_masks(c, settings.resize_width, height) for c in configs}
            one = frame_differences(frames.filter((F.col("height") == height) & F.col("issue").isNull()), masks, settings.motion_threshold)
            features = one if features is None else features.unionByName(one)
        issues = frames.filter("issue IS NOT NULL").select("media_id", "issue").distinct()
        if features is None:
            features = frame_differences(frames.limit(0), {}, settings.motion_threshold)
        return features.unionByName(issues, allowMissingColumns=True)

    return table.update(marked, work, settings.batches, force, _failed)

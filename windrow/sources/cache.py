"""Fingerprint caches: work is redone when anything that shapes its result changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Layout versions of the cached tables.
AUDIO_VERSION = 1
VIDEO_VERSION = 1


def fingerprint(facts: dict[str, Column]) -> Column:
    """Digest of named facts; a missing fact is part of the digest."""
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(facts.items())]), {"ignoreNullFields": "false"}), 256)


def audio_fingerprint(sample_rate: int, frame_seconds: float) -> Column:
    return fingerprint(
        {
            "version": F.lit(AUDIO_VERSION), "sample_rate": F.lit(sample_rate), "frame_seconds": F.lit(float(frame_seconds)),
            "path": F.col("file_path"), "size": F.col("file_size_bytes"), "modified": F.col("modified_time"),
        }
    )


def video_fingerprint(method: str, resize_width: int, sample_period: float) -> Column:
    """Needs a ``zone_signature`` column (see :func:`windrow.kernels.zones.signature`)."""
    return fingerprint(
        {
            "version": F.lit(VIDEO_VERSION), "method": F.lit(method), "resize_width": F.lit(resize_width), "sample_period": F.lit(float(sample_period)),
            "zones": F.col("zone_signature"), "path": F.col("file_path"), "size": F.col("file_size_bytes"), "modified": F.col("modified_time"),
        }
    )


def split_by_cache(media: DataFrame, cached: DataFrame | None, force: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(media to compute, cache rows to reuse). A cache row is valid when its ``fingerprint`` is the expected one."""
    if force or cached is None or "fingerprint" not in cached.columns:
        return media, None
    valid = cached.select("media_id", "fingerprint").distinct()
    todo = media.join(valid, ["media_id", "fingerprint"], "left_anti")
    reuse = cached.join(media.select("media_id", "fingerprint"), ["media_id", "fingerprint"], "left_semi")
    return todo, reuse


def resume(requested: DataFrame, done: DataFrame | None, key: str = "window_id") -> tuple[DataFrame, DataFrame | None]:
    """(pending rows, finished rows still requested)."""
    if done is None:
        return requested, None
    return requested.join(done.select(key), key, "left_anti"), done.join(requested.select(key), key, "left_semi")

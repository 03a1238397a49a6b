"""Media metadata: probe documents, tag timestamps, path context, manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.numbers import first_integer, fraction
from windrow.functions.text import (
    blank_to_null,
    combine_warnings,
    file_name,
    room_display_name,
    room_id_from_path,
    session_id_from_path,
    sorted_warnings,
    token,
)
from windrow.functions.times import clean_time_text, duration_seconds, instant_micros, iso_in_zone, local_time, shift_iso
from windrow.settings import MICROS

# The parts of a probe document that are read.
PROBE_SCHEMA = (
    "struct<streams: array<struct<codec_type: string, codec_name: string, codec_long_name: string, width: string, height: string, "
    "avg_frame_rate: string, r_frame_rate: string, duration: string, sample_rate: string, channels: string, tags: map<string, string>>>, "
    "format: struct<duration: string, tags: map<string, string>>>"
)

# Tag names in order of trust.
TIMESTAMP_KEYS = ("CreationDate", "CreateDate", "MediaCreateDate", "TrackCreateDate", "DateTimeOriginal", "FileModifyDate")
DURATION_KEYS = ("Duration", "MediaDuration", "TrackDuration")

# Warnings that make a recording unusable.
CRITICAL_WARNINGS = (
    "exif_extract_failed", "ffprobe_extract_failed", "missing_timestamp", "invalid_timestamp",
    "missing_duration", "invalid_duration", "missing_video_stream",
)

# Folder layouts, in order.
PATH_LAYOUTS = (
    ("system_id", "room_id", "session_id", "modality"),
    ("room_id", "session_id", "modality"),
    ("modality", "room_id", "session_id"),
)
# Fields that a layout gives.
CONTEXT_FIELDS = ("system_id", "room_id", "session_id", "modality", "source_type")


def first_present(*cols: Column) -> Column:
    return F.coalesce(*[F.when(c != "", c) for c in cols])


def stream_of(document: Column, kind: str) -> Column:
    """First stream of a kind, null if there is none."""
    return F.try_element_at(F.filter(document["streams"], lambda s: s["codec_type"] == kind), F.lit(1))


def probe_fields(text: Column) -> Column:
    """Probe JSON text → struct of typed stream facts and a warning array."""
    doc = F.from_json(text, PROBE_SCHEMA)
    video, audio = stream_of(doc, "video"), stream_of(doc, "audio")
    stated = first_present(doc["format"]["duration"], video["duration"], audio["duration"])
    seconds = duration_seconds(stated)
    created = F.coalesce(
        *[blank_to_null(F.try_element_at(src["tags"], F.lit(k))) for src in (doc["format"], video, audio) for k in ("creation_time", "CreationTime")]
    )
    warnings = F.array(
        F.when(stated.isNotNull() & seconds.isNull(), F.lit("invalid_ffprobe_duration")),
        F.when(video.isNull(), F.lit("missing_video_stream")),
        F.when(audio.isNull(), F.lit("no_embedded_audio_stream")),
    )
    return F.struct(
        first_integer(video["width"]).alias("width"),
        first_integer(video["height"]).alias("height"),
        fraction(first_present(video["avg_frame_rate"], video["r_frame_rate"])).alias("frame_rate"),
        F.trim(first_present(video["codec_name"], video["codec_long_name"])).alias("video_codec"),
        seconds.alias("duration_seconds"),
        audio.isNotNull().alias("has_audio"),
        F.trim(first_present(audio["codec_name"], audio["codec_long_name"])).alias("audio_codec"),
        first_integer(audio["sample_rate"]).alias("audio_sample_rate"),
        first_integer(audio["channels"]).alias("audio_channels"),
        created.alias("creation_time"),
        F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"),
    )


def best_timestamp(tags: Column, zone: str, keys: tuple[str, ...] = TIMESTAMP_KEYS) -> Column:
    """First readable tag → struct(instant, source, warning)."""
    found = F.array(
        *[
            F.struct(
                F.lit(k).alias("source"),
                F.when(F.try_element_at(tags, F.lit(k)) != "", F.try_element_at(tags, F.lit(k))).alias("text"),
            )
            for k in keys
        ]
    )
    stated = F.filter(found, lambda f: f["text"].isNotNull())
    read = F.transform(stated, lambda f: F.struct(f["source"].alias("source"), instant_micros(f["text"], zone).alias("instant_us")))
    good = F.try_element_at(F.filter(read, lambda r: r["instant_us"].isNotNull()), F.lit(1))
    last_bad = F.try_element_at(read, F.lit(-1))
    return F.struct(
        good["instant_us"].alias("instant_us"),
        F.coalesce(good["source"], last_bad["source"]).alias("source"),
        F.when(good.isNull(), F.when(F.size(stated) > 0, F.lit("invalid_timestamp")).otherwise(F.lit("missing_timestamp"))).alias("warning"),
    )


def tag_duration(tags: Column, keys: tuple[str, ...] = DURATION_KEYS) -> Column:
    """First readable duration tag → struct(seconds, warning)."""
    stated = F.filter(F.array(*[F.try_element_at(tags, F.lit(k)) for k in keys]), lambda t: t.isNotNull() & (t != ""))
    good = F.try_element_at(F.filter(F.transform(stated, duration_seconds), lambda s: s.isNotNull()), F.lit(1))
    warning = F.when(good.isNull(), F.when(F.size(stated) > 0, F.lit("invalid_duration")).otherwise(F.lit("missing_duration")))
    return F.struct(good.alias("seconds"), warning.alias("warning"))


def chosen_duration(probe_seconds: Column, probe_warnings: Column, tag_seconds: Column, tag_warning: Column) -> Column:
    """Probe before tag → struct(seconds, warning)."""
    value = F.coalesce(probe_seconds, tag_seconds)
    invalid = F.array_contains(probe_warnings, "invalid_ffprobe_duration") | F.coalesce(tag_warning == "invalid_duration", F.lit(False))
    return F.struct(value.alias("seconds"), F.when(value.isNull(), F.when(invalid, F.lit("invalid_duration")).otherwise(F.lit("missing_duration"))).alias("warning"))


def manifest_status(tokens: Column) -> Column:
    """``error`` with any critical warning, ``warning`` with any other, else ``ok``."""
    critical = F.array(*[F.lit(w) for w in CRITICAL_WARNINGS])
    return F.when(F.arrays_overlap(tokens, critical), "error").when(F.size(tokens) > 0, "warning").otherwise("ok")


def path_context(path: Column, modality: str, layouts: tuple[tuple[str, ...], ...] = PATH_LAYOUTS) -> Column:
    """Folder names → context fields, by the layout of equal depth that best names the modality.

    A layout scores when its modality folder is the wanted modality; the first best one is used.
    """
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    depth = F.size(folders)
    names = F.transform(folders, token)
    wanted = modality.strip().lower()
    ranked = [
        F.when(
            depth == len(layout),
            F.struct(
                (F.when(names[layout.index("modality")] == wanted, 10).otherwise(0) if "modality" in layout else F.lit(0)).alias("score"),
                F.lit(-i).alias("rank"),
                F.struct(*[(names[layout.index(f)] if f in layout else F.lit(None).cast("string")).alias(f) for f in CONTEXT_FIELDS]).alias("fields"),
            ),
        )
        for i, layout in enumerate(layouts)
    ]
    best = F.array_max(F.filter(F.array(*ranked), lambda r: r.isNotNull()))
    fields = best["fields"]
    return F.struct(
        *[(F.coalesce(fields[f], F.lit(wanted)) if f == "modality" else fields[f]).alias(f) for f in CONTEXT_FIELDS],
        F.array_join(folders, "/").alias("source_rel_dir"),
        F.when(best.isNull() & (depth > 0), F.lit("path_context_unmatched")).alias("warning"),
    )


def override(current: Column, new: Column) -> tuple[Column, Column]:
    """Mapping value over path value, and whether it changed anything."""
    value = token(new)
    changed = (F.coalesce(new, F.lit("")) != "") & ~current.eqNullSafe(value)
    return F.when(F.coalesce(new, F.lit("")) != "", value).otherwise(current), changed


def cleaning_manifest(files: DataFrame, zone: str, modality: str = "video", default_zone_config: str = "default_zone", layouts=PATH_LAYOUTS) -> DataFrame:
    """Scanned files with tags and probe text → manifest rows.

    ``files``: ``media_id, file_path, relative_path, tags (map), probe (text),
    issues (array)`` and, when a mapping was applied, ``mapped_*`` and
    ``match_count`` from :func:`windrow.operators.selection.first_mapping`.
    """
    df = files.withColumns(
        {
            "_c": path_context(F.col("relative_path"), modality, layouts),
            "_p": probe_fields(F.coalesce("probe", F.lit("{}"))),
            "_t": best_timestamp(F.col("tags"), zone),
            "_d": tag_duration(F.col("tags")),
        }
    )
    changed = F.lit(False)
    values = {}
    for f in (*CONTEXT_FIELDS, "zone_config_id"):
        current = F.col(f"_c.{f}") if f in CONTEXT_FIELDS else F.lit(None).cast("string")
        if f"mapped_{f}" in files.columns:
            current, differs = override(current, F.col(f"mapped_{f}"))
            changed = changed | differs
        values[f] = current
    df = df.withColumns({f"_v_{f}": c for f, c in values.items()} | {"_changed": changed})
    unknown = {f: F.coalesce(F.col(f"_v_{f}"), F.lit(f"unknown_{f.removesuffix('_id')}")) for f in ("system_id", "room_id", "session_id")}
    df = df.withColumns({f"_k_{f}": c for f, c in unknown.items()})
    duration = chosen_duration(F.col("_p.duration_seconds"), F.col("_p.warnings"), F.col("_d.seconds"), F.col("_d.warning"))
    df = df.withColumn("_dur", duration)
    many = F.col("match_count") > 1 if "match_count" in files.columns else F.lit(False)
    notes = F.concat(
        F.coalesce("issues", F.array().cast("array<string>")),
        F.filter("_p.warnings", lambda w: w != "invalid_ffprobe_duration"),
        F.array(
            F.col("_c.warning"), F.when(F.col("_changed"), F.lit("mapping_override")), F.when(many, F.lit("multiple_mapping_matches")),
            *[F.when(F.col(f"_k_{f}") == f"unknown_{f.removesuffix('_id')}", F.lit(f"unknown_{f.removesuffix('_id')}")) for f in unknown],
            F.col("_t.warning"), F.col("_dur.warning"),
        ),
    )
    df = df.withColumn("_w", F.array_distinct(F.filter(notes, lambda w: w.isNotNull())))
    start, length = F.col("_t.instant_us"), F.col("_dur.seconds")
    return df.select(
        "media_id", F.lit(modality).alias("media_type"), *[F.col(f"_k_{f}").alias(f) for f in unknown],
        F.coalesce("_v_modality", F.lit(modality)).alias("modality"), F.coalesce("_v_source_type", F.lit("")).alias("source_type"),
        F.coalesce("_v_zone_config_id", F.lit(default_zone_config)).alias("zone_config_id"), "file_path",
        file_name("file_path").alias("file_name"), F.col("_c.source_rel_dir").alias("source_rel_dir"),
        F.coalesce(iso_in_zone(start, zone), F.lit("")).alias("start_time"),
        F.coalesce(iso_in_zone(start + F.round(length * MICROS).cast("bigint"), zone), F.lit("")).alias("end_time"),
        F.round(length, 3).alias("duration_seconds"), F.lit(zone).alias("timezone"),
        *[F.col(f"_p.{f}").alias(f) for f in ("width", "height")], F.round("_p.frame_rate", 3).alias("frame_rate"),
        *[F.col(f"_p.{f}").alias(f) for f in ("video_codec", "has_audio", "audio_codec", "audio_sample_rate", "audio_channels")],
        manifest_status(F.col("_w")).alias("quality_status"), sorted_warnings(F.col("_w")).alias("warnings"),
    )


def preparation_manifest(files: DataFrame) -> DataFrame:
    """Scanned files with probe text and optional tags → multi-room manifest rows.

    ``files``: ``media_id, relative_path, file_size_bytes, modified_time (ISO text), tags (map), probe (text), probe_failed (boolean)``.
    """
    keys = tuple(k for k in TIMESTAMP_KEYS if k != "FileModifyDate")
    df = files.withColumn("_p", probe_fields(F.coalesce("probe", F.lit("{}"))))
    tag = F.coalesce(*[F.when(local_time(F.try_element_at("tags", F.lit(k))).isNotNull(), F.try_element_at("tags", F.lit(k))) for k in keys])
    created = F.when(local_time("_p.creation_time").isNotNull(), F.col("_p.creation_time"))
    df = df.withColumns(
        {
            "room_id": room_id_from_path("relative_path"),
            "start_time": F.regexp_replace(clean_time_text(F.coalesce(tag, created, F.col("modified_time"))), "Z$", "+00:00"),
            "timestamp_source": F.when(tag.isNotNull(), "exiftool").when(created.isNotNull(), "ffprobe_creation_time").otherwise("file_mtime_fallback"),
        }
    )
    failed = F.coalesce("probe_failed", F.lit(False))
    notes = combine_warnings(
        F.when(F.col("room_id") == "unknown_room", F.lit("room_id_not_found")),
        F.when(failed, F.lit("ffprobe_failed")),
        F.when(F.col("timestamp_source") == "file_mtime_fallback", F.lit("timestamp_source=file_mtime_fallback")),
    )
    df = df.withColumn("warnings", notes)
    return df.select(
        "media_id", "room_id", room_display_name(F.replace(F.col("room_id"), F.lit("_"), F.lit(" "))).alias("room_display_name"),
        session_id_from_path("relative_path", "room_id").alias("session_id"), file_name("relative_path").alias("file_name"),
        "relative_path", F.col("relative_path").alias("video_path"), "file_size_bytes", "timestamp_source", "start_time",
        F.coalesce(shift_iso("start_time", F.col("_p.duration_seconds")), F.lit("")).alias("end_time"),
        F.col("_p.duration_seconds").alias("duration_seconds"),
        *[F.col(f"_p.{f}").alias(f) for f in ("width", "height", "frame_rate", "video_codec", "has_audio", "audio_codec", "audio_sample_rate", "audio_channels")],
        F.when(failed, "failed").when(F.col("warnings") != "", "warning").otherwise("ok").alias("quality_status"), "warnings",
    )


__all__ = [
    "PROBE_SCHEMA", "TIMESTAMP_KEYS", "probe_fields", "best_timestamp", "tag_duration", "chosen_duration", "manifest_status",
    "path_context", "override", "cleaning_manifest", "preparation_manifest",
]

"""Typed table readers. Schemas are stated, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from windrow.functions.numbers import nan_to_null
from windrow.functions.text import blank_to_null
from windrow.functions.times import with_time_columns

_AUDIO = ", ".join(
    f"audio_{n} double"
    for n in ("rms", "short_time_energy", "zero_crossing_rate", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "spectral_flatness")
)
_IDS = "window_id string, media_id string, room_id string, session_id string, start_time string, end_time string"

# The published tables and their columns.
SCHEMAS = {
    "media_manifest": "media_id string, room_id string, room_display_name string, session_id string, file_name string, relative_path string, absolute_path string, "
    "video_path string, file_size_bytes bigint, timestamp_source string, start_time string, end_time string, duration_seconds double, width int, height int, "
    "frame_rate double, video_codec string, has_audio boolean, audio_codec string, audio_sample_rate int, audio_channels int, quality_status string, warnings string",
    "video_window_index": f"{_IDS}, duration_seconds double, video_path string, video_start_offset_sec double, has_audio boolean, quality_status string, warnings string",
    "video_zone_features": "window_id string, media_id string, system_id string, room_id string, session_id string, zone_id string, start_time string, end_time string, "
    "video_path string, video_start_offset_sec double, duration_seconds double, activity_mean double, activity_std double, motion_pixel_ratio double, frame_count int, warnings string",
    "semantic_zone_video_features": f"{_IDS}, video_path string, video_start_offset_sec double, duration_seconds double, zone_config_id string, zone_id string, semantic_type string, "
    "zone_area_pixels int, zone_area_fraction double, activity_mean double, activity_std double, activity_sum double, activity_norm double, frame_count_used int, quality_status string, warnings string",
    "semantic_biomarker_window_table": f"{_IDS}, activity_mean double, normalized_activity double, mobility_index double, spatial_freedom_index double, occupancy_imbalance_index double, "
    "semantic_transition_proxy double, drinking_activity_fraction double, feeding_activity_fraction double, general_activity_fraction double, "
    "feeding_plus_drinking_activity_fraction double, drinking_to_feeding_activity_ratio double, quality_status string, warnings string",
    "audio_window_features": f"{_IDS}, audio_available boolean, audio_duration_sec double, audio_sample_rate int, {_AUDIO}, audio_quality_flag string, warnings string",
    "env_daily": "room_id string, date date, temp_am_min double, temp_am_max double, temp_pm double, rh_am double, rh_pm double, temp_am_mean double, temp_daily_mean double, "
    "rh_daily_mean double, temp_daily_range double, env_quality_flag string",
    "event_log": "event_id string, event_type string, system_id string, room_id string, session_id string, source_video_path string, source_media_id string, "
    "source_video_start_time string, entry_offset_sec int, exit_offset_sec int, event_start_time string, event_end_time string, label_quality string, notes string",
    "climate_sheet": "Date string, Temp_AM_Min string, Temp_AM_Max string, Temp_PM string, RH_AM string, RH_PM string",
    "path_mapping": "pattern string, system_id string, room_id string, session_id string, modality string, source_type string, zone_config_id string",
    "failed_windows": "stage string, window_id string, media_id string, room_id string, issue string",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[name])


def tidy(df: DataFrame) -> DataFrame:
    """Blank and ``nan`` texts and NaN numbers become null."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            out.append(blank_to_null(f.name).alias(f.name))
        elif isinstance(f.dataType, (DoubleType, FloatType)):
            out.append(nan_to_null(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, name: str, path: str, kind: str = "csv") -> DataFrame:
    """A published table from CSV or parquet; a missing path gives an empty table with its columns.

    CSV columns are matched by heading, so files may order or lack columns.
    """
    wanted = schema(name)
    if not path_exists(spark, path):
        return spark.createDataFrame([], wanted)
    if kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    columns = []
    for f in wanted.fields:
        if f.name in raw.columns:
            columns.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
        else:
            columns.append(F.lit(None).cast(f.dataType).alias(f.name))
    return tidy(raw.select(*columns))


def read_timed(spark: SparkSession, name: str, path: str, kind: str = "csv", zone: str | None = None) -> DataFrame:
    """:func:`read_table` plus the derived time columns."""
    return with_time_columns(read_table(spark, name, path, kind), zone)


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """Mapping rules in file order, values trimmed. A rule file is a short list read as one partition."""
    rules = read_table(spark, "path_mapping", path).coalesce(1)
    return rules.withColumn("map_order", F.monotonically_increasing_id())


def read_documents(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """JSON documents (one per file) with a stated schema."""
    return spark.read.schema(ddl).option("multiLine", True).json(path)


# The canonical columns and the headings accepted for each, in order.
CANONICAL = {
    **{name: (name,) for name in ("window_id", "media_id", "system_id", "room_id", "session_id", "zone_id", "start_time", "end_time", "zone_config_id")},
    "activity_mean": ("activity_mean", "activity", "zone_activity_mean"),
    "activity_std": ("activity_std", "activity_sd"),
    "motion_pixel_ratio": ("motion_pixel_ratio", "motion_ratio"),
    "frame_count": ("frame_count", "n_frames"),
    "video_path": ("video_path", "file_path"),
    **{name: (name,) for name in ("video_start_offset_sec", "duration_seconds", "has_audio", "quality_status", "selection_rank", "warnings")},
}
_NUMERIC = {"activity_mean", "activity_std", "motion_pixel_ratio", "frame_count", "video_start_offset_sec", "duration_seconds", "selection_rank"}


def canonical_columns(df: DataFrame, candidates: dict[str, tuple[str, ...]] = CANONICAL) -> tuple[DataFrame, dict[str, str]]:
    """Resolve headings to canonical columns, and say which source was used.

    Headings match on letters and digits only; a plain heading goes before one
    with a ``__`` suffix. The first candidate found is taken even if it is all
    null; a later one only if it holds a value, else the field is ``(missing)``.
    """
    def bare(text: str) -> str:
        return "".join(ch for ch in text.lower() if ch.isalnum())

    by_name: dict[str, list[str]] = {}
    for c in sorted(df.columns, key=lambda c: "__" in c):
        by_name.setdefault(bare(c.split("__")[0]), []).append(c)
    sources, columns = {}, []
    for field, names in candidates.items():
        chosen = None
        for i, name in enumerate(names):
            found = by_name.get(bare(name), [])
            if not found:
                continue
            if i == 0 or df.filter(F.col(f"`{found[0]}`").isNotNull()).limit(1).count():
                chosen = found[0]
                break
        kind = "double" if field in _NUMERIC else "string"
        sources[field] = chosen or "(missing)"
        columns.append((F.col(f"`{chosen}`").try_cast(kind) if chosen else F.lit(None).cast(kind)).alias(field))
    return df.select(*columns), sources


def mapping_table(spark: SparkSession, sources: dict[str, str]) -> DataFrame:
    """Canonical column, source column and whether it was found, in the order of the columns."""
    return spark.createDataFrame([(i, field, source, source != "(missing)") for i, (field, source) in enumerate(sources.items())], "position int, canonical_column string, source_column string, found boolean")

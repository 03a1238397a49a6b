"""Joining the modalities into one row per window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.functions.text import combine_warnings
from windrow.operators.climate import attach_climate
from windrow.operators.ordered import first_per, join_same

KEYS = ["window_id", "media_id", "room_id", "session_id", "start_time", "end_time"]

# The hand-off columns, in order, with their types.
REQUIRED = {
    "window_id": "string", "media_id": "string", "room_id": "string", "session_id": "string",
    "start_time": "string", "end_time": "string", "local_date": "date", "video_path": "string",
    "activity_mean": "double", "normalized_activity": "double", "mobility_index": "double",
    "spatial_freedom_index": "double", "occupancy_imbalance_index": "double",
    "drinking_activity_fraction": "double", "feeding_activity_fraction": "double",
    "general_activity_fraction": "double", "semantic_transition_proxy": "double",
    "audio_available": "boolean", "audio_rms": "double", "audio_short_time_energy": "double",
    "audio_zero_crossing_rate": "double", "audio_spectral_centroid": "double",
    "audio_spectral_bandwidth": "double", "audio_spectral_rolloff": "double",
    "temp_context": "double", "rh_context": "double", "temp_daily_mean": "double",
    "rh_daily_mean": "double", "env_quality_flag": "string", "quality_status": "string", "warnings": "string",
}


def left_merge(left: DataFrame, right: DataFrame, keys: list[str], suffix: str, order: list[Column] | None = None, unique: str = "window_id") -> DataFrame:
    """Left join on all keys (missing matches missing); the right side is first made unique per ``unique``.

    Right columns whose name is taken get ``suffix``.
    """
    order = order or [F.col(c).asc_nulls_last() for c in keys]
    right = first_per(right, [unique], order)
    taken = set(left.columns)
    renamed = {c: c + suffix for c in right.columns if c in taken and c not in keys}
    return join_same(left, right.withColumnsRenamed(renamed), keys)


def with_missing_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})


def _text(df: DataFrame, name: str) -> Column | None:
    """Lower-case text of a column that exists; a missing value reads as ``nan``, as a text export would show it."""
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("nan")))) if name in df.columns else None


def merged_quality(df: DataFrame) -> Column:
    """Six-way precedence: no activity, failed video, audio flag, climate flag, media status, video warning."""
    video, audio = _text(df, "quality_status_video"), _text(df, "audio_quality_flag")
    climate, media = _text(df, "env_quality_flag"), _text(df, "quality_status")
    rule = F.when(F.col("activity_mean").isNull(), F.lit("failed"))
    if video is not None:
        rule = rule.when(video == "failed", F.lit("failed"))
    if audio is not None:
        rule = rule.when(~audio.isin("", "ok", "manifest_has_audio_false"), F.lit("warning"))
    if climate is not None:
        rule = rule.when(~climate.isin("", "ok"), F.lit("warning"))
    if media is not None:
        rule = rule.when(media.isin("warning", "failed"), F.col("quality_status"))
    if video is not None:
        rule = rule.when(video == "warning", F.lit("warning"))
    return rule.otherwise(F.lit("ok"))


def merged_warnings(df: DataFrame) -> Column:
    def flag(name: str) -> Column:
        return F.when(~F.lower(F.col(name)).isin("", "ok"), F.col(name))

    plain = [F.col(c) for c in ("warnings", "warnings_video", "warnings_audio") if c in df.columns]
    flags = [flag(c) for c in ("audio_quality_flag", "env_quality_flag") if c in df.columns]
    return combine_warnings(*plain, *flags)


def merge_modalities(windows: DataFrame, biomarkers: DataFrame, audio: DataFrame | None, climate: DataFrame | None, climate_by_room: bool = True) -> DataFrame:
    """Windows (with ``local_date`` and ``local_hour``) ⟕ biomarkers ⟕ audio ⟕ climate → the hand-off table.

    Pass ``None`` for a modality that was not recorded at all.
    """
    clock = ["start_us", "end_us", "local_date", "local_hour"]
    df = left_merge(windows, biomarkers.drop(*clock), KEYS, "_video")
    if audio is not None:
        df = left_merge(df, audio.drop(*clock), KEYS, "_audio")
    if climate is not None:
        df = attach_climate(df, climate, climate_by_room)
    df = with_missing_columns(df, {c: REQUIRED[c] for c in ("temp_context", "rh_context", "temp_daily_mean", "rh_daily_mean", "env_quality_flag")})
    if "audio_available" not in df.columns:
        df = df.withColumn("audio_available", F.lit(False))
    df = df.withColumn("audio_available", F.coalesce("audio_available", F.lit(False)))
    df = df.withColumns({"warnings": merged_warnings(df), "quality_status": merged_quality(df)})
    df = first_per(df, ["window_id"], [F.col(c).asc_nulls_last() for c in ("room_id", "session_id", "start_us", "window_id")])
    return with_missing_columns(df, REQUIRED).select(*REQUIRED)


def outer_metadata(selected: DataFrame, index: DataFrame, manifest: DataFrame) -> DataFrame:
    """Full outer union of two window tables by id; the second only adds columns; then the media columns."""
    added = [c for c in index.columns if c not in selected.columns]
    both = selected.withColumnRenamed("window_id", "_w").join(
        index.select(F.col("window_id").alias("_i"), *added), F.col("_w") == F.col("_i"), "full"
    )
    both = both.withColumn("window_id", F.coalesce("_w", "_i")).drop("_w", "_i")
    extra = [c for c in manifest.columns if c not in both.columns]
    if not extra or "media_id" not in both.columns:
        return both
    return both.join(manifest.select("media_id", *extra), "media_id", "left")


def join_with_fallback(left: DataFrame, right: DataFrame, primary: list[str], fallback: list[str], probe: str, order: list[Column]) -> DataFrame:
    """Left join on ``primary``; only if that matches nothing at all, on ``fallback``.

    A job that ends at the first match decides, so the plan that comes back holds the one join that counts.
    """
    columns = [c for c in right.columns if c not in {*primary, *fallback}]

    def joined(keys: list[str]) -> DataFrame:
        return join_same(left, first_per(right, keys, order).select(*keys, *columns), keys)

    first = joined(primary)
    return joined(fallback) if first.filter(F.col(probe).isNotNull()).isEmpty() else first


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Key columns that are never null, so that windows and the join on them share one partitioning."""
    names = [f"_key{i}" for i in range(len(keys))]
    return df.withColumns({n: F.coalesce(F.concat(F.lit("="), F.col(k).cast("string")), F.lit("")) for n, k in zip(names, keys)}), names


def join_one_to_one(left: DataFrame, right: DataFrame, keys: list[str], suffix: str = "_right") -> DataFrame:
    """Left join that raises, when it runs, as soon as a key occurs twice on either side (missing keys count as equal).

    The check numbers the rows of a key where the join has brought them together, so it costs no scan and no shuffle of its own.
    """
    def checked(df: DataFrame, side: str) -> tuple[DataFrame, list[str]]:
        rows, names = _keyed(df, keys)
        again = F.row_number().over(Window.partitionBy(*names).orderBy(*names)) > 1
        message = F.concat(F.lit(f"{side} side has more than one row for {'/'.join(keys)} "), F.concat_ws("/", *names))
        rows = rows.withColumn("_again", again)
        return rows.filter(F.when(F.col("_again"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).drop("_again"), names

    (one, names), (two, _) = checked(left, "left"), checked(right, "right")
    renamed = {c: c + suffix for c in right.columns if c in left.columns and c not in keys}
    return one.join(two.drop(*keys).withColumnsRenamed(renamed), names, "left").drop(*names)


def inner_override(left: DataFrame, right: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """Rows of ``left`` that ``right`` knows too, one per key, with ``columns`` as the right side (its first row of a key) has them.

    Columns that only the right side has are added; other columns and their order are those of the left side.
    """
    source = first_per(right, [key], order).select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    own = first_per(left, [key], [F.col(c).asc_nulls_last() for c in left.columns])
    joined = own.join(source, key)
    kept = [F.col(f"_new_{c}").alias(c) if c in columns else F.col(c) for c in left.columns]
    return joined.select(*kept, *[F.col(f"_new_{c}").alias(c) for c in columns if c not in left.columns])


def combine_failed(*frames: DataFrame) -> DataFrame:
    """Failed rows of all stages, one per (stage, window, issue)."""
    columns = ["stage", "window_id", "media_id", "room_id", "issue"]
    union = frames[0].select(*columns)
    for frame in frames[1:]:
        union = union.unionByName(frame.select(*columns))
    return union.groupBy("stage", "window_id", "issue").agg(
        F.min(F.struct("media_id", "room_id")).alias("_f")
    ).select("stage", "window_id", F.col("_f.media_id").alias("media_id"), F.col("_f.room_id").alias("room_id"), "issue")


def pending(requested: DataFrame, done: DataFrame, key: str = "window_id") -> DataFrame:
    """Requested rows without a finished counterpart."""
    return requested.join(done.select(key), key, "left_anti")


def reusable(done: DataFrame, requested: DataFrame, key: str = "window_id") -> DataFrame:
    """Finished rows that are still requested."""
    return done.join(requested.select(key), key, "left_semi")


def completed_windows(features: DataFrame, expected_zones: int) -> DataFrame:
    """Windows for which every zone is present."""
    zones = features.groupBy("window_id").agg(F.countDistinct("zone_id").alias("zones"))
    return zones.filter(F.col("zones") >= expected_zones)


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Attach ``value`` by ``key``; rows without entry get ``default``."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))

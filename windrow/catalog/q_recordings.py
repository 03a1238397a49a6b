"""Recordings of the supplied tables: manifests, logs, frames of pixels and of sound."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.functions import media
from windrow.functions.times import ntz_micros
from windrow.kernels import audio, video, zones as zn
from windrow.operators.biomarkers import merge_tokens
from windrow.operators.ordered import Axis, time_block, with_position
from windrow.operators.resilience import normalize_event_log
from windrow.operators.selection import first_mapping
from windrow.session import spread
from windrow.sources.tables import canonical_columns, mapping_table

# --- manifests -----------------------------------------------------------------------------------

_DAY, _HOUR = "lpad(CAST(p_size % 28 + 1 AS VARCHAR), 2, '0')", "lpad(CAST(p_partkey % 24 AS VARCHAR), 2, '0')"
_LENGTH = "CASE WHEN p_size % 5 <> 0 THEN p_size + 9 END"


def _stamp(minute: str, date: str = "-", between: str = "T", zone: str = "+00:00"):
    day, hour = F.lpad((F.col("p_size") % 28 + 1).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 24).cast("string"), 2, "0")
    return F.concat(F.lit(f"2025{date}03{date}"), day, F.lit(between), hour, F.lit(f":{minute}:00{zone}"))


def _probe(created=None):
    """A probe document with a picture stream, a length that cannot be read in every fifth row, and sound in even rows."""
    length = F.when(F.col("p_size") % 5 == 0, F.lit("unknown")).otherwise((F.col("p_size") + 9).cast("string"))
    kinds = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("video"), F.lit("audio"))).otherwise(F.array(F.lit("video")))
    tags = F.lit("") if created is None else F.coalesce(F.concat(F.lit(', "tags": {"creation_time": "'), created, F.lit('"}')), F.lit(""))
    streams = F.array_join(F.transform(kinds, lambda k: F.concat(F.lit('{"codec_type": "'), k, F.lit('"}'))), ", ")
    return F.concat(F.lit('{"streams": ['), streams, F.lit('], "format": {"duration": "'), length, F.lit('"'), tags, F.lit("}}"))


@query("manifest_preparation", f"""WITH m AS (SELECT *, {_LENGTH} AS len, p_partkey % 3 AS kind, p_size % 7 = 0 AS lost, p_partkey % 11 = 0 AS failed FROM part),
t AS (SELECT *, '2025-03-' || {_DAY} || 'T' || {_HOUR} || CASE kind WHEN 0 THEN ':00:00-03:00' WHEN 1 THEN ':30:00+00:00' ELSE ':45:00+00:00' END AS start_time FROM m)
SELECT p_partkey, CASE WHEN lost THEN 'unknown_room' ELSE 'room_' || p_size END AS room_id, CASE kind WHEN 0 THEN 'exiftool' WHEN 1 THEN 'ffprobe_creation_time' ELSE 'file_mtime_fallback' END AS timestamp_source, start_time,
CASE WHEN len IS NULL THEN '' ELSE left(start_time, 17) || lpad(CAST(len AS VARCHAR), 2, '0') || right(start_time, 6) END AS end_time, CAST(len AS DOUBLE) AS duration_seconds, p_size % 2 = 0 AS has_audio,
CASE WHEN failed THEN 'failed' WHEN lost OR kind = 2 THEN 'warning' ELSE 'ok' END AS quality_status,
array_to_string(list_filter([CASE WHEN lost THEN 'room_id_not_found' END, CASE WHEN failed THEN 'ffprobe_failed' END, CASE WHEN kind = 2 THEN 'timestamp_source=file_mtime_fallback' END], lambda x: x IS NOT NULL), ';') AS warnings FROM t""")
def manifest_preparation(spark, sf):
    """Files of several rooms with tags, probe documents and file times → manifest rows."""
    kind = F.col("p_partkey") % 3
    path = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("misc/"), F.col("p_partkey").cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("video/Room "), F.col("p_size").cast("string"), F.lit("/a.mp4")))
    tags = F.when(kind == 0, F.create_map(F.lit("CreateDate"), _stamp("00", ":", " ", "-03:00"))).otherwise(F.create_map().cast("map<string,string>"))
    files = tb.table(spark, sf, "part").select(
        F.col("p_partkey").alias("media_id"), path.alias("relative_path"), F.lit(1).cast("bigint").alias("file_size_bytes"), _stamp("45").alias("modified_time"), tags.alias("tags"),
        _probe(F.when(kind == 1, _stamp("30", zone="Z"))).alias("probe"), (F.col("p_partkey") % 11 == 0).alias("probe_failed"),
    )
    out = media.preparation_manifest(files).withColumnRenamed("media_id", "p_partkey")
    return out.select("p_partkey", "room_id", "timestamp_source", "start_time", "end_time", F.col("duration_seconds").cast("double").alias("duration_seconds"), "has_audio", "quality_status", "warnings")


@query("manifest_cleaning", f"""WITH m AS (SELECT *, CASE WHEN p_size % 5 <> 0 THEN p_size + 9 WHEN p_partkey % 4 = 0 THEN 58 END AS len, p_size % 7 = 0 AS lost, p_partkey % 3 = 2 AS untimed, p_size % 3 = 0 AS mapped FROM part),
t AS (SELECT *, CASE WHEN untimed THEN '' ELSE '2025-03-' || {_DAY} || 'T' || {_HOUR} || ':00:00+00:00' END AS start_time FROM m)
SELECT p_partkey, CASE WHEN mapped AND NOT lost THEN 'barn' WHEN lost THEN 'unknown_system' ELSE 'sys' || p_size % 3 END AS system_id, CASE WHEN lost THEN 'unknown_room' ELSE 'room_' || p_size END AS room_id,
CASE WHEN mapped AND NOT lost THEN 'zone_alpha' ELSE 'default_zone' END AS zone_config_id, start_time, CASE WHEN untimed OR len IS NULL THEN '' ELSE left(start_time, 17) || lpad(CAST(len AS VARCHAR), 2, '0') || '+00:00' END AS end_time, CAST(len AS DOUBLE) AS duration_seconds,
array_to_string(list_sort(list_filter([CASE WHEN lost THEN 'path_context_unmatched' END, CASE WHEN lost THEN 'unknown_system' END, CASE WHEN lost THEN 'unknown_room' END, CASE WHEN lost THEN 'unknown_session' END, CASE WHEN mapped AND NOT lost THEN 'mapping_override' END,
  CASE WHEN untimed THEN 'invalid_timestamp' END, CASE WHEN len IS NULL THEN 'invalid_duration' END, CASE WHEN p_size % 2 = 1 THEN 'no_embedded_audio_stream' END], lambda x: x IS NOT NULL)), ';') AS warnings,
CASE WHEN untimed OR len IS NULL THEN 'error' WHEN lost OR mapped OR p_size % 2 = 1 THEN 'warning' ELSE 'ok' END AS quality_status FROM t""")
def manifest_cleaning(spark, sf):
    """Files of one system: folders, a mapping that overrides them, tags before probe for time, probe before tags for length."""
    path = F.when(F.col("p_size") % 7 == 0, F.lit("x/y.mp4")).otherwise(F.concat(F.lit("Sys"), (F.col("p_size") % 3).cast("string"), F.lit("/Room "), F.col("p_size").cast("string"), F.lit("/s/video/a.mp4")))
    stamp = F.when(F.col("p_partkey") % 3 == 2, F.lit("not a time")).otherwise(_stamp("00", ":", " ", ""))
    tags = F.map_filter(F.create_map(F.lit("CreateDate"), stamp, F.lit("Duration"), F.when(F.col("p_partkey") % 4 == 0, F.lit("58 s"))), lambda k, v: v.isNotNull())
    parts = spread(tb.table(spark, sf, "part").select("p_partkey", "p_size"), rows=tb.row_count(spark, sf, "part"), each=tb.DOCUMENTS_A_TASK)
    files = parts.select(
        F.col("p_partkey").alias("media_id"), path.alias("file_path"), path.alias("relative_path"), tags.alias("tags"), _probe().alias("probe"), F.array().cast("array<string>").alias("issues")
    )
    rules = spark.createDataFrame([(1, "^sys0/", "Barn", "", "", "", "", "zone_alpha")], "map_order int, pattern string, system_id string, room_id string, session_id string, modality string, source_type string, zone_config_id string")
    out = media.cleaning_manifest(first_mapping(files, rules), "UTC").withColumnRenamed("media_id", "p_partkey")
    return out.select("p_partkey", "system_id", "room_id", "zone_config_id", "start_time", "end_time", F.col("duration_seconds").cast("double").alias("duration_seconds"), "warnings", "quality_status")


@query("schema_mapping", """SELECT * FROM (VALUES ('activity_mean', 'Zone-Activity Mean'), ('activity_std', 'ACTIVITY_SD'), ('motion_pixel_ratio', '(missing)'), ('frame_count', 'n frames'), ('window_id', 'Window ID'), ('zone_id', 'zone_id__supplemental')) v(canonical_column, source_column)""")
def schema_mapping(spark, sf):
    """Headings of a foreign table resolved to canonical columns; an empty later candidate does not count."""
    zones = tb.zone_rows(spark, sf)
    foreign = zones.select(
        F.col("window_id").alias("Window ID"), F.col("zone_id").alias("zone_id__supplemental"), F.col("activity_mean").alias("Zone-Activity Mean"), F.col("activity_std").alias("ACTIVITY_SD"),
        F.lit(None).cast("double").alias("motion_ratio"), F.col("frame_count").alias("n frames"),
    )
    _, sources = canonical_columns(foreign)
    wanted = ["activity_mean", "activity_std", "motion_pixel_ratio", "frame_count", "window_id", "zone_id"]
    return mapping_table(spark, sources).filter(F.col("canonical_column").isin(*wanted)).select("canonical_column", "source_column")


@query("event_log_normalised", """WITH n AS (SELECT CAST(user_id AS VARCHAR) AS room, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, event_id, event_type, row_number() OVER (ORDER BY ts, event_id) - 1 AS event_seq FROM events WHERE value >= 200)
SELECT CAST(event_seq AS BIGINT) AS event_seq, CASE WHEN event_id % 2 = 0 THEN 'e' || event_id ELSE room || '_event_' || CASE WHEN event_seq < 1000 THEN lpad(CAST(event_seq AS VARCHAR), 3, '0') ELSE left(CAST(event_seq AS VARCHAR), 3) END END AS event_id,
CASE WHEN event_id % 3 = 0 THEN 'unspecified_event' ELSE event_type END AS event_type, room AS room_id, stamp AS start_time, 'event_log' AS candidate_event_source FROM n""")
def event_log_normalised(spark, sf):
    """A log with its own headings, gaps in ids and types, no order: standard columns, numbers by time, defaults."""
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    log = tb.table(spark, sf, "events").filter("value >= 200").select(
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), F.col("event_id").cast("string"))).alias("Event-ID"), F.col("user_id").cast("string").alias("ROOM id"), at.alias("Event Start Time"),
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("end_time"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("eventType"),
    )
    return rounded(normalize_event_log(log).select("event_seq", "event_id", "event_type", "room_id", "start_time", "candidate_event_source"))


@query("pipe_tokens", """WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, unnest(string_split(CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN l_returnflag || ' | nan|' || l_linestatus ELSE l_returnflag END, '|')) AS t,
  generate_subscripts(string_split(CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN l_returnflag || ' | nan|' || l_linestatus ELSE l_returnflag END, '|'), 1) AS p FROM lineitem),
f AS (SELECT l_orderkey, trim(t) AS t, min({'a': l_linenumber, 'b': l_suppkey, 'd': l_partkey, 'e': p}) AS first FROM w WHERE trim(t) NOT IN ('', 'nan') GROUP BY 1, 2)
SELECT l_orderkey, string_agg(t, '; ' ORDER BY first) AS tokens FROM f GROUP BY 1""")
def pipe_tokens(spark, sf):
    """Distinct tokens of pipe-separated texts in first-seen order, glued by another mark."""
    kind = F.col("l_linenumber") % 3
    text = F.when(kind == 0, "").when(kind == 1, F.concat("l_returnflag", F.lit(" | nan|"), "l_linestatus")).otherwise(F.col("l_returnflag"))
    lines = tb.table(spark, sf, "lineitem").withColumn("warnings", text)
    return merge_tokens(lines, ["l_orderkey"], F.struct("l_linenumber", "l_suppkey", "l_partkey"), sep="|", glue="; ").withColumnRenamed("warnings", "tokens")


# --- frames --------------------------------------------------------------------------------------

_QUARTERS = [{"zone_id": f"zone_{'ABCD'[2 * r + c]}", "row": r, "col": c} for r in (0, 1) for c in (0, 1)]
_LEFT = np.arange(64).reshape(8, 8) % 8 < 4
FRAME_MASKS = {None: zn.grid_masks(_QUARTERS, 8, 8), "r1": {"left": _LEFT, "right": ~_LEFT}}


def _mask_sql() -> str:
    rows = [f"('{room or 'r0'}', '{zone}', {np.flatnonzero(mask.ravel()).tolist()})" for room, masks in FRAME_MASKS.items() for zone, mask in masks.items()]
    return "zn AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") v(room_id, zone_id, cells))"


@query("frame_differences", f"""WITH {_mask_sql()},
fr AS (SELECT CAST(label AS VARCHAR) AS media_id, 'r' || label % 2 AS room_id, vec_id AS t, list_transform(embedding, lambda x: greatest(least(floor((CAST(x AS DOUBLE) + 1) * 127.5), 255), 0)) AS px FROM embeddings),
pr AS (SELECT *, lag(t) OVER o AS t0, lag(px) OVER o AS p0 FROM fr WINDOW o AS (PARTITION BY media_id ORDER BY t)),
df AS (SELECT media_id, room_id, t0, t, list_transform(range(1, 65), lambda i: abs(px[i] - p0[i]) / 255) AS d FROM pr WHERE t0 IS NOT NULL),
zd AS (SELECT media_id, t0, t, zone_id, list_transform(cells, lambda c: d[c + 1]) AS v FROM df JOIN zn USING (room_id))
SELECT media_id, CAST(t0 AS DOUBLE) AS interval_start_sec, CAST(t AS DOUBLE) AS interval_end_sec, zone_id, round(list_avg(v), 6) AS activity_mean, round(list_stddev_pop(v), 6) AS activity_std, round(list_sum(v), 6) AS activity_sum,
       round(len(list_filter(v, lambda x: x > 0.1)) / len(v), 6) AS motion_ratio FROM zd""")
def frame_differences(spark, sf):
    """Vectors as pictures of eight by eight, one recording a label; odd labels are of a room with zones of its own."""
    level = lambda x: F.greatest(F.least(F.floor((x.cast("double") + 1) * 127.5), F.lit(255)), F.lit(0))
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda x: F.lpad(F.hex(level(x).cast("bigint")), 2, "0")), ""))
    frames = tb.table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("media_id"), F.concat(F.lit("r"), (F.col("label") % 2).cast("string")).alias("room_id"), F.col("vec_id").cast("double").alias("frame_time_sec"), pixels.alias("pixels"))
    out = video.frame_differences(frames, FRAME_MASKS, motion_threshold=0.1, block_seconds=100)
    return rounded(out.select("media_id", "interval_start_sec", "interval_end_sec", "zone_id", "activity_mean", "activity_std", "activity_sum", "motion_ratio"))


_SAMPLES = """sa AS (SELECT CAST(user_id AS VARCHAR) AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, least(greatest(floor(value * 50) - 2500, -32768), 32767) / 32768 AS v FROM events)"""


@query("audio_frame_features", f"""WITH {_SAMPLES},
nn AS (SELECT media_id, count(*) AS n FROM sa GROUP BY 1),
st AS (SELECT media_id, unnest(range(n)) AS i FROM nn), ok AS (SELECT st.media_id, i FROM st JOIN nn USING (media_id) WHERE i = 0 OR i * 4 + 4 < n),
fr AS (SELECT ok.media_id, i, list(v ORDER BY pos) AS l FROM ok JOIN sa ON sa.media_id = ok.media_id AND pos BETWEEN i * 4 AND i * 4 + 7 GROUP BY 1, 2),
pd AS (SELECT media_id, i, list_concat(l, list_transform(range(8 - len(l)), lambda x: 0.0)) AS l FROM fr)
SELECT media_id, CAST(i AS DOUBLE) AS frame_start_sec, round(sqrt(list_avg(list_transform(l, lambda x: x * x))), 6) AS audio_rms, round(list_avg(list_transform(l, lambda x: x * x)), 6) AS audio_short_time_energy,
       round(len(list_filter(range(1, 8), lambda k: (l[k] < 0) <> (l[k + 1] < 0))) / 7, 6) AS audio_zero_crossing_rate FROM pd""")
def audio_frame_features(spark, sf):
    """Readings of a user as sound, in rows of a day; frames of eight samples that overlap by half."""
    level = F.greatest(F.least(F.floor(F.col("value") * 50) - 2500, F.lit(32767)), F.lit(-32768))
    code = F.lpad(F.hex(F.pmod(level, F.lit(65536)).cast("bigint")), 4, "0")
    events = tb.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("media_id"), ntz_micros("ts").alias("us"), "event_id", F.concat(F.substring(code, 3, 2), F.substring(code, 1, 2)).alias("code"))
    placed = with_position(events, Axis(("media_id",), ("us", "event_id"), time_block("us", 86_400)), "pos")
    rows = F.array_sort(F.collect_list(F.struct("pos", "code")))
    chunks = placed.groupBy("media_id", F.floor(F.col("us") / 86_400_000_000).alias("day")).agg((F.min("pos") - 1).alias("chunk_start"), F.unhex(F.array_join(F.transform(rows, lambda r: r["code"]), "")).alias("pcm"))
    out = audio.audio_frames(chunks, sample_rate=4, frame_seconds=2.0, hop_seconds=1.0, block_frames=50)
    return rounded(out.select("media_id", "frame_start_sec", "audio_rms", "audio_short_time_energy", "audio_zero_crossing_rate"))

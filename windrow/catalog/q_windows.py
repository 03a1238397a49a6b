"""Sliding windows and points inside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.operators import windowing as wn
from windrow.operators.ordered import Axis, even_spread, first_per
from windrow.operators.selection import cap_groups, filter_windows, select_windows
from windrow.settings import WindowSettings


@query("window_index_partial", f"""WITH {tb.WINDOWS_PARTIAL}
SELECT media_id || '_w' || CASE WHEN i >= 9999 THEN CAST(i + 1 AS VARCHAR) ELSE lpad(CAST(i + 1 AS VARCHAR), 4, '0') END AS window_id, media_id, off AS video_start_offset_sec, round(eff, 6) AS duration_seconds,
       strftime(o_orderdate + to_microseconds(CAST(off * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS start_time,
       strftime(o_orderdate + to_microseconds(CAST((off + eff) * 1000000 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS end_time,
       CASE WHEN coalesce(duration_seconds, 0) <= 0 AND quality_status = 'ok' THEN 'warning' ELSE quality_status END AS quality_status,
       CASE WHEN coalesce(duration_seconds, 0) <= 0 THEN CASE warnings WHEN '' THEN '' ELSE warnings || ';' END || 'missing_or_zero_duration'
            WHEN duration_seconds < 30 THEN CASE warnings WHEN '' THEN '' ELSE warnings || ';' END || 'short_media_partial_window' ELSE warnings END AS warnings
FROM (SELECT *, window_index AS i FROM win)""")
def window_index_partial(spark, sf):
    df = wn.sliding_windows(tb.recordings(spark, sf))
    return rounded(df.select("window_id", "media_id", "video_start_offset_sec", "duration_seconds", "start_time", "end_time", "quality_status", "warnings"))


@query("window_index_full", f"""WITH {tb.RECORDINGS}
SELECT media_id || '_w' || lpad(CAST(i + 1 AS VARCHAR), 4, '0') AS window_id, media_id, room_id, session_id, i * 10.0 AS video_start_offset_sec,
       strftime(o_orderdate + to_microseconds((i * 10 + 30) * 1000000), '%Y-%m-%dT%H:%M:%S') AS end_time, has_audio
FROM rec, LATERAL (SELECT unnest(range(0, CAST(floor((duration_seconds - 30 + 0.001) / 10) AS BIGINT) + 1)) AS i) t
WHERE duration_seconds + 0.001 >= 30""")
def window_index_full(spark, sf):
    df = wn.full_windows(tb.recordings(spark, sf))
    return rounded(df.select("window_id", "media_id", "room_id", "session_id", "video_start_offset_sec", "end_time", "has_audio"))


@query("point_in_window", f"""WITH {tb.WINDOWS_PARTIAL}, {tb.INTERVALS}
SELECT w.media_id, w.window_index, p.zone_id, round(avg(activity), 6) AS activity_mean, round(sum(activity), 6) AS activity_sum, count(*) AS frame_count_used
FROM win w JOIN pts p ON w.media_id = p.media_id AND p.center_sec >= w.off AND p.center_sec < w.off + w.eff GROUP BY 1, 2, 3""")
def point_in_window(spark, sf):
    df = wn.aggregate_points(
        tb.intervals(spark, sf), tb.recordings(spark, sf),
        {"activity_mean": F.avg("activity"), "activity_sum": F.sum("activity"), "frame_count_used": F.count(F.lit(1))}, by=["zone_id"],
        rows=tb.row_count(spark, sf, "lineitem"),
    )
    return rounded(df)


@query("end_in_window", f"""WITH {tb.WINDOWS_PARTIAL}, {tb.INTERVALS}
SELECT w.media_id, w.window_index, round(avg(activity), 6) AS activity_mean, round(stddev_pop(activity), 6) AS activity_std, round(avg(ratio), 6) AS motion_pixel_ratio
FROM win w JOIN pts p ON w.media_id = p.media_id AND p.center_sec > w.off + 1e-9 AND p.center_sec <= w.off + w.eff + 1e-6 GROUP BY 1, 2""")
def end_in_window(spark, sf):
    df = wn.aggregate_points(
        tb.intervals(spark, sf), tb.recordings(spark, sf),
        {"activity_mean": F.avg("activity"), "activity_std": F.stddev_pop("activity"), "motion_pixel_ratio": F.avg("ratio")}, bounds="end",
        rows=tb.row_count(spark, sf, "lineitem"),
    )
    return rounded(df)


@query("samples_in_window", f"""WITH {tb.WINDOWS_PARTIAL}, {tb.INTERVALS}
SELECT w.media_id, w.window_index, count(p.media_id) AS frame_count
FROM win w LEFT JOIN pts p ON w.media_id = p.media_id AND p.center_sec >= w.off - 1e-9 AND p.center_sec <= w.off + w.eff + 1e-6 GROUP BY 1, 2""")
def samples_in_window(spark, sf):
    """Every window is kept; windows without samples count zero."""
    media = tb.recordings(spark, sf)
    counts = wn.aggregate_points(tb.intervals(spark, sf), media, {"frame_count": F.count(F.lit(1))}, bounds="closed", rows=tb.row_count(spark, sf, "lineitem"))
    windows = wn.sliding_windows(media).select("media_id", "window_index")
    return windows.join(counts, ["media_id", "window_index"], "left").withColumn("frame_count", F.coalesce("frame_count", F.lit(0)))


@query("audio_windows", f"""WITH {tb.WINDOWS_PARTIAL}, {tb.INTERVALS},
a AS (SELECT w.media_id, w.window_index, avg(activity) AS audio_rms, avg(quantity) AS audio_spectral_centroid, count(*) AS n
      FROM win w JOIN pts p ON w.media_id = p.media_id AND p.center_sec >= w.off AND p.center_sec < w.off + w.eff GROUP BY 1, 2)
SELECT w.media_id, w.window_index, coalesce(w.has_audio AND n > 0, false) AS audio_available, round(CASE WHEN w.has_audio THEN audio_rms END, 6) AS audio_rms,
       round(CASE WHEN w.has_audio THEN audio_spectral_centroid END, 6) AS audio_spectral_centroid,
       CASE WHEN w.has_audio THEN coalesce(n, 0) * 10.0 ELSE 0.0 END AS audio_duration_sec,
       CASE WHEN NOT w.has_audio THEN 'manifest_has_audio_false' WHEN n IS NULL THEN 'insufficient_audio_frames'
            WHEN n * 10.0 + 1e-6 < greatest(0, w.eff - 10.0) THEN 'partial_audio_window' ELSE 'ok' END AS audio_quality_flag
FROM win w LEFT JOIN a USING (media_id, window_index)""")
def audio_windows(spark, sf):
    """Frame features averaged per window, with rows kept for windows without sound."""
    from windrow.operators.audio import audio_windows as build

    media = tb.recordings(spark, sf)
    frames = tb.intervals(spark, sf).select(
        "media_id", F.col("center_sec").alias("frame_center_sec"), F.col("activity").alias("audio_rms"), F.col("quantity").alias("audio_spectral_centroid")
    )
    df = build(frames, media, wn.sliding_windows(media), frame_seconds=10.0, features=["audio_rms", "audio_spectral_centroid"], duration="covered", rows=tb.row_count(spark, sf, "lineitem"))
    return rounded(df.select("media_id", "window_index", "audio_available", "audio_rms", "audio_spectral_centroid", "audio_duration_sec", "audio_quality_flag"))


_SLOTS = f"""WITH {tb.HOURS}"""


@query("head_n_cascade", _SLOTS + """,
a AS (SELECT * FROM hw QUALIFY row_number() OVER (PARTITION BY room_id, session_id ORDER BY start_us, window_id) <= 2),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY start_us, window_id) <= 20)
SELECT window_id, room_id FROM b ORDER BY start_us, window_id LIMIT 500""")
def head_n_cascade(spark, sf):
    """Caps per session, per room and overall, one after the other."""
    caps = [(["room_id", "session_id"], 2), (["room_id"], 20), ([], 500)]
    return cap_groups(tb.hour_windows(spark, sf), caps, ["start_us", "window_id"]).select("window_id", "room_id")


@query("even_spread", """WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders),
s AS (SELECT i, CAST(floor(i * (n - 1) / 499.0 + 0.5) AS BIGINT) AS pos FROM (SELECT max(n) AS n FROM o), LATERAL (SELECT unnest(range(0, 500)) AS i) t)
SELECT o_orderkey, i + 1 AS selection_rank FROM o JOIN s USING (pos)""")
def even_spread_orders(spark, sf):
    """Five hundred evenly spaced rows of the whole ordered table."""
    orders = tb.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    axis = Axis((), ("d", "o_orderkey"), F.datediff("d", F.lit("1970-01-01").cast("date")))
    return even_spread(orders, axis, 500).select("o_orderkey", "selection_rank")


@query("window_selection", f"""WITH {tb.RECORDINGS},
f AS (SELECT * FROM rec WHERE session_id IN ('F', 'P') AND quality_status = 'ok'),
h AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY room_id, session_id ORDER BY o_orderdate, media_id) <= 2),
r AS (SELECT media_id, row_number() OVER (ORDER BY o_orderdate, media_id) - 1 AS pos, count(*) OVER () AS n FROM h),
s AS (SELECT i, CAST(floor(i * (n - 1) / 99.0 + 0.5) AS BIGINT) AS pos FROM (SELECT max(n) AS n FROM r), LATERAL (SELECT unnest(range(0, 100)) AS i) t)
SELECT media_id, i + 1 AS selection_rank FROM r JOIN s USING (pos)""")
def window_selection(spark, sf):
    folder = F.when(F.col("session_id").isin("F", "P"), F.lit("Raw\\Room 1\\")).otherwise(F.lit("Raw\\Room 2\\"))
    media = tb.recordings(spark, sf).withColumn("video_path", F.concat(folder, "media_id"))
    media = filter_windows(media, path_part="raw/room 1")
    axis = Axis((), ("start_time", "media_id"), F.datediff(F.substring("start_time", 1, 10).cast("date"), F.lit("1970-01-01").cast("date")))
    picked = select_windows(media, axis, k=100, per_group=2, group=("room_id", "session_id"), require_ok=True, skip_bad=True)
    return picked.select("media_id", "selection_rank")


@query("first_per_key", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) = 1""")
def first_per_key(spark, sf):
    """Keep the first row per key in an explicit order."""
    df = first_per(tb.table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")])
    return rounded(df.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))

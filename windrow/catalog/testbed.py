"""The domain tables as views over the supplied tables, in Spark and in SQL.

* a room is a user, a session a calendar day, a zone an event type;
* a window is a fixed slot of the day (six hours, or one hour);
* the activity of a zone in a window is the mean event value, the JSON
  property ``k`` is the second modality;
* a recording is an order, its length the summed quantity, its intervals the
  order lines;
* the event log holds the large ``error`` events, one hour each;
* the climate of a day comes from that day's orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from windrow.functions.times import ntz_micros
from windrow.settings import MICROS

ZONES = ["click", "error", "purchase", "signup", "view"]
HOUR_US = 3_600 * MICROS
DOCUMENTS_A_TASK = 20_000  # probe documents read by one task


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def row_count(spark: SparkSession, sf: str, name: str) -> int:
    """Rows of a table, which Spark reads from the footers."""
    return table(spark, sf, name).count()


def _slots(spark: SparkSession, sf: str, hours: int) -> DataFrame:
    us = ntz_micros("ts")
    width = hours * HOUR_US
    start = F.floor(us / width).cast("bigint") * width
    df = table(spark, sf, "events").select(
        "event_id", "ts", "event_type", "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("user_id").cast("string").alias("room_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"), start.alias("start_us"),
    )
    hour = (F.floor(F.col("start_us") / HOUR_US) % 24).cast("string")
    return df.withColumns(
        {
            "end_us": F.col("start_us") + width,
            "window_id": F.concat("room_id", F.lit("_"), "session_id", F.lit("_"), F.lpad(hour, 2, "0")),
        }
    )


def zone_rows(spark: SparkSession, sf: str, hours: int = 6) -> DataFrame:
    """Window × zone activity."""
    return _slots(spark, sf, hours).groupBy(
        "room_id", "session_id", "window_id", "start_us", "end_us", F.col("event_type").alias("zone_id")
    ).agg(
        F.avg("value").alias("activity_mean"), F.stddev_pop("value").alias("activity_std"),
        (F.avg("k") / 100).alias("motion_pixel_ratio"), F.sum("value").alias("activity_sum"), F.count(F.lit(1)).alias("frame_count"),
    )


def _slot_sql(hours: int) -> str:
    width = hours * HOUR_US
    return f"""slots{hours} AS (
  SELECT event_id, ts, event_type, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         CAST(user_id AS VARCHAR) AS room_id, strftime(ts, '%Y-%m-%d') AS session_id,
         epoch_us(ts) // {width} * {width} AS start_us, epoch_us(ts) // {width} * {width} + {width} AS end_us,
         CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y-%m-%d') || '_' ||
           lpad(CAST((epoch_us(ts) // {width} * {width} // {HOUR_US}) % 24 AS VARCHAR), 2, '0') AS window_id
  FROM events)"""


SLOTS6 = _slot_sql(6)
SLOTS1 = _slot_sql(1)
ZONE_ROWS = SLOTS6 + """,
zr AS (
  SELECT room_id, session_id, window_id, start_us, end_us, event_type AS zone_id,
         avg(value) AS activity_mean, stddev_pop(value) AS activity_std, avg(k) / 100 AS motion_pixel_ratio,
         sum(value) AS activity_sum, count(*) AS frame_count
  FROM slots6 GROUP BY ALL)"""

# the three semantic zones: clicks drink, purchases feed, the rest is general
_SEMANTIC = "CASE zone_id WHEN 'click' THEN 'drinking_zone' WHEN 'purchase' THEN 'feeding_zone' ELSE 'general_zone' END"


def semantic_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Window × semantic zone activity with a status and warnings."""
    named = zone_rows(spark, sf).withColumn("zone_id", F.expr(_SEMANTIC))
    grouped = named.groupBy("room_id", "session_id", "window_id", "start_us", "end_us", "zone_id").agg(
        F.avg("activity_mean").alias("activity_mean"), F.sum("activity_sum").alias("activity_sum"), F.sum("frame_count").alias("frame_count")
    )
    quiet, loud = F.col("activity_mean") < 2, F.col("activity_mean") > 200
    return grouped.withColumns(
        {
            "quality_status": F.when(quiet, "failed").when(loud, "warning").otherwise("ok"),
            "warnings": F.when(quiet, "no_interval_overlap").when(loud, "loud;no_interval_overlap").otherwise(""),
        }
    )


SEMANTIC_ROWS = ZONE_ROWS + f""",
sr AS (
  SELECT room_id, session_id, window_id, start_us, end_us, {_SEMANTIC} AS zone_id,
         avg(activity_mean) AS activity_mean, sum(activity_sum) AS activity_sum, sum(frame_count) AS frame_count
  FROM zr GROUP BY ALL),
sq AS (
  SELECT *, CASE WHEN activity_mean < 2 THEN 'failed' WHEN activity_mean > 200 THEN 'warning' ELSE 'ok' END AS quality_status
  FROM sr),
sw AS (
  SELECT room_id, session_id, window_id, start_us, end_us,
         coalesce(max(activity_mean) FILTER (zone_id = 'drinking_zone'), 0) AS d,
         coalesce(max(activity_mean) FILTER (zone_id = 'feeding_zone'), 0) AS f,
         coalesce(max(activity_mean) FILTER (zone_id = 'general_zone'), 0) AS g,
         CASE WHEN bool_or(quality_status = 'failed') THEN 'failed' WHEN bool_or(quality_status = 'warning') THEN 'warning' ELSE 'ok' END AS quality_status
  FROM sq GROUP BY ALL),
sp AS (
  SELECT *, CASE WHEN d + f + g > 0 THEN d / (d + f + g) ELSE 1.0 / 3 END AS pd,
            CASE WHEN d + f + g > 0 THEN f / (d + f + g) ELSE 1.0 / 3 END AS pf,
            CASE WHEN d + f + g > 0 THEN g / (d + f + g) ELSE 1.0 / 3 END AS pg,
            (d + f + g) / 3 AS activity_mean
  FROM sw)"""


def hour_windows(spark: SparkSession, sf: str) -> DataFrame:
    """One row per room and hour with readings, and a three-valued state from the mean."""
    df = _slots(spark, sf, 1).groupBy("room_id", "session_id", "window_id", "start_us", "end_us").agg(
        F.avg("value").alias("activity_mean"), F.sum("value").alias("activity_total"), F.avg("k").alias("k_mean"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return df.withColumns({"duration_seconds": F.lit(3600.0), "state_id": state_of(F.col("activity_mean"))})


def state_of(value: Column) -> Column:
    return F.when(value < 25, 0).when(value < 70, 1).otherwise(2)


HOURS = SLOTS1 + """,
hw AS (
  SELECT room_id, session_id, window_id, start_us, end_us, avg(value) AS activity_mean, sum(value) AS activity_total,
         avg(k) AS k_mean, count(*) AS n_rows,
         CASE WHEN avg(value) < 25 THEN 0 WHEN avg(value) < 70 THEN 1 ELSE 2 END AS state_id
  FROM slots1 GROUP BY ALL)"""


def event_log(spark: SparkSession, sf: str, floor: float = 100.0) -> DataFrame:
    us = ntz_micros("ts")
    return table(spark, sf, "events").filter((F.col("event_type") == "error") & (F.col("value") >= floor)).select(
        F.col("event_id").cast("string").alias("event_id"), F.lit("large_error").alias("event_type"),
        F.col("user_id").cast("string").alias("room_id"), us.alias("event_start_us"), (us + HOUR_US).alias("event_end_us"),
        F.col("event_id").alias("event_seq"),
    )


EVENT_LOG = f"""ev AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, 'large_error' AS event_type, CAST(user_id AS VARCHAR) AS room_id,
         epoch_us(ts) AS event_start_us, epoch_us(ts) + {HOUR_US} AS event_end_us, event_id AS event_seq
  FROM events WHERE event_type = 'error' AND value >= 100)"""

# baseline half a day before, recovery a day after: the supplied events are sparse
BASELINE_MINUTES = 720
RECOVERY_MINUTES = 1_440


def labelled_hours(spark: SparkSession, sf: str) -> DataFrame:
    from windrow.operators.events import label_windows
    from windrow.settings import EventSettings

    settings = EventSettings(baseline_minutes=BASELINE_MINUTES, recovery_minutes=RECOVERY_MINUTES)
    return label_windows(hour_windows(spark, sf), event_log(spark, sf), settings, bin_seconds=86_400)


LABELLED = HOURS + ", " + EVENT_LOG + f""",
pairs AS (
  SELECT w.window_id, e.*, w.start_us, w.end_us,
         greatest(least(w.end_us, e.event_end_us) - greatest(w.start_us, e.event_start_us), 0) / 1e6 AS shared
  FROM hw w JOIN ev e ON w.room_id = e.room_id),
scored AS (
  SELECT *, CASE WHEN shared >= 1 THEN 3
                 WHEN end_us <= event_start_us AND end_us > event_start_us - {BASELINE_MINUTES * 60 * MICROS} THEN 2
                 WHEN start_us >= event_end_us AND start_us < event_end_us + {RECOVERY_MINUTES * 60 * MICROS} THEN 1 END AS pri
  FROM pairs),
best AS (
  SELECT * FROM scored WHERE pri IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY pri DESC, event_seq) = 1),
lab AS (
  SELECT hw.*, b.event_id, b.event_type,
         CASE b.pri WHEN 3 THEN 'during_entry' WHEN 2 THEN 'pre_entry_baseline' WHEN 1 THEN 'post_entry_recovery' ELSE 'outside_event_window' END AS event_phase,
         ((hw.start_us + hw.end_us) / 2 - b.event_start_us) / 1e6 AS seconds_from_event_start,
         ((hw.start_us + hw.end_us) / 2 - b.event_end_us) / 1e6 AS seconds_from_event_end,
         coalesce(b.shared, 0) AS event_overlap_seconds, coalesce(b.pri = 3, false) AS overlaps_event
  FROM hw LEFT JOIN best b USING (window_id))"""


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    """One row per order: a recording whose length is the summed line quantity."""
    lengths = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("duration_seconds"))
    orders = table(spark, sf, "orders")
    return orders.join(lengths, orders.o_orderkey == lengths.l_orderkey, "left").select(
        F.col("o_orderkey").cast("string").alias("media_id"), F.col("o_custkey").cast("string").alias("room_id"),
        F.col("o_orderstatus").alias("session_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("start_time"),
        "duration_seconds", F.lit("").alias("video_path"), (F.col("o_orderkey") % 3 == 0).alias("has_audio"),
        F.when(F.col("o_orderstatus") == "P", "warning").otherwise("ok").alias("quality_status"),
        F.when(F.col("o_orderstatus") == "P", "pending").otherwise("").alias("warnings"),
    )


RECORDINGS = """rec AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS media_id, CAST(o_custkey AS VARCHAR) AS room_id, o_orderstatus AS session_id, o_orderdate,
         d.duration_seconds, o_orderkey % 3 = 0 AS has_audio,
         CASE WHEN o_orderstatus = 'P' THEN 'warning' ELSE 'ok' END AS quality_status,
         CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE '' END AS warnings
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS duration_seconds FROM lineitem GROUP BY 1) d ON o_orderkey = l_orderkey)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as interval measurements at a fixed offset into their recording."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("media_id"), F.col("l_returnflag").alias("zone_id"),
        (F.col("l_linenumber") * 13.0 + F.col("l_suppkey") % 7).alias("center_sec"),
        F.ln("l_extendedprice").alias("activity"), F.col("l_discount").alias("ratio"), F.col("l_quantity").alias("quantity"),
    )


INTERVALS = """pts AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS media_id, l_returnflag AS zone_id, l_linenumber * 13.0 + l_suppkey % 7 AS center_sec,
         ln(l_extendedprice) AS activity, l_discount AS ratio, l_quantity AS quantity FROM lineitem)"""

# all windows of all recordings; range() with a correlated bound
WINDOWS_PARTIAL = RECORDINGS + """,
win AS (
  SELECT r.*, i AS window_index, i * 10.0 AS off,
         CASE WHEN coalesce(duration_seconds, 0) <= 0 THEN 30.0 ELSE least(30.0, greatest(duration_seconds - i * 10.0, 0)) END AS eff
  FROM (SELECT *, CASE WHEN coalesce(duration_seconds, 0) < 30 THEN 0 ELSE CAST(floor((duration_seconds - 30 + 1e-9) / 10) AS BIGINT) END AS last_index FROM rec) r,
       LATERAL (SELECT unnest(range(0, r.last_index + 1)) AS i) t)"""


def climate_sheet(spark: SparkSession, sf: str) -> DataFrame:
    """A daily sheet with texts, gaps and missing tokens, from the orders of each day."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    agg = table(spark, sf, "orders").groupBy(day.alias("d")).agg(
        F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.avg("o_totalprice").alias("m"),
        F.count(F.lit(1)).alias("n"), F.min("o_custkey").alias("c"), F.min("o_orderkey").alias("k"),
    )

    def text(value: Column, gap: Column, token: str) -> Column:
        return F.when(gap, F.lit(token)).otherwise(F.round(value, 3).cast("decimal(18,3)").cast("string"))

    return agg.select(
        F.when(F.col("n") % 2 == 0, F.datediff(F.col("d").cast("date"), F.lit("1899-12-30").cast("date")).cast("string")).otherwise(F.col("d")).alias("Date"),
        text(F.col("lo") / 10000, F.col("c") % 5 == 0, "NA").alias("Temp_AM_Min"),
        text(F.col("hi") / 10000, F.col("c") % 7 == 0, "n/a").alias("Temp_AM_Max"),
        text(F.col("m") / 10000, F.col("k") % 3 == 0, "").alias("Temp_PM"),
        text(F.col("n") * 5.0, F.col("k") % 4 == 0, "N/A").alias("RH_AM"),
        text(F.col("n") * 7.0, F.col("k") % 2 == 0, "na").alias("RH_PM"),
    )


CLIMATE = """sheet AS (
  SELECT CAST(o_orderdate AS DATE) AS date, min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS m, count(*) AS n,
         min(o_custkey) AS c, min(o_orderkey) AS k FROM orders GROUP BY 1),
raw AS (
  SELECT date, CASE WHEN c % 5 = 0 THEN NULL ELSE round(lo / 10000, 3) END AS temp_am_min,
         CASE WHEN c % 7 = 0 THEN NULL ELSE round(hi / 10000, 3) END AS temp_am_max,
         CASE WHEN k % 3 = 0 THEN NULL ELSE round(m / 10000, 3) END AS temp_pm,
         CASE WHEN k % 4 = 0 THEN NULL ELSE n * 5.0 END AS rh_am,
         CASE WHEN k % 2 = 0 THEN NULL ELSE n * 7.0 END AS rh_pm FROM sheet),
am AS (
  SELECT *, CASE WHEN temp_am_min IS NULL THEN temp_am_max WHEN temp_am_max IS NULL THEN temp_am_min ELSE (temp_am_min + temp_am_max) / 2 END AS temp_am_mean FROM raw),
clim AS (
  SELECT *, CASE WHEN temp_am_mean IS NULL THEN temp_pm WHEN temp_pm IS NULL THEN temp_am_mean ELSE (temp_am_mean + temp_pm) / 2 END AS temp_daily_mean,
         CASE WHEN rh_am IS NULL THEN rh_pm WHEN rh_pm IS NULL THEN rh_am ELSE (rh_am + rh_pm) / 2 END AS rh_daily_mean,
         temp_am_max - temp_am_min AS temp_daily_range FROM am)"""

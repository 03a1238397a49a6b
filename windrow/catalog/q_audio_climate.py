"""Climate tables, the multimodal merge, and correlations between modalities."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.functions.times import iso_text, micros_ntz
from windrow.operators import climate as cl, merge as mg, stats as st

_FLAG = """CASE WHEN temp_daily_mean IS NULL AND rh_daily_mean IS NULL THEN 'missing_temp_and_rh' WHEN temp_daily_mean IS NULL OR rh_daily_mean IS NULL THEN 'partial' ELSE 'ok' END"""


@query("climate_daily", f"""WITH {tb.CLIMATE}
SELECT strftime(date, '%Y-%m-%d') AS date, round(temp_am_min, 5) AS temp_am_min, round(temp_am_mean, 5) AS temp_am_mean, round(temp_daily_mean, 5) AS temp_daily_mean, round(rh_daily_mean, 5) AS rh_daily_mean,
       round(temp_daily_range, 5) AS temp_daily_range, {_FLAG} AS env_quality_flag FROM clim""")
def climate_daily(spark, sf):
    """Sheet texts, serial dates and missing tokens → typed daily table."""
    df = cl.normalize_climate(tb.climate_sheet(spark, sf))
    return rounded(df.select(F.date_format("date", "yyyy-MM-dd").alias("date"), "temp_am_min", "temp_am_mean", "temp_daily_mean", "rh_daily_mean", "temp_daily_range", "env_quality_flag"), 5)


# the events fall in one month of another year than the orders: days are matched by their place in the calendar
_SHIFT = "INTERVAL 26 YEAR"
_CTX = f"""WITH {tb.HOURS}, {tb.CLIMATE},
d AS (SELECT *, CAST(CAST(session_id AS DATE) - {_SHIFT} AS DATE) AS local_date, (start_us // 3600000000) % 24 AS h FROM hw),
x AS (SELECT d.*, c.temp_daily_mean, c.rh_daily_mean, CASE WHEN c.date IS NULL THEN NULL ELSE {_FLAG} END AS env_quality_flag,
             coalesce(CASE WHEN h < 12 THEN temp_am_mean ELSE temp_pm END, temp_daily_mean) AS temp_context, coalesce(CASE WHEN h < 12 THEN rh_am ELSE rh_pm END, rh_daily_mean) AS rh_context
      FROM d LEFT JOIN clim c ON c.date = d.local_date)"""


def _windows(spark, sf):
    df = tb.hour_windows(spark, sf)
    return df.withColumns(
        {
            "local_date": F.add_months(F.col("session_id").cast("date"), -26 * 12),
            "local_hour": (F.floor(F.col("start_us") / tb.HOUR_US) % 24).cast("int"),
        }
    )


@query("ampm_context", _CTX + " SELECT window_id, round(temp_context, 5) AS temp_context, round(rh_context, 5) AS rh_context, env_quality_flag FROM x")
def ampm_context(spark, sf):
    df = cl.attach_climate(_windows(spark, sf), cl.normalize_climate(tb.climate_sheet(spark, sf)), by_room=False)
    return rounded(df.select("window_id", "temp_context", "rh_context", "env_quality_flag"), 5)


def _modalities(spark, sf):
    rooms = _windows(spark, sf)
    times = {"start_time": iso_text(micros_ntz("start_us")), "end_time": iso_text(micros_ntz("end_us")), "media_id": F.concat(F.lit("m"), "room_id")}
    windows = rooms.withColumns(times).select(
        "window_id", "media_id", "room_id", "session_id", "start_time", "end_time", "start_us", "end_us", "local_date", "local_hour",
        F.when(F.col("n_rows") > 1, "warning").otherwise("ok").alias("quality_status"), F.when(F.col("n_rows") > 1, "busy").otherwise("").alias("warnings"), F.lit("v").alias("video_path"),
    )
    keys = ["window_id", "media_id", "room_id", "session_id", "start_time", "end_time"]
    full = rooms.withColumns(times)
    bio = full.filter("activity_mean < 150").select(*keys, "activity_mean", F.when(F.col("activity_mean") < 2, "failed").when(F.col("activity_mean") < 5, "warning").otherwise("ok").alias("quality_status"),
                                                    F.when(F.col("activity_mean") < 5, "quiet;busy").otherwise("").alias("warnings"))
    audio = full.filter("k_mean < 90").select(*keys, F.lit(True).alias("audio_available"), F.col("k_mean").alias("audio_rms"), F.when(F.col("k_mean") < 10, "partial_audio_window").otherwise("ok").alias("audio_quality_flag"), F.lit("").alias("warnings"))
    return windows, bio, audio, cl.normalize_climate(tb.climate_sheet(spark, sf))


@query("merged_table", _CTX + """,
m AS (SELECT window_id, activity_mean AS raw, CASE WHEN activity_mean < 150 THEN activity_mean END AS am, CASE WHEN activity_mean < 150 THEN CASE WHEN activity_mean < 2 THEN 'failed' WHEN activity_mean < 5 THEN 'warning' ELSE 'ok' END END AS vq,
             CASE WHEN k_mean < 90 THEN CASE WHEN k_mean < 10 THEN 'partial_audio_window' ELSE 'ok' END END AS aq, k_mean < 90 AS has, k_mean, n_rows, env_quality_flag AS eq, temp_context, rh_context FROM x)
SELECT window_id, round(am, 5) AS activity_mean, has AS audio_available, round(CASE WHEN has THEN k_mean END, 5) AS audio_rms, round(temp_context, 5) AS temp_context, round(rh_context, 5) AS rh_context,
  CASE WHEN am IS NULL OR vq = 'failed' THEN 'failed' WHEN aq IS NULL OR aq <> 'ok' THEN 'warning' WHEN eq IS NULL OR eq <> 'ok' THEN 'warning' WHEN n_rows > 1 THEN 'warning' WHEN vq = 'warning' THEN 'warning' ELSE 'ok' END AS quality_status,
  array_to_string(list_filter([CASE WHEN n_rows > 1 THEN 'busy' END, CASE WHEN am < 5 THEN 'quiet' END, CASE WHEN am < 5 AND n_rows = 1 THEN 'busy' END, CASE WHEN aq <> 'ok' THEN aq END, CASE WHEN eq <> 'ok' THEN eq END], lambda t: t IS NOT NULL), ';') AS warnings FROM m""")
def merged_table(spark, sf):
    """Windows with biomarkers, audio and climate; status and warnings by precedence."""
    df = mg.merge_modalities(*_modalities(spark, sf), climate_by_room=False)
    return rounded(df.select("window_id", "activity_mean", "audio_available", "audio_rms", "temp_context", "rh_context", "quality_status", "warnings"), 5)


_DAILY = f"""WITH {tb.CLIMATE},
dd AS (SELECT CAST(CAST(ts AS DATE) - {_SHIFT} AS DATE) AS date, avg(value) AS audio_value, avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS audio_k FROM events GROUP BY 1),
j AS (SELECT dd.*, clim.* EXCLUDE (date) FROM dd LEFT JOIN clim USING (date)),
p AS (SELECT date, e.env_feature, a.audio_feature, CASE e.env_feature WHEN 'temp_am_mean' THEN temp_am_mean WHEN 'temp_daily_mean' THEN temp_daily_mean ELSE rh_daily_mean END AS x,
             CASE a.audio_feature WHEN 'audio_value' THEN audio_value ELSE audio_k END AS y
      FROM j, (VALUES ('temp_am_mean'), ('temp_daily_mean'), ('rh_daily_mean')) e(env_feature), (VALUES ('audio_value'), ('audio_k')) a(audio_feature)),
v AS (SELECT * FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
rk AS (SELECT *, rank() OVER (PARTITION BY env_feature, audio_feature ORDER BY x) + (count(*) OVER (PARTITION BY env_feature, audio_feature, x) - 1) / 2.0 AS rx,
              rank() OVER (PARTITION BY env_feature, audio_feature ORDER BY y) + (count(*) OVER (PARTITION BY env_feature, audio_feature, y) - 1) / 2.0 AS ry FROM v)"""

_ENV, _AUDIO = ["temp_am_mean", "temp_daily_mean", "rh_daily_mean"], ["audio_value", "audio_k"]


def _daily(spark, sf):
    events = tb.table(spark, sf, "events").select(
        F.add_months(F.to_date("ts"), -26 * 12).alias("local_date"), F.col("value").alias("audio_value"), F.get_json_object("props", "$.k").cast("double").alias("audio_k")
    )
    climate = cl.normalize_climate(tb.climate_sheet(spark, sf)).withColumnRenamed("date", "local_date")
    return st.daily_means(events, _AUDIO).join(climate, "local_date", "left")


@query("daily_means", """SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(avg(value), 6) AS value FROM events GROUP BY 1""")
def daily_means(spark, sf):
    df = tb.table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "value")
    return rounded(st.daily_means(df, ["value"], "day"))


@query("daily_corr", _DAILY + " SELECT env_feature, audio_feature, count(*) AS n_samples, round(corr(x, y), 5) AS pearson_r, round(corr(rx, ry), 5) AS spearman_rho FROM rk GROUP BY 1, 2")
def daily_corr(spark, sf):
    return rounded(st.pair_correlations(_daily(spark, sf), _ENV, _AUDIO), 5)


def _within(r):
    """SQL: probability within ``r`` of Student's t with v = n - 2 degrees of freedom, by the finite sums for whole v."""
    odd = f"2 / pi() * (asin(least(abs({r}), 1.0)) + abs({r}) * coalesce(list_sum(list_transform(range(0, (n - 3) // 2), lambda j: sqrt(pi()) / 2 * exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * pow(1 - {r} * {r}, j + 0.5))), 0))"
    even = f"abs({r}) * list_sum(list_transform(range(0, (n - 2) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow(1 - {r} * {r}, j)))"
    return f"CASE WHEN n % 2 = 1 THEN {odd} ELSE {even} END"


def _adjusted(p):
    return f"least(greatest(min({p} * m / place_{p}) OVER (ORDER BY {p}, env_feature, audio_feature ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 1)"


@query("correlation_table", _DAILY + f""",
co AS (SELECT env_feature, audio_feature, count(*) AS n, corr(x, y) AS r, corr(rx, ry) AS s FROM rk GROUP BY 1, 2),
pp AS (SELECT *, greatest(1 - {_within("r")}, 0) AS p, greatest(1 - {_within("s")}, 0) AS q FROM co),
pl AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p, env_feature, audio_feature) AS place_p, row_number() OVER (ORDER BY q, env_feature, audio_feature) AS place_q FROM pp)
SELECT env_feature, audio_feature, n AS n_samples, round(r, 5) AS pearson_r, round(s, 5) AS spearman_rho, round(p, 5) AS pearson_p, round(q, 5) AS spearman_p,
       round({_adjusted("p")}, 5) AS pearson_fdr_bh, round({_adjusted("q")}, 5) AS spearman_fdr_bh FROM pl""")
def correlation_table(spark, sf):
    """With p-values and their adjustment."""
    return rounded(st.correlation_table(_daily(spark, sf), _ENV, _AUDIO), 5)


@query("strongest_association", _DAILY + " SELECT env_feature, audio_feature, round(corr(x, y), 5) AS pearson_r FROM rk GROUP BY 1, 2 ORDER BY abs(corr(x, y)) DESC NULLS LAST, 1, 2 LIMIT 1")
def strongest_association(spark, sf):
    table = st.pair_correlations(_daily(spark, sf), _ENV, _AUDIO)
    return rounded(st.strongest_association(table, "pearson_r").select("env_feature", "audio_feature", "pearson_r"), 5)

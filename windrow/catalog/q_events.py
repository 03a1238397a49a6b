"""Event labels, phase summaries, responses, model comparison measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.operators import events as ev
from windrow.settings import PHASES

_L = f"WITH {tb.LABELLED}"
_PH = "event_phase IN ('pre_entry_baseline', 'during_entry', 'post_entry_recovery')"
_PHT = "ph AS (SELECT * FROM (VALUES ('pre_entry_baseline'), ('during_entry'), ('post_entry_recovery')) v(phase))"


@query("event_phase_labels", _L + """
SELECT window_id, event_id, event_phase, round(seconds_from_event_start, 6) AS seconds_from_event_start, round(seconds_from_event_end, 6) AS seconds_from_event_end,
       round(event_overlap_seconds, 6) AS event_overlap_seconds, overlaps_event FROM lab""")
def event_phase_labels(spark, sf):
    df = tb.labelled_hours(spark, sf)
    return rounded(df.select("window_id", "event_id", "event_phase", "seconds_from_event_start", "seconds_from_event_end", "event_overlap_seconds", "overlaps_event"))


@query("event_labels_any_room", f"WITH {tb.HOURS}" + """,
wide AS (SELECT CAST(event_id AS VARCHAR) AS event_id, epoch_us(ts) AS event_start_us, epoch_us(ts) + 3600000000 AS event_end_us, event_id AS event_seq FROM events WHERE event_type = 'error' AND value >= 100),
s AS (SELECT w.window_id, e.event_id, e.event_seq, CASE WHEN (least(w.end_us, e.event_end_us) - greatest(w.start_us, e.event_start_us)) / 1e6 >= 1 THEN 3
             WHEN w.end_us <= e.event_start_us AND w.end_us > e.event_start_us - 7200000000 THEN 2 WHEN w.start_us >= e.event_end_us AND w.start_us < e.event_end_us + 7200000000 THEN 1 END AS pri FROM hw w, wide e),
b AS (SELECT * FROM s WHERE pri IS NOT NULL QUALIFY row_number() OVER (PARTITION BY window_id ORDER BY pri DESC, event_seq) = 1)
SELECT hw.window_id, b.event_id, coalesce(b.pri, 0) AS priority FROM hw LEFT JOIN b USING (window_id)""")
def event_labels_any_room(spark, sf):
    """Events without a room label the windows of every room."""
    from windrow.settings import EventSettings

    log = tb.event_log(spark, sf).withColumn("room_id", F.lit(""))
    df = ev.label_windows(tb.hour_windows(spark, sf), log, EventSettings(baseline_minutes=120, recovery_minutes=120))
    priority = F.when(F.col("event_phase") == PHASES[1], 3).when(F.col("event_phase") == PHASES[0], 2).when(F.col("event_phase") == PHASES[2], 1).otherwise(0)
    return rounded(df.select("window_id", "event_id", priority.alias("priority")))


@query("phase_counts", _L + " SELECT event_phase, count(*) AS n FROM lab GROUP BY 1")
def phase_counts(spark, sf):
    return tb.labelled_hours(spark, sf).groupBy("event_phase").agg(F.count(F.lit(1)).alias("n"))


@query("phase_summary", _L + f""", {_PHT},
x AS (SELECT *, event_phase AS phase, 'state_' || state_id AS state_label FROM lab WHERE {_PH} AND event_id IS NOT NULL),
a AS (SELECT phase, count(*) AS n, avg(activity_mean) AS am, max(activity_mean) AS ax, avg(k_mean) AS km FROM x GROUP BY 1),
c AS (SELECT phase, state_label, count(*) AS n FROM x GROUP BY 1, 2),
d AS (SELECT phase, state_label, n / sum(n) OVER (PARTITION BY phase) AS fr FROM c QUALIFY row_number() OVER (PARTITION BY phase ORDER BY n DESC, state_label) = 1)
SELECT ph.phase, coalesce(a.n, 0) AS n_windows, round(am, 6) AS activity_mean_mean, round(ax, 6) AS activity_mean_max, round(km, 6) AS k_mean_mean,
       coalesce(d.state_label, 'n/a') AS dominant_state_label, round(fr, 6) AS dominant_state_fraction FROM ph LEFT JOIN a USING (phase) LEFT JOIN d USING (phase)""")
def phase_summary(spark, sf):
    df = tb.labelled_hours(spark, sf).withColumn("state_label", F.concat(F.lit("state_"), F.col("state_id").cast("string")))
    out = ev.phase_summary(df, {"activity_mean_mean": "activity_mean", "k_mean_mean": "k_mean"}, {"activity_mean_max": "activity_mean"}, "state_label")
    return rounded(out.drop("phase_order"))


@query("phase_metric_long", _L + f""", {_PHT},
x AS (SELECT event_phase AS phase, unnest(['activity_mean', 'k_mean', 'n_rows']) AS metric, unnest([activity_mean, k_mean, CAST(n_rows AS DOUBLE)]) AS value FROM lab WHERE {_PH} AND event_id IS NOT NULL),
a AS (SELECT phase, metric, count(*) AS n, avg(value) AS mean, median(value) AS median, max(value) AS max, stddev_samp(value) AS std FROM x GROUP BY 1, 2),
b AS (SELECT metric, mean AS bm FROM a WHERE phase = 'pre_entry_baseline')
SELECT ph.phase, m.metric, coalesce(n, 0) AS n_windows, round(mean, 6) AS mean, round(median, 6) AS median, round(max, 6) AS max, round(std, 6) AS std,
       round(bm, 6) AS baseline_mean, round(CASE WHEN bm <> 0 THEN mean / bm END, 6) AS fold_change_vs_baseline, round(mean - bm, 6) + 0.0 AS mean_minus_baseline
FROM ph CROSS JOIN (SELECT unnest(['activity_mean', 'k_mean', 'n_rows']) AS metric) m LEFT JOIN a ON a.phase = ph.phase AND a.metric = m.metric LEFT JOIN b ON b.metric = m.metric""")
def phase_metric_long(spark, sf):
    return rounded(ev.phase_metrics_long(tb.labelled_hours(spark, sf), ["activity_mean", "k_mean", "n_rows"]))


@query("dominant_label", _L + """,
c AS (SELECT room_id, state_id, count(*) AS n FROM lab GROUP BY 1, 2)
SELECT room_id, CAST(state_id AS BIGINT) AS dominant_label, round(n / sum(n) OVER (PARTITION BY room_id), 6) AS dominant_fraction FROM c
QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY n DESC, state_id) = 1""")
def dominant_label(spark, sf):
    return rounded(ev.dominant(tb.hour_windows(spark, sf), ["room_id"], "state_id"))


@query("state_phase_share", _L + f""", {_PHT},
c AS (SELECT event_phase AS phase, count(*) FILTER (state_id = 0) AS a, count(*) FILTER (state_id = 1) AS b, count(*) FILTER (state_id = 2) AS c FROM lab GROUP BY 1)
SELECT ph.phase, round(a / (a + b + c), 6) AS share_0, round(b / (a + b + c), 6) AS share_1, round(c / (a + b + c), 6) AS share_2 FROM ph LEFT JOIN c USING (phase)""")
def state_phase_share(spark, sf):
    return rounded(ev.phase_state_shares(tb.labelled_hours(spark, sf), "state_id", [0, 1, 2]))


_MEANS = f"s AS (SELECT event_phase AS phase, avg(activity_mean) AS am, avg(k_mean) AS km, avg(n_rows) AS nm FROM lab WHERE {_PH} AND event_id IS NOT NULL GROUP BY 1)"


def _summary(spark, sf):
    return ev.phase_summary(tb.labelled_hours(spark, sf), {"am": "activity_mean", "km": "k_mean", "nm": "n_rows"}, {})


@query("strongest_response", _L + f""", {_MEANS},
d AS (SELECT abs(max(am) FILTER (phase = 'during_entry') - max(am) FILTER (phase = 'pre_entry_baseline')) AS a, abs(max(km) FILTER (phase = 'during_entry') - max(km) FILTER (phase = 'pre_entry_baseline')) AS k FROM s)
SELECT CASE WHEN a >= k THEN 'activity_mean' ELSE 'k_mean' END AS metric, round(greatest(a, k), 6) AS change FROM d""")
def strongest_response(spark, sf):
    return rounded(ev.strongest_response(_summary(spark, sf), {"activity_mean": "am", "k_mean": "km"}))


@query("phase_comparison", _L + f""", {_MEANS},
w AS (SELECT max(am) FILTER (phase = 'pre_entry_baseline') AS baseline, max(am) FILTER (phase = 'during_entry') AS during, max(am) FILTER (phase = 'post_entry_recovery') AS recovery FROM s)
SELECT round(baseline, 6) AS baseline, round(during, 6) AS during, round(recovery, 6) AS recovery, coalesce(during > baseline, false) AS increased, coalesce(recovery < during, false) AS recovered FROM w""")
def phase_comparison(spark, sf):
    return rounded(ev.phase_comparison(_summary(spark, sf), "am"))


@query("recovery_time", _L + """,
b AS (SELECT event_id, avg(activity_mean) AS bm FROM lab WHERE event_phase = 'pre_entry_baseline' GROUP BY 1)
SELECT l.event_id, round(l.seconds_from_event_end, 6) AS recovery_seconds FROM lab l JOIN b ON b.event_id = l.event_id WHERE event_phase = 'post_entry_recovery' AND activity_mean <= bm
QUALIFY row_number() OVER (PARTITION BY l.event_id ORDER BY start_us, window_id) = 1""")
def recovery_time(spark, sf):
    return rounded(ev.recovery_time(tb.labelled_hours(spark, sf), "activity_mean", ["event_id"]))


@query("compare_runs", _L + f""", {_MEANS},
p AS (SELECT event_phase AS phase, avg(activity_mean) AS am FROM lab WHERE {_PH} AND event_id IS NOT NULL AND n_rows = 1 AND event_phase <> 'during_entry' GROUP BY 1)
SELECT phase, round(s.am, 6) AS am_current, round(p.am, 6) AS am_previous, round(s.am - p.am, 6) + 0.0 AS am_difference FROM s FULL JOIN p USING (phase)""")
def compare_runs(spark, sf):
    """Phase means of this run next to those of another run that lacks a phase."""
    labelled = tb.labelled_hours(spark, sf)
    other = labelled.filter((F.col("n_rows") == 1) & (F.col("event_phase") != "during_entry"))
    before = ev.phase_summary(other, {"am": "activity_mean"}, {}).filter("n_windows > 0")
    return rounded(ev.compare_runs(_summary(spark, sf).filter("n_windows > 0"), before, ["am"]))


@query("model_metrics", _L + f""",
r AS (SELECT *, least(k_mean / 100, 1.0) AS risk, seconds_from_event_start / 60 AS minutes FROM lab),
b AS (SELECT avg(risk) AS m, avg(risk) + stddev_samp(risk) AS thr FROM r WHERE event_phase = 'pre_entry_baseline'),
pc AS (SELECT event_phase, state_id, count(*) AS n FROM r WHERE {_PH} GROUP BY 1, 2),
pur AS (SELECT avg(mx) AS purity FROM (SELECT event_phase, max(n) / sum(n) AS mx FROM pc GROUP BY 1)),
t AS (SELECT minutes FROM r, b WHERE event_phase = 'during_entry' AND risk > thr ORDER BY room_id, session_id, start_us, window_id LIMIT 1),
m AS (SELECT (SELECT avg(risk) FROM r WHERE event_phase = 'during_entry') AS dm, (SELECT avg(risk) FROM r WHERE event_phase = 'post_entry_recovery') AS rm,
             (SELECT avg(CAST(risk > thr AS INT)) FROM r, b WHERE event_phase = 'outside_event_window') AS fp, (SELECT avg(n_rows) FROM r) AS conf,
             (SELECT avg(n_rows) FROM r WHERE event_phase = 'during_entry') AS confd, (SELECT count(DISTINCT state_id) FROM r) AS occ),
u AS (SELECT unnest(['event_detection_contrast', 'state_purity_by_event_phase', 'time_to_detect_minutes', 'false_positive_rate_outside_event_window', 'posterior_confidence_mean',
                     'posterior_confidence_during_event', 'risk_mean_baseline', 'risk_mean_during_event', 'risk_mean_recovery', 'occupied_states']) AS metric_name,
             unnest([dm - b.m, purity, (SELECT minutes FROM t), fp, conf, confd, b.m, dm, rm, CAST(occ AS DOUBLE)]) AS value FROM m, b, pur)
SELECT metric_name, round(value, 6) AS value FROM u""")
def model_metrics(spark, sf):
    """The comparison measures of a state model, over a state and a score derived from the windows."""
    from windrow.models.metrics import model_metrics as measure

    df = tb.labelled_hours(spark, sf).withColumns(
        {"risk_score": F.least(F.col("k_mean") / 100, F.lit(1.0)), "state_probability_max": F.col("n_rows").cast("double")}
    )
    return rounded(measure(df).select("metric_name", "value"))


@query("event_from_media", """WITH m AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS s FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY 3, 1 LIMIT 1)
SELECT 'entry_1' AS event_id, CAST(o_custkey AS VARCHAR) AS room_id, s + 183000000 AS event_start_us, s + 300000000 AS event_end_us FROM m""")
def event_from_media(spark, sf):
    """Event at fixed offsets into the earliest recording of a folder-matched name."""
    from windrow.functions.times import instant_micros

    media = tb.recordings(spark, sf).join(
        tb.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("media_id"), "o_orderkey", "o_orderpriority"), "media_id"
    )
    media = media.withColumns({"video_path": F.concat(F.lit("Raw/"), "o_orderpriority"), "start_us": instant_micros("start_time")})
    return ev.event_from_media(media, "entries/1-URGENT", "entry_1", "entry", 183, 300, tie="o_orderkey").select("event_id", "room_id", "event_start_us", "event_end_us")

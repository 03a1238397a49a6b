"""State sequences: runs, smoothing, flags, ranks, peaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from windrow.catalog import testbed as tb
from windrow.catalog.registry import query, rounded
from windrow.operators import events as ev, nearby, resilience as rs, sequences as sq
from windrow.operators.ordered import time_axis, with_position
from windrow.operators.selection import spaced_extremes

_ROOM = ("room_id",)
_H = f"WITH {tb.HOURS}"


@query("state_runs", _H + """,
c AS (SELECT *, CASE WHEN state_id = lag(state_id) OVER w THEN 0 ELSE 1 END AS ch FROM hw WINDOW w AS (PARTITION BY room_id ORDER BY start_us)),
g AS (SELECT *, sum(ch) OVER (PARTITION BY room_id ORDER BY start_us) AS grp FROM c)
SELECT window_id, CAST(state_id AS BIGINT) AS state_id, count(*) OVER (PARTITION BY room_id, grp) AS state_run_length FROM g""")
def state_runs(spark, sf):
    df = sq.with_run_length(tb.hour_windows(spark, sf), time_axis(_ROOM))
    return rounded(df.select("window_id", "state_id", "state_run_length"))


@query("sustained_flag", _H + """,
m AS (SELECT *, state_id >= 1 AS up, row_number() OVER (PARTITION BY room_id ORDER BY start_us) AS rn FROM hw),
g AS (SELECT *, max(CASE WHEN up THEN 0 ELSE rn END) OVER (PARTITION BY room_id ORDER BY start_us) AS last_low FROM m)
SELECT window_id, up AND rn - last_low >= 3 AS sustained_risk_flag FROM g""")
def sustained_flag(spark, sf):
    level = F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("state_id") + 1)
    df = tb.hour_windows(spark, sf).withColumn("risk_level", level)
    return sq.with_sustained_flag(df, time_axis(_ROOM)).select("window_id", "sustained_risk_flag")


@query("smooth_states", _H.replace("WITH ", "WITH RECURSIVE ") + """,
p AS (SELECT room_id, window_id, state_id, row_number() OVER (PARTITION BY room_id ORDER BY start_us) AS pos,
             lead(state_id) OVER (PARTITION BY room_id ORDER BY start_us) AS nxt FROM hw),
r AS (SELECT room_id, window_id, pos, state_id AS s FROM p WHERE pos = 1
      UNION ALL
      SELECT p.room_id, p.window_id, p.pos, CASE WHEN p.nxt IS NOT NULL AND r.s = p.nxt AND p.state_id <> r.s THEN r.s ELSE p.state_id END
      FROM r JOIN p ON p.room_id = r.room_id AND p.pos = r.pos + 1)
SELECT window_id, CAST(s AS BIGINT) AS smoothed_state FROM r""")
def smooth_states(spark, sf):
    """Sequential three-point smoothing, computed without a sequential pass."""
    return rounded(sq.with_smoothed(tb.hour_windows(spark, sf), time_axis(_ROOM)).select("window_id", "smoothed_state"))


@query("change_points", _H + """,
c AS (SELECT *, lag(state_id) OVER w AS prev FROM hw WINDOW w AS (PARTITION BY room_id, session_id ORDER BY start_us))
SELECT window_id, CAST(state_id AS BIGINT) AS state_id FROM c WHERE prev IS NULL OR prev <> state_id""")
def change_points(spark, sf):
    return rounded(ev.change_points(tb.hour_windows(spark, sf), time_axis(("room_id", "session_id")), "state_id").select("window_id", "state_id"))


@query("row_positions", _H + """
SELECT window_id, row_number() OVER (PARTITION BY room_id ORDER BY start_us) AS room_position, row_number() OVER (ORDER BY start_us, window_id) - 1 AS frame_index FROM hw""")
def row_positions(spark, sf):
    """Positions inside a room and over the whole table."""
    df = with_position(tb.hour_windows(spark, sf), time_axis(_ROOM), "room_position")
    df = with_position(df, time_axis(()), "frame_index").withColumn("frame_index", F.col("frame_index") - 1)
    return rounded(df.select("window_id", "room_position", "frame_index"))


@query("zscore_room", _H + """
SELECT window_id, round(CASE WHEN stddev_pop(activity_mean) OVER w = 0 THEN 0 ELSE (activity_mean - avg(activity_mean) OVER w) / stddev_pop(activity_mean) OVER w END, 6) AS zscore
FROM hw WINDOW w AS (PARTITION BY room_id)""")
def zscore_room(spark, sf):
    return rounded(sq.with_zscore(tb.hour_windows(spark, sf), "activity_mean", ["room_id"]).select("window_id", "zscore"))


_PEAKS = """,
z AS (SELECT *, CASE WHEN stddev_pop(activity_mean) OVER r = 0 THEN 0 ELSE (activity_mean - avg(activity_mean) OVER r) / stddev_pop(activity_mean) OVER r END AS zscore,
             coalesce(lag(activity_mean) OVER o, activity_mean) AS pa, coalesce(lead(activity_mean) OVER o, activity_mean) AS na
      FROM hw WINDOW r AS (PARTITION BY room_id), o AS (PARTITION BY room_id ORDER BY start_us)),
k AS (SELECT *, activity_mean >= pa AND activity_mean >= na AND zscore >= 1.0 AS peak FROM z),
q AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY peak DESC, zscore DESC, activity_mean DESC, start_us) AS rk FROM k)"""


@query("peaks_topk", _H + _PEAKS + """
SELECT room_id || '_candidate_peak_' || lpad(CAST(rk AS VARCHAR), 2, '0') AS event_id, window_id, round(activity_mean, 6) AS activity, round(zscore, 6) AS zscore
FROM q WHERE rk <= 3 AND (peak OR rk = 1)""")
def peaks_topk(spark, sf):
    return rounded(rs.detect_peaks(tb.hour_windows(spark, sf)).select("event_id", "window_id", "activity", "zscore"))


_NEAREST = f"WITH {tb.HOURS}, {tb.EVENT_LOG}" + """,
near_ev AS (SELECT event_id, event_type, room_id, event_start_us + 5400000000 AS event_start_us, event_end_us + 1800000000 AS event_end_us, event_seq FROM ev),
hit AS (SELECT e.event_id, w.window_id, w.start_us FROM near_ev e JOIN hw w ON w.room_id = e.room_id AND w.start_us <= e.event_end_us AND w.end_us >= e.event_start_us),
lonely AS (SELECT * FROM near_ev WHERE event_id NOT IN (SELECT event_id FROM hit)),
nn AS (SELECT e.event_id, w.window_id FROM lonely e JOIN hw w ON w.room_id = e.room_id
       QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY abs(w.start_us - e.event_start_us), w.start_us, w.window_id) = 1),
matched AS (SELECT event_id, window_id, 'overlap' AS matched FROM hit UNION ALL SELECT event_id, window_id, 'nearest' FROM nn)"""


def _late_events(spark, sf):
    log = tb.event_log(spark, sf)
    return log.withColumns({"event_start_us": F.col("event_start_us") + 5_400_000_000, "event_end_us": F.col("event_end_us") + 1_800_000_000})


@query("nearest_event_fallback", _NEAREST + " SELECT event_id, window_id, matched FROM matched")
def nearest_event_fallback(spark, sf):
    """Windows meeting each event; an event that meets none takes the nearest window start."""
    return nearby.met_or_nearest(_late_events(spark, sf), tb.hour_windows(spark, sf), bin_seconds=86_400, count=tb.row_count(spark, sf, "events")).select("event_id", "window_id", "matched")


_RECOVERY = _NEAREST + """,
pos AS (SELECT *, row_number() OVER (PARTITION BY room_id ORDER BY start_us) AS pos FROM hw),
pk AS (SELECT m.event_id, p.room_id, p.pos AS peak, p.activity_mean AS pact, p.window_id AS pwin, p.end_us AS pend
       FROM matched m JOIN pos p USING (window_id) QUALIFY row_number() OVER (PARTITION BY m.event_id ORDER BY p.activity_mean DESC, p.pos) = 1),
b AS (SELECT k.event_id, count(p.pos) AS nb, coalesce(avg(p.activity_mean), any_value(k.pact)) AS base FROM pk k LEFT JOIN pos p ON p.room_id = k.room_id AND p.pos >= k.peak - 2 AND p.pos < k.peak GROUP BY 1),
t AS (SELECT k.*, b.nb, b.base, b.base + 0.2 * greatest(k.pact - b.base, 0) AS thr FROM pk k JOIN b USING (event_id)),
c AS (SELECT t.event_id, min(p.pos) FILTER (p.pos > t.peak AND p.activity_mean <= t.thr) AS calm, max(p.pos) AS lastpos
      FROM t JOIN pos p ON p.room_id = t.room_id AND p.pos BETWEEN t.peak AND t.peak + 6 GROUP BY 1),
e AS (SELECT t.*, c.calm, coalesce(c.calm, c.lastpos) AS fin FROM t JOIN c USING (event_id)),
a AS (SELECT e.event_id, any_value(e.pwin) AS peak_window_id, any_value(e.base) AS base, any_value(e.pact) AS pact, any_value(e.nb) AS nb, any_value(e.fin - e.peak) AS steps, any_value(e.pend) AS pend,
             bool_or(e.calm IS NOT NULL) AS rec, sum(greatest(p.activity_mean - e.base, 0)) * 3600 AS area,
             max(p.end_us) FILTER (p.pos = e.fin) AS fend, max(p.activity_mean) FILTER (p.pos = e.fin) AS fact
      FROM e JOIN pos p ON p.room_id = e.room_id AND p.pos BETWEEN e.peak AND e.fin GROUP BY 1)"""


@query("recovery_metrics", _RECOVERY + """
SELECT event_id, peak_window_id, round(base, 6) AS baseline_activity, round(pact, 6) AS peak_activity, nb AS baseline_window_count, steps AS recovery_time_windows,
       round((fend - pend) / 1e6, 6) AS recovery_time_seconds, round(CASE WHEN fend > pend THEN (fact - pact) / ((fend - pend) / 1e6) ELSE 0 END, 6) + 0.0 AS recovery_slope,
       round(area, 4) AS area_under_recovery_curve, rec AS recovered_flag FROM a""")
def recovery_metrics(spark, sf):
    summary, _ = rs.evaluate_events(tb.hour_windows(spark, sf), _late_events(spark, sf))
    return rounded(summary.select(
        "event_id", "peak_window_id", "baseline_activity", "peak_activity", "baseline_window_count", "recovery_time_windows",
        "recovery_time_seconds", "recovery_slope", F.round("area_under_recovery_curve", 4).alias("area_under_recovery_curve"), "recovered_flag",
    ))


@query("resilience_overlay", _RECOVERY + """,
n AS (SELECT e.event_id, ne.event_seq, p.window_id, CASE WHEN p.pos < e.peak THEN 'baseline' WHEN p.pos = e.peak THEN 'during' ELSE 'recovery' END AS event_phase,
             least(greatest(p.activity_mean - e.base, 0) / CASE WHEN e.pact > e.base THEN e.pact - e.base ELSE 1 END, 1.5) AS pressure
      FROM e JOIN near_ev ne USING (event_id) JOIN pos p ON p.room_id = e.room_id AND p.pos BETWEEN e.peak - 2 AND e.fin
      QUALIFY row_number() OVER (PARTITION BY p.window_id ORDER BY ne.event_seq DESC) = 1)
SELECT hw.window_id, n.event_id, coalesce(n.event_phase, 'normal') AS event_phase, round(coalesce(n.pressure, 0), 6) AS resilience_pressure_index FROM hw LEFT JOIN n USING (window_id)""")
def resilience_overlay(spark, sf):
    """Windows annotated by the latest event that touches them."""
    annotated, _ = rs.compute_resilience(tb.hour_windows(spark, sf), _late_events(spark, sf))
    return rounded(annotated.select("window_id", "event_id", "event_phase", "resilience_pressure_index"))


@query("rank_pct", """SELECT o_orderkey, round(rank() OVER (ORDER BY o_totalprice) / CAST(count(*) OVER () AS DOUBLE), 6) AS rank_pct FROM orders""")
def rank_pct(spark, sf):
    orders = tb.table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return rounded(sq.rank_percent(orders, "o_totalprice", F.floor(F.col("o_totalprice") / 1000)).select("o_orderkey", "rank_pct"))


@query("peak_row", _H + """
SELECT room_id, window_id, round(activity_mean, 6) AS activity_mean FROM hw QUALIFY row_number() OVER (PARTITION BY room_id ORDER BY activity_mean DESC, start_us, window_id) = 1""")
def peak_row(spark, sf):
    return rounded(sq.peak_rows(tb.hour_windows(spark, sf), "activity_mean", ["room_id"], ["start_us", "window_id"]).select("room_id", "window_id", "activity_mean"))


@query("primary_sequence", _H + " SELECT room_id, session_id, count(*) AS rows FROM hw GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1")
def primary_sequence(spark, sf):
    return sq.primary_sequence(tb.hour_windows(spark, sf), ["room_id", "session_id"])


@query("risk_levels", _H + """
SELECT window_id, CASE WHEN r < 0.33 THEN 'low' WHEN r <= 0.66 THEN 'medium' ELSE 'high' END AS risk_level,
       CASE WHEN r <= 0.33 THEN 'low' WHEN r <= 0.66 THEN 'medium' ELSE 'high' END AS risk_level_binned FROM (SELECT window_id, round(least(k_mean / 100, 1), 2) AS r FROM hw)""")
def risk_levels(spark, sf):
    df = tb.hour_windows(spark, sf).withColumn("r", F.round(F.least(F.col("k_mean") / 100, F.lit(1.0)), 2))
    return df.select("window_id", sq.risk_level(F.col("r")).alias("risk_level"), sq.risk_level_binned(F.col("r")).alias("risk_level_binned"))


_PICKS = [
    {"name": "activity_peak", "metric": "activity_mean"},
    {"name": "second_peak", "metric": "k_mean", "floors": {"activity_mean": 40.0}},
    {"name": "calm", "metric": "activity_mean", "lowest": True, "any_hour": True},
    {"name": "spread", "metric": "activity_total", "floors": {"activity_mean": 20.0, "activity_total": 100.0}},
]


def _picks_sql() -> str:
    parts, gaps = [f"WITH {tb.HOURS}", "x AS (SELECT *, (start_us // 3600000000) % 24 AS local_hour FROM hw)"], ""
    for i, rule in enumerate(_PICKS):
        metric = rule["metric"]
        where = "TRUE" + ("" if rule.get("any_hour") else " AND local_hour >= 7 AND local_hour < 17")
        where += "".join(f" AND {c} >= {least}" for c, least in rule.get("floors", {}).items())
        parts.append(f"p{i} AS (SELECT '{rule['name']}' AS selection_key, window_id, start_us, {metric} AS v, (SELECT count(*) FROM x b WHERE b.{metric} < a.{metric}) + 1 AS r FROM x a WHERE {where}{gaps} ORDER BY {metric} {'ASC' if rule.get('lowest') else 'DESC'}, start_us, window_id LIMIT 1)")
        gaps += f" AND abs(start_us - (SELECT start_us FROM p{i})) >= 1200000000"
    union = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(len(_PICKS)))
    return ", ".join(parts) + f" SELECT selection_key, window_id, round(v, 6) AS selection_value, round(r / (SELECT CAST(count(*) AS DOUBLE) FROM x), 6) AS selection_rank_pct FROM ({union})"


@query("greedy_evidence", _picks_sql())
def greedy_evidence(spark, sf):
    """One extreme window per rule, each far enough from the picks before it."""
    df = tb.hour_windows(spark, sf).withColumn("local_hour", (F.floor(F.col("start_us") / tb.HOUR_US) % 24).cast("int"))
    return rounded(spaced_extremes(df, _PICKS).select("selection_key", "window_id", "selection_value", "selection_rank_pct"))

"""Biomarkers, climate, merge, statistics, guards, timelines."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.functions.times import with_time_columns
from windrow.operators import biomarkers as bm, climate as cl, diagnostics as dg, merge as mg, quantiles as qt, stats as st, timeline as tl

ZONES = (
    "window_id string, media_id string, system_id string, room_id string, session_id string, zone_id string, start_time string, end_time string, "
    "duration_seconds double, activity_mean double, activity_std double, motion_pixel_ratio double, warnings string"
)


def zone_rows(spark):
    base = ("media_1", "free_range", "room_1", "s1")
    t1, t2 = ("2025-08-16T09:00:00-03:00", "2025-08-16T09:00:30-03:00"), ("2025-08-16T09:05:00-03:00", "2025-08-16T09:05:30-03:00")
    rows = [
        ("w1", *base, "zone_A", *t1, 30.0, 0.10, 0.01, 0.05, ""), ("w1", *base, "zone_B", *t1, 30.0, 0.20, 0.01, 0.06, "x|y"),
        ("w2", *base, "zone_A", *t2, 30.0, 0.30, 0.02, 0.10, ""), ("w2", *base, "zone_B", *t2, 30.0, 0.80, 0.03, 0.18, "y"),
    ]
    return with_time_columns(spark.createDataFrame(rows, ZONES))


def test_two_windows_two_zones(spark):
    got = {r["window_id"]: r for r in bm.room_biomarkers(zone_rows(spark)).collect()}
    w1, w2 = got["w1"], got["w2"]
    assert w1["distribution"] == pytest.approx({"zone_A": 1 / 3, "zone_B": 2 / 3}) and w1["occupancy_imbalance_index"] == pytest.approx(1 / 6)
    assert (w1["activity_mean"], w1["transition_proxy"], w1["normalized_activity"], w1["mobility_index"]) == (pytest.approx(0.15), 0.0, 0.0, 0.0)
    assert w2["occupancy_imbalance_index"] == pytest.approx(0.2272727, abs=1e-6) and w2["transition_proxy"] == pytest.approx(0.0606061, abs=1e-6)
    assert w2["normalized_activity"] == 1.0 and w2["mobility_index"] == pytest.approx(0.7181818, abs=1e-6)
    assert w1["warnings"] == "x | y" and w1["zone_count"] == 2 and w1["session_id"] == "s1"


def test_no_activity_is_uniform(spark):
    df = zone_rows(spark).withColumns({c: F.lit(None).cast("double") for c in ("activity_mean", "activity_std", "motion_pixel_ratio")})
    row = bm.window_distribution(df).first()
    assert row["distribution_fallback_used"] and row["spatial_freedom_index"] == pytest.approx(1.0) and row["missing_zone_count"] == 2
    assert row["distribution_source"] == "uniform_zero_activity_fallback"


def test_proxy_preference(spark):
    df = spark.createDataFrame([(None, 0.2, 0.3), (0.1, 0.2, 0.3), (None, None, 0.3), (None, None, None)], "activity_mean double, motion_pixel_ratio double, activity_std double")
    got = [(r["activity_proxy_raw"], r["source_activity_field"]) for r in bm.with_activity_proxy(df).collect()]
    assert got == [(0.2, "motion_pixel_ratio"), (0.1, "activity_mean"), (0.3, "activity_std"), (None, "missing")]


def test_semantic_shares_and_status(spark):
    rows = [
        ("w1", "drinking_zone", 0.2, "ok", "", 1), ("w1", "feeding_zone", 0.3, "warning", "b", 2), ("w1", "general_zone", 0.9, "ok", "a", 3), ("w1", "general_zone", 0.5, "ok", "a;b", 4),
        ("w2", "drinking_zone", None, "failed", "x", 1),
    ]
    df = spark.createDataFrame(rows, "window_id string, zone_id string, activity_mean double, quality_status string, warnings string, n int")
    got = {r["window_id"]: r for r in bm.semantic_shares(df, ["window_id"], "n").collect()}
    assert (got["w1"]["drinking_activity_fraction"], got["w1"]["general_activity_fraction"]) == (pytest.approx(0.2), pytest.approx(0.5))
    assert got["w1"]["quality_status"] == "warning" and got["w1"]["drinking_to_feeding_activity_ratio"] == pytest.approx(2 / 3)
    assert got["w2"]["quality_status"] == "failed" and got["w2"]["spatial_freedom_index"] == pytest.approx(1.0)
    assert got["w2"]["activity_mean"] == 0.0 and got["w2"]["feeding_activity_fraction"] == pytest.approx(1 / 3)
    merged = {r["window_id"]: r["warnings"] for r in bm.merge_tokens(df, ["window_id"], F.col("n")).collect()}
    assert merged == {"w1": "b;a", "w2": "x"}


def test_climate_sheet(spark):
    rows = [("45984", "20", "24", "25", "50", "55"), ("2025-08-16", "24", "28", "27", "40", "50"), ("2025-08-17", "NA", "", "30.7", "n/a", "49"), ("bad", "1", "2", "3", "4", "5"), ("2025-08-18", "na", "N/A", "", "", "NA")]
    sheet = spark.createDataFrame(rows, "Date string, Temp_AM_Min string, Temp_AM_Max string, Temp_PM string, RH_AM string, RH_PM string")
    got = {str(r["date"]): r for r in cl.normalize_climate(sheet, "room_1").collect()}
    assert (got["2025-11-23"]["temp_am_mean"], got["2025-11-23"]["temp_daily_mean"], got["2025-11-23"]["rh_daily_mean"]) == (22.0, 23.5, 52.5)
    r = got["2025-08-16"]
    assert (r["temp_am_mean"], r["temp_daily_mean"], r["rh_daily_mean"], r["temp_daily_range"], r["env_quality_flag"], r["room_id"]) == (26.0, 26.5, 45.0, 4.0, "ok", "room_1")
    assert got["2025-08-17"]["temp_daily_mean"] == 30.7 and got["2025-08-17"]["rh_daily_mean"] == 49.0 and got["2025-08-17"]["temp_daily_range"] is None
    assert got["None"]["env_quality_flag"] == "date_parse_failed" and got["2025-08-18"]["env_quality_flag"] == "missing_temp_and_rh"
    with pytest.raises(ValueError, match="RH_PM"):
        cl.normalize_climate(sheet.drop("RH_PM"))


CLIMATE = "room_id string, date date, temp_am_mean double, temp_pm double, temp_daily_mean double, rh_am double, rh_pm double, rh_daily_mean double, env_quality_flag string"


def climate(spark, day="2025-08-17", copies=1, values=(25.0, 27.0, 26.0, 40.0, 50.0, 45.0)):
    import datetime

    return spark.createDataFrame([("room_1", datetime.date.fromisoformat(day), *values, "ok")] * copies, CLIMATE)


def test_context_uses_the_local_clock(spark):
    times = ["2025-08-17T08:00:00-03:00", "2025-08-17T15:00:00-03:00", "2025-08-17T22:30:00-03:00", "2025-08-18T00:10:00-03:00"]
    windows = with_time_columns(spark.createDataFrame([(t, "room_1") for t in times], "start_time string, room_id string"))
    got = {r["start_time"]: (r["temp_context"], r["rh_context"]) for r in cl.attach_climate(windows, climate(spark, copies=3)).collect()}
    assert got == {times[0]: (25.0, 40.0), times[1]: (27.0, 50.0), times[2]: (27.0, 50.0), times[3]: (None, None)}


KEYS = "window_id string, media_id string, room_id string, session_id string, start_time string, end_time string"
KEY = ("media_000001_w0001", "media_000001", "room_1", "room_1_test", "2025-08-16T06:00:00-03:00", "2025-08-16T06:00:30-03:00")


def modalities(spark, audio_flag="ok", media_status="ok"):
    windows = with_time_columns(spark.createDataFrame([(*KEY, 30.0, "v.mp4", media_status, "")], KEYS + ", duration_seconds double, video_path string, quality_status string, warnings string"))
    bio = spark.createDataFrame([(*KEY, 0.5, 0.8, 0.2, 0.1, "ok", "")], KEYS + ", activity_mean double, spatial_freedom_index double, occupancy_imbalance_index double, semantic_transition_proxy double, quality_status string, warnings string")
    audio = spark.createDataFrame([(*KEY, True, 0.1, audio_flag, "")] * 2, KEYS + ", audio_available boolean, audio_rms double, audio_quality_flag string, warnings string")
    return windows, bio, audio, climate(spark, "2025-08-16", values=(22.0, 25.0, 23.5, 50.0, 55.0, 52.5))


def test_merge(spark):
    df = mg.merge_modalities(*modalities(spark))
    assert df.columns == list(mg.REQUIRED) and len(df.columns) == 31 and df.count() == 1
    r = df.first()
    assert (r["temp_context"], r["rh_context"], r["quality_status"], r["warnings"], r["audio_rms"]) == (22.0, 50.0, "ok", "", 0.1)


@pytest.mark.parametrize(
    ("change", "status", "warnings"),
    [
        ({"audio_flag": "no_audio_samples"}, "warning", "no_audio_samples"), ({"audio_flag": "manifest_has_audio_false"}, "ok", "manifest_has_audio_false"),
        ({"media_status": "failed"}, "failed", ""), ({"media_status": "warning"}, "warning", ""),
    ],
)
def test_merge_precedence(spark, change, status, warnings):
    r = mg.merge_modalities(*modalities(spark, **change)).first()
    assert (r["quality_status"], r["warnings"]) == (status, warnings)


def test_merge_without_a_modality(spark):
    windows, bio, audio, days = modalities(spark)
    assert mg.merge_modalities(windows, bio.limit(0), audio, days).first()["quality_status"] == "failed"
    assert mg.merge_modalities(windows, bio, audio.limit(0), days).first()["quality_status"] == "warning"
    none = mg.merge_modalities(windows, bio, None, days).first()
    assert none["quality_status"] == "ok" and none["audio_available"] is False
    assert mg.merge_modalities(windows, bio, audio, None).first()["quality_status"] == "warning"


def test_outer_metadata_and_failed_rows(spark):
    a = spark.createDataFrame([("w1", "m1", "z")], "window_id string, media_id string, zone_config_id string")
    b = spark.createDataFrame([("w1", "m9", 5.0), ("w2", "m2", 6.0)], "window_id string, media_id string, offset double")
    m = spark.createDataFrame([("m1", "p1")], "media_id string, path string")
    got = {r["window_id"]: r.asDict() for r in mg.outer_metadata(a, b, m).collect()}
    assert got["w1"]["offset"] == 5.0 and got["w1"]["path"] == "p1" and got["w2"]["media_id"] is None and set(got) == {"w1", "w2"}
    f = spark.createDataFrame([("s", "w1", "m", "r", "i"), ("s", "w1", "m", "r", "i"), ("s", "w1", "m", "r", "j")], "stage string, window_id string, media_id string, room_id string, issue string")
    assert mg.combine_failed(f, f).count() == 2


def test_guards(spark):
    df = spark.createDataFrame([("room_1", "s", "w1", "t1", 0), ("room_1", "s", "w1", "t1", 1), ("room_1", "s", "w2", "t2", 1)], "room_id string, session_id string, window_id string, start_time string, state_id int")
    with pytest.raises(ValueError, match="one row per room/window"):
        dg.require_unique(df, ["room_id", "window_id"], "table")
    d = dg.sequence_diagnostics(df).first()
    assert d["duplicate_start_time_rows"] == 2 and d["multi_state_start_time_groups"] == 1 and not d["is_valid_temporal_sequence"]
    with pytest.raises(ValueError):
        dg.require_valid_sequence(df)
    dg.require_valid_sequence(df.filter("state_id = 1"))
    assert dg.require_unique(df.filter("state_id = 1"), ["room_id", "window_id"], "table").count() == 2


@pytest.mark.parametrize("kind", ["uniform", "constant", "heavy", "negative", "tiny"])
@pytest.mark.parametrize("accuracy", [5, 20_000])
def test_percentiles_are_exact(spark, kind, accuracy):
    rng = random.Random(1)
    make = {
        "uniform": lambda: rng.uniform(0, 1), "constant": lambda: 4.25, "heavy": lambda: rng.paretovariate(0.3), "negative": lambda: rng.gauss(-1e9, 1e8),
        "tiny": lambda: rng.uniform(-1e-9, 1e-9),
    }[kind]
    data = [(rng.choice(["a", "b", None]), make()) for _ in range(501)] + [("one", 3.0), ("a", None), ("a", float("nan")), ("none", None)]
    df = spark.createDataFrame(data, "g string, v double")
    got = {r["g"]: (r["q1"], r["q5"], r["q9"]) for r in qt.exact_percentiles(df, ["g"], "v", {"q1": 0.1, "q5": 0.5, "q9": 0.99}, accuracy=accuracy).collect()}
    groups = {g: [v for k, v in data if k == g and v is not None and v == v] for g in {k for k, _ in data}}
    want = {g: tuple(np.percentile(v, [10, 50, 99])) for g, v in groups.items() if v}
    assert set(got) == set(want)
    for g in want:
        assert got[g] == pytest.approx(want[g], rel=1e-9, abs=1e-18)


def test_correlations(spark):
    data = [(1.0, 2.0), (2.0, 4.1), (3.0, 5.9), (4.0, 8.3), (5.0, 9.0), (5.0, None)]
    df = spark.createDataFrame([(i, *p, 1.0) for i, p in enumerate(data)], "d int, x double, y double, flat double")
    got = {(r["env_feature"], r["audio_feature"]): r for r in st.correlation_table(df, ["x", "flat"], ["y"]).collect()}
    r = got["x", "y"]
    assert r["n_samples"] == 5 and r["pearson_r"] == pytest.approx(np.corrcoef([p[0] for p in data[:5]], [p[1] for p in data[:5]])[0, 1])
    assert r["spearman_rho"] == pytest.approx(1.0) and r["spearman_p"] == pytest.approx(0.0, abs=1e-9)
    assert got["flat", "y"]["pearson_r"] is None and got["flat", "y"]["pearson_fdr_bh"] is None
    # r = 0.5 with 12 rows: t = 1.8257, two-sided p = 0.0979
    assert spark.range(1).select(st.correlation_p_value(F.lit(0.5), F.lit(12.0))).first()[0] == pytest.approx(0.0979, abs=2e-4)
    assert spark.range(1).select(st.correlation_p_value(F.lit(0.95), F.lit(3.0))).first()[0] == pytest.approx(0.20216, abs=1e-4)


def test_grid_timeline(spark):
    rows = [("w1", z, v, "a;b" if z == "C" else "b") for z, v in (("A", 0.0), ("B", None), ("C", 2.0))]
    features = spark.createDataFrame(rows, "window_id string, zone_id string, activity_mean double, warnings string").withColumn("start_time", F.lit("t"))
    extra = features.unionByName(spark.createDataFrame([("w1", "D", 4.0, "", "t")], "window_id string, zone_id string, activity_mean double, warnings string, start_time string"))
    layout = spark.createDataFrame([("A", 0, 0), ("B", 0, 1), ("C", 1, 0), ("D", 1, 1)], "zone_id string, row int, col int")
    frame = tl.grid_timeline(extra, layout).first()
    assert [(z["zone_id"], z["activity"]) for z in frame["zones"]] == [("A", 0.0), ("B", None), ("C", 0.5), ("D", 1.0)]
    assert frame["warnings"] == ["b", "a"]
    line = json.loads(tl.to_json_lines(tl.grid_timeline(extra, layout)).first()["value"])
    assert line["zones"][1] == {"zone_id": "B", "row": 0, "col": 1, "activity": None, "activity_raw": None}


def test_twin_timeline(spark):
    zones = spark.createDataFrame([("w1", "room_1", "B", 0.4), ("w1", "room_1", "A", 0.2)], "window_id string, room_id string, zone_id string, activity_mean double")
    bio = spark.createDataFrame([("w1", "room_1", 1, 0.4, 0.9, 0.1, 0.3)], "window_id string, room_id string, start_us bigint, mobility_index double, spatial_freedom_index double, occupancy_imbalance_index double, activity_mean double")
    states = spark.createDataFrame([("w1", "room_1", 0, "stable_low_activity", 0.95, 0.2, "low", False)], "window_id string, room_id string, state_id int, state_label string, state_probability_max double, welfare_risk_score double, risk_level string, sustained_risk_flag boolean")
    frame = tl.twin_timeline(zones, bio, states).first()
    assert frame["frame_index"] == 0 and frame["state"]["state_label"] == "stable_low_activity" and frame["event"]["event_phase"] == "normal"
    assert [(z["zone_id"], z["activity_norm"]) for z in frame["zones"]] == [("A", 0.0), ("B", 1.0)]
    rooms = tl.room_headers(bio, spark.createDataFrame([("zone_a", 0, 1)], "zone_id string, row int, col int")).first()
    assert rooms["zones"][0]["display_name"] == "Zone A" and rooms["zones"][0]["polygon"][2] == (2.0, 1.0)


def test_fallback_join_runs_only_when_nothing_matched(spark):
    left = spark.createDataFrame([("w1", "r", "t1"), ("w2", "r", "t2")], "window_id string, room_id string, start_time string")
    other = spark.createDataFrame([("x", "r", "t1", 1.0), ("x", "r", "t1", 2.0), ("y", "r", "t2", 3.0)], "window_id string, room_id string, start_time string, v double")
    join = lambda right: {r["window_id"]: r["v"] for r in mg.join_with_fallback(left, right, ["window_id"], ["room_id", "start_time"], "v", [F.col("v")]).collect()}
    assert join(other) == {"w1": 1.0, "w2": 3.0}
    assert join(other.withColumn("window_id", F.when(F.col("v") == 1.0, "w1").otherwise("z"))) == {"w1": 1.0, "w2": None}


def test_few_values_are_ordered_whatever_their_range(spark):
    """One outlier, and many equal values at the very rank: the selected cells stay near rows / accuracy."""
    rows, accuracy = 40_000, 1_000
    draw = np.random.default_rng(1)
    values = {"outlier": np.append(draw.normal(size=rows - 1), 1e12), "equal": np.where(np.arange(rows) % 2 == 0, 0.0, draw.normal(size=rows)), "tiny": draw.uniform(size=rows) * 1e-12}
    df = spark.createDataFrame([(g, float(x)) for g, v in values.items() for x in v], "g string, v double")
    asked = {"q1": 0.25, "q2": 0.5, "q3": 0.75}
    placed, extent = qt._placed(df, ["g"], "v", asked, accuracy)
    sizes = qt._inside(placed, qt._wanted(placed, extent, ["g"], asked), ["g"]).groupBy("g", "_cell").count().collect()
    assert max(r["count"] for r in sizes) <= 8 * rows / accuracy
    got = {r["g"]: (r["q1"], r["q2"], r["q3"]) for r in qt.exact_percentiles(df, ["g"], "v", asked, accuracy).collect()}
    assert all(got[g] == pytest.approx(np.percentile(v, [25, 50, 75]), rel=1e-12, abs=1e-30) for g, v in values.items())


def test_p_values_of_correlations(spark):
    """Against numerical integration of the density, down to tiny values."""
    cases = [(r, n) for n in (3, 4, 5, 8, 9, 60, 61, 400) for r in (0.0, 0.05, 0.3, -0.6, 0.9, 0.999, 1.0, -1.0)] + [(None, 9), (0.5, 2), (0.5, None), (float("nan"), 9)]
    df = spark.createDataFrame(cases, "r double, n bigint")
    got = [row[0] for row in df.select(st.correlation_p_value(F.col("r"), F.col("n"))).collect()]
    assert got[-4:] == [None] * 4

    def tail(r, v):
        # t = r * sqrt(v / (1 - r * r)): under r = sin(a) the density is cos(a) ** (v - 1)
        whole, part = np.linspace(0, np.pi / 2, 400_001), np.linspace(np.arcsin(abs(r)), np.pi / 2, 400_001)
        return np.trapezoid(np.cos(part) ** (v - 1), part) / np.trapezoid(np.cos(whole) ** (v - 1), whole)

    want = [tail(r, n - 2) for r, n in cases[:-4]]
    assert got[:-4] == pytest.approx(want, rel=1e-5, abs=1e-300)

"""Window generation, points in windows, selection."""

import random

import pytest
from pyspark.sql import functions as F

from windrow.operators import windowing as wn
from windrow.operators.ordered import Axis, even_spread, range_position
from windrow.operators.selection import cap_groups, select_windows
from windrow.plans import heatmap

MEDIA = "media_id string, room_id string, session_id string, start_time string, duration_seconds double, video_path string, has_audio boolean, quality_status string, warnings string"


def media(spark, *lengths):
    rows = [(f"media_{i:06d}", "room_1", "room_1_16_17_aug", "2025-08-16T06:00:00-03:00", d, "v.mp4", True, "ok", "") for i, d in enumerate(lengths, 1)]
    return spark.createDataFrame(rows, MEDIA)


def test_sliding_windows(spark, rows):
    got = rows(wn.sliding_windows(media(spark, 65.0)), "window_index")
    assert [r["window_id"] for r in got] == [f"media_000001_w000{i}" for i in (1, 2, 3, 4)]
    assert [r["video_start_offset_sec"] for r in got] == [0.0, 10.0, 20.0, 30.0]
    assert got[1]["start_time"] == "2025-08-16T06:00:10-03:00" and got[1]["end_time"] == "2025-08-16T06:00:40-03:00"


def test_short_unknown_and_exact_lengths(spark, rows):
    got = {r["media_id"]: r for r in rows(wn.sliding_windows(media(spark, 20.0, 0.0, 30.0, None)))}
    assert got["media_000001"]["duration_seconds"] == 20.0 and got["media_000001"]["warnings"] == "short_media_partial_window"
    assert got["media_000001"]["quality_status"] == "ok"
    assert got["media_000002"]["duration_seconds"] == 30.0 and got["media_000002"]["quality_status"] == "warning"
    assert got["media_000002"]["warnings"] == "missing_or_zero_duration"
    assert got["media_000003"]["warnings"] == "" and got["media_000003"]["window_index"] == 0
    assert got["media_000004"]["warnings"] == "missing_or_zero_duration"


def test_long_recording_is_chunked(spark):
    df = wn.sliding_windows(media(spark, 200_000.0))
    stats = df.agg(F.count("*"), F.countDistinct("window_index"), F.max("window_index")).first()
    expected = int((200_000 - 30) // 10) + 1
    assert tuple(stats) == (expected, expected, expected - 1)


def test_full_windows(spark, rows):
    df = media(spark, 60.0, None, 29.9995, 29.0)
    got = rows(wn.full_windows(df), "media_id", "window_index")
    assert [r["video_start_offset_sec"] for r in got if r["media_id"] == "media_000001"] == [0.0, 10.0, 20.0, 30.0]
    assert got[3]["end_time"] == "2025-08-16T06:01:00-03:00"
    assert {r["media_id"] for r in got} == {"media_000001", "media_000003"}
    assert wn.full_windows(df.withColumn("start_time", F.lit(""))).count() == 0


@pytest.mark.parametrize("bounds", ["center", "end", "closed"])
def test_points_match_brute_force(spark, bounds):
    rng = random.Random(5)
    lengths = [65.0, 20.0, 0.0, 30.0, 121.5, 400.0]
    m = media(spark, *lengths)
    points = [(f"media_{rng.randint(1, 6):06d}", float(rng.choice([rng.uniform(-5, 410), rng.randrange(0, 400, 10)]))) for _ in range(600)]
    windows = [(r["media_id"], r["window_index"], r["video_start_offset_sec"], r["duration_seconds"]) for r in wn.sliding_windows(m).collect()]
    tests = {
        "center": lambda t, a, b: a <= t < b,
        "end": lambda t, a, b: a + 1e-9 < t <= b + 1e-6,
        "closed": lambda t, a, b: a - 1e-9 <= t <= b + 1e-6,
    }
    want = sorted((m_, i, t) for m_, i, off, d in windows for pm, t in points if pm == m_ and tests[bounds](t, off, off + d))
    df = spark.createDataFrame(points, "media_id string, center_sec double")
    got = sorted((r["media_id"], r["window_index"], r["center_sec"]) for r in wn.assign_points(df, m, bounds=bounds).collect())
    assert got == want


INDEX = [
    (f"window_{i:02d}", "media_1", "room_1", "s", f"2025-08-16T06:{i:02d}:00-03:00", f"2025-08-16T06:{i:02d}:30-03:00", "warning", "Raw\\Room 1\\a.mp4") for i in range(1, 11)
]
INDEX_DDL = "window_id string, media_id string, room_id string, session_id string, start_time string, end_time string, quality_status string, video_path string"


def test_even_selection(spark, rows):
    df = spark.createDataFrame(INDEX, INDEX_DDL)
    got = rows(heatmap.select(df, k=3), "selection_rank")
    assert [r["window_id"] for r in got] == ["window_01", "window_06", "window_10"]
    assert [r["selection_rank"] for r in got] == [1, 2, 3]
    assert len(rows(heatmap.select(df, k=30))) == 10
    assert rows(heatmap.select(df, k=3, require_ok=True)) == []
    assert len(rows(heatmap.select(df, path_part="raw/room 1", room="room_1", skip_bad=True))) == 10
    assert len(rows(heatmap.select(df, per_session=4))) == 4


@pytest.mark.parametrize(("n", "k"), [(10, 3), (7, 7), (100, 9), (5, 1), (3, 8)])
def test_even_spread_positions(spark, n, k):
    df = spark.range(n).withColumnRenamed("id", "x")
    got = sorted(r["x"] for r in even_spread(df, Axis((), ("x",), F.floor(F.col("x") / 4)), k).collect())
    want = list(range(n)) if n <= k else [int(i * (n - 1) / max(k - 1, 1) + 0.5) for i in range(k)]
    assert got == want


def test_caps(spark, rows):
    data = [(f"r{i % 2}", f"s{i % 4}", i) for i in range(40)]
    df = spark.createDataFrame(data, "room_id string, session_id string, t int")
    got = cap_groups(df, [(["room_id", "session_id"], 5), (["room_id"], 7), ([], 9), (["room_id"], None)], ["t"])
    kept = sorted(r["t"] for r in got.collect())
    seen, room, out = {}, {}, []
    for r, s, t in data:
        if seen.get(s, 0) < 5:
            seen[s] = seen.get(s, 0) + 1
            if room.get(r, 0) < 7:
                room[r] = room.get(r, 0) + 1
                out.append(t)
    assert kept == out[:9]


def test_select_without_limit_ranks_all(spark, rows):
    df = spark.createDataFrame(INDEX, INDEX_DDL)
    got = rows(select_windows(df, Axis((), ("start_time",), F.lit(0))), "selection_rank")
    assert [r["selection_rank"] for r in got] == list(range(1, 11))


def test_positions_follow_rows_not_the_calendar(spark):
    """All rows share one day: no partition has many more rows than the others, and positions are whole."""
    df = spark.range(20_000).select((F.col("id") * 7919 % 20_000).alias("x"), F.lit(0).alias("start_us"))
    placed = range_position(df, [F.col("start_us"), F.col("x")], "n")
    assert placed.filter(F.col("n") != F.col("x") + 1).count() == 0
    parts = df.repartitionByRange(4, "start_us", "x").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert parts < 2 * 20_000 / 4

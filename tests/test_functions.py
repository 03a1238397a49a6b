"""Scalar rules on literal rows."""

import math

import pytest
from pyspark.sql import functions as F

from windrow.functions import arrays, media, numbers, text, times


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values) or "x int"
    df = spark.createDataFrame([tuple(values.values()) or (1,)], ddl)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("value", "room"),
    [
        ("Room 1", "room_1"), ("Room 2", "room_2"), ("room_3", "room_3"), ("room1_aug16_17_reference.png", "room_1"),
        ("Combined Room 2.xlsx", "room_2"), ("ROOM-007 x", "room_7"), ("broom 3", "unknown_room"), ("nothing", "unknown_room"),
    ],
)
def test_room_text(spark, value, room):
    assert one(spark, text.room_id("s"), s=value) == room


def test_room_path_prefers_the_deepest_part(spark):
    assert one(spark, text.room_id_from_path("p"), p="video/Room 1/Room 2 (16 Aug)/GX01.MP4") == "room_2"
    assert one(spark, text.session_id_from_path("p", F.lit("room_1")), p="video/Room 1/Room 1 (16, 17 Aug)/GX01.MP4") == "room_1_16_17_aug"
    assert one(spark, text.session_id_from_path("p", F.lit("room_1")), p="video/Room 1/Week 2/GX01.MP4") == "room_1_week_2"


def test_slug_and_token(spark):
    assert one(spark, text.slug("s"), s="  Free Range--A ") == "free_range_a"
    assert one(spark, text.slug("s"), s="__") == "unknown"
    assert one(spark, text.token("s"), s="--") is None


def test_warning_lists(spark):
    assert one(spark, text.combine_warnings("a", "b", "c"), a="x; y", b="nan", c="y;z;;x") == "x;y;z"
    assert one(spark, text.combine_warnings("a", "b", sep="|", glue=" | "), a="q|p", b="p|r") == "q | p | r"
    assert one(spark, text.sorted_warnings(F.array(F.lit("b"), F.lit("a"), F.lit("b")))) == "a;b"


def test_wall_clock_and_instant(spark):
    value = "2025-08-16T22:30:00-03:00"
    assert str(one(spark, times.local_time("t"), t=value)) == "2025-08-16 22:30:00"
    assert one(spark, times.instant_micros("t"), t=value) == 1755394200_000000
    assert one(spark, times.instant_micros("t"), t="2025-08-17T01:30:00Z") == 1755394200_000000
    assert one(spark, times.local_time("t"), t="not a time") is None
    assert one(spark, times.instant_micros("t"), t="2026:05:12 18:21:00.250000+00:00") == 1778610060_250000


def test_camera_time_in_zone(spark):
    for value in ("2026:05:12 15:21:00", "2026:05:12 18:21:00+00:00"):
        instant = times.instant_micros("t", "America/Halifax")
        assert one(spark, times.iso_in_zone(instant, "America/Halifax"), t=value) == "2026-05-12T15:21:00-03:00"
    winter = times.iso_in_zone(times.instant_micros("t", "America/Halifax"), "America/Halifax")
    assert one(spark, winter, t="2026:01:12 15:21:00") == "2026-01-12T15:21:00-04:00"


def test_shift_keeps_offset(spark):
    assert one(spark, times.shift_iso("t", F.lit(30.5)), t="2025-08-16T23:59:50-03:00") == "2025-08-17T00:00:20.500000-03:00"


@pytest.mark.parametrize(
    ("value", "seconds"), [("600.5 s", 600.5), ("0:10:00", 600.0), ("10:30", 630.0), ("12", 12.0), ("none", None), ("1:02:03.5", 3723.5)]
)
def test_durations(spark, value, seconds):
    assert one(spark, times.duration_seconds("d"), d=value) == seconds


def test_excel_dates(spark):
    assert str(one(spark, times.excel_date("d"), d="45984")) == "2025-11-23"
    assert str(one(spark, times.excel_date("d"), d="2025-08-16")) == "2025-08-16"
    assert one(spark, times.excel_date("d"), d="later") is None


def test_overlap_needs_all_bounds(spark):
    def seconds(*bounds):
        cols = [F.lit(b).cast("bigint") for b in bounds]
        return one(spark, times.overlap_seconds(*cols))

    assert seconds(0, 30_000_000, 20_000_000, 90_000_000) == 10.0
    assert seconds(0, 30_000_000, 30_000_000, 90_000_000) == 0.0
    assert seconds(0, None, 20_000_000, 90_000_000) == 0.0


@pytest.mark.parametrize(("value", "rate"), [("30000/1001", 30000 / 1001), ("25/1", 25.0), ("0/0", None), ("24.5", 24.5), ("x/2", None)])
def test_fractions(spark, value, rate):
    got = one(spark, numbers.fraction("f"), f=value)
    assert got == pytest.approx(rate) if rate is not None else got is None


def test_missing_numbers(spark):
    for token in ("NA", "N/A", "na", "n/a", "", "nan", "abc"):
        assert one(spark, numbers.to_number("v"), v=token) is None
    assert one(spark, numbers.to_number("v"), v="3.5") == 3.5
    assert one(spark, numbers.row_mean(F.lit(None).cast("double"), F.lit(4.0), F.lit(6.0))) == 5.0
    assert one(spark, numbers.row_mean(F.lit(None).cast("double"), F.lit(None).cast("double"))) is None
    assert one(spark, numbers.clip(F.lit(None).cast("double"), 0, 1)) is None
    assert one(spark, numbers.first_integer("v"), v="about 2.5 m") == 2


def vector(*values):
    return F.array(*[F.lit(float(v)) for v in values])


def test_indices(spark):
    uniform = vector(1, 1, 1, 1)
    assert one(spark, arrays.spatial_freedom(arrays.distribution(uniform))) == pytest.approx(1.0)
    assert one(spark, arrays.occupancy_imbalance(arrays.distribution(uniform))) == pytest.approx(0.0)
    assert one(spark, arrays.half_l1(vector(0.5, 0.5, 0, 0), vector(0, 0.5, 0.5, 0))) == pytest.approx(0.5)
    assert one(spark, arrays.spatial_freedom(vector(1))) == 1.0
    assert one(spark, arrays.spatial_freedom(F.array().cast("array<double>"))) is None
    assert one(spark, arrays.distribution(vector(0, -2, 0))) == pytest.approx([1 / 3] * 3)
    skewed = vector(0.9, 0.05, 0.05)
    assert one(spark, arrays.spatial_freedom(skewed)) < 1
    assert one(spark, arrays.occupancy_imbalance(skewed)) == pytest.approx(0.9 - 1 / 3)


def test_min_max_rules(spark):
    def scaled(value, low, high, **k):
        lit = lambda v: F.lit(v).cast("double")
        return one(spark, numbers.min_max(lit(value), lit(low), lit(high), **k))

    assert scaled(3.0, 1.0, 5.0) == 0.5
    assert scaled(2.0, 2.0, 2.0, const_other=1.0) == 1.0
    assert scaled(0.0, 0.0, 0.0, const_other=1.0) == 0.0
    assert scaled(None, 2.0, 2.0, const_other=1.0) is None
    assert scaled(None, 2.0, 2.0, const_other=0.5, null_as=0.0) == 0.5
    assert scaled(None, 1.0, 5.0, null_as=0.0) == 0.0
    assert scaled(None, None, None) == 0.0


PROBE = """{"format": {"duration": "60.25"}, "streams": [
 {"codec_type": "video", "width": 1920, "height": 1080, "avg_frame_rate": "30000/1001", "codec_name": "h264"},
 {"codec_type": "audio", "codec_name": "aac", "sample_rate": "48000", "channels": 2}]}"""


def test_probe_document(spark):
    got = one(spark, media.probe_fields(F.col("p")), p=PROBE)
    assert (got.width, got.height, got.video_codec, got.audio_codec, got.audio_sample_rate, got.audio_channels) == (1920, 1080, "h264", "aac", 48000, 2)
    assert got.frame_rate == pytest.approx(29.97002997) and got.duration_seconds == 60.25 and got.has_audio and got.warnings == []
    silent = one(spark, media.probe_fields(F.col("p")), p='{"format": {}, "streams": [{"codec_type": "video", "width": 1280, "height": 720, "avg_frame_rate": "25/1", "codec_name": "hevc"}]}')
    assert silent.warnings == ["no_embedded_audio_stream"] and silent.frame_rate == 25.0 and silent.duration_seconds is None
    empty = one(spark, media.probe_fields(F.col("p")), p="{}")
    assert empty.warnings == ["missing_video_stream", "no_embedded_audio_stream"]


def test_timestamp_priority(spark):
    tags = F.create_map(F.lit("CreateDate"), F.lit("2026:05:12 15:20:00"), F.lit("MediaCreateDate"), F.lit("2026:05:12 15:21:00"))
    got = one(spark, media.best_timestamp(tags, "America/Halifax", ("CreateDate", "MediaCreateDate")))
    assert got.source == "CreateDate" and got.warning is None
    bad = F.create_map(F.lit("CreateDate"), F.lit("0000:00:00 00:00:00"))
    assert one(spark, media.best_timestamp(bad, "UTC")).warning == "invalid_timestamp"
    none = F.create_map(F.lit("Other"), F.lit("x"))
    assert one(spark, media.best_timestamp(none, "UTC")).warning == "missing_timestamp"


@pytest.mark.parametrize(
    ("path", "expected"),
    [
        ("free_range/room1/session_a/video/f.mp4", ("free_range", "room1", "session_a", "video", None)),
        ("room1/session_a/video/f.mp4", (None, "room1", "session_a", "video", None)),
        ("video/room1/session_a/f.mp4", (None, "room1", "session_a", "video", None)),
        ("a/f.mp4", (None, None, None, "video", "path_context_unmatched")),
        ("f.mp4", (None, None, None, "video", None)),
    ],
)
def test_path_context(spark, path, expected):
    got = one(spark, media.path_context(F.col("p"), "video"), p=path)
    assert (got.system_id, got.room_id, got.session_id, got.modality, got.warning) == expected


def test_entropy_matches_formula(spark):
    p = [0.2, 0.3, 0.5]
    want = -sum(x * math.log(x) for x in p) / math.log(3)
    assert one(spark, arrays.spatial_freedom(vector(*p))) == pytest.approx(want)

"""Readers, writers, caches, streaming, and whole runs."""

import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow import __main__ as cli
from windrow.functions.media import cleaning_manifest, preparation_manifest
from windrow.functions.times import with_time_columns
from windrow.kernels import zones as zn
from windrow.models.states import GMM
from windrow.operators.biomarkers import fill_zones, room_biomarkers
from windrow.operators.selection import first_mapping, spaced_extremes
from windrow.operators.windowing import sliding_windows
from windrow.plans import cleaning, context, heatmap, measuring, preparation, twin
from windrow.session import cut_lineage
from windrow.settings import MICROS, ModelSettings
from windrow.sources import cache, media as sm, sinks, tables
from windrow.sources.recordings import RecordingTable
from windrow.streaming.incremental import index_pending, stream_manifests

PROBE = json.dumps(
    {"format": {"duration": "60.0"}, "streams": [{"codec_type": "video", "width": 640, "height": 360, "avg_frame_rate": "25/1", "codec_name": "h264"}, {"codec_type": "audio", "codec_name": "aac"}]}
)


def files(spark, rows):
    ddl = "media_id string, file_path string, relative_path string, tags map<string,string>, probe string, issues array<string>"
    return spark.createDataFrame(rows, ddl)


def test_read_table(spark, tmp_path):
    missing = tables.read_table(spark, "event_log", str(tmp_path / "none.csv"))
    assert missing.count() == 0 and "event_start_time" in missing.columns
    (tmp_path / "w.csv").write_text("window_id,duration_seconds,quality_status,extra\nw1,30.0,,x\nw2,nan,ok,y\nw3,abc,nan,z\n")
    got = [tuple(r) for r in tables.read_table(spark, "video_window_index", str(tmp_path / "w.csv")).select("window_id", "duration_seconds", "quality_status", "media_id").orderBy("window_id").collect()]
    assert got == [("w1", 30.0, None, None), ("w2", None, "ok", None), ("w3", None, None, None)]


def test_canonical_columns(spark):
    df = spark.createDataFrame([("w", None, 0.5, "z", "s")], "`Window ID` string, activity_mean double, activity double, zone_id string, session_id__supplemental string")
    got, sources = tables.canonical_columns(df)
    assert sources["window_id"] == "Window ID" and sources["activity_mean"] == "activity_mean" and sources["room_id"] == "(missing)"
    assert sources["session_id"] == "session_id__supplemental" and got.first()["session_id"] == "s" and got.first()["activity_mean"] is None
    swapped = df.drop("activity_mean")
    assert tables.canonical_columns(swapped)[1]["activity_mean"] == "activity"


def test_scan_ids_and_pairs(spark, tmp_path):
    root = tmp_path / "video"
    for name in ("Room 2/b.MP4", "Room 1/s1/a.mp4", "Room 1/s1/note.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"12345")
    scan = sm.scan_media(spark, str(root))
    assert sorted(r["relative_path"] for r in scan.collect()) == ["Room 1/s1/a.mp4", "Room 2/b.MP4"] and scan.first()["file_size_bytes"] == 5
    numbered = {r["relative_path"]: r["media_id"] for r in sm.with_media_ids(sm.union_scans(scan, scan), positional=True).collect()}
    assert numbered == {"Room 1/s1/a.mp4": "media_000001", "Room 2/b.MP4": "media_000002"}
    hashed = {r["media_id"] for r in sm.with_media_ids(scan).collect()}
    assert len(hashed) == 2 and all(len(h) == 18 for h in hashed)
    assert {r["room_id"] for r in sm.with_rooms(scan).collect()} == {"room_1", "room_2"}
    for name in ("room1_x_reference.png", "room1_x_reference_with_notes.png", "room1_y_reference.png", "room1_y_reference_with_notes.png", "room3_reference.png"):
        (tmp_path / name).write_bytes(b"p")
    pairs = sm.zone_image_pairs(spark, str(tmp_path)).collect()
    assert len(pairs) == 1 and pairs[0]["room_id"] == "room_1" and pairs[0]["reference_image"].endswith("room1_x_reference.png")


def test_sidecars(spark, tmp_path):
    (tmp_path / "m1.json").write_text(PROBE)
    (tmp_path / "m2.json").write_text("{}")
    side = sm.read_sidecars(spark, str(tmp_path))
    assert {r["media_id"] for r in side.collect()} == {"m1", "m2"}
    active = spark.createDataFrame([("m1",)], "media_id string")
    assert [r["media_id"] for r in sm.stale_sidecars(side, active).collect()] == ["m2"]
    assert sm.prune_sidecars(spark, str(tmp_path), active, dry_run=True) == 1 and (tmp_path / "m2.json").exists()
    assert sm.prune_sidecars(spark, str(tmp_path), active) == 1 and sorted(f.name for f in tmp_path.glob("*.json")) == ["m1.json"]
    tags = spark.createDataFrame([('[{"CreateDate": "2026:05:12 15:21:00", "Duration": 4}]',)], "t string").select(sm.exif_tags(F.col("t")).alias("m")).first()["m"]
    assert tags["CreateDate"] == "2026:05:12 15:21:00"
    with pytest.raises(FileNotFoundError, match="no_such_tool"):
        sm.require_tool("no_such_tool")


def test_probe_failures_do_not_stop_the_run(spark):
    df = spark.createDataFrame([("/a",), ("/b",)], "file_path string")
    got = sm.probe_files(df, ["no_such_program"], "probe", "ffprobe_extract_failed").collect()
    assert {(r["probe"], r["probe_issue"]) for r in got} == {("{}", "ffprobe_extract_failed")}
    fine = sm.probe_files(df, ["echo", "1"], "probe", "x").collect()
    assert {r["probe_issue"] for r in fine} == {"x"}


def test_cleaning_manifest(spark):
    tags = {"CreateDate": "2026:05:12 15:21:00", "Duration": "58 s"}
    rows = [
        ("video_000001", "/d/free_range/room1/morning/video/a.mp4", "free_range/room1/morning/video/a.mp4", tags, PROBE, []),
        ("video_000002", "/d/room1/morning/video/b.mp4", "room1/morning/video/b.mp4", tags, json.dumps({"streams": [{"codec_type": "video"}]}), []),
        ("video_000003", "/d/x/c.mp4", "x/c.mp4", {}, "{}", ["exif_extract_failed", "ffprobe_extract_failed"]),
    ]
    mapping = spark.createDataFrame([(1, "free_range/room1", "Free Range A", "Room 7", "Morning", "", "", "zone_alpha"), (2, "FREE", "", "", "", "", "", "")], "map_order int, pattern string, system_id string, room_id string, session_id string, modality string, source_type string, zone_config_id string")
    out = cleaning.clean_recordings(files(spark, rows), mapping, "America/Halifax")
    got = {r["media_id"]: r for r in out["media_manifest"].collect()}
    a = got["video_000001"]
    assert (a["system_id"], a["room_id"], a["session_id"], a["zone_config_id"], a["duration_seconds"]) == ("free_range_a", "room_7", "morning", "zone_alpha", 60.0)
    assert a["warnings"] == "mapping_override;multiple_mapping_matches" and a["start_time"] == "2026-05-12T15:21:00-03:00" and a["end_time"] == "2026-05-12T15:22:00-03:00"
    b = got["video_000002"]
    assert b["system_id"] == "unknown_system" and b["duration_seconds"] == 58.0 and b["has_audio"] is False
    assert b["warnings"] == "no_embedded_audio_stream;unknown_system" and b["quality_status"] == "warning"
    c = got["video_000003"]
    assert c["quality_status"] == "error" and "missing_timestamp" in c["warnings"] and "missing_duration" in c["warnings"] and "path_context_unmatched" in c["warnings"]
    assert out["video_window_index"].groupBy("media_id").count().count() == 2 and out["video_window_index"].count() == 7
    counts = {r["token"]: r["n"] for r in cleaning.summarise(out)["warnings"].collect()}
    assert counts["unknown_system"] == 2
    assert cleaning_manifest(files(spark, rows[:1]), "UTC").first()["room_id"] == "room1"
    assert first_mapping(files(spark, rows), mapping.limit(0)).filter("match_count > 0").count() == 0


def prep_files(spark):
    rows = [
        ("media_000001", "video/Room 1/16 Aug/a.MP4", 10, "2025-08-20T00:00:00+00:00", {"CreationDate": "2025:08:16 06:00:00-03:00"}, PROBE, False),
        ("media_000002", "video/Room 2/b.MP4", 10, "2025-08-20T00:00:00+00:00", {}, "{}", True),
    ]
    return spark.createDataFrame(rows, "media_id string, relative_path string, file_size_bytes bigint, modified_time string, tags map<string,string>, probe string, probe_failed boolean")


def test_preparation_manifest(spark):
    got = {r["media_id"]: r for r in preparation_manifest(prep_files(spark)).collect()}
    a, b = got["media_000001"], got["media_000002"]
    assert (a["room_id"], a["room_display_name"], a["session_id"], a["timestamp_source"], a["quality_status"]) == ("room_1", "Room 1", "room_1_16_aug", "exiftool", "ok")
    assert a["start_time"] == "2025-08-16T06:00:00-03:00" and a["end_time"] == "2025-08-16T06:01:00-03:00"
    assert b["quality_status"] == "failed" and "timestamp_source=file_mtime_fallback" in b["warnings"] and b["end_time"] == ""


def measured(spark):
    zones = ["drinking_zone", "feeding_zone", "general_zone"]
    intervals = [("media_000001", t + 1.0, z, 0.1 * (i + 1) + 0.001 * t, 0.01, 5.0) for t in range(0, 60, 2) for i, z in enumerate(zones)]
    metrics = spark.createDataFrame(intervals, "media_id string, interval_center_sec double, zone_id string, activity_mean double, activity_std double, activity_sum double")
    areas = spark.createDataFrame(
        zn.zone_areas({"image_width": 10, "image_height": 10, "zones": [{"zone_id": "drinking_zone", "polygon": [[0, 0], [2, 0], [2, 2], [0, 2]]}, {"zone_id": "feeding_zone", "polygon": [[2, 0], [4, 0], [4, 2], [2, 2]]}]}),
        "zone_id string, semantic_type string, zone_area_pixels int, zone_area_fraction double",
    )
    names = ["audio_rms", "audio_short_time_energy", "audio_zero_crossing_rate", "audio_spectral_centroid", "audio_spectral_bandwidth", "audio_spectral_rolloff", "audio_spectral_flatness"]
    frames = spark.createDataFrame([("media_000001", t + 0.5, *([0.1 + t / 100] * 7)) for t in range(60)], "media_id string, frame_center_sec double, " + ", ".join(f"{n} double" for n in names))
    sheet = spark.createDataFrame([("2025-08-16", "20", "24", "25", "50", "55")], "Date string, Temp_AM_Min string, Temp_AM_Max string, Temp_PM string, RH_AM string, RH_PM string")
    return metrics, areas, frames, sheet


def test_preparation_run(spark):
    from windrow.operators.climate import normalize_climate

    store = lambda name, df: cut_lineage(df)
    index = preparation.index_recordings(prep_files(spark), store=store)
    metrics, areas, frames, sheet = measured(spark)
    out = preparation.prepare(index["media_manifest"], index["video_window_index"], metrics, areas, frames, normalize_climate(sheet, "room_1"), store=store)
    merged = {r["window_id"]: r for r in out["processed_multimodal_window_table"].collect()}
    assert len(merged) == 5
    good, bad = merged["media_000001_w0001"], merged["media_000002_w0001"]
    assert (good["quality_status"], good["warnings"], good["temp_context"], good["audio_available"]) == ("ok", "", 22.0, True)
    assert good["audio_rms"] == pytest.approx(np.mean([0.1 + t / 100 for t in range(30)])) and good["drinking_activity_fraction"] < good["general_activity_fraction"]
    assert bad["quality_status"] == "failed" and "no_interval_overlap" in bad["warnings"]
    failed = {(r["stage"], r["issue"]) for r in out["failed_windows"].collect()}
    assert failed == {("video_features", "no_interval_overlap"), ("audio_features", "manifest_has_audio_false")}
    capped = preparation.index_recordings(prep_files(spark), caps={"per_media": 2, "total": 3})["video_window_index"]
    assert capped.count() == 3
    assert preparation.summarise(out)["coverage"].first()["rows"] == 5


def test_cache_notices_changes(spark):
    media = spark.createDataFrame([("m1", "/a", 5, "t1"), ("m2", "/b", 6, "t2")], "media_id string, file_path string, file_size_bytes bigint, modified_time string")
    current = media.withColumn("fingerprint", cache.audio_fingerprint(22_050, 1.0))
    cached = current.select("media_id", "fingerprint").withColumn("v", F.lit(1))
    todo, reuse = cache.split_by_cache(current, cached)
    assert todo.count() == 0 and reuse.count() == 2
    for other in (cache.audio_fingerprint(16_000, 1.0), cache.audio_fingerprint(22_050, 0.5)):
        todo, reuse = cache.split_by_cache(media.withColumn("fingerprint", other), cached)
        assert todo.count() == 2 and reuse.count() == 0
    touched = media.withColumn("modified_time", F.when(F.col("media_id") == "m1", "t9").otherwise(F.col("modified_time"))).withColumn("fingerprint", cache.audio_fingerprint(22_050, 1.0))
    assert [r["media_id"] for r in cache.split_by_cache(touched, cached)[0].collect()] == ["m1"]
    assert cache.split_by_cache(current, cached.drop("fingerprint"))[0].count() == 2 and cache.split_by_cache(current, cached, force=True)[1] is None
    zoned = media.withColumn("zone_signature", F.lit("s1"))
    a, b = (zoned.withColumn("f", cache.video_fingerprint("frame_difference", w, 2.0)).first()["f"] for w in (640, 320))
    c = zoned.withColumn("zone_signature", F.lit("s2")).withColumn("f", cache.video_fingerprint("frame_difference", 640, 2.0)).first()["f"]
    assert len({a, b, c}) == 3
    pending, kept = cache.resume(spark.createDataFrame([("w1",), ("w2",)], "window_id string"), spark.createDataFrame([("w2",), ("w9",)], "window_id string"))
    assert [r[0] for r in pending.collect()] == ["w1"] and [r[0] for r in kept.collect()] == ["w2"]


def tone(path, seconds, level):
    path.write_bytes(np.full(8 * seconds, level, dtype="<i2").tobytes())


def test_second_run_measures_what_changed(spark, tmp_path):
    """Recordings are replaced one by one, across buckets, forgotten with their file, and tried again when they failed."""
    folder = tmp_path / "media"
    folder.mkdir()
    for i in range(5):
        tone(folder / f"room_{i}_a.mp4", 2 + i, 1000 * (i + 1))
    (folder / "broken.mp4").write_bytes(b"x")
    settings = measuring.MeasureSettings(sample_rate=8, batches=2, audio_command="cat {path}")
    table = RecordingTable(spark, str(tmp_path / "table"), buckets=2)
    listed = lambda: measuring.listed(spark, [str(folder), str(folder)])
    seconds = lambda: {r["media_id"]: r["n"] for r in table.rows().groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    media = listed()
    ids = {r["relative_path"]: r["media_id"] for r in media.collect()}
    assert len(ids) == 6
    assert measuring.measure_audio(table, media, settings) == 6
    assert seconds() == {ids[f"room_{i}_a.mp4"]: 2 + i for i in range(5)}
    before = {r["media_id"]: r["audio_rms"] for r in table.rows().collect()}
    tone(folder / "room_3_a.mp4", 9, 20_000)
    settings = replace(settings, batches=1)
    pending = table.pending(listed().withColumn("fingerprint", cache.audio_fingerprint(8, 1.0)))
    assert sorted(r["media_id"] for r in pending.collect()) == sorted([ids["room_3_a.mp4"], ids["broken.mp4"]])  # the changed and the failed one
    assert measuring.measure_audio(table, listed(), settings) == 2
    assert seconds() == {ids[f"room_{i}_a.mp4"]: 9 if i == 3 else 2 + i for i in range(5)}
    after = {r["media_id"]: r["audio_rms"] for r in table.rows().collect()}
    assert {m for m in after if after[m] != before[m]} == {ids["room_3_a.mp4"]}
    (folder / "room_0_a.mp4").unlink()
    assert measuring.measure_audio(table, listed(), settings) == 1 and ids["room_0_a.mp4"] not in seconds()
    assert table.pending(listed().withColumn("fingerprint", cache.audio_fingerprint(4, 1.0))).count() == 5
    assert table.pending(listed().withColumn("fingerprint", cache.audio_fingerprint(8, 1.0)), force=True).count() == 5


def test_rows_count_once_their_recording_is_finished(spark, tmp_path):
    """A run that stops between rows and log leaves the table as it was."""
    table = RecordingTable(spark, str(tmp_path / "t"), buckets=1)
    media = spark.createDataFrame([("a", "f1"), ("b", "f1")], "media_id string, fingerprint string")
    work = lambda part: part.select("media_id", F.lit(1).alias("v"))
    assert table.rows() is None and table.update(media, work) == 2
    newer = media.withColumn("fingerprint", F.lit("f2"))
    finish, table._written = table._written, lambda *a, **k: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError):
        table.replace(newer.filter("media_id = 'a'"), newer.filter("media_id = 'a'").select("media_id", "fingerprint", F.lit(2).alias("v")))
    table._written = finish
    assert {(r["media_id"], r["v"]) for r in table.rows().collect()} == {("b", 1)} and {r["media_id"] for r in table.pending(newer).collect()} == {"a", "b"}
    assert table.update(newer, lambda part: part.select("media_id", F.lit(3).alias("v"))) == 2
    assert {(r["media_id"], r["v"]) for r in table.rows().collect()} == {("a", 3), ("b", 3)}


def test_video_is_measured_with_the_zones_of_its_room(spark, tmp_path):
    folder = tmp_path / "media"
    folder.mkdir()
    (folder / "room_1_x.mp4").write_bytes(bytes([0] * 8 + [255] * 8))
    (folder / "room_2_x.mp4").write_bytes(bytes([0] * 8 + [51] * 8))
    configs = [{"room_id": f"room_{r}", "zone_config_id": "c", "image_width": 4, "image_height": 2, "zones": [{"zone_id": f"z{r}", "polygon": zn.rectangle_polygon(0, 0, 2, 2)}]} for r in (1, 2)]
    settings = measuring.MeasureSettings(resize_width=4, frames_command="cat {path}")
    table = RecordingTable(spark, str(tmp_path / "t"))
    media = measuring.listed(spark, [str(folder)]).withColumns({"width": F.lit(4), "height": F.lit(2)})
    assert measuring.measure_video(table, media, configs, settings) == 2
    got = {(r["zone_id"], round(r["activity_mean"], 3)) for r in table.rows().collect()}
    assert got == {("z1", 1.0), ("general_zone", 1.0), ("z2", 0.2), ("general_zone", 0.2)}
    configs[1]["zones"][0]["polygon"] = zn.rectangle_polygon(0, 0, 1, 2)
    assert measuring.measure_video(table, media, configs, settings) == 1


def test_streamed_index_is_incremental(spark, tmp_path):
    def add(name, media_id, seconds):
        row = spark.createDataFrame([(media_id, "room_1", "s", "2025-08-16T06:00:00-03:00", seconds, "v.mp4", True, "ok", "")], "media_id string, room_id string, session_id string, start_time string, duration_seconds double, video_path string, has_audio boolean, quality_status string, warnings string")
        full = row.select(*[(F.col(f.name) if f.name in row.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in tables.schema("media_manifest").fields])
        full.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    add("a", "m1", 65.0)
    index_pending(spark, str(tmp_path / "in"), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 4
    add("b", "m2", 30.0)
    add("c", "m1", 40.0)
    index_pending(spark, str(tmp_path / "in"), out, check).awaitTermination()
    got = {r["media_id"]: r["count"] for r in spark.read.parquet(out).groupBy("media_id").count().collect()}
    assert got == {"m1": 2, "m2": 1}
    assert stream_manifests(spark, str(tmp_path / "in")).isStreaming


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", None, [1]), ("b", 2.0, [2])], "k string, v double, arr array<int>")
    sinks.write_table(df, str(tmp_path / "t"), csv=True)
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2
    back = spark.read.option("header", True).csv(str(tmp_path / "t.csv"))
    assert back.columns == ["k", "v"] and back.count() == 2
    sinks.write_timeline(df, {"metadata": {}}, str(tmp_path / "tl"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "tl/frames")).orderBy("value").collect()]
    assert lines[0] == {"k": "a", "v": None, "arr": [1]}
    sinks.write_report(str(tmp_path / "report"), "T", rows=df.select("k", "v"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "report/index")).collect()]
    assert lines[0] == "# T" and "rows: 2 rows" in lines[-1]
    assert spark.read.parquet(str(tmp_path / "report/rows.parquet")).count() == 2
    sinks.copy_tables({"x": df}, str(tmp_path / "copy"))
    assert spark.read.option("header", True).csv(str(tmp_path / "copy/x.csv")).count() == 2


def twin_zones(spark, n=40):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        level = 0.8 if 20 <= i < 24 else 0.1
        at = f"2025-08-17T08:{(i // 2) % 60:02d}:{30 * (i % 2):02d}-03:00"
        until = f"2025-08-17T08:{((i + 1) // 2) % 60:02d}:{30 * ((i + 1) % 2):02d}-03:00"
        for z in "ABCD":
            rows.append((f"w{i:03d}", "m1", "sys", "room_1", "s1", f"zone_{z}", at, until, 30.0, float(level + rng.random() * 0.1), 0.01, 0.1, ""))
    return spark.createDataFrame(rows, "window_id string, media_id string, system_id string, room_id string, session_id string, zone_id string, start_time string, end_time string, duration_seconds double, activity_mean double, activity_std double, motion_pixel_ratio double, warnings string")


LOG = "event_id string, event_type string, room_id string, event_start_time string, event_end_time string"


def test_twin_run(spark):
    log = spark.createDataFrame([("e1", "entry", "room_1", "2025-08-17T08:10:00-03:00", "2025-08-17T08:12:00-03:00")], LOG)
    out = twin.run(with_time_columns(twin_zones(spark)), log, model=ModelSettings(max_iterations=3), kind=GMM)
    assert set(out) == {"biomarker_window_table", "resilience_event_table", "hmm_state_sequence", "hmm_state_summary", "event_validation_summary", "hmm_diagnostics", "timeline"}
    phases = {r["phase"]: r for r in out["event_validation_summary"].collect()}
    assert [phases[p]["n_windows"] for p in ("pre_entry_baseline", "during_entry", "post_entry_recovery")] == [20, 4, 16]
    assert phases["during_entry"]["mobility_index_mean"] > phases["pre_entry_baseline"]["mobility_index_mean"]
    assert out["resilience_event_table"].first()["recovered_flag"] is True
    assert out["hmm_diagnostics"].first()["is_valid_temporal_sequence"] and out["timeline"].count() == 40
    quiet = twin.run(with_time_columns(twin_zones(spark)), None, {"total": 30}, model=ModelSettings(max_iterations=2), kind=GMM)
    assert quiet["biomarker_window_table"].count() == 30 and quiet["event_validation_summary"].filter("n_windows > 0").count() == 0


def test_canonical_zone_table(spark):
    features = twin_zones(spark, 2).drop("session_id", "duration_seconds")
    selected = spark.createDataFrame([("w000", "m1", "s9", 30.0)], "window_id string, media_id string, session_id string, duration_seconds double")
    index = spark.createDataFrame([("w001", "m1", "s8", "ok")], "window_id string, media_id string, session_id string, quality_status string")
    manifest = spark.createDataFrame([("m1", "zone_alpha")], "media_id string, zone_config_id string")
    df, sources = twin.canonical_zones(features, selected, index, manifest)
    got = {r["window_id"]: (r["session_id"], r["zone_config_id"]) for r in df.collect()}
    assert got["w000"] == ("s9", "zone_alpha") and sources["frame_count"] == "(missing)"


def context_inputs(spark):
    zones = with_time_columns(twin_zones(spark))
    bio = cut_lineage(room_biomarkers(zones).drop("distribution"))
    audio = bio.select("window_id", "room_id", "start_time", F.lit(True).alias("audio_available"), *[(F.rand(1) + i).alias(n) for i, n in enumerate(context.AUDIO)], F.lit("ok").alias("audio_quality_flag"))
    import datetime

    climate = spark.createDataFrame([(datetime.date(2025, 8, 17), 25.0, 27.0, 26.0, 40.0, 50.0, 45.0, 2.0, "ok")], "date date, temp_am_mean double, temp_pm double, temp_daily_mean double, rh_am double, rh_pm double, rh_daily_mean double, temp_daily_range double, env_quality_flag string")
    events = twin.event_frame(spark.createDataFrame([("e1", "entry", "room_1", "2025-08-17T08:10:00-03:00", "2025-08-17T08:12:00-03:00")], LOG))
    return bio, audio, climate, events


def test_context_run(spark):
    out = context.run(*context_inputs(spark), model=ModelSettings(max_iterations=2))
    assert out["multimodal_window_table"].count() == 40 and out["audio_env_correlation_table"].count() == 30
    assert out["audio_env_correlation_table"].filter("pearson_r is not null").count() == 0
    summary = out["event_multimodal_summary"]
    assert summary.count() == 3 * len([c for c in context.EVENT_METRICS if c != "welfare_risk_score"])
    metrics = {(r["model_name"], r["metric_name"]) for r in out["hmm_ablation_metrics"].collect()}
    assert ("video_only", "event_detection_contrast") in metrics and ("video_audio_env", "log_likelihood_per_sample") in metrics


def test_semantic_run(spark):
    bio, *rest = context_inputs(spark)
    out = context.run_semantic(bio, *rest, model=ModelSettings(max_iterations=2))
    assert out["semantic_hmm_state_sequence"].count() == 80 and out["semantic_event_validation_summary"].count() == 3
    assert {r["model_name"] for r in out["semantic_hmm_state_summary"].collect()} == {"semantic_video_only", "semantic_multimodal"}


def test_heatmap_run(spark):
    media = spark.createDataFrame([("m1", "room_1", "s", "2025-08-16T06:00:00-03:00", 65.0, "v.mp4", True, "ok", "")], "media_id string, room_id string, session_id string, start_time string, duration_seconds double, video_path string, has_audio boolean, quality_status string, warnings string")
    metrics = spark.createDataFrame([("m1", t, z, 0.1 * i, 0.2) for t in (2.0, 4.0, 8.0) for i, z in enumerate(("A", "B"), 1)], "media_id string, interval_end_sec double, zone_id string, activity_mean double, motion_ratio double")
    samples = spark.createDataFrame([("m1", t) for t in (0.0, 2.0, 4.0, 8.0)], "media_id string, sample_sec double")
    zones = spark.createDataFrame([("A", 0, 0), ("B", 0, 1)], "zone_id string, row int, col int")
    features = heatmap.measure(heatmap.select(sliding_windows(media)), media, metrics, samples, zones)
    got = {(r["window_index"], r["zone_id"]): (r["activity_mean"], r["frame_count"], r["warnings"]) for r in features.collect()}
    assert len(got) == 8 and got[0, "B"] == (pytest.approx(0.2), 4, "") and got[3, "A"] == (None, 0, "insufficient_frames_for_optical_flow")
    frames, header = heatmap.timeline(features, zones)
    assert frames.count() == 4 and [z["zone_id"] for z in header["zones"]] == ["A", "B"]


def test_evidence_picks(spark):
    rows = [(f"w{i:02d}", i * 600 * MICROS, 6 + i % 12, float(i % 7) / 7, float((i * 3) % 11)) for i in range(30)]
    df = spark.createDataFrame(rows, "window_id string, start_us bigint, local_hour int, activity_mean double, metric double")
    got = spaced_extremes(df, [{"name": "a", "metric": "metric"}, {"name": "b", "metric": "metric"}, {"name": "c", "metric": "activity_mean", "lowest": True, "floors": {"activity_mean": 0.1}}]).collect()
    taken, want = [], []
    for key, col, asc, floor in (("a", 4, False, None), ("b", 4, False, None), ("c", 3, True, 0.1)):
        pool = [r for r in rows if 7 <= r[2] < 17 and (floor is None or r[3] >= floor) and all(abs(r[1] - t) >= 1_200 * MICROS for t in taken)]
        best = sorted(pool, key=lambda r: ((r[col] if asc else -r[col]), r[1], r[0]))[0]
        taken.append(best[1])
        want.append((key, best[0], (sum(r[col] < best[col] for r in rows) + 1) / len(rows)))
    assert [(r["selection_key"], r["window_id"], r["selection_rank_pct"]) for r in got] == want


def test_command_line(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    prep_files(spark).write.parquet(str(source / "files.parquet"))
    metrics, areas, frames, sheet = measured(spark)
    for name, df in (("interval_metrics", metrics), ("zone_areas", areas), ("audio_frames", frames), ("climate_sheet", sheet.withColumn("room_id", F.lit("room_1")))):
        df.write.parquet(str(source / f"{name}.parquet"))
    (tmp_path / "c.json").write_text(json.dumps({"windowing": {"window_seconds": 30, "stride_seconds": 15}}))
    args = ["prepare", "--input", str(source), "--output", str(target), "--config", str(tmp_path / "c.json"), "--csv"]
    dry = cli.main([*args, "--dry-run"], spark)
    assert "processed_multimodal_window_table" in dry and not target.exists()
    written = cli.main(args, spark)
    assert written["video_window_index"].count() == 4 and written["processed_multimodal_window_table"].count() == 4
    assert (target / "report").exists() and (target / "env_daily.csv").exists()
    only = cli.main(["prepare", "--input", str(source), "--output", str(tmp_path / "o2"), "--stage", "index", "--max-media", "1"], spark)
    assert set(only) == {"media_manifest", "video_window_index"} and only["media_manifest"].count() == 1
    copied = cli.main(["prepare", "--input", str(source), "--output", str(tmp_path / "o3"), "--stage", "index", "--handoff", str(tmp_path / "copy")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "copy" / "media_manifest.csv")).count() == copied["media_manifest"].count() and (tmp_path / "copy" / "readme").exists()
    (tmp_path / "bad.json").write_text(json.dumps({"model": {"nope": 1}}))
    with pytest.raises(ValueError, match="nope"):
        cli.load_settings(str(tmp_path / "bad.json"))


def header_of(spark, path):
    return json.loads("\n".join(r[0] for r in spark.read.text(str(path)).collect()))


def test_measure_heatmap_and_twin_from_the_command_line(spark, tmp_path):
    media, source, target = tmp_path / "media", tmp_path / "in", tmp_path / "out"
    media.mkdir()
    tone(media / "room_1_a.mp4", 3, 5_000)
    (tmp_path / "m.json").write_text(json.dumps({"measure": {"sample_rate": 8, "audio_command": "cat {path}"}}))
    source.mkdir()
    got = cli.main(["measure", "--input", str(source), "--media", str(media), "--output", str(target), "--config", str(tmp_path / "m.json")], spark)
    assert got["files"].count() == 1 and got["audio_frames"].count() == 3

    index = sliding_windows(spark.createDataFrame([("m1", "room_1", "s", "2025-08-16T06:00:00-03:00", 400.0, "v.mp4", True, "ok", "")], "media_id string, room_id string, session_id string, start_time string, duration_seconds double, video_path string, has_audio boolean, quality_status string, warnings string"))
    manifest = spark.createDataFrame([("m1", "room_1", "s", "2025-08-16T06:00:00-03:00", 400.0, "v.mp4", True, "ok", "")], "media_id string, room_id string, session_id string, start_time string, duration_seconds double, video_path string, has_audio boolean, quality_status string, warnings string")
    metrics = spark.createDataFrame([("m1", float(t), z, 0.1 * i + (t % 7) / 20, 0.2) for t in range(1, 400) for i, z in enumerate(("A", "B"), 1)], "media_id string, interval_end_sec double, zone_id string, activity_mean double, motion_ratio double")
    samples = spark.createDataFrame([("m1", float(t)) for t in range(400)], "media_id string, sample_sec double")
    zones = spark.createDataFrame([("A", 0, 0), ("B", 0, 1)], "zone_id string, row int, col int")
    for name, df in (("video_window_index", index), ("media_manifest", manifest), ("interval_metrics", metrics), ("sample_times", samples), ("zones", zones)):
        df.write.parquet(str(source / f"{name}.parquet"))
    heat = cli.main(["heatmap", "--input", str(source), "--output", str(tmp_path / "heat"), "--max-windows", "12"], spark)
    assert heat["selected_windows"].count() == 12 and spark.read.text(str(tmp_path / "heat/timeline/frames")).count() == 12
    assert [z["zone_id"] for z in header_of(spark, tmp_path / "heat/timeline/header")["zones"]] == ["A", "B"]
    report = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "heat/report/index")).collect())
    assert "first 25 rows by room_id" in report and "zones: 2 rows" in report

    for name in ("selected_windows", "video_zone_features"):
        heat[name].write.parquet(str(source / f"{name}.parquet"))
    (tmp_path / "t.json").write_text(json.dumps({"model": {"max_iterations": 2}}))
    made = cli.main(["twin", "--input", str(source), "--output", str(tmp_path / "twin"), "--config", str(tmp_path / "t.json"), "--refresh"], spark)
    assert made["biomarker_window_table"].count() == index.count() > 12  # too few windows, so all were measured
    header = header_of(spark, tmp_path / "twin/timeline/header")
    assert [r["room_id"] for r in header["rooms"]] == ["room_1"] and [z["zone_id"] for z in header["rooms"][0]["zones"]] == ["A", "B"]
    model = header_of(spark, tmp_path / "twin/model")
    assert model["model_type"] in ("gaussian_hmm", "fallback_gmm_state_model") and len(model["parameters"]["means"]) == model["n_states"]
    assert {r["canonical_column"]: r["source_column"] for r in made["schema_mapping"].collect()}["activity_mean"] == "activity_mean"


def test_decoding_streams_the_program_output(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(np.array([0, 16384, -32768, 8192, 1], dtype="<i2").tobytes())
    df = spark.createDataFrame([("m1", str(tmp_path / "a.raw"), 4, 2), ("m2", str(tmp_path / "none"), 4, 2)], "media_id string, file_path string, width int, height int")
    got = sm.decode_audio(df, 2, command="cat {path}").orderBy("media_id", "chunk_start").collect()
    assert [(r["media_id"], r["chunk_start"], r["issue"]) for r in got] == [("m1", 0, None), ("m1", 2, None), ("m1", 4, None), ("m2", 0, "ffmpeg_decode_failed")]
    assert np.frombuffer(got[0]["pcm"], "<i2").tolist() == [0, 16384] and np.frombuffer(got[1]["pcm"], "<i2").tolist() == [-32768, 8192]
    (tmp_path / "a.raw").write_bytes(bytes([0, 255] * 4 + [51] * 2))
    frames = sm.decode_frames(df, 2, command="cat {path}").orderBy("media_id", "frame_time_sec").collect()
    assert [(r["frame_time_sec"], r["height"], r["issue"]) for r in frames][:5] == [(float(t), 1, None) for t in (0, 2, 4, 6, 8)]
    assert list(frames[0]["pixels"]) == [0, 255] and frames[-1]["issue"] == "opencv_open_failed"


def test_refresh_rule(spark):
    from windrow.operators.stats import source_summary

    index = spark.createDataFrame([(f"w{i}",) for i in range(5)], "window_id string")
    features = spark.createDataFrame([("w1", "m", "t1"), ("w1", "m", "t1"), ("w2", "m", "t2")], "window_id string, media_id string, start_time string")
    row = source_summary(features, index)
    assert row.first()["covered_pct"] == 40.0 and twin.needs_more_windows(row, 30) and not twin.needs_more_windows(row, 2)


def test_zones_belong_to_rooms(spark):
    windows = spark.createDataFrame([("w1", "r1"), ("w2", "r2"), ("w3", "r3")], "window_id string, room_id string")
    zones = spark.createDataFrame([("r1", "a"), ("r2", "b")], "room_id string, zone_id string")
    features = spark.createDataFrame([("w1", "a", 1.0), ("w2", "a", 2.0)], "window_id string, zone_id string, activity double")
    got = fill_zones(windows, zones, features, ["window_id"])
    assert got.columns == ["window_id", "room_id", "zone_id", "activity"]
    assert sorted(map(tuple, got.collect())) == [("w1", "r1", "a", 1.0), ("w2", "r2", "b", None), ("w3", "r3", None, None)]
    checked = {r["room_id"]: r["status"] for r in preparation.zone_configuration(zones, windows).collect()}
    assert checked == {"r1": "ok", "r2": "ok", "r3": "missing_semantic_zone_config"}


def test_video_stage_leaves_the_merged_table_alone(spark, tmp_path):
    source, target = tmp_path / "in", tmp_path / "out"
    prep_files(spark).write.parquet(str(source / "files.parquet"))
    metrics, areas, frames, _ = measured(spark)
    for name, df in (("interval_metrics", metrics), ("zone_areas", areas), ("audio_frames", frames)):
        df.write.parquet(str(source / f"{name}.parquet"))
    whole = cli.main(["prepare", "--input", str(source), "--output", str(target)], spark)
    path = str(target / "processed_multimodal_window_table.parquet")
    before = sorted(map(str, spark.read.parquet(path).collect()))
    part = cli.main(["prepare", "--input", str(source), "--output", str(target), "--stage", "video_features"], spark)
    assert "processed_multimodal_window_table" in whole and "processed_multimodal_window_table" not in part and "failed_windows" not in part
    assert sorted(map(str, spark.read.parquet(path).collect())) == before
    zones = cli.main(["prepare", "--input", str(source), "--output", str(tmp_path / "z"), "--stage", "zones"], spark)
    assert zones["zone_configuration"].count() == 1

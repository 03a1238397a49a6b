"""Ordered scans against plain sequential Python, with a room that holds most rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from windrow.operators import events as ev, nearby, ordered, resilience as rs, sequences as sq, stats as st
from windrow.operators.ordered import Axis, time_axis, with_neighbours, with_position, with_running
from windrow.settings import MICROS, EventSettings, ResilienceSettings

KEYS = ("room_id",)


def sequence_rows(seed=3, n=400, states=3):
    rng = random.Random(seed)
    out, clock = [], {}
    for i in range(n):
        room = None if rng.random() < 0.08 else ("hot" if rng.random() < 0.7 else rng.choice(["a", "b", "c"]))
        clock[room] = clock.get(room, 0) + rng.choice([1, 7, 60, 4_000])
        out.append((room, clock[room] * MICROS, f"w{i:04d}", rng.randrange(states), None if rng.random() < 0.1 else round(rng.uniform(0, 9), 3)))
    return out


DDL = "room_id string, start_us bigint, window_id string, state_id int, value double"


def by_room(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


@pytest.fixture(params=[30, 3_600, 10_000_000])
def axis(request):
    return time_axis(KEYS, seconds=request.param)


def collect(df, *names):
    return {r["window_id"]: tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect()}


def test_neighbours(spark, axis):
    data = sequence_rows()
    df = with_neighbours(spark.createDataFrame(data, DDL), axis, before={"pv": "value"}, after={"nv": "value"})
    want = {}
    for rows in by_room(data).values():
        for i, r in enumerate(rows):
            want[r[2]] = (rows[i - 1][4] if i else None, rows[i + 1][4] if i + 1 < len(rows) else None, i > 0, i + 1 < len(rows))
    assert collect(df, "pv", "nv", "_has_before", "_has_after") == want


def test_running(spark, axis):
    data = sequence_rows()
    df = with_running(spark.createDataFrame(data, DDL), axis, total=("sum", "state_id"), low=("min", "value"), seen=("last", "value"), n=("count", F.lit(1)))
    want = {}
    for rows in by_room(data).values():
        total, low, seen = 0, None, None
        for i, r in enumerate(rows):
            total += r[3]
            if r[4] is not None:
                low, seen = (r[4] if low is None else min(low, r[4])), r[4]
            want[r[2]] = (total, low, seen, i + 1)
    assert collect(df, "total", "low", "seen", "n") == want


def test_running_backwards(spark, axis):
    data = sequence_rows()
    df = with_running(spark.createDataFrame(data, DDL), axis.reversed(), seen=("last", "value"), total=("sum", "state_id"))
    want = {}
    for rows in by_room(data).values():
        seen, total = None, 0
        for r in reversed(rows):
            seen = r[4] if r[4] is not None else seen
            total += r[3]
            want[r[2]] = (seen, total)
    assert collect(df, "seen", "total") == want


def test_run_lengths(spark, axis):
    data = sequence_rows(states=2)
    want = {}
    for rows in by_room(data).values():
        i = 0
        while i < len(rows):
            j = i
            while j < len(rows) and rows[j][3] == rows[i][3]:
                j += 1
            for r in rows[i:j]:
                want[r[2]] = j - i
            i = j
    assert collect(sq.with_run_length(spark.createDataFrame(data, DDL), axis), "state_run_length") == want


def test_smoothing_is_sequential(spark, axis):
    for seed, states in ((1, 2), (2, 3)):
        data = sequence_rows(seed, states=states)
        want = {}
        for rows in by_room(data).values():
            s = [r[3] for r in rows]
            for i in range(1, len(s) - 1):
                if s[i - 1] == s[i + 1] and s[i] != s[i - 1]:
                    s[i] = s[i - 1]
            want |= {r[2]: v for r, v in zip(rows, s)}
        assert collect(sq.with_smoothed(spark.createDataFrame(data, DDL), axis), "smoothed_state") == want


def literal(spark, values):
    data = [("r", i * MICROS, f"w{i}", v, 0.0) for i, v in enumerate(values)]
    return spark.createDataFrame(data, DDL)


def test_published_sequences(spark):
    axis = time_axis(KEYS, seconds=2)
    smooth = collect(sq.with_smoothed(literal(spark, [0, 1, 0, 1, 0]), axis), "smoothed_state")
    assert [smooth[f"w{i}"] for i in range(5)] == [0] * 5
    runs = collect(sq.with_run_length(literal(spark, [0, 0, 1, 1, 1, 0]), axis), "state_run_length")
    assert [runs[f"w{i}"] for i in range(6)] == [2, 2, 3, 3, 3, 1]
    levels = ["low", "medium", "high", "medium", "low"]
    df = literal(spark, range(5)).withColumn("risk_level", F.element_at(F.array(*map(F.lit, levels)), F.col("state_id") + 1))
    flags = collect(sq.with_sustained_flag(df, axis), "sustained_risk_flag")
    assert [flags[f"w{i}"] for i in range(5)] == [False, False, False, True, False]


def test_change_points(spark, axis):
    data = sequence_rows()
    got = {r["window_id"] for r in ev.change_points(spark.createDataFrame(data, DDL), axis, "state_id").collect()}
    want = {r[2] for rows in by_room(data).values() for i, r in enumerate(rows) if i == 0 or rows[i - 1][3] != r[3]}
    assert got == want


def test_global_position(spark):
    data = sequence_rows()
    got = collect(with_position(spark.createDataFrame(data, DDL), time_axis((), seconds=100)), "position")
    want = {r[2]: i + 1 for i, r in enumerate(sorted(data, key=lambda r: (r[1], r[2])))}
    assert got == want


def test_results_do_not_depend_on_partitioning(spark):
    data = sequence_rows()
    random.Random(0).shuffle(data)
    df = spark.createDataFrame(data, DDL)
    axis = time_axis(KEYS, seconds=600)
    first = collect(sq.with_smoothed(df.repartition(7), axis), "smoothed_state")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert collect(sq.with_smoothed(df.coalesce(1), axis), "smoothed_state") == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_benjamini_hochberg(spark):
    def adjust(values, fn):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, p double")
        return [r["q"] for r in fn(df, "p", "q", ["i"]).orderBy("i").collect()]

    for fn in (st.with_benjamini_hochberg, st.with_benjamini_hochberg_small):
        assert adjust([0.01, 0.03, 0.20, 0.04], fn) == pytest.approx([0.04, 0.16 / 3, 0.20, 0.16 / 3])
        got = adjust([0.9, None, 0.2, 0.2], fn)
        assert got[1] is None and got[0] == pytest.approx(0.9) and got[2] == got[3] == pytest.approx(0.3)


def test_adjustment_of_tiny_and_equal_values_uses_every_partition(spark):
    draw = np.random.default_rng(2)
    p = np.concatenate([draw.uniform(size=400) * 1e-12, np.full(200, 3e-13), draw.uniform(size=100) * 1e-300, [0.0, 1.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double").repartition(5)
    out = st.with_benjamini_hochberg(df, "p", "q", ["i"])
    order = np.argsort(p, kind="stable")
    want = np.empty(len(p))
    want[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1].clip(0, 1)
    got = {r["i"]: r["q"] for r in out.collect()}
    assert [got[i] for i in range(len(p))] == pytest.approx(want, rel=1e-12, abs=0) and out.columns == ["i", "p", "q"]
    ranks = ordered.range_placed(df, [F.col("p"), F.col("i")], "_rank").groupBy("_part").count().collect()
    assert len(ranks) == 4 and max(r["count"] for r in ranks) < len(p) / 2


def test_rank_percent_takes_the_lowest_rank(spark):
    values = [3.0, 1.0, 3.0, None, 7.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r["rank_pct"] for r in sq.rank_percent(df, "v", F.floor(F.col("v") / 2)).orderBy("i").collect()]
    assert got == [3 / 5, 1 / 5, 3 / 5, None, 1.0, 1 / 5]


def test_peaks(spark):
    values = [1, 9, 1, 8, 8, 1, 7, 1, 0, 10]
    data = [("r", i * MICROS, f"w{i}", 0, float(v)) for i, v in enumerate(values)] + [("flat", i * MICROS, f"f{i}", 0, 2.0) for i in range(4)]
    df = spark.createDataFrame(data, DDL).withColumns({"activity_mean": F.col("value"), "end_us": F.col("start_us") + MICROS})
    got = {r["event_id"]: r["window_id"] for r in rs.detect_peaks(df, ResilienceSettings(), block_seconds=3).collect()}
    assert got == {"r_candidate_peak_01": "w9", "r_candidate_peak_02": "w1", "flat_candidate_peak_01": "f0"} | (
        {"r_candidate_peak_03": "w3"} if (8 - np.mean(values)) / np.std(values) >= 1 else {}
    )


def evaluate(rows, start, end, s):
    """Sequential restatement of the recovery rule for one event in one room."""
    hits = [i for i, r in enumerate(rows) if r[1] <= end and r[5] >= start]
    if not hits:
        hits = [min(range(len(rows)), key=lambda i: (abs(rows[i][1] - start), i))]
    act = [r[4] if r[4] is not None else 0.0 for r in rows]
    peak = max(hits, key=lambda i: (act[i], -i))
    base = act[max(0, peak - s.baseline_windows) : peak]
    baseline = float(np.mean(base)) if base else act[peak]
    excess = max(act[peak] - baseline, 0.0)
    limit = baseline + s.recovery_fraction * excess
    fin, recovered = None, False
    for i in range(peak + 1, min(len(rows), peak + 1 + s.max_recovery_windows)):
        if act[i] <= limit:
            fin, recovered = i, True
            break
    if fin is None:
        fin = min(len(rows) - 1, peak + s.max_recovery_windows)
    area = sum(max(a - baseline, 0.0) for a in act[peak : fin + 1]) * 30.0
    seconds = (rows[fin][5] - rows[peak][5]) / MICROS
    slope = (act[fin] - act[peak]) / seconds if seconds > 0 else 0.0
    return rows[peak][2], round(baseline, 6), round(act[peak], 6), fin - peak, round(seconds, 6), recovered, round(area, 5), round(slope, 6), len(base)


def test_recovery_against_sequential_rule(spark):
    data = [(r, t, w, s, 0.0 if v is None else v, t + 30 * MICROS) for r, t, w, s, v in sequence_rows(9) if r is not None]
    windows = spark.createDataFrame(data, DDL + ", end_us bigint").withColumns({"activity_mean": F.col("value"), "duration_seconds": F.lit(30.0)})
    rng = random.Random(4)
    groups = by_room(data)
    log = []
    for i in range(40):
        room = rng.choice(list(groups))
        at = rng.randrange(0, groups[room][-1][1] + 10_000 * MICROS)
        log.append((f"e{i:02d}", room, at, at + rng.choice([1, 60, 900]) * MICROS, i, "x", "event_log"))
    events = spark.createDataFrame(log, "event_id string, room_id string, event_start_us bigint, event_end_us bigint, event_seq int, event_type string, candidate_event_source string")
    settings = ResilienceSettings()
    summary, notes = rs.evaluate_events(windows, events, settings, block_seconds=1_000)
    got = {
        r["event_id"]: (
            r["peak_window_id"], round(r["baseline_activity"], 6), round(r["peak_activity"], 6), r["recovery_time_windows"], round(r["recovery_time_seconds"], 6),
            r["recovered_flag"], round(r["area_under_recovery_curve"], 5), round(r["recovery_slope"], 6), r["baseline_window_count"],
        )
        for r in summary.collect()
    }
    assert got == {e[0]: evaluate(groups[e[1]], e[2], e[3], settings) for e in log}
    annotated = rs.overlay_annotations(windows, notes, events)
    assert annotated.count() == len(data)
    assert annotated.filter("event_phase = 'normal'").agg(F.max("resilience_pressure_index")).first()[0] == 0.0


def test_events_are_told_apart_by_sequence_and_meet_or_take_the_nearest(spark):
    draw = random.Random(6)
    spans = []
    for i in range(120):
        start = draw.randrange(300)
        spans.append((draw.choice(["a", "b", None]), start * MICROS, (start + draw.choice([1, 5, 40])) * MICROS, f"w{i:03d}"))
    log = [("same", draw.choice(["a", "b", None, "nowhere"]), at * MICROS, (at + draw.choice([0, 3, -2])) * MICROS, i) for i, at in enumerate(draw.choices(range(-50, 400), k=60))]
    windows = spark.createDataFrame(spans, "room_id string, start_us bigint, end_us bigint, window_id string")
    events = spark.createDataFrame(log, "event_id string, room_id string, event_start_us bigint, event_end_us bigint, event_seq int")
    want = set()
    for _, room, lo, hi, seq in log:
        here = [w for w in spans if w[0] == room]
        hits = [(seq, w[3], "overlap") for w in here if lo <= hi and w[1] <= hi and w[2] >= lo]
        nearest = sorted(here, key=lambda w: (abs(w[1] - lo), w[1], w[3]))[:1]
        want.update(hits or [(seq, w[3], "nearest") for w in nearest])
    for bins, blocks in ((7, 11), (1_000, 60)):
        got = nearby.met_or_nearest(events, windows, bin_seconds=bins, block_seconds=blocks).collect()
        assert len(got) == len(want) and {(r["event_seq"], r["window_id"], r["matched"]) for r in got} == want
    measured = windows.withColumns({"activity_mean": F.lit(1.0), "duration_seconds": F.lit(1.0)})
    summary, notes = rs.evaluate_events(measured, events)
    assert sorted(r["event_seq"] for r in summary.collect()) == sorted({w[0] for w in want})
    assert rs.overlay_annotations(measured, notes, events).count() == len(spans)


def label(data, log, s):
    """Sequential restatement of the labelling rule."""
    state = {w[2]: (0, None, "outside_event_window", 0.0) for w in data}
    before, after = s.baseline_minutes * 60 * MICROS, s.recovery_minutes * 60 * MICROS
    for event, room, a, b in log:
        for w in data:
            if room and w[0] != room:
                continue
            shared = max(0, min(w[5], b) - max(w[1], a)) / MICROS
            for priority, phase, hit in (
                (3, "during_entry", shared >= s.min_overlap_seconds),
                (2, "pre_entry_baseline", w[5] <= a and w[5] > a - before),
                (1, "post_entry_recovery", w[1] >= b and w[1] < b + after),
            ):
                if hit and state[w[2]][0] < priority:
                    state[w[2]] = (priority, event, phase, shared)
    return {k: v[1:] for k, v in state.items()}


@pytest.mark.parametrize("bin_seconds", [600, 100_000])
def test_labels_against_sequential_rule(spark, bin_seconds):
    data = [(r, t, w, s, v, t + 30 * MICROS) for r, t, w, s, v in sequence_rows(11)]
    rng = random.Random(8)
    log = []
    for i in range(15):
        room = rng.choice(["hot", "a", "b", "", "hot"])
        at = rng.randrange(0, 400_000) * MICROS
        log.append((f"e{i:02d}", room, at, at + rng.choice([5, 117, 4_000]) * MICROS))
    log.append(("twin", *log[0][1:]))
    events = spark.createDataFrame([(*e, i, "t") for i, e in enumerate(log)], "event_id string, room_id string, event_start_us bigint, event_end_us bigint, event_seq int, event_type string")
    windows = spark.createDataFrame(data, DDL + ", end_us bigint")
    settings = EventSettings()
    got = collect(ev.label_windows(windows, events, settings, bin_seconds=bin_seconds), "event_id", "event_phase", "event_overlap_seconds")
    assert got == label(data, log, settings)
    limited = collect(ev.label_windows(windows, events, settings, "none", bin_seconds), "event_id", "event_phase", "event_overlap_seconds")
    assert limited == label(data, [e for e in log if e[1]], settings)


def test_published_labels(spark):
    from windrow.functions.times import with_time_columns

    rows = [
        ("w1", "08:40:00", "08:40:30"), ("w2", "08:49:15", "08:49:45"), ("w3", "08:51:10", "08:51:40"), ("w4", "08:48:50", "08:49:20"), ("w5", "10:51:10", "10:51:40"),
    ]
    windows = with_time_columns(
        spark.createDataFrame([(w, "room_1", f"2025-08-17T{a}-03:00", f"2025-08-17T{b}-03:00") for w, a, b in rows], "window_id string, room_id string, start_time string, end_time string")
    )
    log = with_time_columns(spark.createDataFrame([("2025-08-17T08:49:00-03:00", "2025-08-17T08:50:57-03:00")], "start_time string, end_time string"))
    log = log.select(F.lit("e").alias("event_id"), F.lit("entry").alias("event_type"), F.lit("room_1").alias("room_id"), F.col("start_us").alias("event_start_us"), F.col("end_us").alias("event_end_us"), F.lit(0).alias("event_seq"))
    got = collect(ev.label_windows(windows, log), "event_phase", "event_overlap_seconds", "overlaps_event")
    assert got == {
        "w1": ("pre_entry_baseline", 0.0, False), "w2": ("during_entry", 30.0, True), "w3": ("post_entry_recovery", 0.0, False),
        "w4": ("during_entry", 20.0, True), "w5": ("outside_event_window", 0.0, False),
    }


def test_event_log_headings(spark):
    log = spark.createDataFrame([("2025-08-17T08:49:00", "2025-08-17T08:50:00", "room_1"), ("2025-08-16T08:49:00", "2025-08-16T08:50:00", "room_1")], "`Event Start Time` string, End_Time string, RoomID string")
    got = [r.asDict() for r in rs.normalize_event_log(log).orderBy("event_seq").collect()]
    assert [r["event_id"] for r in got] == ["room_1_event_000", "room_1_event_001"]
    assert got[0]["start_time"] == "2025-08-16T08:49:00" and got[0]["event_type"] == "unspecified_event"


def test_axis_with_value_blocks(spark):
    df = spark.createDataFrame([(float(x),) for x in (5, 1, 1, 9, 3)], "v double").withColumn("i", F.monotonically_increasing_id())
    got = sorted((r["v"], r["n"]) for r in with_position(df, Axis((), ("v", "i"), F.floor("v")), "n").collect())
    assert got == [(1.0, 1), (1.0, 2), (3.0, 3), (5.0, 4), (9.0, 5)]


def test_rows_without_time_come_last(spark):
    data = [("r", None, "w0", 0, 1.0), ("r", 5 * MICROS, "w1", 0, 2.0), ("r", 1 * MICROS, "w2", 0, 3.0), ("r", None, "w3", 0, 4.0)]
    df = spark.createDataFrame(data, DDL)
    axis = time_axis(KEYS, seconds=2)
    assert collect(with_position(df, axis), "position") == {"w2": 1, "w1": 2, "w0": 3, "w3": 4}
    near = collect(with_neighbours(df, axis, before={"pv": "value"}), "pv")
    assert near == {"w2": None, "w1": 3.0, "w0": 2.0, "w3": 1.0}
    back = collect(with_running(df, axis.reversed(), n=("count", F.lit(1))), "n")
    assert back == {"w3": 1, "w0": 2, "w1": 3, "w2": 4}

"""Disturbance and recovery around events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.functions.numbers import clip
from windrow.operators.nearby import highest_met
from windrow.operators.ordered import Axis, first_per, time_axis, with_group_stats, with_neighbours, with_position
from windrow.settings import MICROS, ResilienceSettings


def activity_or_total(df: DataFrame) -> Column:
    total = F.col("activity_total") if "activity_total" in df.columns else F.lit(None).cast("double")
    return F.coalesce(F.col("activity_mean"), total, F.lit(0.0))


def detect_peaks(windows: DataFrame, settings: ResilienceSettings = ResilienceSettings(), block_seconds: int = 86_400) -> DataFrame:
    """Candidate events: local peaks with a high z-score, else the room's highest window; top k per room."""
    axis = time_axis(("room_id",), seconds=block_seconds)
    df = windows.withColumn("_a", activity_or_total(windows))
    stats = with_group_stats(df, ["room_id"], {"_mu": F.avg("_a"), "_sd": F.stddev_pop("_a")})
    near = with_neighbours(stats, axis, before={"_pa": "_a"}, after={"_na": "_a"})
    z = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col("_a") - F.col("_mu")) / F.col("_sd"))
    near = near.withColumn("zscore", z)
    peak = (F.col("_a") >= F.coalesce("_pa", "_a")) & (F.col("_a") >= F.coalesce("_na", "_a")) & (F.col("zscore") >= settings.peak_zscore)
    flagged = near.withColumn("_peak", peak)
    # peaks sort before other rows, so a room without peaks falls back to its first maximum
    order = [F.col("_peak").desc(), F.col("zscore").desc(), F.col("_a").desc(), F.col("start_us").asc(), F.col("window_id").asc()]
    best = first_per(flagged, ["room_id"], order, settings.max_events_per_room)
    rank = F.row_number().over(Window.partitionBy("room_id").orderBy(*order))
    best = best.withColumn("_rank", rank).filter(F.col("_peak") | (F.col("_rank") == 1))
    return best.select(
        F.concat(F.col("room_id").cast("string"), F.lit("_candidate_peak_"), F.lpad(F.col("_rank").cast("string"), 2, "0")).alias("event_id"),
        "room_id", "window_id", F.col("start_us").alias("event_start_us"), F.col("end_us").alias("event_end_us"),
        F.lit("candidate_activity_peak").alias("event_type"), F.lit("activity_peak_fallback").alias("candidate_event_source"),
        F.col("_a").alias("activity"), "zscore", F.col("_rank").cast("bigint").alias("peak_rank"),
    )


def normalize_event_log(log: DataFrame) -> DataFrame:
    """Event log with any spelling of its headings → the standard columns, with defaults.

    Both ``start_time`` and ``event_start_time`` spellings are understood.
    """
    # Recognised headings, letters and digits only.
    known = {
        "eventid": "event_id", "roomid": "room_id", "eventtype": "event_type",
        "starttime": "start_time", "endtime": "end_time", "eventstarttime": "start_time", "eventendtime": "end_time",
    }
    renames: dict[str, str] = {}
    for c in log.columns:
        target = known.get("".join(ch for ch in c.lower() if ch.isalnum()))
        if target and target not in renames.values():
            renames[c] = target
    df = log.withColumnsRenamed(renames)
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("event_id", "room_id", "start_time", "end_time", "event_type") if c not in df.columns})
    if "event_seq" not in df.columns:
        df = with_position(df, _text_axis(), "event_seq").withColumn("event_seq", F.col("event_seq") - 1)
    default = F.concat(F.coalesce("room_id", F.lit("room")), F.lit("_event_"), F.lpad(F.col("event_seq").cast("string"), 3, "0"))
    return df.withColumns(
        {
            "event_id": F.coalesce("event_id", default),
            "event_type": F.coalesce("event_type", F.lit("unspecified_event")),
            "candidate_event_source": F.lit("event_log"),
        }
    )


def _text_axis() -> Axis:
    # blocks follow the calendar month in the text
    month = F.regexp_replace(F.substring(F.col("start_time"), 1, 7), "-", "").try_cast("bigint")
    return Axis((), ("start_time", "end_time", "room_id", "event_id"), month)


def evaluate_events(
    windows: DataFrame, events: DataFrame, settings: ResilienceSettings = ResilienceSettings(), block_seconds: int = 86_400, bin_seconds: int = 3_600
) -> tuple[DataFrame, DataFrame]:
    """Peak, baseline, recovery and curve measures per event (``event_seq``), and the annotated neighbourhood rows.

    An event carries at most ``baseline + 1 + recovery`` windows, so the measures are array arithmetic on one row.
    """
    near = highest_met(events, windows, activity_or_total(windows), settings.baseline_windows, settings.max_recovery_windows, bin_seconds, block_seconds)
    activity = F.col("top._a")
    total = F.aggregate("prev", F.lit(0.0), lambda acc, r: acc + r["_a"])
    near = near.withColumn("baseline_activity", F.coalesce(F.try_divide(total, F.size("prev")), activity))
    near = near.withColumn("_excess", F.greatest(activity - F.col("baseline_activity"), F.lit(0.0)))
    limit = F.col("baseline_activity") + settings.recovery_fraction * F.col("_excess")
    near = near.withColumn("_calm", F.array_position(F.transform("next", lambda r: r["_a"] <= limit), F.lit(True)))
    near = near.withColumn("_steps", F.when(F.col("_calm") > 0, F.col("_calm")).otherwise(F.size("next").cast("bigint")))
    near = near.withColumns({"_after": F.slice("next", F.lit(1), F.col("_steps").cast("int")), "_end": F.when(F.col("_steps") > 0, F.get("next", (F.col("_steps") - 1).cast("int"))).otherwise(F.col("top"))})
    length = F.coalesce("top._length", F.lit(0.0))
    seconds = F.coalesce((F.col("_end._end") - F.col("top._end")) / float(MICROS), length * F.col("_steps"))
    base = F.col("baseline_activity")
    area = F.aggregate(F.concat(F.array("top"), F.col("_after")), F.lit(0.0), lambda acc, r: acc + F.greatest(r["_a"] - base, F.lit(0.0)))
    summary = near.select(
        F.col("about.id").alias("event_id"), "event_seq", "room_id", F.col("top._about.id").alias("peak_window_id"), F.col("top._t").alias("peak_start_us"),
        "baseline_activity", activity.alias("peak_activity"), F.size("prev").cast("bigint").alias("baseline_window_count"), F.col("_steps").alias("recovery_time_windows"), seconds.alias("recovery_time_seconds"),
        F.when(seconds > 0, (F.col("_end._a") - activity) / seconds).otherwise(F.lit(0.0)).alias("recovery_slope"),
        (area * length).alias("area_under_recovery_curve"), (F.col("_calm") > 0).alias("recovered_flag"), F.col("_end._end").alias("recovery_end_us"),
    )
    phase = lambda rows, name: F.transform(rows, lambda r: F.struct(r["_about"]["id"].alias("window_id"), r["_a"].alias("a"), F.lit(name).alias("phase")))
    touched = near.withColumn("_r", F.explode(F.concat(phase(F.col("prev"), "baseline"), phase(F.array("top"), "during"), phase(F.col("_after"), "recovery"))))
    pressure = F.greatest(F.col("_r.a") - base, F.lit(0.0)) / F.when(F.col("_excess") > 0, F.col("_excess")).otherwise(1.0)
    notes = touched.select(
        F.col("about.id").alias("event_id"), "event_seq", "room_id", F.col("_r.window_id").alias("window_id"), F.col("_r.phase").alias("event_phase"),
        clip(pressure, 0.0, 1.5).alias("resilience_pressure_index"), F.col("about.type").alias("event_type"), F.col("about.source").alias("candidate_event_source"),
    )
    return summary, notes


def overlay_annotations(windows: DataFrame, notes: DataFrame, events: DataFrame) -> DataFrame:
    """Attach event annotations; where several events touch a window the later one (``event_seq``) stays."""
    extra = [c for c in ("event_type", "candidate_event_source") if c in events.columns]
    payload = F.struct("event_id", "event_phase", "resilience_pressure_index", *extra)
    key = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("\u0000"))
    latest = notes.select(key("room_id").alias("_kr"), key("window_id").alias("_kw"), payload.alias("_n"), F.struct("event_seq", "event_id").alias("_o"))
    latest = latest.groupBy("_kr", "_kw").agg(F.max_by("_n", "_o").alias("_n"))
    plain = windows.drop("event_id", "event_phase", "event_type", "candidate_event_source", "resilience_pressure_index")
    joined = plain.withColumns({"_kr": key("room_id"), "_kw": key("window_id")}).join(latest, ["_kr", "_kw"], "left").drop("_kr", "_kw")
    columns = {
        "event_id": F.col("_n.event_id"),
        "event_phase": F.coalesce("_n.event_phase", F.lit("normal")),
        "resilience_pressure_index": F.coalesce("_n.resilience_pressure_index", F.lit(0.0)),
    }
    if "event_type" in extra:
        columns["event_type"] = F.col("_n.event_type")
    if "candidate_event_source" in extra:
        columns["candidate_event_source"] = F.coalesce("_n.candidate_event_source", F.lit("none"))
    return joined.withColumns(columns).drop("_n")


def compute_resilience(windows: DataFrame, events: DataFrame | None, settings: ResilienceSettings = ResilienceSettings()) -> tuple[DataFrame, DataFrame]:
    """Annotated windows and the event table; without a log, detected peaks stand in for events."""
    if events is None:
        events = detect_peaks(windows, settings).withColumn("event_seq", F.col("peak_rank"))
    summary, notes = evaluate_events(windows, events, settings)
    return overlay_annotations(windows, notes, events), summary

"""Event intervals: labelling windows, phase summaries, response measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.times import overlap_seconds
from windrow.operators.ordered import Axis, join_same, with_neighbours
from windrow.operators.quantiles import exact_percentiles, long_values
from windrow.operators.timetree import least_at, least_meeting
from windrow.session import cut_lineage
from windrow.settings import BASELINE, DURING, MICROS, OUTSIDE, PHASES, RECOVERY, EventSettings

_PHASE_ORDER = {p: i for i, p in enumerate(PHASES)}


def interval_pairs(
    left: DataFrame, right: DataFrame, keys: list[str], left_span: tuple[Column, Column], right_span: tuple[Column, Column], bin_seconds: int
) -> DataFrame:
    """Rows of both sides whose closed spans meet, as a hash join.

    Spans are cut into time bins and joined on (keys, bin), so only neighbours
    in time meet and a busy room is spread over its bins. A pair sharing
    several bins is kept in the first one only.
    """
    width = F.lit(bin_seconds * MICROS)

    def cut(df: DataFrame, span: tuple[Column, Column], tag: str) -> DataFrame:
        spanned = df.withColumns({f"_{tag}lo": span[0], f"_{tag}hi": span[1]})
        spanned = spanned.filter(F.col(f"_{tag}lo") <= F.col(f"_{tag}hi"))
        spanned = spanned.withColumn(f"_{tag}first", F.floor(F.col(f"_{tag}lo") / width))
        return spanned.withColumn("_bin", F.explode(F.sequence(F.col(f"_{tag}first"), F.floor(F.col(f"_{tag}hi") / width))))

    pairs = cut(left, left_span, "l").join(cut(right, right_span, "r"), [*keys, "_bin"])
    pairs = pairs.filter(F.col("_bin") == F.greatest("_lfirst", "_rfirst"))
    pairs = pairs.filter((F.col("_llo") <= F.col("_rhi")) & (F.col("_lhi") >= F.col("_rlo")))
    return pairs.drop("_bin", *[f"_{t}{n}" for t in "lr" for n in ("lo", "hi", "first")])


def phase_of(start: Column, end: Column, ev_start: Column, ev_end: Column, settings: EventSettings) -> tuple[Column, Column]:
    """Priority (3 during, 2 baseline, 1 recovery, null none) and overlap seconds of one window and one event."""
    before = F.lit(settings.baseline_minutes * 60 * MICROS)
    after = F.lit(settings.recovery_minutes * 60 * MICROS)
    shared = overlap_seconds(start, end, ev_start, ev_end)
    priority = (
        F.when(shared >= settings.min_overlap_seconds, 3)
        .when((end <= ev_start) & (end > ev_start - before), 2)
        .when((start >= ev_end) & (start < ev_end + after), 1)
    )
    return priority, shared


def label_windows(
    windows: DataFrame,
    events: DataFrame,
    settings: EventSettings = EventSettings(),
    blank_room: str = "all",
    bin_seconds: int = 3_600,
) -> DataFrame:
    """Label each window relative to the events of its room.

    ``events``: ``event_id, event_type, room_id, event_start_us, event_end_us, event_seq``.
    During beats baseline beats recovery; among equals the event with the lowest
    ``event_seq`` wins. Windows near no event are ``outside_event_window``.
    ``blank_room``: events without room match ``all`` rooms or ``none``.
    """
    known = events.filter(F.col("event_start_us").isNotNull() & F.col("event_end_us").isNotNull())
    # events over one identical interval label the same windows; the earliest stands for all
    known = known.withColumn("room_id", F.coalesce("room_id", F.lit(""))).groupBy("room_id", "event_start_us", "event_end_us").agg(
        F.min(F.struct("event_seq", "event_id", "event_type")).alias("_e")
    ).select("room_id", "event_start_us", "event_end_us", "_e.*")
    before = F.lit(settings.baseline_minutes * 60 * MICROS)
    after = F.lit(settings.recovery_minutes * 60 * MICROS)
    # windows over one span of a room share their label, so pairs are formed once per span
    spans = windows.filter(F.col("start_us").isNotNull() & F.col("end_us").isNotNull()).select(
        "room_id", "start_us", "end_us", F.col("room_id").alias("_room")
    ).distinct()
    reach = (F.col("event_start_us") - before, F.col("event_end_us") + after)
    pairs = interval_pairs(spans, known.filter("room_id <> ''"), ["room_id"], (F.col("start_us"), F.col("end_us")), reach, bin_seconds).drop("room_id")
    priority, _ = phase_of(F.col("start_us"), F.col("end_us"), F.col("event_start_us"), F.col("event_end_us"), settings)
    pairs = pairs.withColumn("_pri", priority).filter(F.col("_pri").isNotNull())
    event = F.struct("event_seq", "event_id", "event_type", "event_start_us", "event_end_us")
    # the highest priority, then the first event: both as a least value
    best = pairs.groupBy(F.col("_room").alias("room_id"), "start_us", "end_us").agg(F.min(F.struct((-F.col("_pri")).alias("rank"), event.alias("event"))).alias("_b"))
    labelled = join_same(windows, best, ["room_id", "start_us", "end_us"])
    if blank_room == "all":
        anywhere = _anywhere(spans, known.filter("room_id = ''"), settings)
        labelled = join_same(labelled, anywhere, ["start_us", "end_us"]).withColumn("_b", F.least("_b", "_any")).drop("_any")
    chosen, start, end = F.col("_b.event"), F.col("start_us"), F.col("end_us")
    mid = start + (end - start) / 2
    rank = -F.col("_b.rank")
    shared = overlap_seconds(start, end, chosen["event_start_us"], chosen["event_end_us"])
    return labelled.withColumns(
        {
            **{f: chosen[f] for f in ("event_id", "event_type", "event_start_us", "event_end_us")},
            "seconds_from_event_start": (mid - chosen["event_start_us"]) / MICROS,
            "seconds_from_event_end": (mid - chosen["event_end_us"]) / MICROS,
            "event_phase": F.when(rank == 3, DURING).when(rank == 2, BASELINE).when(rank == 1, RECOVERY).otherwise(OUTSIDE),
            "event_overlap_seconds": F.when(rank.isNotNull(), shared).otherwise(F.lit(0.0)),
            "overlaps_event": F.coalesce(rank == 3, F.lit(False)),
        }
    ).drop("_b")


def _anywhere(spans: DataFrame, events: DataFrame, settings: EventSettings) -> DataFrame:
    """``start_us``, ``end_us`` and ``_any`` (rank and event) of the spans near an event that belongs to no room.

    Rooms play no part, so spans are reduced over all rooms first, and each asks the time tree instead of meeting events.
    """
    least = round(settings.min_overlap_seconds * MICROS)
    before, after = settings.baseline_minutes * 60 * MICROS, settings.recovery_minutes * 60 * MICROS
    keys = ["start_us", "end_us"]
    span = spans.select(*keys).distinct()
    marks = events.withColumn("_e", F.struct("event_seq", "event_id", "event_type", "event_start_us", "event_end_us"))
    start, end = F.col("event_start_us"), F.col("event_end_us")
    # sharing `least` or more is meeting, once both the event and the span end that much earlier
    long = marks.filter(end - start >= least)
    during = least_meeting(span, keys, F.col("start_us"), F.col("end_us") - least, long, start, end - least, "_e").withColumnRenamed("_e", "_during")
    ahead = least_at(span, "end_us", marks, start - before + 1, start, "_e").withColumnRenamed("_e", "_ahead")
    behind = least_at(span, "start_us", marks, end, end + after - 1, "_e").withColumnRenamed("_e", "_behind")
    ranked = span.join(during, keys, "left").join(ahead, "end_us", "left").join(behind, "start_us", "left")
    one = lambda rank, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(-rank).alias("rank"), F.col(c).alias("event")))
    return ranked.select(*keys, F.coalesce(one(3, "_during"), one(2, "_ahead"), one(1, "_behind")).alias("_any")).filter("_any IS NOT NULL")


def event_from_media(
    media: DataFrame, path_or_name: str, event_id: str, event_type: str, entry_seconds: float, exit_seconds: float, tie: str = "media_id"
) -> DataFrame:
    """Event row at fixed offsets into the earliest media file whose path or name matches; of several the least ``tie``."""
    wanted = path_or_name.replace("\\", "/").lower()
    path = F.lower(F.replace(F.col("video_path"), F.lit("\\"), F.lit("/")))
    match = (path == wanted) | F.endswith(path, F.lit("/" + wanted.split("/")[-1])) | (path == wanted.split("/")[-1])
    first = media.filter(match & F.col("start_us").isNotNull()).agg(
        F.min_by(F.struct("media_id", "room_id", "session_id", "video_path", "start_us"), F.struct("start_us", tie)).alias("m")
    ).filter("m is not null")
    return first.select(
        F.lit(event_id).alias("event_id"), F.lit(event_type).alias("event_type"),
        "m.room_id", "m.session_id", F.col("m.video_path").alias("source_video_path"), F.col("m.media_id").alias("source_media_id"),
        (F.col("m.start_us") + F.lit(round(entry_seconds * MICROS))).alias("event_start_us"),
        (F.col("m.start_us") + F.lit(round(exit_seconds * MICROS))).alias("event_end_us"),
        F.lit(0).cast("bigint").alias("event_seq"),
    )


def phases_frame(df: DataFrame) -> DataFrame:
    """The three phases as a tiny table with their report position."""
    spark = df.sparkSession
    rows = F.explode(F.array(*[F.struct(F.lit(i).alias("phase_order"), F.lit(p).alias("phase")) for p, i in _PHASE_ORDER.items()]))
    return spark.range(1).select(rows.alias("p")).select("p.*")


def dominant(df: DataFrame, by: list[str], label: str, name: str = "dominant") -> DataFrame:
    """Most frequent label per group with its share; ties go to the alphabetically first label."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("_n"))
    grouped = counts.groupBy(*by).agg(
        F.max_by(F.col(label), F.col("_n")).alias("_any"), F.sum("_n").alias("_t"),
        F.max("_n").alias("_m"),
        F.min(F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l"))).alias("_best"),
    )
    return grouped.select(*by, F.col("_best.l").alias(f"{name}_label"), (F.col("_m") / F.col("_t")).alias(f"{name}_fraction"))


def phase_summary(labelled: DataFrame, means: dict[str, str], maxes: dict[str, str], label: str | None = None) -> DataFrame:
    """Exactly three rows (baseline, during, recovery): window count, means, maxima and dominant label."""
    part = labelled.filter(F.col("event_phase").isin(*PHASES) & F.col("event_id").isNotNull()).withColumnRenamed("event_phase", "phase")

    def column(c: str) -> Column:
        return F.col(c) if c in labelled.columns else F.lit(None).cast("double")

    stats = part.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n_windows"),
        *[F.avg(column(c)).alias(n) for n, c in means.items()],
        *[F.max(column(c)).alias(n) for n, c in maxes.items()],
    )
    out = phases_frame(labelled).join(stats, "phase", "left").withColumn("n_windows", F.coalesce("n_windows", F.lit(0)))
    if label and label in labelled.columns:
        named = part.withColumn(label, F.coalesce(label, F.lit("unlabeled_state")))
        out = out.join(dominant(named, ["phase"], label, "dominant_state"), "phase", "left").withColumn(
            "dominant_state_label", F.coalesce("dominant_state_label", F.lit("n/a"))
        )
    return out


def phase_metrics_long(labelled: DataFrame, metrics: list[str]) -> DataFrame:
    """Phase × metric: count, mean, median, max, sample std, and change against the baseline mean."""
    part = labelled.filter(F.col("event_phase").isin(*PHASES) & F.col("event_id").isNotNull())
    # the labelled part is small next to its input and is read by every aggregate below
    slim = cut_lineage(part.select(F.col("event_phase").alias("phase"), *metrics))
    long = long_values(slim, ["phase"], metrics)
    keys = ["phase", "metric"]
    stats = long.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("value").alias("mean"), F.max("value").alias("max"), F.stddev_samp("value").alias("std")
    )
    medians = exact_percentiles(long, keys, "value", {"median": 0.5})
    grid = phases_frame(labelled).withColumn("metric", F.explode(F.array(*[F.lit(m) for m in metrics])))
    baseline = stats.filter(F.col("phase") == BASELINE).select("metric", F.col("mean").alias("baseline_mean"))
    out = grid.join(stats, keys, "left").join(medians, keys, "left").join(baseline, "metric", "left")
    return out.withColumns(
        {
            "n_windows": F.coalesce("n_windows", F.lit(0)),
            "fold_change_vs_baseline": F.when(F.col("baseline_mean") != 0, F.col("mean") / F.col("baseline_mean")),
            "mean_minus_baseline": F.col("mean") - F.col("baseline_mean"),
        }
    ).drop("phase_order")


def phase_state_shares(labelled: DataFrame, state: str, states: list) -> DataFrame:
    """Phase × state proportions, zero-filled, three rows."""
    part = labelled.filter(F.col("event_phase").isin(*PHASES)).withColumnRenamed("event_phase", "phase")
    counts = part.groupBy("phase").pivot(state, states).agg(F.count(F.lit(1)))
    columns = [str(s) for s in states]
    filled = phases_frame(labelled).join(counts, "phase", "left").na.fill(0, columns)
    whole = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in columns])
    return filled.select("phase", *[F.coalesce(F.try_divide(F.col(f"`{c}`"), whole), F.lit(0.0)).alias(f"share_{c}") for c in columns])


def strongest_response(summary: DataFrame, metrics: dict[str, str]) -> DataFrame:
    """The metric whose mean moves most from baseline to the event (first listed on ties)."""
    def at(phase: str, column: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    changes = summary.agg(*[F.abs(at(DURING, c) - at(BASELINE, c)).alias(n) for n, c in metrics.items()])
    options = F.filter(
        F.array(*[F.struct(F.col(n).alias("change"), F.lit(-i).alias("rank"), F.lit(n).alias("metric")) for i, n in enumerate(metrics)]),
        lambda o: o["change"].isNotNull(),
    )
    best = F.array_max(options)
    return changes.select(best["metric"].alias("metric"), best["change"].alias("change"))


def phase_comparison(summary: DataFrame, column: str) -> DataFrame:
    """One row: did the metric rise in the event, did it fall after it (false when a side is missing)."""
    def at(phase: str) -> Column:
        return F.max(F.when(F.col("phase") == phase, F.col(column)))

    wide = summary.agg(at(BASELINE).alias("baseline"), at(DURING).alias("during"), at(RECOVERY).alias("recovery"))
    return wide.withColumns(
        {
            "increased": F.coalesce(F.col("during") > F.col("baseline"), F.lit(False)),
            "recovered": F.coalesce(F.col("recovery") < F.col("during"), F.lit(False)),
        }
    )


def compare_runs(current: DataFrame, previous: DataFrame, columns: list[str]) -> DataFrame:
    """Two runs' phase summaries side by side with the difference per column."""
    left = current.select("phase", *[F.col(c).alias(f"{c}_current") for c in columns])
    right = previous.select("phase", *[F.col(c).alias(f"{c}_previous") for c in columns])
    joined = left.join(right, "phase", "full")
    return joined.withColumns({f"{c}_difference": F.col(f"{c}_current") - F.col(f"{c}_previous") for c in columns})


def recovery_time(labelled: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Per group: seconds after the event of the first later window at or below the baseline mean."""
    base = labelled.filter(F.col("event_phase") == BASELINE).groupBy(*by).agg(F.avg(metric).alias("baseline_mean"))
    after = join_same(labelled.filter(F.col("event_phase") == RECOVERY), base, by, "inner").filter(F.col(metric) <= F.col("baseline_mean"))
    return after.groupBy(*by).agg(
        F.min_by("seconds_from_event_end", F.struct("start_us", "window_id")).alias("recovery_seconds")
    )


def change_points(df: DataFrame, axis: Axis, label: str) -> DataFrame:
    """Rows at which the label differs from the row before (the first row counts)."""
    scanned = with_neighbours(df, axis, before={"_pl": label})
    changed = ~F.col("_has_before") | ~F.col("_pl").eqNullSafe(F.col(label))
    return scanned.filter(changed).drop("_pl", "_has_before")

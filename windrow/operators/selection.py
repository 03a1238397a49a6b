"""Choosing windows: filters, caps per group, mapping rules, evidence picks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.text import path_contains
from windrow.operators.ordered import Axis, attach_row, even_spread, first_per, with_position
from windrow.settings import MICROS


def filter_windows(
    windows: DataFrame,
    room: str | None = None,
    session: str | None = None,
    path_part: str | None = None,
    skip_bad: bool = False,
    require_ok: bool = False,
) -> DataFrame:
    df = windows
    if room and "room_id" in df.columns:
        df = df.filter(F.col("room_id").cast("string") == room)
    if session and "session_id" in df.columns:
        df = df.filter(F.col("session_id").cast("string") == session)
    if path_part and "video_path" in df.columns:
        df = df.filter(path_contains("video_path", path_part))
    status = F.coalesce(F.lower(F.col("quality_status").cast("string")), F.lit("nan")) if "quality_status" in df.columns else None
    if skip_bad and status is not None:
        df = df.filter(status != "error")
    if require_ok and status is not None:
        df = df.filter(status == "ok")
    return df


def include_rooms(df: DataFrame, include: str | list[str] = "auto", exclude: list[str] | None = None) -> DataFrame:
    if include != "auto":
        df = df.filter(F.col("room_id").isin([include] if isinstance(include, str) else include))
    return df.filter(~F.col("room_id").isin(exclude)) if exclude else df


def cap_groups(df: DataFrame, caps: list[tuple[list[str], int | None]], order: list[str]) -> DataFrame:
    """First n rows per group, applied one after the other (an empty key list caps the whole frame)."""
    ordering = [F.col(c).asc_nulls_last() for c in order]
    for keys, n in caps:
        if n is None:
            continue
        df = first_per(df, keys, ordering, n) if keys else df.orderBy(*ordering).limit(n)
    return df


def select_windows(windows: DataFrame, axis: Axis, k: int | None = None, per_group: int | None = None, group: tuple[str, ...] = ("room_id", "session_id", "media_id"), **filters) -> DataFrame:
    """Filter, cap per recording, spread evenly, and number the chosen windows."""
    df = filter_windows(windows, **filters)
    if per_group is not None:
        df = first_per(df, [g for g in group if g in df.columns], [F.col(c).asc_nulls_last() for c in axis.order], per_group)
    return even_spread(df, axis, k) if k is not None else with_position(df, axis, "selection_rank")


def first_mapping(files: DataFrame, mapping: DataFrame, path: str = "file_path", key: str = "media_id") -> DataFrame:
    """First mapping rule whose pattern is found in the path, and how many rules matched.

    ``mapping``: ``map_order, pattern, …``, a configuration. The rules travel as one array, so each
    file is tested in place and nothing is shuffled.
    """
    values = [c for c in mapping.columns if c != "pattern"]
    rules = mapping.filter(F.coalesce(F.col("pattern"), F.lit("")) != "").select(F.struct("map_order", "pattern", *[c for c in values if c != "map_order"]).alias("_rule"))
    listed = attach_row(files, rules.agg(F.array_sort(F.collect_list("_rule")).alias("_rules")))
    met = F.filter("_rules", lambda r: F.regexp_like(F.col(path), F.concat(F.lit("(?i)"), r["pattern"])))
    found = listed.withColumn("_met", met).withColumn("_m", F.get("_met", F.lit(0)))
    return found.select(
        *files.columns, *[F.col(f"_m.{v}").alias(f"mapped_{v}" if v != "map_order" else v) for v in values],
        F.greatest(F.size("_met"), F.lit(0)).cast("bigint").alias("match_count"),
    )


# The published picks, each the extreme of a metric among windows that reach the floors.
EVIDENCE = [
    {"name": "feeding_peak", "metric": "feeding_activity_fraction"},
    {"name": "drinking_peak", "metric": "drinking_activity_fraction"},
    {"name": "general_day_peak", "metric": "general_activity_fraction", "floors": {"activity_mean": 0.00014}},
    {"name": "transition_peak", "metric": "semantic_transition_proxy", "floors": {"activity_mean": 0.005, "semantic_transition_proxy": 0.12}},
    {"name": "mobility_peak", "metric": "mobility_index", "floors": {"activity_mean": 0.01}},
]


def spaced_extremes(df: DataFrame, rules: list[dict] = EVIDENCE, gap_seconds: int = 1_200, daylight: tuple[int, int] = (7, 17)) -> DataFrame:
    """One window per rule, in the order of the rules, none closer than ``gap_seconds`` to one picked before.

    A rule has ``name`` and ``metric``, and may have ``floors`` (least values of columns), ``lowest`` (the smallest value instead
    of the largest) and ``any_hour`` (else the local hour lies in ``daylight``). Equal values go to the earlier window, then the
    smaller id.

    The picks so far are one row, an array that an aggregate extends by the next best window; so the plan is
    a chain with one scan for each rule and one for the ranks, and no step on the driver. A rule that no window meets ends the run with an error.
    """
    spark = df.sparkSession
    kind = df.select(F.struct(F.lit("").alias("rule"), F.lit(0.0).alias("value"), *df.columns).alias("pick")).schema["pick"].dataType.simpleString()
    picks = spark.range(1).select(F.array().cast(f"array<{kind}>").alias("_picks"))
    for rule in rules:
        value = F.col(rule["metric"]).cast("double")
        fits = value.isNotNull()
        if not rule.get("any_hour"):
            fits &= (F.col("local_hour") >= daylight[0]) & (F.col("local_hour") < daylight[1])
        for column, least in rule.get("floors", {}).items():
            fits &= F.col(column) >= least
        apart = ~F.exists("_picks", lambda pick: F.abs(pick["start_us"] - F.col("start_us")) < gap_seconds * MICROS)
        row = F.struct(F.lit(rule["name"]).alias("rule"), value.alias("value"), *df.columns)
        place = F.struct(value if rule.get("lowest") else -value, "start_us", "window_id")
        best = attach_row(df.filter(fits), picks).filter(apart).agg(F.min_by(row, place).alias("_best"), F.first("_picks").alias("_before"))
        known = F.when(F.col("_best").isNull(), F.raise_error(F.lit(f"no window matches {rule['name']}")).cast(kind)).otherwise(F.col("_best").cast(kind))
        picks = best.select(F.concat("_before", F.array(known)).alias("_picks"))
    below = [F.count_if(F.col(r["metric"]) < F.col("_picks")[k]["value"]) for k, r in enumerate(rules)]
    share = [((b + 1) / F.count(r["metric"])).alias(r["name"]) for b, r in zip(below, rules)]
    ranks = attach_row(df, picks).agg(F.first("_picks").alias("_picks"), F.array(*share).alias("_shares"))
    rows = ranks.select(F.posexplode("_picks").alias("_at", "_pick"), "_shares")
    metric = F.array(*[F.lit(r["metric"]) for r in rules])
    return rows.select(
        *[F.col(f"_pick.{c}").alias(c) for c in df.columns], F.get("_shares", "_at").alias("selection_rank_pct"),
        F.col("_pick.rule").alias("selection_key"), F.get(metric, F.col("_at")).alias("selection_metric"), F.col("_pick.value").alias("selection_value"),
    )

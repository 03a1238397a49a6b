"""Zone activity → window biomarkers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions import arrays
from windrow.functions.numbers import clip, min_max
from windrow.operators.ordered import Axis, attach_row, first_per, join_same, time_axis, with_group_stats, with_neighbours
from windrow.settings import SEMANTIC_ZONES, MobilityWeights


def with_activity_proxy(zones: DataFrame) -> DataFrame:
    """First present of the three activity measures, and its name."""
    # Order of preference.
    names = ["activity_mean", "motion_pixel_ratio", "activity_std"]
    present = [F.col(n) if n in zones.columns else F.lit(None).cast("double") for n in names]
    source = F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for c, n in zip(present, names)], F.lit("missing"))
    return zones.withColumns({"activity_proxy_raw": F.coalesce(*present), "source_activity_field": source})


def merge_tokens(rows: DataFrame, keys: list[str], order: Column, column: str = "warnings", sep: str = ";", glue: str | None = None) -> DataFrame:
    """Distinct tokens of all rows of a group in first-seen order, as text.

    Tokens are reduced to one row per (group, token) before they are collected,
    so the collected list is as long as the vocabulary, not as the group.
    """
    pieces = rows.select(
        *keys, order.alias("_o"), F.posexplode(F.split(F.coalesce(F.col(column), F.lit("")), "\\" + sep)).alias("_p", "_t")
    ).withColumn("_t", F.trim("_t")).filter((F.col("_t") != "") & (F.lower("_t") != "nan"))
    first = pieces.groupBy(*keys, "_t").agg(F.min(F.struct("_o", "_p")).alias("_first"))
    ordered = F.array_sort(F.collect_list(F.struct("_first", "_t")))
    return first.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda x: x["_t"]), glue if glue is not None else sep).alias(column)
    )


def window_distribution(
    zones: DataFrame,
    keys: list[str] | None = None,
    carry: list[str] | None = None,
    fallback_source: str = "uniform_zero_activity_fallback",
    quiet_uniform: bool = True,
) -> DataFrame:
    """One row per window: totals, means, the zone→share map and its two indices.

    ``carry`` columns are taken from the window's first zone. ``fallback_source`` is the ``distribution_source`` of windows
    without activity; ``distribution_fallback_used`` marks them under any name. Their shares are uniform or, without
    ``quiet_uniform``, not a number.

    Zone rows are combined per zone first, so duplicated rows of one window are
    merged on the map side and the collected map has one entry per zone.
    """
    keys, carry = keys or ["room_id", "start_us", "window_id"], carry or []
    base = zones if "activity_proxy_raw" in zones.columns else with_activity_proxy(zones)
    have = [c for c in ("activity_mean", "activity_std", "motion_pixel_ratio") if c in base.columns]
    per_zone = base.groupBy(*keys, "zone_id").agg(
        F.sum(F.greatest(F.coalesce(F.col("activity_proxy_raw"), F.lit(0.0)), F.lit(0.0))).alias("_w"),
        F.sum(F.col("activity_proxy_raw").isNull().cast("bigint")).alias("_missing"),
        *[F.sum(c).alias(f"_s_{c}") for c in have],
        *[F.count(c).alias(f"_n_{c}") for c in have],
        *[F.min(c).alias(c) for c in carry],
    )
    entries = F.array_sort(F.collect_list(F.when(F.col("zone_id").isNotNull(), F.struct(F.col("zone_id"), F.col("_w")))))
    # Output names of the plain means.
    mean_names = {"activity_mean": "activity_mean", "activity_std": "activity_std_mean", "motion_pixel_ratio": "motion_pixel_ratio_mean"}
    windows = per_zone.groupBy(*keys).agg(
        F.count("zone_id").alias("zone_count"),
        F.sum("_missing").alias("missing_zone_count"),
        F.sum("_w").alias("activity_total"),
        *[F.try_divide(F.sum(f"_s_{c}"), F.sum(f"_n_{c}")).alias(mean_names[c]) for c in have],
        F.map_from_entries(entries).alias("_weights"),
        *[F.min_by(c, "zone_id").alias(c) for c in carry],
    )
    fallback = (F.col("activity_total") <= 0) | (F.col("zone_count") <= 0)
    quiet = 1.0 / F.col("zone_count") if quiet_uniform else F.lit(float("nan"))
    share = F.transform_values("_weights", lambda _, w: F.when(fallback, quiet).otherwise(w / F.col("activity_total")))
    windows = windows.withColumns(
        {
            "distribution_fallback_used": fallback,
            "distribution_source": F.when(fallback, fallback_source).otherwise("activity_proxy_distribution"),
            "distribution": share,
        }
    )
    vector = F.map_values("distribution")
    return windows.withColumns(
        {
            "spatial_freedom_index": arrays.spatial_freedom(vector),
            "occupancy_imbalance_index": arrays.occupancy_imbalance(vector),
        }
    ).drop("_weights")


def semantic_shares(zones: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row per window from the three fixed zones; a zone without value counts as zero.

    When a zone occurs more than once the row with the highest ``order`` wins.
    """
    value = F.col("activity_mean").cast("double")

    def pick(zone: str) -> Column:
        here = F.col("zone_id") == zone
        if order is None:
            return F.max(F.when(here, value))
        return F.max_by(value, F.when(here, F.col(order)))

    severity = F.max(F.when(F.col("quality_status") == "failed", 2).when(F.col("quality_status") == "warning", 1).otherwise(0))
    picked = zones.groupBy(*keys).agg(
        *[F.coalesce(pick(z), F.lit(0.0)).alias(f"_{z}") for z in SEMANTIC_ZONES], severity.alias("_sev")
    )
    values = F.array(*[F.col(f"_{z}") for z in SEMANTIC_ZONES])
    picked = picked.withColumn("_p", arrays.distribution(values))
    drinking, feeding, general = (F.col("_p")[i] for i in range(3))
    return picked.withColumns(
        {
            "activity_mean": arrays.total(values) / 3.0,
            "spatial_freedom_index": arrays.spatial_freedom(F.col("_p")),
            "occupancy_imbalance_index": arrays.occupancy_imbalance(F.col("_p")),
            "drinking_activity_fraction": drinking,
            "feeding_activity_fraction": feeding,
            "general_activity_fraction": general,
            "feeding_plus_drinking_activity_fraction": drinking + feeding,
            "drinking_to_feeding_activity_ratio": F.when(feeding > 0, drinking / feeding),
            "quality_status": F.when(F.col("_sev") == 2, "failed").when(F.col("_sev") == 1, "warning").otherwise("ok"),
        }
    ).drop("_p", "_sev", *[f"_{z}" for z in SEMANTIC_ZONES])


def with_transition(
    windows: DataFrame,
    vector: str,
    by: tuple[str, ...] = ("room_id",),
    name: str = "transition_proxy",
    axis: Axis | None = None,
) -> DataFrame:
    """Half the L1 change of the distribution since the previous window; zero for the first.

    ``by`` is (room) or (room, session); ``vector`` is an array or a zone→share map.
    """
    axis = axis or time_axis(by)
    is_map = dict(windows.dtypes)[vector].startswith("map")
    # an array moves through the scan; maps cannot be grouped or ordered
    source = windows.withColumn("_vec", F.map_entries(vector) if is_map else F.col(vector))
    scanned = with_neighbours(source, axis, before={"_prev": "_vec"})
    if is_map:
        change = arrays.half_l1_maps(F.map_from_entries("_prev"), F.col(vector))
    else:
        change = arrays.half_l1(F.col("_prev"), F.col(vector))
    return scanned.withColumn(name, F.when(F.col("_has_before"), change).otherwise(F.lit(0.0))).drop("_vec", "_prev", "_has_before")


def with_scaled(
    df: DataFrame,
    value: str,
    name: str,
    by: list[str],
    const_zero: float = 0.0,
    const_other: float = 0.5,
    null_as: float | None = None,
    clipped: bool = False,
) -> DataFrame:
    """Min-max scaling per group; see :func:`windrow.functions.numbers.min_max` for the constant and null rules."""
    stats = with_group_stats(df, by, {"_lo": F.min(value), "_hi": F.max(value)})
    scaled = min_max(F.col(value), F.col("_lo"), F.col("_hi"), const_zero, const_other, null_as, clipped)
    return stats.withColumn(name, scaled).drop("_lo", "_hi")


def mobility(activity: Column, transition: Column, weights: MobilityWeights = MobilityWeights(), bounded: bool = False) -> Column:
    score = weights.activity * activity + weights.transition * transition
    return clip(score, 0.0, 1.0) if bounded else score


def room_biomarkers(zones: DataFrame, weights: MobilityWeights = MobilityWeights(), quiet_uniform: bool = True) -> DataFrame:
    """The full window biomarker table from zone rows (any number of zones); ``quiet_uniform`` as in ``window_distribution``."""
    keys = ["room_id", "start_us", "window_id"]
    ids = [c for c in ("media_id", "system_id", "session_id", "start_time", "end_time", "end_us", "duration_seconds", "zone_config_id") if c in zones.columns]
    windows = window_distribution(zones, keys, ids, quiet_uniform=quiet_uniform)
    if "warnings" in zones.columns:
        merged = merge_tokens(zones, keys, F.col("zone_id"), sep="|", glue=" | ")
        windows = join_same(windows, merged, keys).withColumn("warnings", F.coalesce("warnings", F.lit("")))
    windows = with_transition(windows, "distribution")
    ends = {f"_{n}_{c}": f(c) for c in ("activity_mean", "activity_total") for n, f in (("lo", F.min), ("hi", F.max))}
    windows = with_group_stats(windows, ["room_id"], ends)
    scaled = [min_max(F.col(c), F.col(f"_lo_{c}"), F.col(f"_hi_{c}"), 0.0, 1.0) for c in ("activity_mean", "activity_total")]
    windows = windows.withColumn("normalized_activity", F.coalesce(*scaled, F.lit(0.0))).drop(*ends)
    return windows.withColumn("mobility_index", mobility(F.col("normalized_activity"), F.col("transition_proxy"), weights))


def semantic_biomarkers(zones: DataFrame, by: tuple[str, ...] = ("room_id",), order: str | None = None) -> DataFrame:
    """The semantic window biomarker table (three zones). ``by`` sets where transitions start afresh."""
    keys = [c for c in ("window_id", "media_id", "room_id", "session_id", "start_time", "end_time", "start_us", "end_us") if c in zones.columns]
    windows = semantic_shares(zones, keys, order)
    if "warnings" in zones.columns:
        position = F.col(order) if order else F.col("zone_id")
        merged = merge_tokens(zones, keys, position)
        windows = join_same(windows, merged, keys).withColumn("warnings", F.coalesce("warnings", F.lit("")))
    windows = windows.withColumn(
        "_vec", F.array("drinking_activity_fraction", "feeding_activity_fraction", "general_activity_fraction")
    ).withColumnRenamed("_vec", "shares")
    windows = with_transition(windows, "shares", by, "semantic_transition_proxy").drop("shares")
    windows = with_scaled(windows, "activity_mean", "normalized_activity", ["room_id"], 0.0, 0.5, null_as=0.0, clipped=True)
    return windows.withColumn(
        "mobility_index",
        mobility(F.col("normalized_activity"), F.col("semantic_transition_proxy"), bounded=True),
    )


def activity_share(zones: DataFrame, window: str = "window_id", value: str = "activity_sum", name: str = "activity_norm") -> DataFrame:
    """A zone's part of its window's activity; equal parts when the window has none."""
    stats = with_group_stats(zones, [window], {"_sum": F.sum(value), "_zones": F.count("zone_id")})
    share = F.when(F.coalesce(F.col("_sum"), F.lit(0.0)) > 0, F.coalesce(F.col(value), F.lit(0.0)) / F.col("_sum")).otherwise(
        1.0 / F.coalesce(F.nullif(F.col("_zones"), F.lit(0)), F.lit(1))
    )
    return stats.withColumn(name, clip(share, 0.0, 1.0)).drop("_sum", "_zones")


def fill_zones(windows: DataFrame, zones: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """One row per window and configured zone; zones without features are null rows.

    With a ``room_id`` in ``zones`` (the zone configuration) a window has the zones of its room, and a window of a room without
    configuration is one row with a null zone. Without it one layout serves all rooms.
    """
    if "room_id" in zones.columns and "room_id" in windows.columns:
        grid = join_same(windows, zones, ["room_id"])
    else:
        layout = zones.agg(F.collect_list(F.struct(*zones.columns)).alias("_layout"))
        grid = attach_row(windows, layout).withColumn("_z", F.explode("_layout"))
        grid = grid.select(*windows.columns, *[F.col("_z")[c].alias(c) for c in zones.columns])
    return join_same(grid, features, [*keys, "zone_id"])


def dominant_zone(windows: DataFrame, by: list[str]) -> DataFrame:
    """Per group, the zone with the largest mean fraction (ties by name) and that mean."""
    names = ["drinking_activity_fraction", "feeding_activity_fraction", "general_activity_fraction"]
    means = windows.groupBy(*by).agg(*[F.avg(n).alias(n) for n in names])
    options = F.filter(
        F.array(*[F.struct(F.col(n).alias("mean"), F.lit(-i).alias("rank"), F.lit(n).alias("zone")) for i, n in enumerate(names)]),
        lambda o: o["mean"].isNotNull(),
    )
    best = F.array_max(options)
    return means.select(*by, best["zone"].alias("dominant_zone"), best["mean"].alias("dominant_mean"))


def dedupe_windows(df: DataFrame, order: list[Column]) -> DataFrame:
    return first_per(df, ["window_id"], order)

"""State sequences: run lengths, sustained flags, smoothing, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.operators.ordered import Axis, attach_row, first_per, join_same, with_group_stats, with_neighbours, with_runs


def with_run_length(df: DataFrame, axis: Axis, state: str = "state_id") -> DataFrame:
    """Length of the run of equal states each row belongs to."""
    return with_runs(df, axis, state).withColumnRenamed("run_length", "state_run_length").drop("run_position")


def with_sustained_flag(df: DataFrame, axis: Axis, level: str = "risk_level", n: int = 3) -> DataFrame:
    """True from the n-th consecutive medium or high row on."""
    marked = df.withColumn("_up", F.coalesce(F.col(level).isin("medium", "high"), F.lit(False)))
    runs = with_runs(marked, axis, "_up")
    return runs.withColumn("sustained_risk_flag", F.col("_up") & (F.col("run_position") >= n)).drop(
        "_up", "run_length", "run_position"
    )


def with_smoothed(df: DataFrame, axis: Axis, state: str = "state_id", name: str = "smoothed_state") -> DataFrame:
    """Three-point smoothing in which the left neighbour is already smoothed.

    A row is a candidate when its two neighbours agree and differ from it. A
    replaced row equals its right neighbour, so that neighbour stays as it is:
    along a run of consecutive candidates every other one, starting with the
    first, is replaced. This removes the sequential dependency.
    """
    near = with_neighbours(df, axis, before={"_l": state}, after={"_r": state})
    candidate = F.col("_has_before") & F.col("_has_after") & (F.col("_l") == F.col("_r")) & (F.col(state) != F.col("_l"))
    near = near.withColumn("_cand", F.coalesce(candidate, F.lit(False)))
    runs = with_runs(near, axis, "_cand")
    replaced = F.col("_cand") & (F.col("run_position") % 2 == 1)
    return runs.withColumn(name, F.when(replaced, F.col("_l")).otherwise(F.col(state))).drop(
        "_l", "_r", "_has_before", "_has_after", "_cand", "run_length", "run_position"
    )


def with_zscore(df: DataFrame, value: str, by: list[str], name: str = "zscore") -> DataFrame:
    """(value − mean) / population std per group; zero for a constant group."""
    stats = with_group_stats(df, by, {"_mu": F.avg(value), "_sd": F.stddev_pop(value)})
    score = F.when(F.col("_sd") == 0, F.lit(0.0)).otherwise((F.col(value) - F.col("_mu")) / F.col("_sd"))
    return stats.withColumn(name, score).drop("_mu", "_sd")


def risk_level(score: Column) -> Column:
    """Below 0.33 low, up to 0.66 medium, else high."""
    return F.when(score < 0.33, "low").when(score <= 0.66, "medium").otherwise("high")


def risk_level_binned(score: Column) -> Column:
    """Right-closed bins: 0.33 itself is low."""
    return F.when(score <= 0.33, "low").when(score <= 0.66, "medium").otherwise("high")


def primary_sequence(df: DataFrame, by: list[str]) -> DataFrame:
    """Key of the sequence with the most rows (ties by key)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), *[F.col(c).asc_nulls_last() for c in by]).limit(1)


def peak_rows(df: DataFrame, metric: str, by: list[str], order: list[str]) -> DataFrame:
    """Row with the highest metric per group; the first in ``order`` on ties."""
    return first_per(df.filter(F.col(metric).isNotNull()), by, [F.col(metric).desc(), *[F.col(c).asc_nulls_last() for c in order]])


def rank_percent(df: DataFrame, value: str, axis_block: Column, name: str = "rank_pct") -> DataFrame:
    """Lowest rank among equals over the number of values.

    Counts per distinct value are accumulated over value blocks, so no task
    sees the whole column.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", axis_block)
    blocks = counts.groupBy("_b").agg(F.sum("_c").alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_b", F.coalesce(before, F.lit(0)).alias("_base"))
    within = F.sum("_c").over(Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1))
    ranks = counts.withColumn("_in", F.coalesce(within, F.lit(0))).join(blocks, "_b").select(
        F.col(value), (F.col("_base") + F.col("_in") + 1).alias("_rank")
    )
    total = df.agg(F.count(value).alias("_size"))
    return attach_row(join_same(df, ranks, [value]), total).withColumn(name, F.col("_rank") / F.col("_size")).drop("_rank", "_size")

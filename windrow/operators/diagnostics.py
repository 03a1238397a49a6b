"""Guards and sequence diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.operators.ordered import attach_row


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key groups with more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Raise when a key occurs twice; else hand the frame through."""
    bad = duplicate_keys(df, keys).limit(1).count()
    if bad:
        raise ValueError(f"{what} must have one row per {'/'.join(k.removesuffix('_id') for k in keys)}")
    return df


def sequence_diagnostics(df: DataFrame, state: str = "state_id") -> DataFrame:
    """One row: sizes, duplicated rows, start times with several states, and overall validity."""
    start_keys = [c for c in ("room_id", "session_id", "start_time") if c in df.columns]
    def repeated(keys: list[str], name: str) -> DataFrame:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(state).alias("s"))
        return sizes.agg(
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias(f"duplicate_{name}_rows"),
            F.count(F.when(F.col("s") > 1, 1)).alias(f"multi_state_{name}_groups"),
            F.count(F.lit(1)).alias(f"unique_{name}_count"),
        )

    totals = df.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("room_id").alias("unique_room_count"),
        F.countDistinct("window_id").alias("unique_window_count"),
    )
    one = attach_row(attach_row(totals, repeated(["room_id", "window_id"], "room_window")), repeated(start_keys, "start_time"))
    return one.withColumn(
        "is_valid_temporal_sequence",
        (F.col("duplicate_room_window_rows") == 0) & (F.col("duplicate_start_time_rows") == 0) & (F.col("multi_state_start_time_groups") == 0),
    )


def sequence_summary(df: DataFrame) -> DataFrame:
    keys = [c for c in ("room_id", "session_id") if c in df.columns]
    return df.groupBy(*keys).agg(
        F.count("window_id").alias("row_count"), F.countDistinct("window_id").alias("unique_windows"),
        F.min("start_time").alias("start_time_min"), F.max("start_time").alias("start_time_max"),
    )


def require_valid_sequence(df: DataFrame, state: str = "state_id") -> None:
    """Raise when the state table is not one row per window in time."""
    verdict = sequence_diagnostics(df, state).select("is_valid_temporal_sequence").first()
    if not verdict[0]:
        raise ValueError("state table is not a valid temporal sequence")

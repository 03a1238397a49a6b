"""Daily climate readings and their attachment to windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.functions.numbers import row_mean, to_number
from windrow.functions.times import excel_date
from windrow.operators.ordered import first_per

# Sheet headings and their column names.
SHEET_COLUMNS = {
    "Date": "date",
    "Temp_AM_Min": "temp_am_min",
    "Temp_AM_Max": "temp_am_max",
    "Temp_PM": "temp_pm",
    "RH_AM": "rh_am",
    "RH_PM": "rh_pm",
}
READINGS = [c for c in SHEET_COLUMNS.values() if c != "date"]


def environment_flag(date: Column, temp: Column, rh: Column) -> Column:
    return (
        F.when(date.isNull(), "date_parse_failed")
        .when(temp.isNull() & rh.isNull(), "missing_temp_and_rh")
        .when(temp.isNull() | rh.isNull(), "partial")
        .otherwise("ok")
    )


def with_daily_means(daily: DataFrame) -> DataFrame:
    """Means that skip missing readings, the morning range and the quality flag."""
    df = daily.withColumn("temp_am_mean", row_mean("temp_am_min", "temp_am_max"))
    df = df.withColumns(
        {
            "temp_daily_mean": row_mean("temp_am_mean", "temp_pm"),
            "rh_daily_mean": row_mean("rh_am", "rh_pm"),
            "temp_daily_range": F.col("temp_am_max") - F.col("temp_am_min"),
        }
    )
    return df.withColumn("env_quality_flag", environment_flag(F.col("date"), F.col("temp_daily_mean"), F.col("rh_daily_mean")))


def normalize_climate(sheet: DataFrame, room_id: str | None = None) -> DataFrame:
    """Climate sheet as read (texts allowed) → typed daily table. Missing headings raise."""
    absent = [c for c in SHEET_COLUMNS if c not in sheet.columns]
    if absent:
        raise ValueError("climate sheet lacks columns: " + ", ".join(absent))
    keep = [F.col("room_id")] if room_id is None and "room_id" in sheet.columns else []
    if room_id is not None:
        keep = [F.lit(room_id).alias("room_id")]
    typed = sheet.select(
        *keep,
        excel_date("Date").alias("date"),
        *[to_number(c).alias(n) for c, n in SHEET_COLUMNS.items() if n != "date"],
    )
    return with_daily_means(typed)


def am_pm(hour: Column, am: Column, pm: Column, daily: Column, cutoff: int = 12) -> Column:
    """Morning reading before the cutoff hour, else the afternoon one; the daily mean fills gaps."""
    return F.coalesce(F.when(hour < cutoff, am).otherwise(pm), daily)


def attach_climate(windows: DataFrame, climate: DataFrame, by_room: bool = True, cutoff: int = 12) -> DataFrame:
    """Left join of the day's climate by local date (and room), plus the AM/PM context.

    The climate table is made unique per key first, so windows never multiply.
    """
    keys = ["room_id", "local_date"] if by_room else ["local_date"]
    wanted = ["temp_am_mean", "temp_pm", "temp_daily_mean", "rh_am", "rh_pm", "rh_daily_mean", "env_quality_flag"]
    wanted += [c for c in ("temp_daily_range",) if c in climate.columns]
    # rows on the same day are ordered by their readings, which makes the choice repeatable
    days = climate.withColumnRenamed("date", "local_date").select(*keys, *wanted)
    days = first_per(days, keys, [F.col(c).asc_nulls_last() for c in wanted])
    joined = windows.join(days, keys, "left")
    hour = F.col("local_hour")
    return joined.withColumns(
        {
            "temp_context": am_pm(hour, F.col("temp_am_mean"), F.col("temp_pm"), F.col("temp_daily_mean"), cutoff),
            "rh_context": am_pm(hour, F.col("rh_am"), F.col("rh_pm"), F.col("rh_daily_mean"), cutoff),
        }
    )


__all__ = ["SHEET_COLUMNS", "READINGS", "normalize_climate", "with_daily_means", "am_pm", "attach_climate", "environment_flag"]

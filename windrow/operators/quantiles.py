"""Exact percentiles by selection instead of by collecting a group.

Spark's exact ``percentile`` keeps every distinct value of a group in one task's memory. Here a sketch with a known
rank error (``percentile_approx``) gives two values around every wanted rank. They cut the values into a few
cells, a cut being a cell of its own, so that many equal values stay one value. Cells are counted,
and only those that hold a wanted rank are ordered: about ``4 / accuracy`` of the rows for each percentile. The
sketch decides how many rows that is, never the result: a rank that it missed lies in a neighbouring, larger cell.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.operators.ordered import join_same


def _placed(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float], accuracy: int) -> tuple[DataFrame, DataFrame]:
    """Values with their cell, and the number of values and the cuts of each group."""
    valid = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*groups, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy
    around = sorted({min(max(p + side, 0.0), 1.0) for p in probabilities.values() for side in (-margin, margin)})
    extent = valid.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", around, accuracy).alias("_cuts"))

    def above(cut: Column) -> Column:
        return (F.col("_v") >= cut).cast("int") + (F.col("_v") > cut).cast("int")

    cell = reduce(lambda a, b: a + b, [above(F.get("_cuts", F.lit(i))) for i in range(len(around))])
    return join_same(valid, extent, groups).select(*groups, "_v", cell.alias("_cell")), extent


def _wanted(placed: DataFrame, extent: DataFrame, groups: list[str], probabilities: dict[str, float]) -> DataFrame:
    """The ranks that the percentiles need, each with its cell and the number of values before the cell (``_from``)."""
    # a few rows per group from here on
    histogram = placed.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    by_cell = Window.partitionBy(*groups).orderBy("_cell")
    upto = F.sum("_c").over(by_cell.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    histogram = histogram.select(*groups, "_cell", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probabilities.items()]))
    spots = extent.select(*groups, "_n", asked.alias("_a")).select(*groups, F.col("_a.name").alias("_name"), ((F.col("_n") - 1) * F.col("_a.p")).alias("_at"))
    ranks = spots.select(*groups, "_name", "_at", F.explode(F.array_distinct(F.array(F.floor("_at"), F.ceil("_at")))).alias("_rank"))
    wanted = join_same(ranks, histogram, groups).filter((F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return wanted.select(*groups, "_cell", "_name", "_at", "_rank", "_from")


def _inside(placed: DataFrame, wanted: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct values of the cells that hold a wanted rank, with how often they occur."""
    cells = wanted.select(*groups, "_cell", "_from").distinct()
    return join_same(placed, cells, [*groups, "_cell"], "inner").groupBy(*groups, "_cell", "_from", "_v").agg(F.count(F.lit(1)).alias("_c"))


def exact_percentiles(df: DataFrame, groups: list[str], value: str, probabilities: dict[str, float], accuracy: int = 20_000) -> DataFrame:
    """Linear-interpolated percentiles, one column per name, one row per group with values.

    ``accuracy`` is that of the sketch (rank error at most ``rows / accuracy``) and sets how many rows are ordered.
    """
    if not groups:
        one = df.select(F.lit(0).alias("_all"), value)
        return exact_percentiles(one, ["_all"], value, probabilities, accuracy).drop("_all")
    placed, extent = _placed(df, groups, value, probabilities, accuracy)
    wanted = _wanted(placed, extent, groups, probabilities)
    by_value = Window.partitionBy(*groups, "_cell").orderBy("_v")
    seen = F.col("_from") + F.sum("_c").over(by_value.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inside = _inside(placed, wanted, groups).select(*groups, "_cell", "_v", (seen - F.col("_c")).alias("_a"), seen.alias("_b"))
    hits = join_same(wanted, inside, [*groups, "_cell"], "inner").filter((F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_b")))
    low = F.max(F.when(F.col("_rank") == F.floor("_at"), F.col("_v")))
    high = F.max(F.when(F.col("_rank") == F.ceil("_at"), F.col("_v")))
    share = F.max(F.col("_at") - F.floor("_at"))
    answers = hits.groupBy(*groups, "_name").agg((low + (high - low) * share).alias("_q"))
    return answers.groupBy(*groups).agg(*[F.max(F.when(F.col("_name") == n, F.col("_q"))).alias(n) for n in probabilities])


def long_values(df: DataFrame, keep: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    """Wide to long over numeric columns."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    return df.selectExpr(*[f"`{k}`" for k in keep], f"stack({len(columns)}, {pairs}) as ({name}, {value})")


def describe(df: DataFrame, columns: list[str], groups: list[str] | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (long form, one row per group and column)."""
    groups = groups or []
    long = long_values(df, groups, columns)
    keys = [*groups, "metric"]
    present = F.col("value")
    base = long.groupBy(*keys).agg(
        F.count(present).alias("count"), F.avg(present).alias("mean"), F.stddev_samp(present).alias("std"),
        F.min(present).alias("min"), F.max(present).alias("max"),
    )
    quartiles = exact_percentiles(long, keys, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    return join_same(base, quartiles, keys).select(*keys, "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def column_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (``metric``, ``median``) per column that holds any value."""
    return exact_percentiles(long_values(df, [], columns), ["metric"], "value", {"median": 0.5})

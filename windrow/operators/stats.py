"""Correlation, multiple testing, coverage and missingness."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.operators.ordered import attach_row, range_placed


def correlation(x: str, y: str) -> Column:
    """Pearson coefficient; null when a side does not vary (``corr`` raises then under ANSI mode)."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def daily_means(df: DataFrame, columns: list[str], day: str = "local_date") -> DataFrame:
    """Mean per calendar day; rows without a day are dropped."""
    return df.filter(F.col(day).isNotNull()).groupBy(day).agg(*[F.avg(c).alias(c) for c in columns])


def pair_correlations(daily: DataFrame, left: list[str], right: list[str], left_name: str = "env_feature", right_name: str = "audio_feature") -> DataFrame:
    """Pearson and Spearman per column pair over rows that have both.

    Needs three rows and two distinct values on each side, else null. Meant for
    daily tables: ranks are taken over one row per calendar day.
    """
    def side(names: list[str], tag: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names])).alias(tag)

    pairs = daily.select("*", side(left, "_l")).select("*", side(right, "_r")).select(
        F.col("_l.name").alias(left_name), F.col("_r.name").alias(right_name), F.col("_l.v").alias("x"), F.col("_r.v").alias("y")
    )
    both = pairs.filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    keys = [left_name, right_name]

    def average_rank(c: str) -> Column:
        by_value = Window.partitionBy(*keys).orderBy(c)
        ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        return F.rank().over(by_value) + (ties - 1) / 2.0

    ranked = both.withColumns({"rx": average_rank("x"), "ry": average_rank("y")})
    stats = ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), correlation("x", "y").alias("_p"), correlation("rx", "ry").alias("_s"),
        ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("_varies"),
    )
    grid = daily.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in left])).alias(left_name)).select(
        left_name, F.explode(F.array(*[F.lit(n) for n in right])).alias(right_name)
    )
    usable = (F.col("n_samples") >= 3) & F.col("_varies")
    return grid.join(stats, keys, "left").select(
        *keys, F.coalesce("n_samples", F.lit(0)).alias("n_samples"),
        F.when(usable, F.col("_p")).alias("pearson_r"), F.when(usable, F.col("_s")).alias("spearman_rho"),
    )


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation from Student's t with ``n - 2`` degrees of freedom; null below three samples.

    For whole degrees of freedom v, with ``x = 1 - r * r``, the probability within ``|r|`` is ``|r|`` times a finite sum of
    v / 2 terms (and an angle where v is odd), and the probability beyond is ``|r|`` times the terms that would follow. Each
    term comes from the one before, so both are folds over a sequence. The tail is summed itself where it is small, so that tiny p-values keep their
    digits. The cost grows with v, the number of samples (days).
    """
    size = F.abs(r.cast("double"))
    x = F.greatest(1.0 - size * size, F.lit(0.0))
    v = n.cast("int") - 2
    odd = v % 2

    def fold(first: Column, last: Column, start: Column, factor) -> Column:
        """Sum of terms: ``start``, then each times ``factor`` of its number."""
        empty = F.array().cast("array<int>")
        numbers = F.when(last >= first, F.sequence(first, last)).otherwise(empty)
        state = F.struct(start.alias("term"), start.alias("total"))
        step = lambda s, i: F.struct((s["term"] * factor(i)).alias("term"), (s["total"] + s["term"] * factor(i)).alias("total"))
        return F.aggregate(numbers, state, step, lambda s: s["total"])

    ratio = lambda i: x * (2 * i - 1 + odd) / (2 * i + odd)
    # odd: angle + sum over (v - 1) / 2 terms; even: v / 2 terms
    terms = F.floor(v / 2).cast("int")
    inner = size * fold(F.lit(1), terms - 1, F.when(odd == 1, F.sqrt(x)).otherwise(F.lit(1.0)), ratio)
    within = F.when(odd == 1, 2 / math.pi * (F.asin(F.least(size, F.lit(1.0))) + F.when(terms > 0, inner).otherwise(0.0))).otherwise(inner)
    # the term at which the inner sum stops is where the tail begins, reached in logarithms
    logs = F.aggregate(F.when(terms > 0, F.sequence(F.lit(1), terms)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + F.ln((2 * i - 1 + odd) / (2 * i + odd)))
    begin = F.exp(logs + v / 2 * F.ln(x)) * F.when(odd == 1, F.lit(2 / math.pi)).otherwise(1.0)
    more = F.least(F.ceil(40 / F.greatest(size * size, F.lit(1e-9))), F.lit(10_000_000)).cast("int")
    beyond = size * fold(F.lit(0), more, begin, lambda i: x * (v + 2 * i + 1) / (v + 2 * i + 2))
    p = F.when(x == 0.0, F.lit(0.0)).when(size * size * v >= 8.0, beyond).otherwise(F.greatest(1.0 - within, F.lit(0.0)))
    return F.when(r.isNotNull() & ~F.isnan(r.cast("double")) & (n >= 3), p)


def with_benjamini_hochberg(df: DataFrame, p: str, name: str, tie: list[str]) -> DataFrame:
    """False-discovery-rate adjusted p-values over the whole frame; missing p stays missing.

    Ranks and the running minimum from above are taken in range partitions along p; each partition carries
    the minimum of all later ones, so equal or tiny values crowd no task.
    """
    ranked = range_placed(df.filter(F.col(p).isNotNull()), [F.col(p), *[F.col(c) for c in tie]], "_rank")
    size = ranked.agg(F.max("_rank").alias("_m"))
    raw = attach_row(ranked, size).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    later = Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    carried = raw.groupBy("_part").agg(F.min("_raw").alias("_least")).select("_part", F.min("_least").over(later).alias("_least"))
    here = F.min("_raw").over(Window.partitionBy("_part").orderBy(F.desc("_rank")))
    lowest = raw.withColumn("_here", here).join(carried, "_part").withColumn("_adj", F.least("_here", "_least"))
    adjusted = lowest.withColumn(name, F.least(F.greatest(F.col("_adj"), F.lit(0.0)), F.lit(1.0))).select(*df.columns, name)
    missing = df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    return adjusted.unionByName(missing)


def with_benjamini_hochberg_small(df: DataFrame, p: str, name: str, tie: list[str]) -> DataFrame:
    """The same adjustment by one window, for tables whose size is set by configuration (feature pairs)."""
    known = F.col(p).isNotNull()
    order = [F.col(p), *[F.col(c) for c in tie]]
    mine = Window.partitionBy(known)
    raw = F.col(p) * F.count(p).over(mine) / F.row_number().over(mine.orderBy(*order))
    ranked = df.withColumn("_raw", F.when(known, raw))
    lowest = F.min("_raw").over(mine.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return ranked.withColumn(name, F.when(known, F.least(F.greatest(lowest, F.lit(0.0)), F.lit(1.0)))).drop("_raw")


def correlation_table(daily: DataFrame, left: list[str], right: list[str]) -> DataFrame:
    """The full table: coefficients, p-values and adjusted p-values."""
    table = pair_correlations(daily, left, right)
    table = table.withColumns(
        {
            "pearson_p": correlation_p_value(F.col("pearson_r"), F.col("n_samples")),
            "spearman_p": correlation_p_value(F.col("spearman_rho"), F.col("n_samples")),
        }
    )
    ids = ["env_feature", "audio_feature"]
    table = with_benjamini_hochberg_small(table, "pearson_p", "pearson_fdr_bh", ids)
    return with_benjamini_hochberg_small(table, "spearman_p", "spearman_fdr_bh", ids)


def matrix(long: DataFrame, row: str, rows: list[str], column: str, columns: list[str], value: str) -> DataFrame:
    """Long form to a matrix: ``position``, ``row`` and one column per name, with every row of ``rows`` in that order, filled or not."""
    grid = long.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(r) for r in rows])).alias("position", row))
    cells = long.filter(F.col(row).isin(*rows)).groupBy(row).agg(*[F.first(F.when(F.col(column) == c, F.col(value)), ignorenulls=True).alias(c) for c in columns])
    return grid.join(cells, row, "left").select("position", row, *columns)


def strongest_association(table: DataFrame, column: str) -> DataFrame:
    """The pair with the largest absolute coefficient."""
    return table.orderBy(F.abs(F.col(column)).desc_nulls_last(), "env_feature", "audio_feature").limit(1)


def missing_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Null count per column, long form."""
    columns = columns or df.columns
    one = df.agg(*[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in columns])
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {pairs}) as (column_name, missing)")


def coverage(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Row count and the percentage of rows meeting each condition."""
    return df.agg(F.count(F.lit(1)).alias("rows"), *[(100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("int"))).alias(n) for n, c in conditions.items()])


def token_counts(df: DataFrame, column: str, sep: str = ";") -> DataFrame:
    """Frequency of the tokens of a list held as text."""
    tokens = df.select(F.explode(F.split(F.col(column), "\\" + sep)).alias("token")).withColumn("token", F.trim("token"))
    return tokens.filter(F.col("token") != "").groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Row count per key; a missing key is a group of its own."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def session_coverage(df: DataFrame) -> DataFrame:
    return df.groupBy("room_id", "session_id").agg(
        F.min("start_time").alias("start_time_min"), F.max("end_time").alias("end_time_max"), F.count(F.lit(1)).alias("window_count")
    )


def zone_stats(df: DataFrame, value: str = "activity_mean") -> DataFrame:
    return df.groupBy("zone_id").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.max(value).alias("max")
    )


def first_warning(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """First non-blank warning text per group."""
    text = F.when(F.trim("warnings") != "", F.col("warnings"))
    return df.groupBy(*by).agg(F.min_by(text, F.when(text.isNotNull(), F.struct(*order))).alias("warnings"))


def source_summary(features: DataFrame, index: DataFrame) -> DataFrame:
    """One row: how much of the window index the features cover."""
    have = features.agg(
        F.count(F.lit(1)).alias("feature_rows"), F.countDistinct("window_id").alias("feature_windows"),
        F.countDistinct("media_id").alias("feature_media"), F.min("start_time").alias("first_start"), F.max("start_time").alias("last_start"),
    )
    known = index.agg(F.count(F.lit(1)).alias("index_rows"), F.countDistinct("window_id").alias("index_windows"))
    return attach_row(have, known).withColumn("covered_pct", 100.0 * F.try_divide(F.col("feature_windows"), F.col("index_windows")))

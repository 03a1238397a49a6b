"""Comparison measures of a state model."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.operators.ordered import attach_row
from windrow.settings import BASELINE, DURING, OUTSIDE, PHASES, RECOVERY


def model_metrics(df: DataFrame, log_likelihood_per_sample: float | None = None) -> DataFrame:
    """Long table of measures from a labelled state sequence.

    Needs ``event_phase, state_id, risk_score, state_probability_max,
    seconds_from_event_start`` and the order columns ``room_id, session_id,
    start_us, window_id``. The detection time is that of the first row in
    sequence order above baseline mean + 1 sample sd.
    """
    risk, phase = F.col("risk_score"), F.col("event_phase")

    def mean_in(p: str):
        return F.avg(F.when(phase == p, risk))

    base = df.agg(mean_in(BASELINE).alias("_bm"), F.stddev_samp(F.when(phase == BASELINE, risk)).alias("_bs"))
    marked = attach_row(df, base).withColumn("_over", risk > F.col("_bm") + F.col("_bs"))
    order = F.struct("room_id", "session_id", "start_us", "window_id")
    hit = (phase == DURING) & F.col("_over")
    one = marked.agg(
        F.first("_bm").alias("risk_mean_baseline"),
        mean_in(DURING).alias("risk_mean_during_event"),
        mean_in(RECOVERY).alias("risk_mean_recovery"),
        F.min_by(F.col("seconds_from_event_start") / 60.0, F.when(hit, order)).alias("time_to_detect_minutes"),
        F.avg(F.when((phase == OUTSIDE) & F.col("_over").isNotNull(), F.col("_over").cast("int"))).alias("false_positive_rate_outside_event_window"),
        F.avg("state_probability_max").alias("posterior_confidence_mean"),
        F.avg(F.when(phase == DURING, F.col("state_probability_max"))).alias("posterior_confidence_during_event"),
        F.countDistinct("state_id").cast("double").alias("occupied_states"),
    )
    counts = df.filter(phase.isin(*PHASES)).groupBy("event_phase", "state_id").agg(F.count(F.lit(1)).alias("n"))
    purity = counts.groupBy("event_phase").agg((F.max("n") / F.sum("n")).alias("p")).agg(F.avg("p").alias("state_purity_by_event_phase"))
    wide = attach_row(one, purity).withColumns(
        {
            "event_detection_contrast": F.col("risk_mean_during_event") - F.col("risk_mean_baseline"),
            "log_likelihood_per_sample": F.lit(log_likelihood_per_sample).cast("double"),
        }
    )
    names = [
        "event_detection_contrast", "state_purity_by_event_phase", "time_to_detect_minutes", "false_positive_rate_outside_event_window",
        "posterior_confidence_mean", "posterior_confidence_during_event", "risk_mean_baseline", "risk_mean_during_event",
        "risk_mean_recovery", "occupied_states",
    ]
    if log_likelihood_per_sample is not None:
        names.insert(4, "log_likelihood_per_sample")
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return wide.selectExpr(f"stack({len(names)}, {pairs}) as (metric_name, value)")


def compare_models(metrics: DataFrame, left: str, right: str, metric: str = "event_detection_contrast") -> DataFrame:
    """Which of two models has the larger measure: ``greater``, ``smaller``, ``equal`` or ``inconclusive`` (right against left)."""
    def value(model: str):
        return F.max(F.when((F.col("model_name") == model) & (F.col("metric_name") == metric), F.col("value")))

    both = metrics.agg(value(left).alias("left_value"), value(right).alias("right_value"))
    a, b = F.col("left_value"), F.col("right_value")
    verdict = F.when(a.isNull() | b.isNull(), "inconclusive").when(b > a, "greater").when(b < a, "smaller").otherwise("equal")
    return both.withColumn("verdict", verdict)

"""From states to labels and risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.functions import arrays
from windrow.functions.numbers import clip
from windrow.operators.ordered import Axis, attach_row
from windrow.operators.sequences import risk_level, with_run_length, with_sustained_flag
from windrow.session import cut_lineage
from windrow.settings import ModelSettings, RiskWeights


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def _flat_min_max(name: str, flat: float = 0.5) -> Column:
    """Min-max over the summary rows (one per state, so a handful); a constant column gives ``flat``."""
    everything = Window.partitionBy(F.lit(1))
    value = _zero(name)
    low, high = F.min(value).over(everything), F.max(value).over(everything)
    return F.when(low == high, F.lit(flat)).otherwise((value - low) / (high - low))


def _policy_min_max(name: str) -> Column:
    """Min-max in which a constant column gives 0 if zero, else 0.5, and a missing value 0."""
    everything = Window.partitionBy(F.lit(1))
    low, high = F.min(name).over(everything), F.max(name).over(everything)
    scaled = F.when(low.isNull(), 0.0).when(low == high, F.when(low == 0, 0.0).otherwise(0.5)).otherwise((F.col(name) - low) / (high - low))
    return clip(F.coalesce(scaled, F.lit(0.0)), 0.0, 1.0)


def state_summary(sequence: DataFrame, means: list[str]) -> DataFrame:
    """One row per state: count, share, feature means, run lengths."""
    aggs = [F.count("window_id").alias("window_count")]
    aggs += [(F.avg(c) if c in sequence.columns else F.lit(None).cast("double")).alias(f"{c}_mean") for c in means]
    if "state_run_length" in sequence.columns:
        aggs += [F.avg("state_run_length").alias("state_run_length_mean"), F.max("state_run_length").alias("state_run_length_max")]
    summary = sequence.groupBy("state_id").agg(*aggs)
    whole = F.sum("window_count").over(Window.partitionBy(F.lit(1)))
    return summary.withColumn("window_fraction", F.col("window_count") / whole)


def with_twin_risk(summary: DataFrame, weights: RiskWeights = RiskWeights()) -> DataFrame:
    """Risk components and weight of the twin model."""
    df = summary.withColumns(
        {
            "component_activity_level": clip(_zero("normalized_activity_mean"), 0.0, 1.0),
            "component_mobility_level": _flat_min_max("mobility_index_mean"),
            "component_imbalance": clip(_zero("occupancy_imbalance_index_mean"), 0.0, 1.0),
            "component_low_spatial_freedom": clip(1.0 - _zero("spatial_freedom_index_mean"), 0.0, 1.0),
            "component_resilience_pressure": _flat_min_max("resilience_pressure_index_mean"),
            "component_persistence": _flat_min_max("state_run_length_mean"),
        }
    )
    df = df.withColumn("component_activity_mobility", clip((F.col("component_activity_level") + F.col("component_mobility_level")) / 2, 0.0, 1.0))
    parts = {
        "component_activity_mobility": weights.activity_mobility, "component_imbalance": weights.imbalance,
        "component_low_spatial_freedom": weights.low_spatial_freedom, "component_resilience_pressure": weights.resilience_pressure,
        "component_persistence": weights.persistence,
    }
    return df.withColumn("state_risk_weight", clip(_weighted(parts), 0.0, 1.0))


def with_semantic_risk(summary: DataFrame) -> DataFrame:
    """Risk components and weight of the semantic-zone models."""
    df = summary.withColumns(
        {
            "component_activity": _policy_min_max("normalized_activity_mean"),
            "component_mobility": _policy_min_max("mobility_index_mean"),
            "component_imbalance": clip(_zero("occupancy_imbalance_index_mean"), 0.0, 1.0),
            "component_low_spatial": clip(1.0 - _zero("spatial_freedom_index_mean"), 0.0, 1.0),
            "component_transition": _policy_min_max("semantic_transition_proxy_mean"),
            "component_functional_shift": clip(_zero("feeding_plus_drinking_activity_fraction_mean"), 0.0, 1.0),
        }
    )
    # Published weights.
    parts = {
        "component_activity": 0.22, "component_mobility": 0.24, "component_imbalance": 0.20,
        "component_low_spatial": 0.16, "component_transition": 0.13, "component_functional_shift": 0.05,
    }
    return df.withColumn("state_risk_weight", clip(_weighted(parts), 0.0, 1.0))


def with_context_risk(summary: DataFrame) -> DataFrame:
    """Risk weight of the audio-and-climate comparison models."""
    df = summary.withColumns(
        {
            "component_activity": _flat_min_max("activity_mean_mean"),
            "component_mobility": _flat_min_max("mobility_index_mean"),
            "component_imbalance": clip(_zero("occupancy_imbalance_index_mean"), 0.0, 1.0),
            "component_low_spatial": clip(1.0 - _zero("spatial_freedom_index_mean"), 0.0, 1.0),
        }
    )
    # Published weights.
    parts = {"component_activity": 0.35, "component_mobility": 0.35, "component_imbalance": 0.20, "component_low_spatial": 0.10}
    return df.withColumn("state_risk_weight", clip(_weighted(parts), 0.0, 1.0))


def _weighted(parts: dict[str, float]) -> Column:
    terms = [F.lit(w) * F.col(c) for c, w in parts.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def twin_label() -> Column:
    """Label of a twin state. Rule order, thresholds and names."""
    activity, mobility = F.col("component_activity_level"), F.col("component_mobility_level")
    both, spatial = F.col("component_activity_mobility"), _zero("spatial_freedom_index_mean")
    narrow, imbalance = F.col("component_low_spatial_freedom"), F.col("component_imbalance")
    pressure, persistence, risk = F.col("component_resilience_pressure"), F.col("component_persistence"), F.col("state_risk_weight")
    rules = [
        ("sustained_deviation", (risk >= 0.70) & (persistence >= 0.55) & ((both >= 0.50) | (imbalance >= 0.35) | (narrow >= 0.35))),
        ("disturbance_or_transition", (both >= 0.60) & (pressure >= 0.45)),
        ("stable_low_activity", (activity <= 0.18) & (mobility <= 0.25) & (imbalance <= 0.20)),
        ("localized_low_activity_concentration", (activity <= 0.22) & (imbalance >= 0.30) & ((narrow >= 0.25) | (spatial <= 0.80))),
        ("concentrated_high_activity", (activity >= 0.45) & (imbalance >= 0.30) & (narrow >= 0.25)),
        ("normal_distributed_activity", (activity >= 0.28) & (spatial >= 0.65) & (imbalance <= 0.35)),
        ("distributed_low_activity", (activity <= 0.25) & (spatial >= 0.65)),
        ("localized_activity_shift", narrow >= 0.35),
    ]
    return _first_rule(rules, "mixed_activity_pattern")


def semantic_label() -> Column:
    """Label of a semantic-zone state. Rule order, thresholds and names."""
    activity, mobility = _zero("normalized_activity_mean"), _zero("mobility_index_mean")
    spatial, imbalance = _zero("spatial_freedom_index_mean"), _zero("occupancy_imbalance_index_mean")
    transition, functional = _zero("semantic_transition_proxy_mean"), _zero("feeding_plus_drinking_activity_fraction_mean")
    drinking, feeding, general = (_zero(f"{z}_activity_fraction_mean") for z in ("drinking", "feeding", "general"))
    risk = _zero("state_risk_weight")
    rules = [
        ("disturbance_or_transition", (risk >= 0.68) & ((mobility >= 0.45) | (transition >= 0.40))),
        ("distributed_low_activity", (activity <= 0.18) & (mobility <= 0.22) & (imbalance <= 0.22)),
        ("localized_low_activity_concentration", (activity <= 0.22) & ((imbalance >= 0.30) | (spatial <= 0.72))),
        ("drinker_concentrated_activity", (drinking >= F.greatest(feeding, general)) & (drinking >= 0.42)),
        ("feeder_concentrated_activity", (feeding >= F.greatest(drinking, general)) & (feeding >= 0.42)),
        ("functional_area_activity", (functional >= 0.60) & (activity >= 0.24)),
        ("general_area_activity", (general >= 0.55) & (activity >= 0.28)),
    ]
    return _first_rule(rules, "mixed_semantic_activity_pattern")


def _first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    chain = F.when(rules[0][1], rules[0][0])
    for name, test in rules[1:]:
        chain = chain.when(test, name)
    return chain.otherwise(otherwise)


def with_labels(summary: DataFrame, label: Column) -> DataFrame:
    """Add ``state_label``; a label used by an earlier state gets the state id as suffix."""
    base = summary.withColumn("_l", label)
    repeat = F.row_number().over(Window.partitionBy("_l").orderBy("state_id")) > 1
    suffixed = F.concat(F.col("_l"), F.lit("_"), F.col("state_id").cast("string"))
    return base.withColumn("state_label", F.when(repeat, suffixed).otherwise(F.col("_l"))).drop("_l")


def row_risk(posterior: Column, weights: Column) -> Column:
    """Posterior-weighted state risk, bounded to [0, 1]."""
    return clip(arrays.dot(posterior, weights), 0.0, 1.0)


def weight_vector(summary: DataFrame, n_states: int) -> DataFrame:
    """The state weights as one array row (zero for states that never occur)."""
    return summary.agg(
        F.array(*[F.coalesce(F.max(F.when(F.col("state_id") == i, F.col("state_risk_weight"))), F.lit(0.0)) for i in range(n_states)]).alias("_weights")
    )


def score_sequence(sequence: DataFrame, axis: Axis, n_states: int, settings: ModelSettings = ModelSettings()) -> tuple[DataFrame, DataFrame]:
    """State rows with posteriors → (scored rows, labelled state summary) by the twin rules."""
    means = ["mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "activity_mean", "normalized_activity", "resilience_pressure_index", "state_probability_max"]
    # both are read several times below: runs by the summary and twice by the sustained flag, the summary by labels and weights
    runs = cut_lineage(with_run_length(sequence, axis))
    summary = cut_lineage(with_labels(with_twin_risk(state_summary(runs, means), settings.risk), twin_label()))
    labelled = runs.join(summary.select("state_id", "state_label"), "state_id", "left")
    scored = attach_row(labelled, weight_vector(summary, n_states)).withColumns(
        {"state_label": F.coalesce("state_label", F.lit("unlabeled_state")), "welfare_risk_score": row_risk(F.col("posterior"), F.col("_weights"))}
    ).drop("_weights")
    scored = scored.withColumn("risk_level", risk_level(F.col("welfare_risk_score")))
    flagged = with_sustained_flag(scored, axis, n=settings.sustained_windows)
    return flagged.withColumn("high_risk_flag", F.col("risk_level") == "high"), summary


def with_posterior_columns(df: DataFrame, count: int) -> DataFrame:
    """``posterior_state_0 …``, zero past the fitted states."""
    return df.withColumns({f"posterior_state_{i}": arrays.padded(F.col("posterior"), i) for i in range(count)})

"""Biomarkers with sound and climate → multimodal table, correlations, event summary, model comparison."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from windrow.functions.times import with_time_columns
from windrow.models import metrics as mm, risk as rk
from windrow.models.preprocess import MULTIMODAL_FEATURES, VIDEO_FEATURES, fit_scaling, state_count, with_features
from windrow.models.states import HMM, assigned, sequence_axis, with_states
from windrow.operators import events as ev, stats
from windrow.operators.climate import attach_climate
from windrow.operators.merge import join_with_fallback
from windrow.operators.ordered import attach_row
from windrow.operators.sequences import risk_level, risk_level_binned, with_sustained_flag
from windrow.session import cut_lineage
from windrow.settings import AUDIO_FEATURES, EventSettings, ModelSettings

# Columns of the correlation table.
ENV = ("temp_context", "rh_context", "temp_daily_mean", "rh_daily_mean", "temp_daily_range")
AUDIO = AUDIO_FEATURES[:6]

# Metrics of the event summary.
EVENT_METRICS = ("activity_mean", "mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "welfare_risk_score", *AUDIO, "temp_context", "rh_context")

# Features of the semantic-zone models.
SEMANTIC_VIDEO = (
    "mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "normalized_activity", "drinking_activity_fraction",
    "feeding_activity_fraction", "general_activity_fraction", "feeding_plus_drinking_activity_fraction", "semantic_transition_proxy",
)
SEMANTIC_MULTIMODAL = (*SEMANTIC_VIDEO, *AUDIO, "temp_context", "rh_context")


def merge_context(biomarkers: DataFrame, audio: DataFrame, climate: DataFrame, events: DataFrame, settings: EventSettings = EventSettings(), blank_room: str = "none") -> DataFrame:
    """Windows with sound (by id, else by room and start), the day's climate and event labels."""
    order = [F.col("window_id").asc_nulls_last()] if "window_id" in audio.columns else [F.col("start_time").asc_nulls_last()]
    keep = ["window_id", "room_id", "start_time", *[c for c in audio.columns if c.startswith("audio_")]]
    df = join_with_fallback(biomarkers, audio.select(*keep), ["window_id"], ["room_id", "start_time"], "audio_available", order)
    if "local_date" not in df.columns:
        df = with_time_columns(df)
    df = attach_climate(df, climate, by_room=False, cutoff=settings.am_hour_cutoff)
    return ev.label_windows(df, events, settings, blank_room)


def usable(df: DataFrame) -> DataFrame:
    """Windows with sound and climate context."""
    return df.filter(F.coalesce("audio_available", F.lit(False)) & F.col("temp_context").isNotNull() & F.col("rh_context").isNotNull())


@dataclass(frozen=True)
class Comparison:
    sequences: DataFrame
    summaries: DataFrame
    metrics: DataFrame
    n_states: int


def compare_models(df: DataFrame, models: dict[str, tuple[str, ...]], settings: ModelSettings = ModelSettings(), rules: str = "context", kind: str = HMM) -> Comparison:
    """Fit one state model per feature set on the same windows and measure each.

    ``rules``: ``context`` (audio and climate comparison) or ``semantic`` (zone models).
    """
    df = cut_lineage(df)
    axis = sequence_axis(df)
    size = df.count()
    k = state_count(size, settings)
    sequences, summaries, measures = [], [], []
    for name, wanted in models.items():
        features = [c for c in wanted if c in df.columns]
        ready = with_features(df, fit_scaling(df, features, indicators=False))
        done = assigned(ready, axis, k, settings, kind)
        loglik, used = done.log_likelihood / max(size, 1), done.kind
        placed = cut_lineage(with_states(ready, done))
        means = [*dict.fromkeys((*SEMANTIC_MULTIMODAL, *MULTIMODAL_FEATURES)), "state_probability_max"]
        summary = rk.state_summary(placed, means)
        if rules == "semantic":
            summary = rk.with_labels(rk.with_semantic_risk(summary), rk.semantic_label())
        else:
            summary = rk.with_context_risk(summary)
        scored = attach_row(placed, rk.weight_vector(summary, k)).withColumn("risk_score", rk.row_risk(F.col("posterior"), F.col("_weights"))).drop("_weights")
        level = risk_level if rules == "semantic" else risk_level_binned
        scored = scored.withColumn("risk_level", level(F.col("risk_score")))
        if rules == "semantic":
            scored = with_sustained_flag(scored, axis, n=settings.sustained_windows)
        tag = {"model_name": F.lit(name), "model_type": F.lit(used)}
        sequences.append(scored.withColumns(tag))
        summaries.append(summary.withColumns(tag))
        measures.append(mm.model_metrics(scored, loglik).withColumns({**tag, "n_states": F.lit(k)}))

    def union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    return Comparison(union(sequences), union(summaries), union(measures), k)


def run(biomarkers: DataFrame, audio: DataFrame, climate: DataFrame, events: DataFrame, settings: EventSettings = EventSettings(), model: ModelSettings = ModelSettings(), with_models: bool = True) -> dict[str, DataFrame]:
    """All tables of the audio and climate run."""
    merged = cut_lineage(merge_context(biomarkers, audio, climate, events, settings))
    heard = merged.filter(F.coalesce("audio_available", F.lit(False)))
    env = [c for c in ENV if c in merged.columns]
    daily = stats.daily_means(heard, [*env, *[a for a in AUDIO if a in merged.columns]])
    metrics = [c for c in EVENT_METRICS if c in merged.columns]
    out = {
        "multimodal_window_table": merged,
        "audio_env_correlation_table": stats.correlation_table(daily, env, [a for a in AUDIO if a in merged.columns]),
        "event_multimodal_summary": ev.phase_metrics_long(merged, metrics),
    }
    if with_models:
        both = compare_models(usable(merged), {"video_only": VIDEO_FEATURES, "video_audio_env": MULTIMODAL_FEATURES}, model)
        out |= {"hmm_ablation_state_sequences": both.sequences, "hmm_ablation_metrics": both.metrics}
    return out


def run_semantic(biomarkers: DataFrame, audio: DataFrame, climate: DataFrame, events: DataFrame, settings: EventSettings = EventSettings(), model: ModelSettings = ModelSettings()) -> dict[str, DataFrame]:
    """All tables of the semantic-zone run; the second model is the primary one."""
    labelled = cut_lineage(merge_context(biomarkers, audio, climate, events, settings))
    both = compare_models(labelled, {"semantic_video_only": SEMANTIC_VIDEO, "semantic_multimodal": SEMANTIC_MULTIMODAL}, model, "semantic")
    primary = both.sequences.filter(F.col("model_name") == "semantic_multimodal")
    labels = both.summaries.filter(F.col("model_name") == "semantic_multimodal").select("state_id", "state_label")
    primary = primary.join(labels, "state_id", "left")
    names = [c for c in (*SEMANTIC_VIDEO, "risk_score") if c in primary.columns]
    summary = ev.phase_summary(primary, {f"{c}_mean": c for c in names}, {"mobility_index_max": "mobility_index", "risk_score_max": "risk_score"}, "state_label")
    return {
        "semantic_multimodal_window_table": labelled, "semantic_hmm_state_sequence": both.sequences, "semantic_hmm_state_summary": both.summaries,
        "semantic_hmm_ablation_metrics": both.metrics, "semantic_event_validation_summary": summary,
    }

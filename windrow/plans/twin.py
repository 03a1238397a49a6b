"""Zone features → biomarkers, resilience, event labels, states, validation and twin timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from windrow.functions.times import with_time_columns
from windrow.models.states import HMM, fit_states
from windrow.operators import diagnostics, events as ev
from windrow.operators.biomarkers import room_biomarkers, with_activity_proxy
from windrow.operators.merge import outer_metadata
from windrow.operators.ordered import join_same
from windrow.operators.resilience import compute_resilience, normalize_event_log
from windrow.operators.selection import cap_groups
from windrow.operators.timeline import header_rows, room_headers, twin_timeline
from windrow.session import cut_lineage
from windrow.settings import EventSettings, ModelSettings, MobilityWeights, ResilienceSettings
from windrow.sources.tables import canonical_columns


def canonical_zones(features: DataFrame, selected: DataFrame, index: DataFrame, manifest: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Zone rows with window and media metadata under canonical names, and where each column came from."""
    metadata = outer_metadata(selected, index, manifest)
    taken = set(features.columns) - {"window_id"}
    metadata = metadata.withColumnsRenamed({c: f"{c}__supplemental" for c in metadata.columns if c in taken})
    joined = features.join(metadata, "window_id", "left")
    canonical, sources = canonical_columns(joined)
    return with_time_columns(with_activity_proxy(canonical)), sources


def needs_more_windows(coverage: DataFrame, minimum: int = 30) -> bool:
    """Whether measured windows are too few for a model while the index holds more (from :func:`source_summary`)."""
    row = coverage.select("feature_windows", "index_windows").first()
    return row["feature_windows"] < minimum and row["index_windows"] > row["feature_windows"]


def event_frame(log: DataFrame, zone: str | None = None) -> DataFrame:
    """Normalised event log with instants, numbered in order."""
    named = normalize_event_log(log)
    timed = with_time_columns(named, zone)
    return timed.withColumnsRenamed({"start_us": "event_start_us", "end_us": "event_end_us"}).select(
        "event_id", "event_type", "room_id", "event_start_us", "event_end_us", "event_seq", "candidate_event_source"
    )


def run(
    zones: DataFrame,
    log: DataFrame | None,
    caps: dict[str, int | None] | None = None,
    events: EventSettings = EventSettings(),
    resilience: ResilienceSettings = ResilienceSettings(),
    model: ModelSettings = ModelSettings(),
    weights: MobilityWeights = MobilityWeights(),
    kind: str = HMM,
    exports: dict | None = None,
    layout: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """All tables of the run. The labelled window table is materialised once, because every later step reads it.

    ``exports`` receives what is not a table: the ``model`` description and the ``header`` of the timeline, with
    the rooms and (from ``layout``: ``zone_id, row, col``) their zones.
    """
    caps = caps or {}
    windows = room_biomarkers(zones, weights)
    windows = cap_groups(
        windows, [(["room_id", "session_id"], caps.get("per_session")), (["room_id"], caps.get("per_room")), ([], caps.get("total"))],
        ["room_id", "start_us", "window_id"],
    )
    windows = cut_lineage(windows.drop("distribution"))
    diagnostics.require_unique(windows, ["room_id", "window_id"], "window biomarker table")
    parsed = event_frame(log) if log is not None else None
    annotated, event_table = compute_resilience(windows, parsed, resilience)
    annotated = annotated.withColumnsRenamed({c: f"resilience_{c}" for c in ("event_id", "event_type", "event_phase", "candidate_event_source")})
    if parsed is not None:
        labelled = ev.label_windows(annotated, parsed, events)
    else:
        labelled = annotated.withColumns(
            {
                **{c: F.lit(None).cast("string") for c in ("event_id", "event_type")}, "event_phase": F.lit("outside_event_window"),
                **{c: F.lit(None).cast("double") for c in ("seconds_from_event_start", "seconds_from_event_end")},
                "event_overlap_seconds": F.lit(0.0), "overlaps_event": F.lit(False),
            }
        )
    labelled = cut_lineage(labelled)
    states = fit_states(labelled, model, kind=kind)
    sequence = cut_lineage(states.sequence)
    diagnostics.require_valid_sequence(sequence)
    score = ["window_id", "room_id", "state_id", "state_label", "state_probability_max", "welfare_risk_score", "risk_level", "sustained_risk_flag"]
    if exports is not None:
        cells = zones.select("zone_id").distinct().withColumns({"row": F.lit(0), "col": F.lit(0)}) if layout is None else layout
        exports["model"] = states.description()
        exports["header"] = {
            "metadata": {"title": "window twin timeline", "model_type": states.model_type, "n_states": states.n_states},
            "rooms": header_rows(room_headers(labelled, cells), "room_id"),
        }
    merged = join_same(labelled, sequence.select(*score), ["window_id", "room_id"])
    # Output names of the phase measures.
    means = {
        "activity_mean_mean": "activity_mean", "mobility_index_mean": "mobility_index", "spatial_freedom_index_mean": "spatial_freedom_index",
        "occupancy_imbalance_index_mean": "occupancy_imbalance_index", "risk_score_mean": "welfare_risk_score",
    }
    maxes = {"activity_mean_max": "activity_mean", "mobility_index_max": "mobility_index", "risk_score_max": "welfare_risk_score"}
    return {
        "biomarker_window_table": labelled,
        "resilience_event_table": event_table,
        "hmm_state_sequence": sequence,
        "hmm_state_summary": states.summary,
        "event_validation_summary": ev.phase_summary(merged, means, maxes, "state_label"),
        "hmm_diagnostics": diagnostics.sequence_diagnostics(sequence),
        "timeline": twin_timeline(zones, labelled, sequence),
    }

"""Run settings with the published default values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Event phases, in report order.
BASELINE = "pre_entry_baseline"
DURING = "during_entry"
RECOVERY = "post_entry_recovery"
OUTSIDE = "outside_event_window"
PHASES = (BASELINE, DURING, RECOVERY)

# The three semantic zones, in vector order.
SEMANTIC_ZONES = ("drinking_zone", "feeding_zone", "general_zone")

# The seven audio frame features.
AUDIO_FEATURES = (
    "audio_rms",
    "audio_short_time_energy",
    "audio_zero_crossing_rate",
    "audio_spectral_centroid",
    "audio_spectral_bandwidth",
    "audio_spectral_rolloff",
    "audio_spectral_flatness",
)

MICROS = 1_000_000


@dataclass(frozen=True)
class WindowSettings:
    window_seconds: int = 30
    stride_seconds: int = 10


@dataclass(frozen=True)
class EventSettings:
    baseline_minutes: int = 10
    recovery_minutes: int = 20
    min_overlap_seconds: float = 1.0
    am_hour_cutoff: int = 12


@dataclass(frozen=True)
class ResilienceSettings:
    peak_zscore: float = 1.0
    max_events_per_room: int = 3
    baseline_windows: int = 2
    max_recovery_windows: int = 6
    recovery_fraction: float = 0.2


@dataclass(frozen=True)
class RiskWeights:
    activity_mobility: float = 0.30
    imbalance: float = 0.25
    low_spatial_freedom: float = 0.20
    resilience_pressure: float = 0.15
    persistence: float = 0.10


@dataclass(frozen=True)
class ModelSettings:
    n_states: int | str = "auto"
    max_states: int = 4
    min_windows: int = 30
    max_iterations: int = 250
    tolerance: float = 1e-2
    seed: int = 42
    missing_indicators: bool = True
    sustained_windows: int = 3
    risk: RiskWeights = field(default_factory=RiskWeights)


@dataclass(frozen=True)
class MobilityWeights:
    activity: float = 0.7
    transition: float = 0.3

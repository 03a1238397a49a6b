"""Model input: feature choice, median imputation, standardisation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from windrow.operators.quantiles import column_medians
from windrow.settings import ModelSettings

# Candidate features of the published models.
TWIN_FEATURES = ("mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "normalized_activity")
PRESSURE = "resilience_pressure_index"
VIDEO_FEATURES = ("mobility_index", "spatial_freedom_index", "occupancy_imbalance_index", "activity_mean")
MULTIMODAL_FEATURES = VIDEO_FEATURES + (
    "audio_rms", "audio_short_time_energy", "audio_zero_crossing_rate", "audio_spectral_centroid",
    "audio_spectral_bandwidth", "audio_spectral_rolloff", "temp_context", "rh_context",
)


def twin_features(df: DataFrame) -> list[str]:
    """The four biomarkers present, plus the pressure index when it holds any value."""
    names = [c for c in TWIN_FEATURES if c in df.columns]
    if PRESSURE in df.columns and df.filter(F.col(PRESSURE).isNotNull()).limit(1).count():
        names.append(PRESSURE)
    if not names:
        raise ValueError("no model features available")
    return names


def state_count(n_windows: int, settings: ModelSettings = ModelSettings()) -> int:
    """Number of states for a number of windows."""
    if n_windows <= 1:
        return 1
    if settings.n_states == "auto":
        wanted = 2 if n_windows < 12 else 3 if n_windows < settings.min_windows else settings.max_states
        return min(wanted, n_windows)
    return max(1, min(int(settings.n_states), n_windows, settings.max_states))


@dataclass(frozen=True)
class Scaling:
    """Per-feature median, mean and population deviation; features without any value are left out."""

    names: tuple[str, ...]
    medians: tuple[float, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    indicators: bool

    def vector(self) -> Column:
        parts = []
        for n, median, mean, deviation in zip(self.names, self.medians, self.means, self.deviations):
            if n.endswith("__missing"):
                value = F.col(n.removesuffix("__missing")).isNull().cast("double")
            else:
                value = F.coalesce(F.col(n).cast("double"), F.lit(median))
            parts.append((value - F.lit(mean)) / F.lit(deviation if deviation > 0 else 1.0))
        return F.array(*parts)


def fit_scaling(df: DataFrame, features: list[str], indicators: bool = True) -> Scaling:
    """Two aggregates over the data; only a few numbers per feature reach the driver."""
    medians = {r["metric"]: r["median"] for r in column_medians(df, features).collect()}
    used = [f for f in features if f in medians]
    names = used + ([f"{f}__missing" for f in features] if indicators else [])

    def value(n: str) -> Column:
        if n.endswith("__missing"):
            return F.col(n.removesuffix("__missing")).isNull().cast("double")
        return F.coalesce(F.col(n).cast("double"), F.lit(medians[n]))

    row = df.agg(
        *[F.avg(value(n)).alias(f"m{i}") for i, n in enumerate(names)], *[F.stddev_pop(value(n)).alias(f"s{i}") for i, n in enumerate(names)]
    ).first()
    return Scaling(
        tuple(names), tuple(float(medians.get(n, 0.0)) for n in names),
        tuple(float(row[f"m{i}"]) for i in range(len(names))), tuple(float(row[f"s{i}"]) for i in range(len(names))), indicators,
    )


def with_features(df: DataFrame, scaling: Scaling, name: str = "features") -> DataFrame:
    return df.withColumn(name, scaling.vector())

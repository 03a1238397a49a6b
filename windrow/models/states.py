"""The state model end to end: features → states → labels and risk."""

from __future__ import annotations

import logging
from dataclasses import asdict, dataclass
from math import isfinite

from pyspark.sql import DataFrame

from windrow.models.gmm import assign, fit_gmm, smoothed_one_hot, with_assigned
from windrow.models.hmm import decode, fit_hmm
from windrow.models.preprocess import Scaling, fit_scaling, state_count, twin_features, with_features
from windrow.models.risk import score_sequence, with_posterior_columns
from windrow.operators.ordered import Axis, time_axis
from windrow.session import cut_lineage
from windrow.settings import ModelSettings

log = logging.getLogger(__name__)

HMM, GMM = "gaussian_hmm", "fallback_gmm_state_model"


@dataclass(frozen=True)
class StateResult:
    sequence: DataFrame
    summary: DataFrame
    model_type: str
    n_states: int
    scaling: Scaling
    model: object
    note: str = ""

    def description(self) -> dict:
        """What is needed to apply the model again: kind, scaling and parameters."""
        return {"model_type": self.model_type, "n_states": self.n_states, "note": self.note, "scaling": asdict(self.scaling), "parameters": self.model.to_dict()}


def sequence_axis(df: DataFrame) -> Axis:
    """A sequence is a room, or a room and session where sessions are known."""
    return time_axis(tuple(c for c in ("room_id", "session_id") if c in df.columns))


@dataclass(frozen=True)
class Assigned:
    """States and posteriors of the rows, the model that gave them, and why it was not the sequence model."""

    kind: str
    model: object
    states: DataFrame
    log_likelihood: float
    note: str = ""


def assigned(ready: DataFrame, axis: Axis, k: int, settings: ModelSettings = ModelSettings(), kind: str = HMM, row_id: str = "window_id") -> Assigned:
    """Fit the model of ``kind`` to ``features``. Whatever ends the fit of the sequence model, the mixture takes over.

    ``log_likelihood`` is the total over the rows.
    """
    note = ""
    if kind == HMM:
        try:
            model, packed = fit_hmm(ready, axis, row_id, k, settings)
            if not isfinite(model.log_likelihood):
                raise ArithmeticError(f"log-likelihood {model.log_likelihood}")
            # decoding is part of the fit: a model that cannot decode its own rows is none
            return Assigned(HMM, model, cut_lineage(decode(packed, model, row_id)), model.log_likelihood)
        except Exception as error:  # noqa: BLE001
            note = f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"[:300]
            log.warning("sequence model failed, mixture used: %s", note)
    mixture = fit_gmm(ready, k, settings)
    return Assigned(GMM, mixture, assign(ready, mixture, row_id), mixture.mean_log_likelihood * ready.count(), note)


def with_states(ready: DataFrame, done: Assigned, row_id: str = "window_id") -> DataFrame:
    """The rows with their states. The mixture judges a row by itself, so its states need no join."""
    rows = [row_id, *[c for c in ready.columns if c not in (row_id, "features")]]
    if done.kind == GMM:
        return with_assigned(ready, done.model).select(*rows, "state_id", "posterior", "state_probability_max")
    return ready.select(*rows).join(done.states, row_id)


def fit_states(df: DataFrame, settings: ModelSettings = ModelSettings(), features: list[str] | None = None, kind: str = HMM, n_windows: int | None = None) -> StateResult:
    """Fit, decode, label and score. ``kind`` chooses the sequence model or the mixture, which also stands in when the former fails."""
    # read many times below: medians, scaling, starting centres, every iteration
    df = cut_lineage(df)
    names = features or twin_features(df)
    axis = sequence_axis(df)
    scaling = fit_scaling(df, names, settings.missing_indicators)
    k = state_count(df.count() if n_windows is None else n_windows, settings)
    ready = with_features(df, scaling)
    done = assigned(ready, axis, k, settings, kind)
    sequence = with_states(ready, done)
    if done.kind == GMM:
        sequence = smoothed_one_hot(cut_lineage(sequence), axis, k)
    scored, summary = score_sequence(cut_lineage(sequence), axis, k, settings)
    return StateResult(with_posterior_columns(scored, max(settings.max_states, k)).drop("posterior"), summary, done.kind, k, scaling, done.model, done.note)


__all__ = ["HMM", "GMM", "Assigned", "StateResult", "assigned", "fit_states", "sequence_axis", "with_states"]

"""Gaussian mixture with diagonal covariance: the model used when no sequence model can be fitted."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windrow.functions.arrays import one_hot
from windrow.models.hmm import initial_model, log_density
from windrow.operators.ordered import Axis
from windrow.operators.sequences import with_smoothed
from windrow.session import cut_lineage, spread
from windrow.settings import ModelSettings

# Published defaults of the mixture.
REGULARISER = 1e-6
TOLERANCE = 1e-3
MAX_ITERATIONS = 100


@dataclass(frozen=True)
class DiagonalMixture:
    weights: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    mean_log_likelihood: float
    iterations: int
    history: tuple[float, ...] = ()

    def to_dict(self) -> dict:
        return {"weights": self.weights.tolist(), "means": self.means.tolist(), "variances": self.variances.tolist(), "mean_log_likelihood": self.mean_log_likelihood, "iterations": self.iterations}

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        return log_density(x, self.means, self.variances) + np.log(self.weights + 1e-300)


def _responsibility(model: DiagonalMixture, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    joint = model.log_joint(x).T  # arrays that are long in the rows
    top = joint.max(axis=0)
    total = top + np.log(np.exp(joint - top).sum(axis=0))
    return np.exp(joint - total).T, total


def row_blocks(df: DataFrame, features: str = "features") -> DataFrame:
    """The vectors of an Arrow batch as one row of bytes, feature after feature (``x``), with their number (``n``).

    A fit reads its rows once per iteration; as bytes they reach numpy without a Python step per row.
    """
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                columns = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, -1).T
                yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([columns.tobytes()], pa.binary())], ["n", "x"])

    return df.select(F.col(features)).mapInArrow(run, "n bigint, x binary")


def _sums(model: DiagonalMixture, hard: bool):
    """Per task: summed responsibilities and moments. ``hard`` assigns each row to its nearest centre."""
    def run(batches):
        k, d = model.means.shape
        weight, m1, m2, loglik, rows = np.zeros(k), np.zeros((k, d)), np.zeros((k, d)), 0.0, 0
        for batch in batches:
            for block in batch.column("x"):
                x = np.frombuffer(block.as_buffer()).reshape(d, -1).T
                if hard:
                    nearest = ((x[:, None, :] - model.means[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
                    r, total = np.eye(k)[nearest], np.zeros(len(x))
                else:
                    r, total = _responsibility(model, x)
                weight += r.sum(axis=0)
                m1 += r.T @ x
                m2 += r.T @ (x * x)
                loglik += total.sum()
                rows += len(x)
        if rows:
            flat = np.concatenate([weight, m1.ravel(), m2.ravel(), [loglik, rows]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    return run


def stepped(blocks: DataFrame, model: DiagonalMixture, hard: bool = False) -> DiagonalMixture:
    """The mixture after one step over ``row_blocks``, with the mean log-likelihood before it. ``hard`` assigns rows to the nearest mean."""
    k, d = model.means.shape
    sums = blocks.mapInArrow(_sums(model, hard), "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(sums))
    for row in sums:
        flat[row["i"]] = row["v"]
    weight, m1, m2 = flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d : k + 2 * k * d].reshape(k, d)
    filled = (weight + 1e-15)[:, None]
    means = np.where(weight[:, None] > 0, m1 / filled, model.means)
    variances = np.maximum(m2 / filled - means * means, 0.0) + REGULARISER
    mean_ll = float("-inf") if hard else float(flat[-2] / flat[-1])
    return DiagonalMixture(weight / weight.sum(), means, variances, mean_ll, model.iterations + (not hard), model.history)


def fit_gmm(df: DataFrame, k: int, settings: ModelSettings = ModelSettings(), features: str = "features", max_iterations: int = MAX_ITERATIONS) -> DiagonalMixture:
    data = cut_lineage(spread(df.select(F.col(features).alias("features"))))
    start = initial_model(data, k, "features", settings.seed)
    blocks = cut_lineage(spread(row_blocks(data), rows=data.count()))
    model = stepped(blocks, DiagonalMixture(np.full(k, 1.0 / k), start.means, start.variances, float("-inf"), 0), hard=True)
    previous = float("-inf")
    for step in range(1, max_iterations + 1):
        model = stepped(blocks, model)
        model = replace(model, history=(*model.history, model.mean_log_likelihood))
        if step > 1 and abs(model.mean_log_likelihood - previous) < TOLERANCE:
            break
        previous = model.mean_log_likelihood
    return model


def with_assigned(df: DataFrame, model: DiagonalMixture, features: str = "features") -> DataFrame:
    """Component posteriors and the most likely component of each row, as columns: no join brings them back to the rows."""
    joint = []
    for weight, means, variances in zip(model.weights, model.means, model.variances):
        gaps = [F.col(features)[i] - F.lit(float(m)) for i, m in enumerate(means)]
        distance = reduce(lambda a, b: a + b, [g * g / F.lit(float(v)) for g, v in zip(gaps, variances)])
        joint.append((distance + F.lit(float(np.log(2 * np.pi * variances).sum()))) * -0.5 + F.lit(float(np.log(weight + 1e-300))))
    rows = df.withColumn("_joint", F.array(*joint)).withColumn("_top", F.array_max("_joint"))
    total = F.col("_top") + F.ln(F.aggregate("_joint", F.lit(0.0), lambda a, j: a + F.exp(j - F.col("_top"))))
    rows = rows.withColumn("_total", total).withColumn("posterior", F.transform("_joint", lambda j: F.exp(j - F.col("_total"))))
    most = F.array_max("posterior")
    return rows.withColumns({"state_id": (F.array_position("posterior", most) - 1).cast("int"), "state_probability_max": most}).drop("_joint", "_top", "_total")


def assign(df: DataFrame, model: DiagonalMixture, row_id: str, features: str = "features") -> DataFrame:
    """``row_id`` with the component posteriors and the most likely component."""
    return with_assigned(df, model, features).select(row_id, "state_id", "posterior", "state_probability_max")


def smoothed_one_hot(df: DataFrame, axis: Axis, k: int) -> DataFrame:
    """Smooth the component path and replace posteriors by certainty."""
    smooth = with_smoothed(df, axis, "state_id", "_s")
    return smooth.withColumns(
        {"state_id": F.col("_s"), "posterior": one_hot(F.col("_s"), k), "state_probability_max": F.lit(1.0)}
    ).drop("_s")

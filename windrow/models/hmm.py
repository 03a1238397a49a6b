"""Gaussian hidden Markov model with diagonal covariance, fitted over long sequences.

A sequence is cut into chunks of at most ``chunk_rows`` consecutive windows. A
chunk acts on the state vector as one k×k matrix, so a pass over a sequence is

1. per chunk: the product of its step matrices (parallel over all chunks),
2. per sequence: a scan over those small matrices, which gives every chunk the
   message entering it and the one coming back from its end,
3. per chunk: the ordinary recursion with known ends (parallel again).

The result is the same as one pass over the whole sequence, but no task holds
more than one chunk of rows, or one k×k matrix per chunk of a sequence.
Expectation steps end in sums of fixed size; only those reach the driver.
Decoding works alike with (max, +) in place of (+, ×).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from windrow.models.lockstep import Lockstep, by_step, slabs
from windrow.operators.ordered import Axis, with_position
from windrow.session import cut_lineage, spread
from windrow.settings import ModelSettings

# Variance prior and floor of the published model's defaults.
VARIANCE_PRIOR = 1e-2
VARIANCE_FLOOR = 1e-3

_SCAN = "_seq string, _chunk bigint, entry array<double>, exit array<double>, first_state int, last_state int"


def log_density(x: np.ndarray, means: np.ndarray, variances: np.ndarray) -> np.ndarray:
    """Log density of rows under each state, (rows, states), a feature at a time on arrays that are long in the rows."""
    total = np.tile(np.log(2 * np.pi * variances).sum(axis=1)[:, None], len(x))
    for column, mean, variance in zip(x.T, means.T, variances.T):
        gap = column - mean[:, None]
        gap *= gap
        gap /= variance[:, None]
        total += gap
    total *= -0.5
    return total.T


@dataclass(frozen=True)
class GaussianHmm:
    start: np.ndarray
    transition: np.ndarray
    means: np.ndarray
    variances: np.ndarray
    log_likelihood: float = float("-inf")
    iterations: int = 0
    history: tuple[float, ...] = ()

    @property
    def n_states(self) -> int:
        return len(self.start)

    def log_emission(self, x: np.ndarray) -> np.ndarray:
        return log_density(x, self.means, self.variances)

    def to_dict(self) -> dict:
        return {
            "start": self.start.tolist(), "transition": self.transition.tolist(), "means": self.means.tolist(),
            "variances": self.variances.tolist(), "log_likelihood": self.log_likelihood, "iterations": self.iterations,
        }


def pack_sequences(df: DataFrame, axis: Axis, row_id: str, features: str = "features", chunk_rows: int = 2_048) -> DataFrame:
    """One row per chunk: sequence text, chunk number, row ids and the flattened feature matrix in order."""
    placed = with_position(df, axis, "_pos")
    seq = F.concat_ws("\u0001", *[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in axis.keys]) if axis.keys else F.lit("")
    cut = placed.select(
        seq.alias("_seq"), F.floor((F.col("_pos") - 1) / chunk_rows).alias("_chunk"), "_pos", F.col(row_id).alias("_id"), F.col(features).alias("_x")
    )
    rows = F.array_sort(F.collect_list(F.struct("_pos", "_id", "_x")))
    packed = cut.groupBy("_seq", "_chunk").agg(rows.alias("_r")).select(
        "_seq", "_chunk", F.transform("_r", lambda r: r["_id"]).alias("ids"), F.flatten(F.transform("_r", lambda r: r["_x"])).alias("x")
    )
    sizes = cut.groupBy("_seq").agg((F.max("_chunk") + 1).alias("_chunks"))
    return packed.join(sizes, "_seq")


def _matrix(values, d: int) -> np.ndarray:
    return np.asarray(values, dtype=float).reshape(-1, d)


def _laid(model: GaussianHmm, pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, Lockstep]]:
    """The chunks of a batch in slabs, each with its rows of the batch in the order of the slab."""
    d = model.means.shape[1]
    sizes = pdf["x"].map(len).to_numpy() // d
    for part in slabs(sizes):
        rows = pdf.iloc[part]
        yield rows, Lockstep(model, [_matrix(x, d) for x in rows["x"]], (rows["_chunk"] == 0).to_numpy())


def _summaries(model: GaussianHmm, decode: bool):
    def run(batches):
        for pdf in batches:
            for rows, step in _laid(model, pdf):
                matrices = step.products().reshape(len(rows), -1)
                best = step.best().reshape(len(rows), -1) if decode else np.zeros((len(rows), 0))
                yield pd.DataFrame({"_seq": rows["_seq"], "_chunk": rows["_chunk"], "matrix": list(matrices), "best": list(best)})

    return run


def _scan_sequences(model: GaussianHmm, decode: bool):
    """The scan of many sequences at once, one step per chunk of the longest of a slab."""
    k = model.n_states

    def run(batches):
        for pdf in batches:
            sizes = pdf["chunks"].map(len).to_numpy()
            for part in slabs(sizes):
                yield scanned(pdf.iloc[part], sizes[part])

    def scanned(rows: pd.DataFrame, sizes: np.ndarray) -> pd.DataFrame:
        count, steps = len(rows), int(sizes.max())
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")
        seq = np.repeat(np.arange(count), sizes)
        at = (np.arange(len(seq)) - np.repeat(np.cumsum(sizes) - sizes, sizes), seq)

        def laid(name: str) -> np.ndarray:
            out = np.zeros((steps, count, k, k))
            out[at] = np.concatenate(rows[name].to_list()).reshape(-1, k, k)
            return out

        matrices = laid("matrix")
        entry, end = np.ones((steps, count, k)), np.ones((steps, count, k))
        message, back = np.tile(np.asarray(model.start, float), (count, 1)), np.ones((count, k))
        for t, n in enumerate(active):
            entry[t, :n] = message[:n]
            moved = np.einsum("ni,nij->nj", message[:n], matrices[t, :n])
            message[:n] = moved / moved.sum(axis=1, keepdims=True)
        for t in range(steps - 1, -1, -1):
            n = active[t]
            end[t, :n] = back[:n]
            moved = np.einsum("nij,nj->ni", matrices[t, :n], back[:n])
            back[:n] = moved / moved.sum(axis=1, keepdims=True)
        before, after = np.full((steps, count), -1), np.full((steps, count), -1)
        if decode:
            best, scores = laid("best"), np.zeros((steps, count, k))
            score = np.tile(np.log(model.start + 1e-300), (count, 1))
            for t, n in enumerate(active):
                scores[t, :n] = score[:n]
                score[:n] = (score[:n, :, None] + best[t, :n]).max(axis=1)
            state = score.argmax(axis=1)
            for t in range(steps - 1, -1, -1):
                n = active[t]
                after[t, :n] = state[:n]
                state[:n] = (scores[t, :n] + best[t][np.arange(n), :, state[:n]]).argmax(axis=1)
                before[t, :n] = state[:n] if t else -1
        return pd.DataFrame(
            {
                "_seq": rows["_seq"].to_numpy()[seq], "_chunk": np.concatenate(rows["chunks"].to_list()), "entry": list(entry[at]), "exit": list(end[at]),
                "first_state": before[at], "last_state": after[at],
            }
        )

    return run


def _ends(model: GaussianHmm, rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Messages at both ends of chunks; a sequence of one chunk starts and ends by itself."""
    k = model.n_states
    entry = [model.start if e is None else e for e in rows["entry"]]
    end = [np.ones(k) if e is None else e for e in rows["exit"]]
    return np.array(entry, dtype=float).reshape(-1, k), np.array(end, dtype=float).reshape(-1, k)


def _statistics(model: GaussianHmm, steps):
    """Per task: one row of summed statistics. ``steps`` gives the slabs of the batches with the messages at their ends."""
    def run(batches):
        flat, seen = 0.0, False
        for step, entry, end in steps(batches):
            gamma, pairs, loglik = step.summed(entry, end)
            start = gamma[:, : len(step.first)][:, step.first].sum(axis=1)
            parts = [start, pairs, gamma.sum(axis=1), gamma @ step.rows, gamma @ (step.rows * step.rows), [loglik.sum()]]
            flat = flat + np.concatenate([np.ravel(p) for p in parts])
            seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["i", "v"])

    return run


def _long_steps(model: GaussianHmm):
    def steps(batches):
        for batch in batches:
            for rows, step in _laid(model, batch.to_pandas()):
                yield step, *_ends(model, rows)

    return steps


def _block_steps(model: GaussianHmm):
    k, d = model.means.shape

    def steps(batches):
        for batch in batches:
            for sizes, x in zip(batch.column("sizes"), batch.column("x")):
                sizes = np.frombuffer(sizes.as_buffer(), np.int32)
                rows = np.frombuffer(x.as_buffer()).reshape(d, -1).T
                yield Lockstep(model, rows, np.ones(len(sizes), bool), sizes), np.tile(model.start, (len(sizes), 1)), np.ones((len(sizes), k))

    return steps


def _gathered(lists: pa.ListArray, d: int):
    """Slabs of the sequences of an Arrow column: sizes, longest first, the places of their rows in the column, and the rows by step."""
    sizes = np.diff(lists.offsets.to_numpy()) // d
    x, begins = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, d), np.cumsum(sizes) - sizes
    for part in slabs(sizes):
        own = sizes[part]
        rows = np.repeat(begins[part] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield own, rows, x[rows[by_step(own)]]


def whole_blocks(packed: DataFrame, d: int) -> DataFrame:
    """Sequences of one chunk, many to a row: their ``sizes`` and, feature after feature, their rows by step, as bytes.

    A fit reads its rows once per iteration; as bytes they reach numpy without a Python step per sequence.
    """
    def run(batches):
        for batch in batches:
            for own, _, x in _gathered(batch.column(0), d):
                yield pa.RecordBatch.from_arrays([pa.array([own.astype(np.int32).tobytes()], pa.binary()), pa.array([x.T.tobytes()], pa.binary())], ["sizes", "x"])

    return packed.filter("_chunks = 1").select("x").mapInArrow(run, "sizes binary, x binary")


def _decoded(model: GaussianHmm):
    def run(batches):
        for pdf in batches:
            for rows, step in _laid(model, pdf):
                gamma = step.smoothed(*_ends(model, rows))[0]
                path = step.paths(rows["first_state"].to_numpy(), rows["last_state"].to_numpy())
                yield pd.DataFrame({"_id": np.concatenate(rows["ids"].to_list()), "state_id": path, "posterior": list(gamma)})

    return run


def _decoded_alone(model: GaussianHmm):
    """States of sequences of one chunk, from the buffers of a batch without a Python step per sequence."""
    k, d = model.means.shape

    def run(batches):
        for batch in batches:
            ids = batch.column("ids").flatten()
            for own, rows, x in _gathered(batch.column("x"), d):
                step = Lockstep(model, x, np.ones(len(own), bool), own)
                gamma = step.smoothed(np.tile(model.start, (len(own), 1)), np.ones((len(own), k)))[0]
                unknown = np.full(len(own), -1)
                path = step.paths(unknown, unknown)
                posterior = pa.ListArray.from_arrays(np.arange(0, gamma.size + 1, k, dtype=np.int32), pa.array(gamma.ravel()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows)), pa.array(path.astype(np.int32)), posterior], ["_id", "state_id", "posterior"])

    return run


def _with_scanned(long: DataFrame, model: GaussianHmm, decode: bool) -> DataFrame:
    """Chunks of sequences of several chunks with the messages at their ends."""
    small = long.select("_seq", "_chunk", "x").mapInPandas(
        _summaries(model, decode), "_seq string, _chunk bigint, matrix array<double>, best array<double>"
    )
    # small matrices of whole sequences as rows, so that Python is called for a batch of sequences and not for each
    rows = F.array_sort(F.collect_list(F.struct("_chunk", "matrix", "best")))
    sequences = small.groupBy("_seq").agg(rows.alias("_r")).select(
        "_seq", F.transform("_r", lambda r: r["_chunk"]).alias("chunks"), *[F.flatten(F.transform("_r", lambda r: r[c])).alias(c) for c in ("matrix", "best")]
    )
    return long.join(sequences.mapInPandas(_scan_sequences(model, decode), _SCAN), ["_seq", "_chunk"])


def _any_long(packed: DataFrame) -> bool:
    return packed.filter("_chunks > 1").limit(1).count() > 0


def initial_model(df: DataFrame, k: int, features: str, seed: int, centre_steps: int = 300) -> GaussianHmm:
    """Uniform start and transitions, k-means centres (to convergence, or ``centre_steps``), overall variances."""
    vectors = df.select(array_to_vector(features).alias("features"))
    d = len(df.select(features).first()[0])
    spread = df.agg(*[F.var_pop(F.col(features)[i]).alias(f"v{i}") for i in range(d)]).first()
    centres = np.array(KMeans(k=k, seed=seed, maxIter=centre_steps).fit(vectors).clusterCenters(), dtype=float)
    # fewer distinct points than states: spread copies a little so that states can part
    while len(centres) < k:
        centres = np.vstack([centres, centres[len(centres) % max(len(centres), 1)] + 1e-3 * (len(centres) + 1)])
    centres = centres[np.lexsort(centres.T[::-1])]
    variances = np.tile(np.array([float(v or 0.0) for v in spread]) + VARIANCE_FLOOR, (k, 1))
    return GaussianHmm(np.full(k, 1.0 / k), np.full((k, k), 1.0 / k), centres, variances)


def maximise(model: GaussianHmm, flat: np.ndarray) -> GaussianHmm:
    """New parameters from summed statistics."""
    k, d = model.means.shape
    cuts = np.cumsum([k, k * k, k, k * d, k * d])
    start, pairs, weight, m1, m2 = np.split(flat[:-1], cuts[:-1])
    pairs, m1, m2 = pairs.reshape(k, k), m1.reshape(k, d), m2.reshape(k, d)
    filled = np.maximum(weight, 1e-10)[:, None]
    means = np.where(weight[:, None] > 1e-10, m1 / filled, model.means)
    scatter = np.maximum(m2 - 2 * means * m1 + means * means * weight[:, None], 0.0)
    rows = pairs.sum(axis=1, keepdims=True)
    transition = np.where(rows > 0, pairs / np.where(rows > 0, rows, 1.0), model.transition)
    return replace(model, start=start / start.sum(), transition=transition, means=means, variances=(VARIANCE_PRIOR + scatter) / filled)


def expected(whole: DataFrame, long: DataFrame | None, model: GaussianHmm) -> np.ndarray:
    """Summed statistics of one expectation step, in the order that ``maximise`` reads; the last is the log-likelihood.

    ``whole`` are the ``whole_blocks``, ``long`` the chunks of sequences of several chunks, if any.
    """
    kind = "i int, v double"
    parts = whole.mapInArrow(_statistics(model, _block_steps(model)), kind)
    if long is not None:
        messages = _with_scanned(long, model, False).select("_chunk", "x", "entry", "exit")
        parts = parts.unionByName(messages.mapInArrow(_statistics(model, _long_steps(model)), kind))
    sums = parts.groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(sums))
    for row in sums:
        flat[row["i"]] = row["v"]
    return flat


def _long(packed: DataFrame) -> DataFrame | None:
    return packed.filter("_chunks > 1") if _any_long(packed) else None


def stepped(packed: DataFrame, model: GaussianHmm) -> GaussianHmm:
    """The model after one step of expectation and maximisation, with the log-likelihood before it."""
    flat = expected(whole_blocks(packed, model.means.shape[1]), _long(packed), model)
    return replace(maximise(model, flat), log_likelihood=float(flat[-1]), iterations=model.iterations + 1)


def fit_hmm(
    df: DataFrame, axis: Axis, row_id: str, k: int, settings: ModelSettings = ModelSettings(), features: str = "features", chunk_rows: int = 2_048
) -> tuple[GaussianHmm, DataFrame]:
    """Expectation–maximisation until the gain falls below the tolerance; returns the model and the packed data."""
    packed = cut_lineage(spread(pack_sequences(df, axis, row_id, features, chunk_rows), "_seq", "_chunk"))
    model = initial_model(df, k, features, settings.seed)
    whole, long = cut_lineage(spread(whole_blocks(packed, model.means.shape[1]), rows=packed.filter("_chunks = 1").count())), _long(packed)
    previous, history = float("-inf"), []
    for step in range(settings.max_iterations):
        flat = expected(whole, long, model)
        history.append(float(flat[-1]))
        model = replace(maximise(model, flat), log_likelihood=float(flat[-1]), iterations=step + 1, history=tuple(history))
        if flat[-1] - previous < settings.tolerance:
            break
        previous = float(flat[-1])
    return model, packed


def decode(packed: DataFrame, model: GaussianHmm, row_id: str, kind: str = "string") -> DataFrame:
    """Most likely state path and posteriors: ``row_id, state_id, posterior, state_probability_max``."""
    shape = f"_id {kind}, state_id int, posterior array<double>"
    rows = packed.filter("_chunks = 1").select("ids", "x").mapInArrow(_decoded_alone(model), shape)
    long = _long(packed)
    if long is not None:
        rows = rows.unionByName(_with_scanned(long, model, True).mapInPandas(_decoded(model), shape))
    return rows.withColumnRenamed("_id", row_id).withColumn("state_probability_max", F.array_max("posterior"))

"""Audio frame features.

Sound comes as rows of 16-bit samples (``media_id, chunk_start, pcm``: index of the first sample, little-endian bytes), a
recording in any number of rows. It is dealt out in blocks of frames, each row going to the block that it
lies in and its first samples to the block before, as far as frames overlap; so a recording of any length is many tasks, and a task holds one block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from windrow.kernels.streams import grouped
from windrow.settings import AUDIO_FEATURES

# Guard against logarithm of zero, and the roll-off share.
EPSILON = 1e-12
ROLLOFF = 0.85

_SCHEMA = ", ".join(f"{n} double" for n in AUDIO_FEATURES)


def spectral_features(frames: np.ndarray, sample_rate: int) -> dict[str, np.ndarray]:
    """Seven features per row of a (frames × samples) matrix."""
    size = frames.shape[1]
    power = (frames * frames).mean(axis=1)
    crossings = np.abs(np.diff(np.signbit(frames).astype(np.int8), axis=1)).mean(axis=1) if size > 1 else np.zeros(len(frames))
    spectrum = np.abs(np.fft.rfft(frames * np.hanning(size)[None, :], axis=1))
    hertz = np.fft.rfftfreq(size, d=1.0 / sample_rate)
    mass = spectrum.sum(axis=1) + EPSILON
    centroid = (spectrum @ hertz) / mass
    width = np.sqrt((spectrum * (hertz[None, :] - centroid[:, None]) ** 2).sum(axis=1) / mass)
    reached = np.cumsum(spectrum, axis=1) >= (ROLLOFF * mass)[:, None]
    flatness = np.exp(np.log(spectrum + EPSILON).mean(axis=1)) / (spectrum + EPSILON).mean(axis=1)
    return {
        "audio_rms": np.sqrt(power), "audio_short_time_energy": power, "audio_zero_crossing_rate": crossings,
        "audio_spectral_centroid": centroid, "audio_spectral_bandwidth": width,
        "audio_spectral_rolloff": hertz[reached.argmax(axis=1)], "audio_spectral_flatness": flatness,
    }


def audio_frames(recordings: DataFrame, sample_rate: int, frame_seconds: float = 1.0, hop_seconds: float | None = None, block_frames: int = 256) -> DataFrame:
    """Features of every frame: ``media_id, frame_start_sec, frame_center_sec`` and seven measures.

    Frames start every ``hop_seconds`` (a whole frame by default). The last one is padded with zeros; a frame that would hold
    no sample which the one before lacks is left out. Rows of a recording must not overlap; gaps between them are silence.
    """
    size = max(1, round(sample_rate * frame_seconds))
    hop = size if hop_seconds is None else max(1, min(size, round(sample_rate * hop_seconds)))
    span, more = block_frames * hop, size - hop
    begin = F.coalesce("chunk_start", F.lit(0)).cast("bigint") if "chunk_start" in recordings.columns else F.lit(0).cast("bigint")
    chunks = recordings.select("media_id", begin.alias("_lo"), (begin + F.floor(F.length("pcm") / 2)).alias("_hi"), "pcm").filter("_hi > _lo")
    # block k wants samples from k * span to (k + 1) * span + more
    first, last = F.floor((F.col("_lo") - more) / F.lit(span)), F.floor((F.col("_hi") - 1) / F.lit(span))
    dealt = chunks.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    lo, hi = F.greatest(F.col("_lo"), F.col("_block") * span), F.least(F.col("_hi"), (F.col("_block") + 1) * span + more)
    parts = dealt.withColumns({"_a": lo, "_b": hi}).filter("_b > _a")
    piece = F.substring("pcm", ((F.col("_a") - F.col("_lo")) * 2 + 1).cast("int"), ((F.col("_b") - F.col("_a")) * 2).cast("int"))
    parts = parts.select("media_id", "_block", F.col("_a").alias("at"), piece.alias("pcm"))
    schema = f"media_id string, frame_start_sec double, frame_center_sec double, {_SCHEMA}"

    def emit(key: tuple, rows: Iterator[dict]) -> Iterator[tuple]:
        media, block = key
        sound, end = np.zeros(span + more), 0
        for row in rows:
            samples = np.frombuffer(row["pcm"][: len(row["pcm"]) // 2 * 2], "<i2") / 32768.0
            at = row["at"] - block * span
            sound[at : at + len(samples)] = samples
            end = max(end, at + len(samples))
        count = min(block_frames, -(-max(end - more, 1 if block == 0 else 0) // hop))
        for i in range(0, count, 64):
            starts = np.arange(i, min(i + 64, count)) * hop
            measures = spectral_features(sound[starts[:, None] + np.arange(size)], sample_rate)
            seconds = (starts + block * span) / sample_rate
            for j, t in enumerate(seconds):
                yield (media, float(t), float(t + size / sample_rate / 2), *[float(measures[n][j]) for n in AUDIO_FEATURES])

    ordered = parts.repartition("media_id", "_block").sortWithinPartitions("media_id", "_block", "at")
    return ordered.mapInArrow(grouped(emit, ["media_id", "_block"], to_arrow_schema(StructType.fromDDL(schema))), schema)

"""A set of 64-bit hashes as bits of bounded size, for dropping rows early inside a scan.

A hash that is in the set always passes; others pass by chance. So a filter only saves work: what
passes is joined exactly afterwards, and results do not depend on the filter's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from windrow.llm.words import mix

_U = np.uint64
SEGMENT_BYTES = 1 << 20
PROBES = 5


def _spots(hashes: np.ndarray):
    a, b = mix(hashes), hashes | _U(1)
    for k in range(PROBES):
        yield ((a + _U(k) * b) >> _U(64 - 23)).astype(np.int64)


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(SEGMENT_BYTES, np.uint8)
    for at in _spots(rows["h"].to_numpy(np.int64).view(np.uint64)):
        np.bitwise_or.at(bits, at >> 3, np.uint8(1) << (at & 7).astype(np.uint8))
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [bits.tobytes()]})


@dataclass
class HashFilter:
    bits: np.ndarray  # segment x bytes

    def passing(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes may be in the set."""
        if not len(self.bits):
            return np.zeros(len(hashes), bool)
        base = (hashes.view(np.int64) % len(self.bits)) * SEGMENT_BYTES
        flat, out = self.bits.reshape(-1), np.ones(len(hashes), bool)
        for at in _spots(hashes):
            out &= ((flat[base + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1) != 0
        return out


def built(hashes: DataFrame, count: int, max_bytes: int = 64 << 20) -> HashFilter:
    """Filter of the column ``h`` (distinct, ``count`` rows), with one byte for each up to ``max_bytes``.

    Segments are built on the executors. A segment receives its share of the hashes in parts,
    whose bits are united on the driver, where the whole filter (``max_bytes`` at most) lies.
    """
    segments = min(-(-count // SEGMENT_BYTES), max_bytes // SEGMENT_BYTES)
    bits = np.zeros((segments, SEGMENT_BYTES), np.uint8)
    if segments:
        part = F.pmod(F.xxhash64("h"), F.lit(max(1, count // (segments * 2 * SEGMENT_BYTES))))
        rows = hashes.select("h", F.pmod("h", F.lit(segments)).alias("segment"), part.alias("part"))
        for r in rows.groupBy("segment", "part").applyInPandas(_segment, "segment bigint, bits binary").toLocalIterator():
            bits[r["segment"]] |= np.frombuffer(r["bits"], np.uint8)
    return HashFilter(bits)

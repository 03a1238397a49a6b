"""Document fingerprints by consistent weighted sampling.

A document is a weighted set: its words with their counts. For each of ``samples`` slots and
each word there are fixed draws ``r, c ~ Gamma(2, 1)`` and ``b ~ U(0, 1)``, taken from a hash of word and slot.
With ``t = floor(ln w / r + b)`` and ``ln a = ln c - r (t - b) - r`` the word with the smallest ``ln a`` is the
slot's sample, together with its ``t``. Two documents agree in a slot with the probability of their
generalised Jaccard similarity (sum of smaller weights over sum of larger ones), so the share of equal
slots estimates it.

``ln a`` depends on word and weight alone: a slice of documents evaluates its distinct (word,
weight) pairs once, and each document takes minima over its rows. Samples are written as
16-bit digests, never 0; a document without words has zeros only and is unlike any document with words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.store import saved
from windrow.llm.words import Words, mix

_U = np.uint64
PAIRS_AT_ONCE = 1024


def words_of(texts: list[bytes]) -> Words:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(texts), np.uint8), offsets, lower=False)


def scrambled(words: np.ndarray, slots: np.ndarray, which: int) -> np.ndarray:
    """64 bits for each word and slot; ``which`` names one of several independent draws."""
    x = words[:, None] ^ mix(slots * _U(8) + _U(which + 1))[None, :]
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(32)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(29)
    return x


def uniform(bits: np.ndarray, shift: int, width: int) -> np.ndarray:
    """Draws in (0, 1) from ``width`` of the bits."""
    part = ((bits >> _U(shift)) & _U((1 << width) - 1)).astype(np.float32)
    part += np.float32(0.5)
    part *= np.float32(2.0**-width)
    return part


def scores(words: np.ndarray, weights: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """``ln a`` and ``t`` for each pair (word, weight) and slot."""
    slots = np.arange(samples, dtype=np.uint64)
    one, two = scrambled(words, slots, 0), scrambled(words, slots, 1)
    r = -np.log(uniform(one, 0, 24) * uniform(one, 32, 24))
    log_c = np.log(-np.log(uniform(two, 0, 21) * uniform(two, 21, 21)))
    b = uniform(two, 42, 21)
    t = np.floor(np.log(weights.astype(np.float32))[:, None] / r + b)
    return log_c - r * (t - b) - r, t


def signatures(texts: list[bytes], samples: int) -> np.ndarray:
    """One row of ``samples`` 16-bit digests for each text."""
    out = np.zeros((len(texts), samples), np.uint16)
    words = words_of(texts)
    if not len(words.hash):
        return out
    owner = words.owner
    order = np.lexsort((words.hash, owner))
    h, o = words.hash[order], owner[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (o[1:] != o[:-1])])
    at = np.flatnonzero(new)
    weight = np.diff(np.concatenate([at, [len(h)]]))
    h, o = h[at], o[at]
    # distinct pairs of word and weight in the slice
    pair = mix(h + weight.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    _, first, place = np.unique(pair, return_index=True, return_inverse=True)
    low, step = np.empty((len(first), samples), np.float32), np.empty((len(first), samples), np.float32)
    for a in range(0, len(first), PAIRS_AT_ONCE):
        part = first[a : a + PAIRS_AT_ONCE]
        low[a : a + len(part)], step[a : a + len(part)] = scores(h[part], weight[part], samples)
    begin = np.flatnonzero(np.concatenate([[True], o[1:] != o[:-1]]))
    end = np.concatenate([begin[1:], [len(o)]])
    slot = np.arange(samples)
    for a, b in zip(begin.tolist(), end.tolist()):
        rows = place[a:b]
        best = low[rows].argmin(axis=0)
        won = mix(h[a + best] + step[rows[best], slot].astype(np.int64).astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        out[o[a]] = (won % _U(65535)).astype(np.uint16) + np.uint16(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots, row by row; two documents without words are alike."""
    return (a == b).mean(axis=1)


def written(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def fingerprint(texts: Column, samples: int = 64) -> Column:
    """Fingerprint of each text as hexadecimal digits, four for a sample; null counts as empty."""
    @F.pandas_udf("string")
    def apply(column):
        import pandas as pd

        return pd.Series([s for a in range(0, len(column), 200) for s in written(signatures([x.encode() for x in column[a : a + 200]], samples))])

    return apply(F.coalesce(texts, F.lit("")))


def edited(text: str, following: str) -> str:
    """``text`` with its last third of characters replaced by the first as many of ``following``."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


SCHEMA = "row string, part int, doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, text string"


def compared(docs: DataFrame, samples: int = 64, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2_000_000) -> DataFrame:
    """Each document next to its edited form and to the next document, in descending order of ids.

    Returns ``doc_id``, ``n_chars``, ``edited`` as its SHA-256, both fingerprints, and the likeness of the document's
    fingerprint to the edited text's (``near_edited``) and the next document's (``near_next``). The document after the last is the
    first; a single document follows itself.

    Documents are dealt to range partitions of their order, so a neighbour is the next row of the same
    partition. Only the last row of each partition needs the first one of another: these few rows
    (two for each partition) are matched in a second step.

    Cases: null text counts as empty; null ids come last; rows with equal ids are ordered by a
    hash of their text, then the text; an empty table gives an empty result; other columns are ignored.
    """
    from hashlib import sha256

    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie").desc()]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order, F.col("text").desc()).select("doc_id", "text", F.spark_partition_id().alias("part"))

    def judged(keys: pa.Array, part: list[int], texts: list[str], following: list[str], own: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
        changed = [edited(a, b) for a, b in zip(texts, following)]
        other = signatures([c.encode() for c in changed], samples)
        n = len(texts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(["done"] * n), pa.array(part, pa.int32()), keys, pa.array([len(t) for t in texts], pa.int64()), pa.array([sha256(c.encode()).hexdigest() for c in changed]), pa.array(written(own)),
                pa.array(written(other)), pa.array(likeness(own, other)), pa.array(likeness(own, after)), pa.nulls(n, pa.string()),
            ],
            names,
        )

    def edge(row: str, key: pa.Array, part: int, text: str) -> pa.RecordBatch:
        null = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([row]), pa.array([part], pa.int32()), key, *null, pa.array([text])], names)

    schema = SCHEMA.format(kind=kind)
    names = [f.strip().split(" ")[0] for f in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order; each is judged when the next one has come."""
        held: tuple[pa.Array, str, np.ndarray, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, part = batch.column(1).to_pylist(), batch.column(2)[0].as_py()
            size = np.cumsum([len(t) for t in texts]) // slice_bytes
            cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts, cuts[1:]):
                own = signatures([t.encode() for t in texts[a:b]], samples)
                keys, line = batch.column(0).slice(a, b - a), texts[a:b]
                if held is None:
                    yield edge("first", keys.slice(0, 1), part, line[0])
                else:
                    keys, line, own = pa.concat_arrays([held[0], keys]), [held[1], *line], np.concatenate([held[2], own])
                if len(line) > 1:
                    yield judged(keys.slice(0, len(line) - 1), [part] * (len(line) - 1), line[:-1], line[1:], own[:-1], own[1:])
                held = (keys.slice(len(line) - 1, 1), line[-1], own[-1:], part)
        if held is not None:
            yield edge("last", held[0], held[3], held[1])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, following = batch.column(2)[k].as_py(), batch.column(3)[k].as_py()
                both = signatures([text.encode(), following.encode()], samples)
                yield judged(batch.column(0).slice(k, 1), [batch.column(1)[k].as_py()], [text], [following], both[:1], both[1:])

    walked = saved(placed.mapInArrow(walk, schema), "fingerprints")
    # one first and one last row for each partition that has rows; their numbers fit the driver
    numbers = [r["part"] for r in walked.filter("row = 'first'").select("part").orderBy("part").collect()]
    follows = {p: q for p, q in zip(numbers, [*numbers[1:], *numbers[:1]])}
    result = walked.filter("row = 'done'")
    if numbers:
        pairs = spark.createDataFrame(sorted(follows.items()), "part int, next int")
        first = walked.filter("row = 'first'").select(F.col("part").alias("next"), F.col("text").alias("following"))
        last = walked.filter("row = 'last'").select("doc_id", "part", "text").join(pairs, "part").join(first, "next")
        result = result.unionByName(last.select("doc_id", "part", "text", "following").mapInArrow(close, schema))
    return result.select(*names[2:9])

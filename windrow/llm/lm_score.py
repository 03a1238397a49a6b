"""Language-model scores from a log-frequency Bloom filter.

A bigram model over the training rows. Bigrams met ``least`` times or more enter a Bloom filter as (bigram, 1) to
(bigram, q), where ``q`` is the count's step on a logarithmic scale; a lookup asks for step 1, 2, ... until one is missing, and
so reads the quantised count. Rarer bigrams are not stored: their share of a context is backed off to
smoothed single words, as is the discount::

    P(w | v) = max(n(v w) - d, 0) / n(v) + (1 - D(v) / n(v)) * P(w),    P(w) = (n(w) + 1) / (N + V + 1)

``D(v)`` is the sum of ``n(v w) - d`` over the stored bigrams of ``v``; a context that training never met
leaves ``P(w)``. A text starts in a context of its own and ends with an end token.

How it runs: one scan counts words and bigrams by 64-bit hashes, first inside blocks of texts, then over a shuffle that
carries the sorted hashes of a block as bytes, one row for each of ``RANGES`` ranges of hashes; the filter is made of segments (by
ranges of hashes too, each of ``SEGMENT_BITS`` bits), built where Spark puts their bigrams; a second scan sums
``D(v)``. Segments and word counts grow with the corpus, so they are broadcast only while they fit in ``max_broadcast`` bytes.
A scan asks the filter once for each distinct bigram of a slice, and remembers the counts of frequent ones, which take the most steps.
Beyond that the same filter is asked segment by segment, for blocks of about ``BLOCK_BYTES`` of text: the distinct bigrams of a block go
sorted, as gaps of a few bytes, to where the segment of their hash is, and a byte for each comes back. Stored mass is summed by
ranges of words and comes back with the counts, 4 bytes and less for each distinct word of a block; then the block's texts meet both and are scored. Both ways
ask the same bits, so they have the same false positives.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.store import removed, saved, setting
from windrow.llm.words import Words, mix, slices

_U = np.uint64
END, BEGIN = _U(0x51ED270B153D2C9F), _U(0xA3C59AC2F1E0B7D1)
SEGMENT_BITS = 1 << 23
PROBES = 7
BITS_PER_ITEM = 10
STEP = 1.5  # ratio of neighbouring counts on the logarithmic scale
RANGES = 4096  # of hashes, by their upper bits
BLOCK = 1 << 22  # tokens that are counted before they are sent
MERGED = 250_000  # hashes of a row of counts, about
PLACES = 1 << 18  # words whose stored mass is summed together
OFTEN, MEMORY = 8, 1 << 20  # a count of at least this step is remembered, and so many of them
BLOCK_BYTES = 12 << 20  # of text whose distinct bigrams ask the filter together
ASKED = 1 << 18  # bigrams that are looked up at once


def tokens(words: Words, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, their contexts, and the text of each."""
    counts = words.counts
    owner = np.repeat(np.arange(rows), counts + 1)
    out = np.full(len(owner), END)
    last = np.cumsum(counts + 1) - 1
    inner = np.ones(len(owner), bool)
    inner[last] = False
    out[inner] = words.hash
    context = np.concatenate([[BEGIN], out[:-1]]) if len(out) else out
    context[last[:-1] + 1] = BEGIN
    return out, context, owner


def bigrams(context: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(context * _U(0x9E3779B97F4A7C15) + token)


def step_of(count: np.ndarray, least: int) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(count, least) / least) / np.log(STEP) + 1e-9).astype(np.int64)


def count_of(step: np.ndarray, least: int) -> np.ndarray:
    """The middle of a step's whole counts."""
    low = np.ceil(least * STEP ** (step - 1) - 1e-9)
    return np.where(step > 0, (low + np.maximum(low, np.ceil(least * STEP**step - 1e-9) - 1)) / 2, 0.0)


def first_place(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the probes of an item start and how far apart they are; the upper bits are the place in a segment."""
    return items, (items << _U(32)) | (items >> _U(32)) | _U(1)


def places(items: np.ndarray) -> Iterator[np.ndarray]:
    """Bits of an item inside its segment, one probe after the other."""
    at, stride = first_place(items)
    for _ in range(PROBES):
        yield at >> _U(64 - 23)
        at = at + stride


def segment_of(grams: np.ndarray, segments: int) -> np.ndarray:
    """Segments are ranges of hashes, so sorted bigrams ask one segment after the other."""
    return ((grams >> _U(32)) * _U(segments) >> _U(32)).astype(np.int64)


@dataclass
class Model:
    """What scoring needs: the filter, single words with their counts and stored mass, and totals."""

    bits: np.ndarray  # segment x bytes
    words: np.ndarray  # sorted hashes
    counts: np.ndarray
    stored: np.ndarray  # D(v)
    total: int
    distinct: int
    least: int
    discount: float

    def has(self, grams: np.ndarray, step: int) -> np.ndarray:
        """Whether (bigram, step) is in the filter."""
        return self.found(grams, segment_of(grams, len(self.bits)) * (SEGMENT_BITS // 8), step)

    def found(self, grams: np.ndarray, base: np.ndarray, step: int) -> np.ndarray:
        """The same, with the first byte of each bigram's segment."""
        if not len(self.bits):
            return np.zeros(len(grams), bool)
        flat = self.bits.reshape(-1)
        at, stride = first_place(item(grams, step))

        def bit() -> np.ndarray:
            place = at >> _U(64 - 23)
            return flat[base + (place >> _U(3)).view(np.int64)] >> (place & _U(7)).astype(np.uint8)

        hit = bit()
        for _ in range(2):
            at = at + stride
            hit &= bit()
        # most of what is not stored has met a missing bit by now
        alive = np.flatnonzero(hit & 1)
        at, stride, base = at[alive], stride[alive], base[alive]
        hit = np.ones(len(alive), np.uint8)
        for _ in range(PROBES - 3):
            at = at + stride
            hit &= bit()
        out = np.zeros(len(grams), bool)
        out[alive[hit != 0]] = True
        return out

    def quantised(self, grams: np.ndarray) -> np.ndarray:
        """Counts read from the filter, 0 for bigrams that are not stored."""
        return count_of(self.steps(grams), self.least)

    def steps(self, grams: np.ndarray, base: np.ndarray | None = None) -> np.ndarray:
        """The last step that the filter has of each bigram."""
        out, left, step = np.zeros(len(grams), np.int64), np.arange(len(grams)), 0
        if base is None:
            base = segment_of(grams, len(self.bits)) * (SEGMENT_BITS // 8)
        while len(left):
            step += 1
            hit = self.found(grams, base, step)
            left, grams, base = left[hit], grams[hit], base[hit]
            out[left] = step
        return out

    def places_of(self, hashes: np.ndarray) -> np.ndarray:
        """Places in ``words`` of sorted hashes, -1 for unknown ones."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        # in sorted order, neighbouring searches touch the same memory
        spot = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[spot] == hashes, spot, -1)

    def looked_up(self, values: np.ndarray, spot: np.ndarray) -> np.ndarray:
        return np.where(spot >= 0, values[spot].astype(float), 0.0) if len(values) else np.zeros(len(spot))


class Reader:
    """Counts of bigrams for one task: each distinct one of a slice is asked once, frequent ones are remembered."""

    def __init__(self, model: Model):
        self.model = model
        self.grams, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new: list[tuple[np.ndarray, np.ndarray]] = []

    def counts(self, grams: np.ndarray) -> np.ndarray:
        distinct, back = np.unique(grams, return_inverse=True)
        step = np.zeros(len(distinct), np.int64)
        asked = np.ones(len(distinct), bool)
        if len(self.grams):
            spot = np.minimum(np.searchsorted(self.grams, distinct), len(self.grams) - 1)
            asked = self.grams[spot] != distinct
            step = np.where(asked, 0, self.known[spot])
        left = np.flatnonzero(asked)
        step[left] = self.model.steps(distinct[left])
        often = left[step[left] >= OFTEN]
        self.new.append((distinct[often], step[often]))
        if sum(len(x) for x, _ in self.new) > len(self.grams) // 4:
            self.remember()
        return count_of(np.arange(step.max(initial=0) + 1), self.model.least)[step][back]

    def remember(self) -> None:
        """Sort new ones in; what is too much is dropped and asked again when it comes."""
        grams, known = (np.concatenate(x) for x in zip((self.grams, self.known), *self.new))
        self.grams, first = np.unique(grams, return_index=True)
        self.known, self.new = known[first], []
        if len(self.grams) > MEMORY:
            self.grams, self.known = self.grams[:0], self.known[:0]


def told_apart(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, sorted, and for each token the place of its word and of its context there."""
    distinct, back = np.unique(np.append(token, BEGIN), return_inverse=True)
    before = np.concatenate([back[-1:], back[:-2]])
    before[context == BEGIN] = back[-1]
    return distinct, back[:-1], before


def item(grams: np.ndarray, step: int) -> np.ndarray:
    return mix(grams + _U(step * 0xD6E8FEB86659FD93 % (1 << 64)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (the first ``RANGES`` ranges) and bigrams (the next) of training rows with their counts in a block of texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for batch in batches:
        for a, b, words in slices(batch.column(0), lower=True):
            token, context, _ = tokens(words, b - a)
            held.append((token, bigrams(context, token)))
            size += len(token)
            if size >= BLOCK:
                yield from _sent(held)
                held, size = [], 0
    if held:
        yield from _sent(held)


def _sent(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Sorted distinct hashes of a block (8 bytes each) and their numbers (4 bytes each), a row for each range of hashes."""
    for kind in (0, 1):
        found, n = np.unique(np.concatenate([x[kind] for x in held]), return_counts=True)
        n = n.astype(np.uint32)
        edges = np.searchsorted(found, np.arange(RANGES, dtype=np.uint64) * _U((1 << 64) // RANGES))
        edges = np.append(edges, len(found))
        for some in np.array_split(np.flatnonzero(np.diff(edges)), max(1, len(found) // MERGED)):
            if len(some):
                cuts = np.append(edges[some], edges[some[-1] + 1])
                yield pa.RecordBatch.from_arrays([pa.array((kind * RANGES + some).astype(np.int32)), _bytes(found, cuts), _bytes(n, cuts)], ["range", "h", "n"])


def _bytes(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """The values between neighbouring cuts as bytes."""
    part = np.ascontiguousarray(values[cuts[0] : cuts[-1]])
    offsets = ((cuts - cuts[0]) * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(part)])


def _values(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of bytes, and where each row's begin and end."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.dtype(kind).itemsize
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), kind), (offsets - offsets[0]) // size


COUNTS = "kind tinyint, h binary, n binary, size bigint, total bigint, items bigint, ends bigint"


def _merged(least: int):
    """Rows of ``_counted`` in order of their ranges to counts: of words with their numbers, of bigrams with their steps."""

    def summed(kind: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        keys, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        if not len(keys):
            return
        order = np.argsort(keys)
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, n = keys[first], np.add.reduceat(n[order].astype(np.int64), first)
        if kind:
            keys, n = keys[n >= least], n[n >= least]
            step = step_of(n, least).astype(np.int8)
        total, items, ends = (0, int(step.sum(dtype=np.int64)), 0) if kind else (int(n.sum()), 0, int(n[keys == END].sum()))
        values = [[kind], [keys.tobytes()], [(step if kind else n).tobytes()], [len(keys)], [total], [items], [ends]]
        types = [pa.int8(), pa.binary(), pa.binary(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types)], ["kind", "h", "n", "size", "total", "items", "ends"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, last, held, size = 0, -1, [], 0
        for batch in batches:
            ranges = batch.column(0).to_numpy()
            (keys, cuts), (n, _) = _values(batch.column(1), np.uint64), _values(batch.column(2), np.uint32)
            starts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1]])) if len(ranges) else []
            for i, j in zip(starts, [*starts[1:], len(ranges)]):
                # a range is summed when all its rows are there, small ones together
                if ranges[i] != last and held and (size >= MERGED or ranges[i] // RANGES != kind):
                    yield from summed(kind, held)
                    held, size = [], 0
                last, kind = ranges[i], ranges[i] // RANGES
                held.append((keys[cuts[i] : cuts[j]], n[cuts[i] : cuts[j]]))
                size += int(cuts[j] - cuts[i])
        if held:
            yield from summed(kind, held)

    return run


def _segment(rows: pd.DataFrame) -> pd.DataFrame:
    """The bits of one segment."""
    bits = np.zeros(SEGMENT_BITS, bool)
    grams, steps = rows["h"].to_numpy(np.int64).view(np.uint64), rows["step"].to_numpy()
    for step in range(1, int(steps.max()) + 1):
        grams, steps = grams[steps >= step], steps[steps >= step]
        for place in places(item(grams, step)):
            bits[place.view(np.int64)] = True
    return pd.DataFrame({"segment": [rows["segment"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})


@dataclass
class Statistics:
    """Counts of the training rows as a table of bytes: hashes, with numbers of words and steps of bigrams."""

    counts: DataFrame
    total: int
    distinct: int
    items: int
    rows: int
    least: int
    discount: float

    @property
    def segments(self) -> int:
        return -(-self.items * BITS_PER_ITEM // SEGMENT_BITS)

    @property
    def bytes(self) -> int:
        return 20 * self.distinct + self.items * BITS_PER_ITEM // 8


def texts_of(docs: DataFrame, text_col: str) -> Column:
    return F.coalesce(docs[text_col], F.lit("")).alias("text")


def train(docs: DataFrame, learn: Column, text_col: str = "text", least: int = 2, discount: float = 0.75) -> Statistics:
    """Count words and bigrams of the rows for which ``learn`` holds."""
    rows = docs.filter(learn).select(texts_of(docs, text_col)).mapInArrow(_counted, "range int, h binary, n binary")
    counts = saved(rows.repartition("range").sortWithinPartitions("range").mapInArrow(_merged(least), COUNTS), "counts", keep_shuffles=False)
    words, grams = F.col("kind") == 0, F.col("kind") == 1
    total, distinct, items, ends = counts.agg(F.sum("total"), F.sum(F.when(words, F.col("size"))), F.sum(F.when(grams, F.col("items"))), F.sum("ends")).first()
    return Statistics(counts, total or 0, distinct or 0, items or 0, ends or 0, least, discount)


def filter_segments(stats: Statistics) -> DataFrame:
    """The filter as rows ``segment`` and ``bits``; a segment without bigrams has none."""
    segments = max(1, stats.segments)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                (keys, _), (steps, _) = _values(batch.column(0).slice(k, 1), np.uint64), _values(batch.column(1).slice(k, 1), np.int8)
                if len(keys):
                    segment = segment_of(keys, segments)
                    first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]]))
                    cuts = np.append(first, len(keys))
                    yield pa.RecordBatch.from_arrays([pa.array(segment[first]), _bytes(keys, cuts), _bytes(steps, cuts)], ["segment", "h", "step"])

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        keys, steps = np.frombuffer(b"".join(rows["h"]), np.int64), np.frombuffer(b"".join(rows["step"]), np.int8)
        return _segment(pd.DataFrame({"h": keys, "step": steps, "segment": rows["segment"].iloc[0]}))

    rows = stats.counts.filter("kind = 1").select("h", "n").mapInArrow(deal, "segment bigint, h binary, step binary")
    return rows.groupBy("segment").applyInPandas(fill, "segment bigint, bits binary")


def built(stats: Statistics, docs: DataFrame, learn: Column, text_col: str) -> Model:
    """The model for broadcasting: filter segments, sorted words and the stored mass of each context."""
    spark = docs.sparkSession
    # words come a row of counts at a time into arrays of their final size, so that the driver holds them once
    hashes, counts, at = np.empty(stats.distinct + 1, np.uint64), np.empty(stats.distinct + 1, np.min_scalar_type(stats.total)), 0
    for r in stats.counts.filter("kind = 0").select("h", "n").toLocalIterator():
        size = len(r["h"]) // 8
        hashes[at : at + size], counts[at : at + size] = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64)
        at += size
    hashes[at], counts[at] = BEGIN, stats.rows  # texts as often as they begin
    counts = counts[np.argsort(hashes)]
    hashes.sort()
    bits = np.zeros((stats.segments, SEGMENT_BITS // 8), np.uint8)
    if stats.segments:
        for r in saved(filter_segments(stats), "segments", keep_shuffles=False).toLocalIterator():
            bits[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    model = Model(bits, hashes, counts, np.zeros(len(hashes), np.float32), stats.total, stats.distinct, stats.least, stats.discount)
    shared = spark.sparkContext.broadcast(model)

    def mass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader, total = Reader(m), np.zeros(len(m.words))
        for batch in batches:
            for a, b, words in slices(batch.column(0), lower=True):
                token, context, _ = tokens(words, b - a)
                distinct, _, before = told_apart(token, context)
                count = reader.counts(bigrams(context, token))
                share = np.bincount(before[count > 0], 1 - m.discount / count[count > 0], len(distinct))
                spot = m.places_of(distinct)
                total[spot[share != 0]] += share[share != 0]
        for part in range(-(-len(total) // PLACES)):
            at = np.flatnonzero(total[part * PLACES : (part + 1) * PLACES])
            if len(at):
                yield pa.RecordBatch.from_pylist([{"part": part, "at": at.astype(np.int32).tobytes(), "mass": total[part * PLACES + at].tobytes()}])

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PLACES)
        for at, mass in zip(rows["at"], rows["mass"]):
            total[np.frombuffer(at, np.int32)] += np.frombuffer(mass)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "mass": [total.astype(np.float32).tobytes()]})

    rows = docs.filter(learn).select(texts_of(docs, text_col)).mapInArrow(mass, "part bigint, at binary, mass binary")
    for r in rows.groupBy("part").applyInPandas(summed, "part bigint, mass binary").collect():
        of = model.stored[r["part"] * PLACES : (r["part"] + 1) * PLACES]
        of[:] = np.frombuffer(r["mass"], np.float32)[: len(of)]
    shared.destroy()
    return model


OUTPUT = "doc_id {kind}, n_tokens bigint, n_known bigint, base_score double, score double"


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 2, discount: float = 0.75, max_broadcast: int = 400_000_000) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Training rows are those for which ``learn`` holds. Words are lower-cased (A-Z); the end of a text is a token. ``base_score``
    is the sum of ``log10 P(w)``, ``score`` that of ``log10 P(w | v)``.

    Cases: a null or empty text has the end token alone; a null in ``learn`` keeps a row out of training; without training rows every
    probability is 1; repeated rows count and are scored each; an empty table gives an empty result; other
    columns are ignored.
    """
    stats = train(docs, learn, text_col, least, discount)
    kind = docs.schema[id_col].dataType.simpleString()
    if stats.bytes > max_broadcast:
        # the texts are scanned again and again, and their partitions must not change with the cores that are there
        spark, key = docs.sparkSession, "spark.sql.leafNodeDefaultParallelism"
        with setting(spark, key, spark.conf.get(key, None) or str(spark.sparkContext.defaultParallelism)):
            return joined(docs, stats, learn, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(built(stats, docs, learn, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        reader = Reader(m)
        for batch in batches:
            for a, b, words in slices(batch.column(1), lower=True):
                token, context, owner = tokens(words, b - a)
                distinct, of, before = told_apart(token, context)
                spot = m.places_of(distinct)
                times, kept = m.looked_up(m.counts, spot), m.looked_up(m.stored, spot)
                single = (times + 1) / (m.total + m.distinct + 1)
                chance = mixture(single[of], times[before], kept[before], reader.counts(bigrams(context, token)), m.discount)
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, n), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, spot[of] >= 0, n).astype(np.int64)), pa.array(np.bincount(owner, np.log10(single)[of], n)),
                        pa.array(np.bincount(owner, np.log10(chance), n)),
                    ],
                    ["doc_id", "n_tokens", "n_known", "base_score", "score"],
                )

    rows = docs.select(docs[id_col].alias("doc_id"), texts_of(docs, text_col)).mapInArrow(run, OUTPUT.format(kind=kind))
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(stats.total).cast("bigint").alias("train_tokens"), "base_score", "score")


def mixture(single: np.ndarray, times: np.ndarray, kept: np.ndarray, count: np.ndarray, discount: float) -> np.ndarray:
    """``P(w | v)`` from ``P(w)``, ``n(v)``, ``D(v)`` and the quantised ``n(v w)``."""
    times_or_one = np.maximum(times, 1)
    own = np.maximum(np.minimum(count, times) - discount, 0) / times_or_one
    return np.where(times > 0, own + (1 - np.minimum(kept / times_or_one, 0.999)) * single, single)


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest takes, which is said first."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values, np.uint64).view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def widened(data: pa.Buffer | bytes) -> np.ndarray:
    found = np.frombuffer(data, np.uint8)
    width = int(found[0])
    out = np.zeros(((len(found) - 1) // width, 8), np.uint8)
    out[:, :width] = found[1:].reshape(len(out), width)
    return out.view(np.uint64).ravel()


def squeezed(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the gaps between neighbours."""
    return hashes[:1].tobytes() + narrow(np.diff(hashes))


def unsqueezed(data: pa.Buffer | bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(data[:8], np.uint64), widened(data[8:])]), dtype=np.uint64)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Consecutive rows with about ``BLOCK_BYTES`` of ``text``, with their partition (column ``p``) and a number; the cuts depend on the rows and not on the batches they come in."""
    held, size, number = [], 0, 0

    def whole() -> tuple[int, int, pa.RecordBatch]:
        block = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        return block.column("p")[0].as_py(), number, block

    for batch in batches:
        # an empty text has an end token too
        upto = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        begin, before = 0, 0
        while begin < len(upto):
            end = int(np.searchsorted(upto, before + BLOCK_BYTES - size)) + 1
            held.append(batch.slice(begin, end - begin))
            if end > len(upto):
                size += int(upto[-1]) - before
                break
            yield whole()
            held, size, number, begin, before = [], 0, number + 1, end, int(upto[end - 1])
    if held:
        yield whole()


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens`` of a block, which come slice by slice."""
    found = []
    for a, b, words in slices(texts, lower=True):
        token, context, owner = tokens(words, b - a)
        found.append((token, context, owner + a))
    return tuple(np.concatenate(x) for x in zip(*found))


def distinct_of(hashes: np.ndarray) -> np.ndarray:
    """The distinct ones, sorted; ``np.unique`` takes many times as long without counts or places."""
    found = np.sort(hashes)
    return found[np.concatenate([[True], found[1:] != found[:-1]])]


def _cuts(keys: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal keys."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
    return list(zip(first, [*first[1:], len(keys)]))


def _told(grams: np.ndarray) -> int:
    """Tells sets of hashes apart."""
    return int(np.bitwise_xor.reduce(grams).view(np.int64))


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    """Rows whose columns are named with their types as Spark does."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[kind]) for v, (_, kind) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of whole numbers, and of bytes that are not copied."""
    for batch in batches:
        columns = [[x.as_buffer() for x in c] if pa.types.is_binary(c.type) else c.to_pylist() for c in batch.columns]
        yield from zip(*columns)


def _blockwise(rows: Iterator[tuple]) -> Iterator[tuple[int, int, dict[int, list[tuple]]]]:
    """Rows in order of their blocks: partition and number of a block, and by kind what is there of it."""
    last, held = None, {}
    for p, k, kind, _, *values in rows:
        if (p, k) != last and held:
            yield *last, held
            held = {}
        last = p, k
        held.setdefault(kind, []).append(values)
    if held:
        yield *last, held


def _answered(answers: list[tuple], count: int, told: int) -> np.ndarray:
    """The steps of a block's sorted distinct bigrams."""
    steps = np.concatenate([np.frombuffer(x, np.int8) for x, _, _ in answers])
    if len(steps) != count or np.bitwise_xor.reduce(np.array([x for _, _, x in answers], np.int64)) != told:
        raise RuntimeError("texts were read in another order than before")
    return steps


ASK, ANSWER = "range bigint, part int, p int, k int, h binary", "p int, k int, kind int, at bigint, x binary, y binary, told bigint"
OF_WORDS = "at bigint, p int, k int, x binary, y binary"


def answered(base: DataFrame, stats: Statistics, asked: int = 1 << 26) -> DataFrame:
    """For each block of texts the steps of its distinct bigrams, read where the filter's segments lie; ``stats.counts`` are removed.

    A block sends a row for each range of segments, ``RANGES`` at most. A range is sent to as many tasks as it takes for each to have about ``asked`` tokens.
    """
    segments, least = max(1, stats.segments), stats.least
    width = -(-segments // RANGES)
    parts = max(1, stats.total // (segments * asked))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, block in blocks(batches):
            token, context, _ = tokens_of(block.column("text"))
            grams = distinct_of(bigrams(context, token))
            key = segment_of(grams, segments) // width
            yield _batch([(int(key[a]), (p + k) % parts, p, k, squeezed(grams[a:b])) for a, b in _cuts(key)], ASK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none, last, held, size = np.zeros(0, np.uint64), None, [], 0
        model = Model(np.zeros((width, SEGMENT_BITS // 8), np.uint8), none, none, none, 0, 0, least, 0.0)

        def looked_up() -> pa.RecordBatch:
            grams = np.concatenate([x for *_, x in held])
            steps = model.steps(grams, (segment_of(grams, segments) - last[0] * width) * (SEGMENT_BITS // 8)).astype(np.int8)
            ends = np.cumsum([len(x) for *_, x in held])
            return _batch([(p, k, 0, last[0], steps[end - len(x) : end].tobytes(), None, _told(x)) for (p, k, x), end in zip(held, ends.tolist())], ANSWER)

        for key, part, p, k, h in _rows(batches):
            if (key, part) != last or size >= ASKED:
                if held:
                    yield looked_up()
                    held, size = [], 0
                if (key, part) != last:
                    last = key, part
                    model.bits[:] = 0
            if p < 0:
                model.bits[k - key * width] = np.frombuffer(h, np.uint8)
            else:
                held.append((p, k, unsqueezed(h)))
                size += len(held[-1][2])
        if held:
            yield looked_up()

    bits = saved(filter_segments(stats), "segments", keep_shuffles=False)
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    filters = bits.select(F.floor(F.col("segment") / width).alias("range"), every, F.lit(-1).alias("p"), F.col("segment").cast("int").alias("k"), F.col("bits").alias("h"))
    rows = filters.unionByName(base.select("p", "text").mapInArrow(ask, ASK))
    removed(stats.counts)
    answers = saved(rows.repartition("range", "part").sortWithinPartitions("range", "part", "p", "k").mapInArrow(answer, ANSWER), "answers", keep_shuffles=False)
    removed(bits)
    return answers


def weighed(base: DataFrame, answers: DataFrame, words: DataFrame, stats: Statistics) -> DataFrame:
    """For each block of texts ``n(w)`` and ``D(w)`` of its distinct words, which are summed over all blocks by ranges of words."""
    ranges = min(RANGES, 1 + ((answers.agg(F.sum(F.length("x"))).first()[0] or 0) >> 20))
    least, discount, begins = stats.least, stats.discount, stats.rows

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each block its words, and of its sorted distinct bigrams how often they are learnt and the place of the first word."""
        for p, k, block in blocks(batches):
            token, context, owner = tokens_of(block.column("text"))
            grams, place = np.unique(bigrams(context, token), return_inverse=True)
            learnt = block.column("learn").to_numpy(zero_copy_only=False)[owner]
            found, _, before = told_apart(token, context)
            of = np.zeros(len(grams), np.int64)
            of[place] = before
            n = np.bincount(place[learnt], minlength=len(grams))
            yield _batch([(p, k, 1, 0, narrow(of), narrow(n), _told(grams), squeezed(found))], f"{ANSWER}, z binary")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, held in _blockwise(_rows(batches)):
            (of, n, told, found) = held[1][0]
            of, n, found = widened(of).astype(np.int64), widened(n), unsqueezed(found)
            steps = _answered([x[:3] for x in held[0]], len(of), told)
            count = count_of(np.arange(steps.max() + 1), least)[steps]
            some = (count > 0) & (n > 0)
            mass = np.bincount(of[some], n[some] * (1 - discount / count[some]), len(found))
            at = segment_of(found, ranges)
            yield _batch([(int(at[a]), p, k, squeezed(found[a:b]), mass[a:b].tobytes()) for a, b in _cuts(at)], OF_WORDS)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, n in _rows(batches):
            h, n = np.frombuffer(h, np.uint64), np.frombuffer(n, np.int64)
            at = segment_of(h, ranges)
            yield _batch([(int(at[a]), -1, 0, squeezed(h[a:b]), n[a:b].tobytes()) for a, b in _cuts(at)], OF_WORDS)

    def summed(at: int, held: list[tuple]) -> pa.RecordBatch | None:
        """The answers to blocks: words of one range with their numbers and mass."""
        own = [(unsqueezed(h), np.frombuffer(n, np.int64)) for p, _, h, n in held if p < 0] + [(np.array([BEGIN]), np.array([begins]))]
        h, n = (np.concatenate(x) for x in zip(*own))
        order = np.argsort(h)
        h, n = h[order], n[order]
        asked = [(p, k, unsqueezed(x), np.frombuffer(mass)) for p, k, x, mass in held if p >= 0]
        if not asked:
            return None
        distinct, back = np.unique(np.concatenate([x[2] for x in asked]), return_inverse=True)
        kept = np.bincount(back, np.concatenate([x[3] for x in asked])).astype(np.float32)
        spot = np.minimum(np.searchsorted(h, distinct), len(h) - 1)
        times = np.where(h[spot] == distinct, n[spot], 0)
        ends = np.cumsum([len(x[2]) for x in asked]).tolist()
        some = [back[end - len(x[2]) : end] for x, end in zip(asked, ends)]
        return _batch([(p, k, 1, at, narrow(times[i]), kept[i].tobytes(), None) for (p, k, _, _), i in zip(asked, some)], ANSWER)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for at, *row in _rows(batches):
            if at != last and held and (out := summed(last, held)):
                yield out
            held = held if at == last else []
            last = at
            held.append(row)
        if held and (out := summed(last, held)):
            yield out

    wide = answers.withColumn("z", F.lit(None).cast("binary"))
    rows = wide.unionByName(base.select("p", "learn", "text").mapInArrow(pairs, f"{ANSWER}, z binary"))
    asked = rows.repartition("p", "k").sortWithinPartitions("p", "k", "kind", "at").mapInArrow(weigh, OF_WORDS)
    both = words.select("h", "n").mapInArrow(known, OF_WORDS).unionByName(asked)
    return saved(both.repartition("at").sortWithinPartitions("at", "p", "k").mapInArrow(ranged, ANSWER), "weights", keep_shuffles=False)


def joined(docs: DataFrame, stats: Statistics, learn: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same scores from the same filter, for statistics too large to broadcast: blocks of texts ask its segments and the ranges of words.

    Blocks are told apart by partition and number, so rows have to come in the same order each time; where a shuffle is below them, they are written first.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(docs[id_col].alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), texts_of(docs, text_col))
    written = [base := saved(base, "texts", keep_shuffles=False)] if "Exchange" in base._jdf.queryExecution().executedPlan().toString() else []
    base = base.withColumn("p", F.spark_partition_id())  # a task's own number would count those of other tables in a union
    words = saved(stats.counts.filter("kind = 0").select("h", "n"), "words")
    answers = answered(base, stats)
    weights = weighed(base, answers, words, stats)
    removed(words)
    total, size, discount = stats.total, float(stats.total + stats.distinct + 1), stats.discount
    least = stats.least

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, k, block in blocks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, block.schema) as out:
                out.write_batch(block)
            yield _batch([(p, k, 2, 0, sink.getvalue().to_pybytes(), None, None)], ANSWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held in _blockwise(_rows(batches)):
            block = pa.ipc.open_stream(held[2][0][0]).read_next_batch()
            token, context, owner = tokens_of(block.column("text"))
            grams, place = np.unique(bigrams(context, token), return_inverse=True)
            steps = _answered(held[0], len(grams), _told(grams))
            count = count_of(np.arange(steps.max() + 1), least)[steps][place]
            _, of, before = told_apart(token, context)
            times = np.concatenate([widened(x) for x, _, _ in held[1]]).astype(float)
            kept = np.concatenate([np.frombuffer(x, np.float32) for _, x, _ in held[1]]).astype(float)
            single = (times + 1) / size
            chance = mixture(single[of], times[before], kept[before], count, discount)
            n = len(block)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"), pa.array(np.bincount(owner, minlength=n)), pa.array(np.bincount(owner, times[of] > 0, n).astype(np.int64)), pa.array(np.bincount(owner, np.log10(single)[of], n)),
                    pa.array(np.bincount(owner, np.log10(chance), n)),
                ],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    rows = answers.unionByName(weights).unionByName(base.select("p", "doc_id", "text").mapInArrow(send, ANSWER))
    out = rows.repartition("p", "k").sortWithinPartitions("p", "k", "kind", "at").mapInArrow(run, OUTPUT.format(kind=kind))
    out = saved(out, "scores", keep_shuffles=False)
    removed(answers, weights, *written)
    return out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "score")

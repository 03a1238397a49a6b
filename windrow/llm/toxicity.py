"""Toxicity from the nearest labelled examples.

The index holds a bounded sample of labelled documents: ``examples`` of either class, those with the
smallest seeded hash. A document is a TF-IDF vector over the words that at least two examples share
(``(1 + ln tf) * idf``; document frequencies are counted over *all* documents), and likeness is the exact
cosine over that vocabulary.

The index is inverted and cut into blocks of ``block`` examples. For each block and word it holds the largest
weight in the block. The ``frequent`` words that most examples have are a dense matrix instead; one product for a slice of
documents gives their part of all cosines. The k-th best part is a lower bound of the k-th best cosine, the best part of
a block plus the largest weights of its other words an upper bound of its cosines, and only the postings of blocks whose upper
bound reaches the lower one are read: what is left cannot change the neighbours. Cosines are summed in double
precision and compared to 10 decimals, so they do not depend on the slice.

The k nearest vote with weight ``1 / (1 - cosine + softness)``. Shares of votes become probabilities by a
monotone fit (pool adjacent violators) on ``calibration`` labelled documents in the classes' natural ratio; one that is
an example itself does not vote on itself. The neighbours with their cosines are the evidence.

At scale: sampling is a top-n by hash, document frequencies are one scan with partial counts for a fixed vocabulary, the
index (a few MB, bounded by the sample) is broadcast, and scoring is one scan without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from windrow.llm.words import NO_LETTER, slices

SLICE = 64  # documents of a product
SLICE_BYTES = 300_000  # of texts whose words are held at once; hashing takes some 30 times as much
TERMS = "doc_id string, toxic int, terms array<bigint>, counts array<int>"


def sliced(texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[np.ndarray, np.ndarray]]]]:
    """:func:`bags` of consecutive texts of about ``SLICE_BYTES`` together, with their range."""
    for a, b, words in slices(texts, SLICE_BYTES, lower=True, gaps=NO_LETTER):
        yield a, b, [np.unique(words.hash[words.first[k] : words.first[k + 1]].view(np.int64), return_counts=True) for k in range(b - a)]


def bags(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct words of each text (sorted hashes, as signed) and how often each occurs."""
    for _, _, found in sliced(texts):
        yield from found


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = list(bags(batch.column(2)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.list_(pa.int64())), pa.array([n.astype(np.int32) for _, n in found], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms", "counts"]
        )


@dataclass(frozen=True)
class Taught:
    """A labelled document as a bag of words."""

    name: str
    toxic: int
    terms: np.ndarray
    counts: np.ndarray


def _taught(table: pa.Table) -> list[Taught]:
    """Rows of :data:`TERMS` as views of flat arrays, in an order of their own."""
    table = table.combine_chunks()
    if not table.num_rows:
        return []
    names, toxic = table.column(0).to_pylist(), table.column(1).to_pylist()
    terms, counts = table.column(2).chunk(0), table.column(3).chunk(0)
    cuts = terms.offsets.to_numpy().tolist()
    words, times = terms.values.to_numpy(), counts.values.to_numpy()
    rows = [Taught(n, y, words[a:b], times[a:b]) for n, y, a, b in zip(names, toxic, cuts, cuts[1:])]
    return sorted(rows, key=lambda r: (r.name, len(r.terms), int(r.terms.sum()) if len(r.terms) else 0))


@dataclass
class Index:
    """Examples by frequent terms, postings of the other terms by block, the largest weights there, and the calibration curve."""

    terms: np.ndarray  # sorted vocabulary
    idf: np.ndarray  # with the relevance factor
    column: np.ndarray  # of each term: its row in ``dense``, -1 for other terms
    dense: np.ndarray  # frequent term x example
    starts: np.ndarray  # block x term: where its postings begin; one column more
    place: np.ndarray  # of each posting: the example
    value: np.ndarray  # and its weight
    peaks: np.ndarray  # term x block: largest weight, or a little more
    toxic: np.ndarray
    names: list[str | None]
    k: int
    softness: float
    width: int  # examples of a block
    curve: tuple[np.ndarray, np.ndarray] | None = None
    prior: float = 0.0

    @classmethod
    def of(cls, bag: list[tuple[np.ndarray, np.ndarray]], terms: np.ndarray, idf: np.ndarray, toxic: np.ndarray, names: list[str | None], k: int, softness: float, width: int, frequent: int = 256) -> Index:
        """Index of examples given as bags of words."""
        count = -(-len(bag) // width)
        none = np.zeros(0, np.int64)
        index = cls(terms, idf, np.full(len(terms), -1), np.zeros((0, len(bag))), np.zeros((count, len(terms) + 1), np.int64), none, np.zeros(0), np.zeros((len(terms), count)), toxic, names, k, softness, width)
        vectors = [index.vector(*b) for b in bag]
        if not vectors or not len(terms):
            return index
        spot, value = (np.concatenate(parts) for parts in zip(*vectors))
        place = np.repeat(np.arange(len(vectors)), [len(v) for v, _ in vectors])
        most = np.argsort(-np.bincount(spot, minlength=len(terms)), kind="stable")[:frequent]
        index.column[most] = np.arange(len(most))
        index.dense = np.zeros((len(most), len(bag)))
        common = index.column[spot] >= 0
        index.dense[index.column[spot[common]], place[common]] = value[common]
        spot, value, place = spot[~common], value[~common], place[~common]
        order = np.lexsort((place, spot, place // width))
        index.place, index.value = place[order], value[order]
        found = np.bincount(place // width * len(terms) + spot, minlength=count * len(terms)).reshape(count, -1)
        index.starts[:, 1:] = np.cumsum(found, axis=1)
        index.starts += (np.cumsum(found.sum(axis=1)) - found.sum(axis=1))[:, None]
        np.maximum.at(index.peaks, (spot, place // width), value)
        # every worker holds the index: half the bytes where that loses nothing, a peak goes up to the next short number
        low = index.peaks.astype(np.float32)
        index.peaks = np.where(low < index.peaks, np.nextafter(low, np.float32(np.inf)), low)
        if len(index.place) < 1 << 31:
            index.starts, index.place = index.starts.astype(np.int32), index.place.astype(np.int32)
        return index

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vocabulary places and unit weights of a bag of words."""
        if not len(self.terms) or not len(terms):
            return np.zeros(0, np.int64), np.zeros(0)
        spot = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[spot] == terms
        spot = spot[known]
        weight = (1 + np.log(counts[known])) * self.idf[spot]
        spot, weight = spot[weight > 0], weight[weight > 0]
        return spot, (weight / (np.sqrt((weight * weight).sum()) or 1.0))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], but: list[str] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each vector, places and cosines of the k nearest examples, of equal ones the first; the example named in ``but`` is none."""
        for a in range(0, len(vectors), SLICE):
            part = vectors[a : a + SLICE]
            weights = np.zeros((len(part), len(self.dense)))
            for n, (spot, weight) in enumerate(part):
                column = self.column[spot]
                weights[n, column[column >= 0]] = weight[column >= 0]
            for n, ((spot, weight), known) in enumerate(zip(part, weights @ self.dense)):
                if len(spot) and len(self.names):
                    yield self._best(spot, weight, known, None if but is None else but[a + n])
                else:
                    yield np.zeros(0, np.int64), np.zeros(0)

    def _best(self, spot: np.ndarray, weight: np.ndarray, known: np.ndarray, but: str | None) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`nearest`, for one vector whose part of the cosines is ``known``."""
        k = min(self.k + (but is not None), len(known))
        other = self.column[spot] < 0
        spot, weight = spot[other], weight[other]
        bound = np.maximum.reduceat(known, np.arange(0, len(known), self.width)) + weight @ self.peaks[spot]
        blocks = np.flatnonzero(bound + 1e-9 >= np.partition(known, -k)[-k])
        begin = self.starts[blocks[:, None], spot].ravel()
        size = self.starts[blocks[:, None], spot + 1].ravel() - begin
        some = np.flatnonzero(size)
        begin, size = begin[some], size[some]
        before = np.cumsum(size) - size
        at = np.repeat(begin - before, size) + np.arange(size.sum())
        added = np.bincount(self.place[at], self.value[at] * np.repeat(weight[some % len(weight)], size), minlength=len(known)) if len(at) else 0.0
        place = (blocks[:, None] * self.width + np.arange(self.width)).ravel()
        place = place[place < len(known)]
        cosine = np.round(known + added, 10)[place]
        close = np.flatnonzero(cosine >= np.partition(cosine, -k)[-k])
        best = place[close][np.lexsort((place[close], -cosine[close]))][:k]
        if but is not None:
            best = np.array([p for p in best.tolist() if self.names[p] != but][: self.k], np.int64)
        return best, np.round(known + added, 10)[best]

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """Share of the neighbours' votes for toxic; without neighbours nothing is known."""
        ok = cosine > 0
        if not ok.any():
            return float("nan")
        pull = 1.0 / (1.0 - np.minimum(cosine[ok], 1.0) + self.softness)
        return float((pull * self.toxic[place[ok]]).sum() / pull.sum())

    def score(self, vote: float) -> float:
        """Calibrated probability of a share of votes."""
        if np.isnan(vote) or self.curve is None:
            return self.prior if np.isnan(vote) else vote
        return float(np.interp(vote, *self.curve))


def monotone(votes: np.ndarray, labels: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing fit of labels over votes: pooled means, with ``smooth`` imaginary rows at the mean of all."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for v, y in zip(votes[order].tolist(), labels[order].tolist()):
        pools.append([v, y, 1.0])  # sum of votes, of labels, rows
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    base = float(labels.mean())
    x = np.array([p[0] / p[2] for p in pools])
    y = np.array([(p[1] + smooth * base) / (p[2] + smooth) for p in pools])
    return x, np.maximum.accumulate(y)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", examples: int = 1024, calibration: int = 4096, k: int = 15, block: int = 64, softness: float = 0.05, seed: int = 0) -> Index:
    """Index and calibration from rows of ``labels`` for which ``learn`` (an expression over its ``doc_id``) holds.

    A document with several labels counts as toxic if one says so; labels without a value or a document teach nothing; of rows that repeat an id the least text teaches.
    """
    marks = labels.select(labels[id_col].alias("doc_id"), labels[label_col].alias("toxic")).filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    marks = marks.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chance = F.xxhash64(F.col("doc_id").cast("string"), F.lit(seed))
    picked = {name: [r for r in marks.filter(rule).select("doc_id", "toxic", chance.alias("chance")).orderBy("chance", "doc_id").limit(n).collect()] for name, rule, n in (("toxic", F.col("toxic") > 0, examples), ("clean", F.col("toxic") <= 0, examples))}
    inside = {r["doc_id"] for rows in picked.values() for r in rows}
    checks = {r["doc_id"] for r in marks.select("doc_id", F.xxhash64(chance, F.lit("calibration")).alias("chance")).orderBy("chance", "doc_id").limit(calibration).collect()}
    ids = sorted(inside | checks)  # at most 2 * examples + calibration
    spark = docs.sparkSession
    if not ids:
        return Index.of([], np.zeros(0, np.int64), np.zeros(0), np.zeros(0), [], k, softness, block)
    kind = docs.schema[id_col].dataType
    wanted = spark.createDataFrame([(i,) for i in ids], f"doc_id {kind.simpleString()}").join(marks, "doc_id")
    texts = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(wanted), "doc_id")
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # an id that repeats teaches once
    rows = _taught(texts.select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text").mapInArrow(_vectors, TERMS).toArrow())
    known = {str(i) for i in inside}
    chosen = sorted((r for r in rows if r.name in known), key=lambda r: (r.toxic, len(r.terms)))  # like with like in a block
    bag = [(r.terms, r.counts) for r in chosen]
    every = np.concatenate([t for t, _ in bag]) if bag else np.zeros(0, np.int64)
    terms, shared = np.unique(every, return_counts=True)
    terms = terms[shared >= 2]
    toxic = np.array([float(r.toxic) for r in chosen])

    total, frequency = document_frequencies(docs, text_col, terms)
    weight = np.log((1 + total) / (1 + frequency)) * relevance(terms, [t for t, _ in bag], toxic)
    index = Index.of(bag, terms, weight, toxic, [r.name for r in chosen], k, softness, block)
    chosen_checks = {str(i) for i in checks}
    tests = [r for r in rows if r.name in chosen_checks]
    index.prior = float(np.mean([r.toxic for r in tests] or [0.0]))
    votes = np.array([index.vote(*found) for found in index.nearest([index.vector(r.terms, r.counts) for r in tests], [r.name for r in tests])])
    truth = np.array([float(r.toxic) for r in tests])
    usable = ~np.isnan(votes) if len(votes) else np.zeros(0, bool)
    if usable.any():
        index.curve = monotone(votes[usable], truth[usable])
    return index


def relevance(terms: np.ndarray, bags: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """0.5 plus the absolute z-score of each term's share in toxic against clean examples."""
    found = np.zeros((2, len(terms)))
    for bag, y in zip(bags, toxic):
        spot = np.minimum(np.searchsorted(terms, bag), max(0, len(terms) - 1))
        if len(terms):
            found[int(y > 0), spot[terms[spot] == bag]] += 1
    n = np.array([(toxic <= 0).sum(), (toxic > 0).sum()], float)
    if not n.all():
        return np.full(len(terms), 0.5)
    share = found.sum(axis=0) / n.sum()
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return 0.5 + np.abs(found[1] / n[1] - found[0] / n[0]) / spread


def document_frequencies(docs: DataFrame, text_col: str, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """Number of documents, and in how many of them each term occurs; the result has as many rows as ``terms``."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, found, seen = shared.value, np.zeros(len(shared.value) + 1, np.int64), 0
        for batch in batches:
            for bag, _ in bags(batch.column(0)):
                seen += 1
                if len(words) and len(bag):
                    spot = np.minimum(np.searchsorted(words, bag), len(words) - 1)
                    found[spot[words[spot] == bag]] += 1
        found[-1] = seen
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], ["at", "n"])

    rows = docs.select(F.coalesce(docs[text_col], F.lit("")).alias("text")).mapInArrow(count, "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms) + 1)
    for r in rows:
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1]


def score(docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, evidence: int = 5, keep: list[str] | None = None) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` and ``evidence`` of every row; with ``keep``, those columns of ``docs`` as ``column_0`` on and ``score``.

    ``evidence`` has the nearest examples as (doc_id, cosine, toxic). Only the text shapes a score.

    Cases: a null or empty text, or one without a known word, gets the share of toxic rows among the calibration
    rows; without any labelled row all scores are 0; equal cosines go by the order of the index; repeated
    rows are scored each; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = [docs[id_col].alias("doc_id")] if keep is None else [docs[c].alias(f"column_{k}") for k, c in enumerate(keep)]
    once = keep is not None and text_col in keep and docs.schema[text_col].dataType == T.StringType()  # a text that is kept is not sent a second time
    rows = docs.select(*kept, *([] if once else [F.coalesce(docs[text_col], F.lit("")).alias("text")]))
    width = len(kept)
    at_text = keep.index(text_col) if once else width
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:width]]
    extra = ["score double"] if keep is not None else ["score double", "predicted int", "evidence array<struct<doc_id:string,cosine:float,toxic:int>>"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = pa.array(model.names, pa.string())
        for batch in batches:
            for a, b, found in sliced(batch.column(at_text)):
                scores, places, cosines = [], [], []
                for place, cosine in model.nearest([model.vector(*bag) for bag in found]):
                    scores.append(model.score(model.vote(place, cosine)))
                    if keep is None:
                        places.append(place[:evidence])
                        cosines.append(cosine[:evidence])
                columns = [pa.array(scores, pa.float64())]
                if keep is None:
                    cuts = np.concatenate([[0], np.cumsum([len(p) for p in places], dtype=np.int64)])
                    at, near = (np.concatenate([np.zeros(0), *parts]) for parts in (places, cosines))
                    at = at.astype(np.int64)
                    reasons = pa.StructArray.from_arrays([names.take(pa.array(at)), pa.array(near, pa.float32()), pa.array(model.toxic[at].astype(np.int32))], ["doc_id", "cosine", "toxic"])
                    columns += [pa.array(np.array(scores) >= threshold).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), reasons)]
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in batch.columns[:width]], *columns], [*batch.schema.names[:width], *[e.split(" ")[0] for e in extra]])

    return rows.mapInArrow(run, ", ".join(fields + extra))


def without_toxic(docs: DataFrame, index: Index, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is below ``threshold``."""
    scored = score(docs, index, text_col=text_col, keep=docs.columns).filter(F.col("score") < threshold)
    return scored.select(*[F.col(f"column_{k}").alias(c) for k, c in enumerate(docs.columns)])

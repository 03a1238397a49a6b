"""Removing passages that occur more than once.

A *window* is ``size`` consecutive words. Every word covered by a window whose words also start anywhere
else goes. Windows are found through *anchors*: of the runs of ``gram`` words inside a window, the one with the
smallest hash (the first of equals). Equal windows have equal anchors, and consecutive windows mostly
share one, so a text is a row of *pieces*: the windows of one anchor occurrence, with all their
words.

1. *Candidates.* Anchors are counted; those met twice or more pass a bounded hash filter inside the next scan,
   so pieces that cannot repeat never leave it.
2. *Confirmation.* Pieces are counted by anchor and content. A piece met twice or more repeats as a whole. The
   others repeat in part, if at all: where an anchor has several contents, their windows are counted, and
   those met twice or more are the recurring passages.
3. *Location.* Passages and the pieces still open are dealt to shards by anchor; an anchor with many pieces is dealt to
   many shards, each with its passages. A shard compiles one Aho-Corasick automaton over word numbers and
   streams its pieces through it, which yields every occurrence. (A text is thus streamed
   in its pieces, through the shards of its anchors; a window lies within one piece.)
4. Spans are gathered by document and the words left are returned.

Texts are shuffled once, in step 4. Counts are combined before each shuffle; joins on anchors or contents read
written tables, so Spark can split hot ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from windrow.llm.hash_filter import HashFilter, built
from windrow.llm.store import saved
from windrow.llm.words import Words, chained, mix, powers, slices

_U = np.uint64


def ranges_hash(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the values in each range."""
    up, down = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def pieces(words: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word, end word (exclusive) and anchor hash of each piece; word numbers run over the slice."""
    n = len(words.hash)
    none = np.zeros(0, np.int64)
    if n < size:
        return none, none, none, np.zeros(0, np.uint64)
    grams = chained(words.hash, gram)
    window = size - gram + 1
    anchor = np.arange(n - size + 1) + np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1)
    owner = words.owner
    valid = owner[: n - size + 1] == owner[size - 1 :]  # the window ends in the text where it starts
    start = np.flatnonzero(valid)
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64)
    a = anchor[start]
    # anchors never move back, and windows of another text have other anchors
    new = np.concatenate([[True], a[1:] != a[:-1]])
    first = start[new]
    last = start[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])]
    return owner[first], first, last + size, grams[a[new]]


def identity(anchor: np.ndarray, content: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Hash of one piece of one text."""
    return mix(mix(anchor + content * _U(3)) + mix(key.view(np.uint64) ^ mix(start.astype(np.uint64))))


def located(docs: DataFrame, size: int, gram: int, shard_pieces: int, max_filter: int) -> DataFrame:
    """Spans (``doc_id``, ``key``, ``begin``, ``end`` in words) that cover all recurring windows of ``docs``.

    ``docs`` has ``doc_id``, ``key`` (a hash of the text) and ``text``; rows alike in all three give the same spans each.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in slices(batch.column(0)):
                h, n = np.unique(pieces(words, size, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

    met = docs.select("text").mapInArrow(anchors, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    met = saved(met.select("h"), "anchors")
    candidates = spark.sparkContext.broadcast(built(met, met.count(), max_filter))

    def found(batch: pa.RecordBatch, filtered: HashFilter) -> Iterator[tuple]:
        """Pieces of a batch (columns doc_id, key, text) whose anchor passes."""
        keys = batch.column(1).to_numpy(zero_copy_only=False)
        for a, _, words in slices(batch.column(2)):
            text, begin, end, h = pieces(words, size, gram)
            passes = filtered.passing(h)
            text, begin, end, h = text[passes], begin[passes], end[passes], h[passes]
            content = ranges_hash(words.hash, begin, end)
            yield words, text + a, begin, end, h, content, keys[text + a], begin - words.first[text]

    def occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, text, begin, end, h, content, key, start in found(batch, candidates.value):
                columns = [pa.array(h.view(np.int64)), pa.array(content.view(np.int64)), batch.column(0).take(pa.array(text)), pa.array(key), pa.array(start.astype(np.int32)), pa.array((end - begin).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, ["h", "c", "doc_id", "key", "start", "words"])

    rows = docs.select("doc_id", "key", "text")
    met_pieces = saved(rows.mapInArrow(occurring, f"h bigint, c bigint, doc_id {kind}, key bigint, start int, words int"), "pieces")

    contents = met_pieces.groupBy("h", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "start")).alias("one"), F.first("words").alias("words"))
    contents = saved(contents, "contents")
    per_anchor = saved(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1"), "anchors-of-several")
    several = saved(contents.join(per_anchor, "h"), "several")

    # words of one occurrence of each content that has to be looked into
    ids = several.select("h", "c", "one.key", "one.start").mapInArrow(_identities, "h bigint")
    wanted = spark.sparkContext.broadcast(built(ids, several.count(), max_filter))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, _, begin, end, h, content, key, start in found(batch, candidates.value):
                take = wanted.value.passing(identity(h, content, key, start))
                data = words.data.tobytes()
                text = [b" ".join(data[words.begin[a] : words.end[b - 1]].split()) for a, b in zip(begin[take].tolist(), end[take].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(h[take].view(np.int64)), pa.array(content[take].view(np.int64)), pa.array(text, pa.binary())], ["h", "c", "text"])

    texts = rows.mapInArrow(cut, "h bigint, c bigint, text binary").groupBy("h", "c").agg(F.first("text").alias("text"))
    open_pieces = saved(several.select("h", "c", "n", "contents").join(texts, ["h", "c"]), "texts")
    spans = matched(open_pieces, size, shard_pieces)

    whole = contents.filter("n > 1").select("h", "c", F.lit(0).alias("from"), F.col("words").alias("to"))
    repeated = saved(whole.unionByName(spans), "repeated")
    joined = met_pieces.select("h", "c", "doc_id", "key", "start").join(repeated, ["h", "c"])
    return joined.select("doc_id", "key", (F.col("start") + F.col("from")).alias("begin"), (F.col("start") + F.col("to")).alias("end"))


def _identities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, c, key, start = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(identity(h.view(np.uint64), c.view(np.uint64), key, start).view(np.int64))], ["h"])


def matched(open_pieces: DataFrame, size: int, shard_pieces: int) -> DataFrame:
    """Recurring parts of the pieces that occur once: ``h``, ``c``, ``from``, ``to`` in words of the piece.

    ``open_pieces`` has all contents (``h``, ``c``, ``n``, ``contents``, ``text``) of anchors with several.
    """
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, words in slices(batch.column(3)):
                begin = np.flatnonzero(words.owner[: max(0, len(words.hash) - size + 1)] == words.owner[size - 1 :])
                row = words.owner[begin]
                take = pa.array(row + a)
                w = ranges_hash(words.hash, begin, begin + size)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(take) for k in range(3)], pa.array(w.view(np.int64)), pa.array((begin - words.first[row]).astype(np.int32))], ["h", "c", "n", "w", "at"])

    every = open_pieces.select("h", "c", "n", "text").mapInArrow(windows, "h bigint, c bigint, n bigint, w bigint, at int")
    # a window that starts twice in one piece is met twice as well
    counted = every.groupBy("h", "w").agg(F.sum("n").alias("met"), F.count_if(F.col("n") == 1).alias("open"), F.min(F.struct("c", "at")).alias("one"))
    recurring = saved(counted.filter("met > 1 and open > 0").select("h", "one.c", "one.at"), "windows")
    passages = recurring.join(open_pieces.select("h", "c", "contents", "text"), ["h", "c"]).select("h", "contents", "text", "at")

    shards = max(1, -(-open_pieces.count() // shard_pieces))
    copies = F.ceil(F.col("contents") / shard_pieces).cast("bigint")
    shard = lambda part: F.pmod(F.xxhash64("h", part), F.lit(shards))
    left = passages.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), copies - 1))).select(shard(F.col("part")).alias("shard"), F.col("text").alias("passage"), "at")
    right = open_pieces.filter("n = 1").select(shard(F.pmod("c", copies)).alias("shard"), "h", "c", "text")

    def locate(passages: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        numbers: dict[bytes, int] = {}
        numbered = lambda text: tuple([numbers.setdefault(w, len(numbers)) for w in text.split()])
        machine, cache = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), {}
        for text, at in zip(passages["passage"], passages["at"]):
            words = cache.get(text) or cache.setdefault(text, numbered(text))
            machine.add_word(words[at : at + size], size)
        out: dict[str, list] = {"h": [], "c": [], "from": [], "to": []}
        if len(machine):
            machine.make_automaton()
            for h, c, text in zip(pieces["h"], pieces["c"], pieces["text"]):
                begin = end = -1
                for last, n in machine.iter(cache.get(text) or numbered(text)):
                    if last + 1 - n > end:  # a gap: the span before is complete
                        if end > begin:
                            for name, v in zip(out, (h, c, begin, end)):
                                out[name].append(v)
                        begin = last + 1 - n
                    end = last + 1
                if end > begin:
                    for name, v in zip(out, (h, c, begin, end)):
                        out[name].append(v)
        return pd.DataFrame(out).astype({"h": "int64", "c": "int64", "from": "int32", "to": "int32"})

    return left.groupBy("shard").cogroup(right.groupBy("shard")).applyInPandas(locate, "h bigint, c bigint, `from` int, `to` int")


SPANS = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def stripped(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Texts (columns doc_id, text, spans) without the words in their spans."""
    n_words, n_removed, kept, merged = [], [], [], []
    for text, covered in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
        words, out, at, cuts = text.split(), [], 0, []
        for span in sorted(covered or [], key=lambda s: (s["begin"], s["end"])):
            if cuts and span["begin"] <= cuts[-1]["end"]:
                cuts[-1]["end"] = max(cuts[-1]["end"], span["end"])
            else:
                cuts.append(dict(span))
        for span in cuts:
            out += words[at : span["begin"]]
            at = span["end"]
        out += words[at:]
        n_words.append(len(words))
        n_removed.append(len(words) - len(out))
        kept.append(b" ".join(out).decode())
        merged.append(cuts)
    columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(merged, SPANS), pa.array(kept, pa.string())]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "spans", "kept"])


def deduplicated(docs: DataFrame, size: int = 35, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = 2000, max_filter: int = 64 << 20) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``spans`` (of removed words) and ``kept`` (the other words, one space between).

    Words are runs of characters other than space and tab to carriage return, compared as they are.

    Cases: a null or empty text, or one with fewer than ``size`` words, loses nothing (null has no words); repeated
    rows repeat each other's windows, so all their words go if they have a window; a null id is an id of its own; an
    empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    spans = located(rows, size, gram, shard_pieces, max_filter)
    covers = spans.groupBy("doc_id", "key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    covers = covers.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans")
    joined = rows.join(covers, F.expr("key = _key and doc_id <=> _id"), "left").select("doc_id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                yield stripped(batch.slice(a, 256))

    return joined.mapInArrow(strip, f"doc_id {kind}, n_words bigint, n_removed bigint, spans array<struct<begin:int,end:int>>, kept string")

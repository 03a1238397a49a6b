"""Near-duplicates by MinHash with tensored banding.

A table key needs ``2 * half`` minhashes. Instead of as many minhashes as all tables need, two collections of ``side``
half keys are computed, and each pair of a half key from the one and a half key from the other is a
table: ``side ** 2`` tables from ``2 * side * half`` minhashes. Two sets with Jaccard similarity ``s`` meet in a table unless no
half key of a collection agrees, so they are missed with a probability of at most ``2 * (1 - s ** half) ** side``:
4e-4 at 0.8 for 12 half keys of 3, 2e-5 at 0.85, 3e-7 at 0.9.

1. Documents with equal sets form a class (counted before the shuffle); only classes go on.
2. Keys are counted; those of two classes or more pass a bounded hash filter when rows are made, so lone keys are
   not shuffled with their class.
3. In each table entry one class is the hub (the smallest by one of three random orders, the same throughout, so
   large groups have few hubs). Members are paired with their hub only, and each pair is compared on the full sets.
4. Links give components. A member may be like another member though not like its hub: components joined by pairs
   with a similarity of ``near`` or more form a family, and inside a family every class outside the largest component is
   compared with all classes of other components, in blocks of bounded size, on the full sets.
5. Members of an entry that are still in several components, whatever their similarity to the hub, meet in a join of rare-shingle
   prefixes, which holds every linked pair of them; its pairs are compared on the full sets.
6. The components of all three kinds of links are final.

So two linked classes that share a table entry end in one component: either both are linked to its hub (or one is the hub), or
they are in several components and step 5 compares them. Pairs of classes are made with hubs, outside
the largest component of a family, and for shared rare shingles between components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.components import components
from windrow.llm.hash_filter import built
from windrow.llm.store import saved
from windrow.llm.words import Words, mix, slices
from windrow.session import spread

_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
ORDERS = 3
SKETCH_BITS = 21
SLICE_BYTES = 300_000  # of texts whose words are held at once; hashing takes some 30 times as much


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """The set of ``width``-word shingles of each text, sorted; a shorter text is one shingle, one without words none."""
    h = words.hash
    runs = h.copy()
    for k in range(1, width):
        runs = mix(runs[: len(h) - k] * _GOLD + h[k:]) if len(h) > k else runs[:0]
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            short = h[a : a + 1]
            for k in range(a + 1, b):
                short = mix(short * _GOLD + h[k : k + 1])
            yield mix(short + _U(b - a))
        else:
            yield np.zeros(0, np.uint64)


def identity(shingles: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(np.array([mix(shingles + _U(1)).sum(dtype=np.uint64) + _U(len(shingles))], np.uint64)).view(np.int64)[0])


def half_keys(shingles: np.ndarray, factors: np.ndarray, half: int) -> np.ndarray:
    """Half keys of both collections, from minhashes by multiplication with odd factors."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 2048):
        low = np.minimum(low, (shingles[a : a + 2048, None] * factors[None, :]).min(axis=0))
    parts = low.reshape(-1, half)
    out = parts[:, 0]
    for k in range(1, half):
        out = mix(out * _GOLD + parts[:, k])
    return mix(out)


def table_keys(halves: np.ndarray) -> np.ndarray:
    """Keys of all tables, a row for each row of half keys."""
    side = halves.shape[1] // 2
    one, two = halves[:, :side], halves[:, side:]
    table = np.arange(side * side, dtype=np.uint64).reshape(side, side)
    return mix(one[:, :, None] * _GOLD + two[:, None, :] + mix(table)[None]).reshape(len(halves), -1)


def near_groups(
    docs: DataFrame, shingle: int = 5, similarity: tuple[int, int] = (80, 100), side: int = 12, half: int = 3, near: float = 0.5, block: int = 512, id_col: str = "doc_id", text_col: str = "text", max_filter: int = 64 << 20, carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept`` and what ``carry`` adds
    (further columns, as expressions over ``docs``).

    Words are lower-cased (A-Z). Sets with ``similarity[1] * intersection >= similarity[0] * union`` are linked; ``component_id`` is the
    smallest ``doc_id`` reachable over links, and the document of that id is kept.

    Cases: a null or empty text, or one without words, has an empty set, is linked with nothing and kept; a text
    shorter than a shingle is one shingle; rows that repeat an id are kept or not together; a null id never
    is the smallest, and a component of null ids alone is kept; an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    factors = mix(np.arange(1, 2 * side * half + 1, dtype=np.uint64)) | _U(1)
    part, whole = similarity
    extra = [f"_carry_{name}" for name in carry or {}]
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"), *[c.alias(f"_carry_{n}") for n, c in (carry or {}).items()])
    carried = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sizes, halves = [], [], []
            for _, _, words in slices(batch.column(1), SLICE_BYTES, lower=True):
                for s in shingle_sets(words, shingle):
                    names.append(identity(s) if len(s) else None)
                    sizes.append(len(s))
                    halves.append(half_keys(s, factors, half).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), pa.array(halves, pa.list_(pa.int64())), *batch.columns[2:]], ["doc_id", "id", "n", "halves", *extra])

    marks = saved(rows.mapInArrow(marked, f"doc_id {kind}, id bigint, n int, halves array<bigint>{carried}"), "marks")
    classes = marks.filter("id is not null").groupBy("id").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    classes = saved(classes, "classes")

    def keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1)
        keys = table_keys(halves)
        return keys.reshape(-1), np.repeat(np.arange(batch.num_rows), keys.shape[1]), np.tile(np.arange(keys.shape[1]) % ORDERS, batch.num_rows)

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                yield pa.RecordBatch.from_arrays([pa.array(keyed(batch.slice(a, 2000))[0].view(np.int64))], ["h"])

    plain = spread(classes.select("id", "n", "halves"), "id")  # each row becomes side * side keys
    shared = saved(plain.mapInArrow(lone, "h bigint").groupBy("h").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("h"), "keys")
    passing = spark.sparkContext.broadcast(built(shared, shared.count(), max_filter))

    def entered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                piece = batch.slice(a, 2000)
                keys, row, order = keyed(piece)
                take = passing.value.passing(keys)
                at = pa.array(row[take])
                yield pa.RecordBatch.from_arrays([pa.array(keys[take].view(np.int64)), piece.column(0).take(at), piece.column(1).take(at), pa.array(order[take].astype(np.int32))], ["k", "id", "n", "turn"])

    entries = saved(plain.mapInArrow(entered, "k bigint, id bigint, n int, turn int"), "entries")
    hubs = entries.groupBy("k").agg(F.count(F.lit(1)).alias("members"), F.min(F.struct(F.xxhash64("id", "turn").alias("place"), F.col("id").alias("id"), F.col("n").alias("n"))).alias("hub")).filter("members > 1")
    hubs = saved(hubs.select("k", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), (F.col("members") > 2).alias("crowded")), "hubs")
    alike = F.least("n", "hub_n") >= near * F.greatest("n", "hub_n")
    met = entries.join(hubs, "k").filter((F.col("id") != F.col("hub")) & (alike | F.col("crowded")))
    pairs = saved(met.groupBy("id", "hub", "n", "hub_n").agg(F.max("crowded").alias("crowded")), "pairs")

    ids = saved(pairs.select("id").union(pairs.filter(alike).select("hub")).distinct(), "paired")
    chosen = spark.sparkContext.broadcast(built(ids.select(F.col("id").alias("h")), ids.count(), max_filter))

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in slices(batch.column(0), SLICE_BYTES, lower=True):
                found = {identity(s): s for s in shingle_sets(words, shingle) if len(s)}
                names = np.array(list(found), np.int64)
                take = chosen.value.passing(names.view(np.uint64)) if len(names) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(names[take]), pa.array([found[x].view(np.int64) for x in names[take].tolist()], pa.list_(pa.int64()))], ["id", "shingles"])

    sets = rows.select("text").mapInArrow(gathered, "id bigint, shingles array<bigint>").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = saved(sets.join(ids, "id"), "sets")
    hub_sets = sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles"))
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    compared = pairs.filter(alike).join(sets, "id").join(hub_sets, "hub").select("id", "hub", common.alias("both"), (F.col("n") + F.col("hub_n")).alias("sum"))
    compared = saved(compared.filter(F.col("both") >= near * (F.col("sum") - F.col("both"))), "compared")
    links = compared.filter(whole * F.col("both") >= part * (F.col("sum") - F.col("both"))).select(F.col("id").alias("u"), F.col("hub").alias("v"))
    labels = components(links)

    # components that may hold a link which no hub saw
    named = ids.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    named = saved(named, "named")
    of = lambda name, out: named.select(F.col("id").alias(name), F.col("component").alias(out))
    across = compared.select("id", "hub").join(of("id", "u"), "id").join(of("hub", "v"), "hub").filter("u != v").select("u", "v").distinct()
    across = saved(across, "across")
    if across.limit(1).count():
        named = united(named, within_families(named, components(across), sets, part, whole, block))

    # members of an entry that its hub leaves in several components, whatever their similarity to it
    seated = pairs.filter("crowded").select("id", "hub").join(named, "id")
    split = seated.groupBy("hub").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("hub")
    parted = saved(seated.join(split, "hub").select("id", "component").distinct(), "parted")
    count = parted.count()
    if count:
        open_ids = spark.sparkContext.broadcast(built(parted.select(F.col("id").alias("h")), count, max_filter))
        named = united(named, by_prefixes(parted, sets, open_ids, part, whole))

    firsts = classes.select("id", "first").join(named, "id", "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    firsts = saved(firsts, "firsts")
    least = saved(firsts.groupBy("component").agg(F.min("first").alias("component_id")), "least")
    groups = saved(firsts.join(least, "component").select("id", "component_id"), "groups")
    known = marks.filter("id is not null").join(groups, "id").select("doc_id", "n", "component_id", *extra)
    empty = marks.filter("id is null").select("doc_id", "n", F.col("doc_id").alias("component_id"), *extra)
    out = known.unionByName(empty)
    return out.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), *[F.col(n).alias(n.removeprefix("_carry_")) for n in extra])


def united(named: DataFrame, links: DataFrame) -> DataFrame:
    """``named`` (``id``, ``component``) with components joined by ``links`` (``u``, ``v``) between them."""
    final = components(links).select(F.col("id").alias("component"), F.col("component").alias("last"))
    return saved(named.join(final, "component", "left").select("id", F.coalesce("last", "component").alias("component")), "named")


def prefixes(shingles: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, part: int, whole: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the ``shingles`` of consecutive sets belong to the prefixes, as indexes, and their places in the order of their set.

    The order is by the sketch's count, then by value. Sets that are linked share ``ceil(n * part / whole)`` or more of the ``n`` shingles of
    either, so they share one among the first ``n - ceil(n * part / whole) + 1``. A shingle that the sketch counts once is in no other set.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    count = sketch[slots(shingles)]
    order = np.lexsort((shingles, count, owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    longest = sizes - -(-sizes * part // whole) + 1
    take = (place < longest[owner]) & (count[order] > 1)
    return order[take], place[take]


def slots(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ _GOLD) >> _U(64 - SKETCH_BITS)).astype(np.int64)


def by_prefixes(parted: DataFrame, sets: DataFrame, open_ids, part: int, whole: int) -> DataFrame:
    """All links (``u``, ``v``) between the components of ``parted`` (``id``, ``component``), by a join of rare-shingle prefixes.

    Shingles are ordered by a sketch of their counts of fixed size; another order would only make more pairs, not lose one.
    ``open_ids`` is a filter of the ids (what it lets pass by chance is dropped by the join).
    """

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                piece = batch.slice(a, 2000)
                piece = piece.filter(pa.array(open_ids.value.passing(piece.column(0).to_numpy().view(np.uint64))))
                if piece.num_rows:
                    yield piece.column(0).to_numpy(), np.diff(piece.column(1).offsets.to_numpy()).astype(np.int64), piece.column(1).flatten().to_numpy().view(np.uint64)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, _, shingles in chosen(batches):
            np.add.at(n, slots(shingles), 1)
        at = np.flatnonzero(n)
        for a in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 100_000].astype(np.int32)), pa.array(n[at[a : a + 100_000]])], ["slot", "n"])

    plain = sets.select("id", "shingles")
    found = plain.mapInArrow(counted, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # 2 ** SKETCH_BITS rows at most
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    sketch[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(np.minimum(sketch, np.iinfo(np.uint32).max).astype(np.uint32))

    def prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sizes, shingles in chosen(batches):
            at, place = prefixes(shingles, sizes, shared.value, part, whole)
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            columns = [shingles[at].view(np.int64), ids[row], sizes[row].astype(np.int32), place.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["shingle", "id", "n", "place"])

    rows = saved(plain.mapInArrow(prefixed, "shingle bigint, id bigint, n int, place int").join(parted, "id"), "prefixes")
    other = rows.select("shingle", *[F.col(c).alias(f"other_{c}") for c in ("id", "n", "place", "component")])
    # the first shingle that a linked pair shares leaves room for all the others that it must share
    room = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    sure = (F.col("component") < F.col("other_component")) & ((whole + part) * room >= part * (F.col("n") + F.col("other_n")))
    open_pairs = saved(rows.join(other, "shingle").filter(sure).select("id", "other_id", "component", "other_component").distinct(), "open")
    other_sets = sets.select(F.col("id").alias("other_id"), F.col("shingles").alias("other"))
    both, all_of = F.size(F.array_intersect("shingles", "other")), F.size("shingles") + F.size("other")
    judged = open_pairs.join(sets, "id").join(other_sets, "other_id").select(F.col("component").alias("u"), F.col("other_component").alias("v"), both.alias("both"), all_of.alias("sum"))
    return judged.filter(whole * F.col("both") >= part * (F.col("sum") - F.col("both"))).select("u", "v").distinct()


def within_families(named: DataFrame, families: DataFrame, sets: DataFrame, part: int, whole: int, block: int) -> DataFrame:
    """Links (``u``, ``v``) between components of one family, from all comparisons that hubs left open.

    ``named`` has ``id`` and ``component``, ``families`` the components (``id``) of families (``component``).
    """
    family = families.select(F.col("id").alias("component"), F.col("component").alias("family"))
    members = saved(named.join(family, "component"), "members")
    sizes = saved(members.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n")), "sizes")
    largest = sizes.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("main"))
    largest = saved(largest.select("family", "main.component", (F.col("all") - F.col("main.n")).alias("others"), "all").withColumnRenamed("component", "main"), "families")
    placed = members.join(largest, "family").join(sets, "id")
    blocks = F.ceil(F.col("all") / block).cast("bigint")
    turns = F.ceil(F.col("others") / block).cast("bigint")
    every = F.sequence(F.lit(0).cast("bigint"), turns - 1)
    rows = placed.withColumn("block", F.pmod(F.xxhash64("id"), blocks)).withColumn("turn", F.explode(every)).withColumn("asks", F.lit(False))
    asking = placed.filter("component != main").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    asking = asking.withColumn("turn", F.pmod(F.xxhash64("id", F.lit("turn")), turns)).withColumn("asks", F.lit(True))
    columns = ["family", "block", "turn", "component", "asks", "shingles"]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        have, ask = group[~asks], group[asks]
        found: set[tuple[int, int]] = set()
        if len(have) and len(ask):
            shingles = list(have["shingles"])
            size = np.array([len(s) for s in shingles])
            owner = np.repeat(np.arange(len(size)), size)
            flat = np.concatenate(shingles)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            names = have["component"].to_numpy()
            for own, s in zip(ask["component"].tolist(), ask["shingles"]):
                s = np.sort(np.asarray(s))
                low, high = np.searchsorted(flat, s, "left"), np.searchsorted(flat, s, "right")
                n = high - low
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                both = np.bincount(owner[at], minlength=len(size))
                hit = (whole * both >= part * (size + len(s) - both)) & (names != own)
                found.update((own, other) for other in np.unique(names[hit]).tolist())
        return pd.DataFrame(sorted(found), columns=["u", "v"], dtype="int64")

    both = rows.select(*columns).unionByName(asking.select(*columns))
    return saved(both.groupBy("family", "block", "turn").applyInPandas(compare, "u bigint, v bigint").distinct(), "links")

"""Source divergence audit: which sources of a language use its terms differently, and which terms tell.

Terms are counted per (language, source); a language keeps those in at least
``least_docs`` of its documents. Use in a group is smoothed to a whole number
per thousand million, so all arithmetic is exact.

1. One scan counts terms in the tasks (bounded tables, written out when full); sums
   and document frequencies per (language, term) need one shuffle and give one
   row a kept term with its uses by source, which is written.
2. Terms (count-cell ranking): terms of a group with equal (group count, language
   count) are one cell, and the excess is evaluated once a cell. Cells are ranked
   by excess, equal values are merged, and the multiplicities before a value give
   its first rank. Only cells that begin within the top are expanded into terms,
   in UTF-8 order.
3. Pairs: the terms of a language are dealt to blocks of at most ``block`` counts
   (terms times sources); a block adds up the distances of all its pairs of sources
   and the partial sums are added.

No group of rows grows with the corpus: ranked lists are cut in the map tasks, blocks
are bounded, and what is one row a source (headers, rankings of pairs) is bounded by
the sources of a language.

Cases: null text, language or source count as ''; documents without terms still
name their group; a group without kept terms has the smoothed rates of no
uses; a language without kept terms gives pairs of value 0 and no terms; a
language with one source gives no pairs; repeated rows are counted again; other columns are
ignored; an empty table gives an empty result. Totals are exact while those of a
group stay below 9 * 10**15.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.store import saved

PRIOR = 5

#: A-Z become a-z, all other ASCII but a-z becomes a space: what split() leaves are the terms.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_SLICE = 1 << 20


def _slices(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a folded text, about a megabyte of text at a time."""
    begin = 0
    while begin < len(raw):
        cut = raw.find(b" ", begin + _SLICE) if len(raw) - begin > _SLICE else -1
        end = len(raw) if cut < 0 else cut
        yield raw[begin:end].split()
        begin = end


def _counted(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Uses and documents of each (lang, source, term) of the rows (lang, source, text) seen since the last output."""
    tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def rows() -> pa.RecordBatch:
        sizes = [len(uses) for uses, _ in tables.values()]
        names = [pa.array([key[k] for key in tables], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))) for k in (0, 1)]
        terms = pa.array([t for uses, _ in tables.values() for t in uses], pa.binary()).cast(pa.string())
        numbers = [pa.array([n for pair in tables.values() for n in (pair[0].values() if k == 0 else map(pair[1].__getitem__, pair[0]))], pa.int64()) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*names, terms, *numbers], names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), batch[2]):
            uses, docs = tables.setdefault((lang, source), (Counter(), Counter()))
            met: set[bytes] = set()
            for terms in _slices(text.as_py().encode().translate(_FOLD)):
                uses.update(terms)
                met.update(terms)
            docs.update(met)
            if sum(len(u) for u, _ in tables.values()) > most:
                yield rows()
                tables.clear()
    if tables:
        yield rows()


def kept_terms(docs: DataFrame, least_docs: int = 30, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", table: int = 400_000) -> DataFrame:
    """``lang``, ``term``, ``total`` and ``uses`` (array of ``source``, ``n``) of the terms in at least ``least_docs`` documents of a language.

    ``table`` bounds the counts that a task holds before it writes them out.
    """
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = rows.mapInArrow(lambda batches: _counted(batches, table), "lang string, source string, term string, n long, docs long")
    # one exchange serves both aggregations: rows of a term are together
    groups = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = groups.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("uses"))
    return terms.filter(F.col("docs") >= least_docs).select("lang", "term", "total", "uses")


def rate(count: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``1 + floor(10**9 * (count + 5) / size)`` in whole numbers: three digits of a long division to the base of 1,000."""
    whole, rest = 0, count + PRIOR
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, size)
        whole = whole * 1000 + digit
    return whole + 1


def rate_of(count: str, size: str) -> Column:
    """The same of two columns."""
    first = f"(({count} + {PRIOR}) * 1000)"
    second = f"({first} % {size} * 1000)"
    third = f"({second} % {size} * 1000)"
    return F.expr(f"{first} div {size} * 1000000 + {second} div {size} * 1000 + {third} div {size} + 1")


def sizes_of(docs: DataFrame, terms: DataFrame, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per (lang, source) of the documents: ``size`` and ``lang_size`` (uses plus prior), ``kept`` (terms of the language)."""
    groups = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    uses = terms.select("lang", F.explode("uses").alias("u")).groupBy("lang", F.col("u.source").alias("source")).agg(F.sum("u.n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("total"))
    joined = groups.join(uses, ["lang", "source"], "left").join(langs, "lang", "left")
    prior = F.coalesce("kept", F.lit(0)) * PRIOR
    return joined.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), (F.coalesce("n", F.lit(0)) + prior).alias("size"), (F.coalesce("total", F.lit(0)) + prior).alias("lang_size"))


def top_terms(terms: DataFrame, sizes: DataFrame, top: int = 50) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: the terms that a source uses more than its language, largest excess first, to rank ``top``."""
    uses = terms.select("lang", "term", "total", F.explode("uses").alias("u")).select("lang", F.col("u.source").alias("source"), "term", "total", F.col("u.n").alias("n"))
    group = ["lang", "source"]
    cells = uses.groupBy(*group, "n", "total").agg(F.count(F.lit(1)).alias("many")).join(sizes, group)
    cells = cells.select(*group, "n", "total", "many", (rate_of("n", "size") - rate_of("total", "lang_size")).alias("value")).filter("value > 0")
    # a cell with `top` larger ones before it cannot be reached; equal values share a rank and stay together
    cells = cells.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(F.desc("value")))).filter(F.col("place") <= top)
    merged = cells.groupBy(*group, "value").agg(F.sum("many").alias("many"), F.collect_set(F.struct("n", "total")).alias("cells"))
    before = F.coalesce(F.sum("many").over(Window.partitionBy(*group).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = merged.withColumn("before", before).filter(F.col("before") < top).select(*group, "value", "before", F.inline("cells"))
    named = uses.join(wanted, [*group, "n", "total"])
    named = named.withColumn("at", F.row_number().over(Window.partitionBy(*group, "value").orderBy("term"))).filter(F.col("at") <= top)
    return named.select(*group, F.col("term").alias("item"), "value", (F.col("before") + F.col("at")).cast("int").alias("rank")).filter(F.col("rank") <= top)


def _distances(terms: pa.Table, header: pa.Table) -> pa.Table:
    """Sums over a block of terms of the distances of each pair of sources, as (lang, a, b, value)."""
    if not terms.num_rows or not header.num_rows:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    lang, sources = header["lang"][0].as_py(), header["sources"].combine_chunks()[0].values
    names, size = sources.field("source"), sources.field("size").to_numpy(zero_copy_only=False)
    uses = terms["uses"].combine_chunks()
    owner = np.repeat(np.arange(terms.num_rows), pc.list_value_length(uses).to_numpy(zero_copy_only=False))
    entry = uses.flatten()
    column = pc.index_in(entry.field("source"), value_set=names).to_numpy(zero_copy_only=False)
    table = np.tile(rate(np.zeros(len(size), np.int64), size), (terms.num_rows, 1))
    table[owner, column] = rate(entry.field("n").to_numpy(zero_copy_only=False), size[column])
    left, right, value = [], [], []
    for i in range(len(size) - 1):
        value.append(np.abs(table[:, i + 1 :] - table[:, i : i + 1]).sum(axis=0))
        left.append(np.full(len(size) - 1 - i, i))
        right.append(np.arange(i + 1, len(size)))
    if not value:
        return _distances(terms.slice(0, 0), header)
    left, right, value = map(np.concatenate, (left, right, value))
    return pa.table({"lang": pa.array([lang] * len(value), pa.string()), "a": names.take(pa.array(left)), "b": names.take(pa.array(right)), "value": pa.array(value, pa.int64())})


def pair_distances(terms: DataFrame, sizes: DataFrame, block: int = 1 << 15) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: the other sources of each source's language, farthest first."""
    headers = sizes.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "size"))).alias("sources"), F.max("kept").alias("kept"))
    headers = headers.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("kept") * F.size("sources") / F.lit(block))).cast("int"))
    dealt = terms.join(headers.select("lang", "blocks"), "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("shard"), "uses")
    heads = headers.select("lang", "sources", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks").cast("bigint") - 1)).alias("shard"))
    parts = dealt.groupBy("lang", "shard").cogroup(heads.groupBy("lang", "shard")).applyInArrow(_distances, "lang string, a string, b string, value long")
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").union(sums.select("lang", F.col("b"), F.col("a"), "value"))
    groups = sizes.select("lang", "source")
    # the result itself is one row a pair of sources
    pairs = groups.join(groups.withColumnRenamed("source", "item"), "lang").filter("source <> item").join(both, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.select("lang", "source", "item", "value", F.row_number().over(order).alias("rank"))


def audit(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", block: int = 1 << 15, table: int = 400_000) -> DataFrame:
    """``lang``, ``source``, ``part`` (``pair`` or ``term``), ``item``, ``value``, ``rank`` for every source of every language."""
    terms = saved(kept_terms(docs, least_docs, text_col, lang_col, source_col, table), "terms")
    sizes = saved(sizes_of(docs, terms, lang_col, source_col), "sizes")
    parts = [pair_distances(terms, sizes, block).withColumn("part", F.lit("pair")), top_terms(terms, sizes, top).withColumn("part", F.lit("term"))]
    return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")

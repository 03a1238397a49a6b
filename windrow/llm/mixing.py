"""Mixing sources to target weights with Sainte-Laguë apportionment of equal-token blocks.

A source's words are laid out in a line: its documents are dealt to shards by a hash, and
stand in seeded order inside a shard. The line of each shard is cut into blocks of
``block`` words. Blocks are then given out by highest quotients ``weight / (2k + 1)``,
first to sources by their targets, then to each source's shards by their sizes, which
yields one integer quota for every shard. A shard with ``n`` blocks and quota ``q`` takes
each block ``q // n`` or ``q // n + 1`` times; which blocks get the extra turn is a
systematic selection with a seeded start over the seeded order. Its counts have a closed form, so
what a document gives is the difference of two values, and no block is ever a row.

Highest quotients without listing all seats: with ``S`` takers and ``N`` seats, rounding
``w (N - S/2) / W`` gives seats that are won for certain, and rounding ``w (N + S/2) / W``
bounds what can be won. Only the seats in between (at most 2 S) are ranked.

At scale: sources are aggregated first; ranks over sources come from range partitions with
offsets; the documents are shuffled once, by (source, shard), without their texts. A shard
has about ``shard_docs`` documents (a source has at most ``max_shards`` shards), so a source with a
third of all rows is many shards. Only sums of fixed size reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from windrow.llm.store import saved


def word_count(text: Column) -> Column:
    """Number of words (runs of characters other than space and tab to carriage return); null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its global position from 1 along ``order``: range partitions, their counts, offsets."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = saved(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = place.groupBy(part.alias("_part")).count()  # one row for each partition
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return place.withColumn("_part", part).join(offsets, "_part").withColumn(name, F.col("_offset") + inside + 1).drop("_part", "_at", "_offset")


def with_targets(sources: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``target`` of each source: ``share`` of all sizes by weight, none above ``most`` times its size.

    ``sources`` has ``_source`` and ``_words``. Weights repeat along the sources in code point order, null
    last. The excess of sources at their limit goes to the others by weight, until none is above.
    """
    order = [F.col("_source").asc_nulls_last()]
    table = ranked(sources, order, "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    table = saved(table.withColumn("_weight", weight).withColumn("_limit", F.col("_words") * F.lit(float(most))), "sources")
    total = share * (table.agg(F.sum("_words")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        # sources at their limit for this level; the level only rises, so the set only grows
        at_limit = F.col("_limit") <= F.col("_weight") * F.lit(level)
        n, kept, open_weight = table.agg(F.count_if(at_limit), F.sum(F.when(at_limit, F.col("_limit"))), F.sum(F.when(~at_limit, F.col("_weight")))).first()
        if n == full or not open_weight:
            break
        full, level = n, max(0.0, total - (kept or 0.0)) / open_weight
    return table.withColumn("target", F.least(F.col("_limit"), F.col("_weight") * F.lit(level)) if open_weight else F.col("_limit"))


def apportioned(takers: DataFrame, weight: str, seats: Column, keys: list[str], tie: list[Column], name: str) -> DataFrame:
    """Sainte-Laguë seats of each ``_taker`` inside ``keys``, as column ``name``.

    ``seats`` is constant inside ``keys``. Equal quotients go by ``tie``. Without ``keys`` the ranking is over
    range partitions; with ``keys`` the takers of a key are ranked in a window, so their number must be bounded.
    """
    sums = [F.count(F.lit(1)).alias("_takers"), F.sum(weight).alias("_all")]
    if keys:
        joined = takers.join(takers.groupBy(*keys).agg(*sums), keys)
    else:
        count, total = takers.agg(*sums).first()
        joined = takers.withColumns({"_takers": F.lit(count), "_all": F.lit(total)})
    half = F.col("_takers") / 2

    def rounded(n: Column) -> Column:
        share = F.col(weight) * F.greatest(n, F.lit(0.0)) / F.col("_all")
        return F.when(F.col("_all") > 0, F.floor(share + 0.5)).otherwise(0).cast("bigint")

    joined = joined.withColumn("_seats", seats.cast("bigint"))
    bounded = saved(joined.withColumns({"_sure": rounded(F.col("_seats") - half), "_most": rounded(F.col("_seats") + half + 1)}), "quotas")
    rows = bounded.filter("_most > _sure").withColumn("_seat", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    rows = rows.withColumn("_quotient", F.col(weight) / (2 * F.col("_seat") - 1))
    best = [F.col("_quotient").desc(), *tie, F.col("_seat").asc()]
    if keys:
        won = bounded.groupBy(*keys).agg(F.sum("_sure").alias("_won"))
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*best))).join(won, keys)
    else:
        won = bounded.agg(F.sum("_sure")).first()[0] or 0
        rows = ranked(rows, best, "_place").withColumn("_won", F.lit(won))
    extra = rows.filter(F.col("_place") <= F.col("_seats") - F.col("_won")).groupBy("_taker").agg(F.count(F.lit(1)).alias("_extra"))
    quota = F.col("_sure") + F.coalesce("_extra", F.lit(0))
    return bounded.join(extra, "_taker", "left").withColumn(name, quota).drop("_takers", "_all", "_seats", "_sure", "_most", "_extra")


def _taken(docs, weights, share, most, block, seed, shard_docs, max_shards, id_col, text_col, source_col, carry) -> DataFrame:
    """Documents with ``_id``, ``_size``, ``_words``, ``target``, ``_taken`` and the carried columns under a prefix."""
    held = [docs[c].alias(f"_carry_{c}") for c in carry]
    rows = docs.select(docs[id_col].alias("_id"), docs[source_col].cast("string").alias("_source"), word_count(docs[text_col]).alias("_size"), *held)
    by_source = F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("null"))
    rows = rows.withColumns({"_key": by_source, "_turn": F.xxhash64(F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(seed))})
    if not carry:
        rows = saved(rows, "sized")

    stats = rows.groupBy("_key", "_source").agg(F.sum("_size").alias("_words"), F.count(F.lit(1)).alias("_docs"))
    sources = saved(with_targets(stats, weights, share, most).withColumn("_taker", F.col("_key")), "targets")
    seats = round((sources.agg(F.sum("target")).first()[0] or 0.0) / block)
    sources = apportioned(sources, "target", F.lit(seats), [], [F.col("_source").asc_nulls_last()], "_quota")
    count = F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("_docs") / shard_docs))).cast("bigint")
    sources = saved(sources.select("_key", "_words", "target", "_quota", count.alias("_shards")), "sources")

    placed = rows.join(sources, "_key").withColumn("_shard", F.pmod(F.xxhash64("_turn", F.lit("shard")), F.col("_shards")))
    shards = placed.groupBy("_key", "_shard").agg(F.sum("_size").alias("_shard_words"), F.first("_quota").alias("_quota")).withColumn("_taker", F.concat_ws("/", "_shard", "_key"))
    shards = apportioned(shards, "_shard_words", F.col("_quota"), ["_key"], [F.col("_shard").asc()], "_shard_quota")
    n = F.ceil(F.col("_shard_words") / block).cast("bigint")
    shift = F.pmod(F.xxhash64("_shard", "_key", F.lit(seed)), F.greatest(n, F.lit(1)))
    shards = saved(shards.select("_key", "_shard", n.alias("_n"), F.least("_shard_quota", n * ceil(most)).alias("_q"), shift.alias("_shift")), "shards")

    line = Window.partitionBy("_key", "_shard").orderBy("_turn", F.col("_id").asc_nulls_last(), "_size")
    end = F.sum("_size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lined = placed.withColumn("_end", end).join(shards, ["_key", "_shard"])

    def turns(k: str) -> Column:
        """Turns at the first ``k`` places of the cycle."""
        return F.expr(f"(({k}) * _q) div _n")

    def turns_before(b: str) -> Column:
        """Turns that the first ``b`` blocks get; the cycle starts at ``_shift``."""
        wrapped = F.col("_q") - turns("_shift") + turns(f"({b}) + _shift - _n")
        return F.when(F.expr(f"({b}) + _shift <= _n"), turns(f"({b}) + _shift") - turns("_shift")).otherwise(wrapped)

    def words_before(x: str) -> Column:
        """Words taken from the first ``x`` words of the line."""
        b, rest = f"(({x}) div {block})", F.expr(f"({x}) % {block}")
        return turns_before(b) * block + F.when(rest == 0, F.lit(0)).otherwise((turns_before(f"{b} + 1") - turns_before(b)) * rest)

    taken = F.when(F.col("_size") > 0, words_before("_end") - words_before("_end - _size")).otherwise(0)
    return lined.withColumn("_taken", taken.cast("bigint"))


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 0, shard_docs: int = 500, max_shards: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per document: ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken``.

    ``size`` counts words; ``taken`` is the number of words that the mix takes, repeats counted, at most
    ``ceil(most)`` times the size.

    Cases: a null or empty text has size 0 and gives nothing; null sources are one source, ordered
    last; a null id is hashed like an empty one; repeated rows are separate documents; equal seeded
    places are ordered by id and size; an empty table, or one without words, takes nothing; other columns are ignored.
    """
    out = _taken(docs, weights, share, most, block, seed, shard_docs, max_shards, id_col, text_col, source_col, [])
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_words").alias("source_size"), "target", F.col("_taken").alias("taken"))


def mixed(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 0, shard_docs: int = 500, max_shards: int = 4096,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    A document of which ``x`` times its size is taken (0 to ``ceil(most)``) appears ``floor(x)`` times, and once more by a
    seeded draw with the remainder as its chance, so a source's words come near its target and whole
    texts stay whole. Documents without words are not part of a mix.
    """
    out = _taken(docs, weights, share, most, block, seed, shard_docs, max_shards, id_col, text_col, source_col, docs.columns)
    draw = F.pmod(F.xxhash64("_turn", F.lit("draw")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("_size") > 0, F.floor(F.col("_taken") / F.col("_size") + draw)).otherwise(0).cast("int")
    kept = out.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    return kept.select(*[F.col(f"`_carry_{c}`").alias(c) for c in docs.columns])

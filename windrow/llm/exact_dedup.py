"""Exact duplicates by progressive refinement.

Length, then a hash of the first characters, then a hash of the whole text: each
level looks only at the groups that the one before left with two rows or more.

1. One scan gives each text's length and prefix hash. They are counted together
   (a pair is the prefix level inside its length group), with map-side partial
   counts; only the pairs met twice or more are kept. No text is shuffled.
2. A second scan hashes whole texts, and only those in a kept pair: the pairs are
   broadcast while they number at most ``broadcast_pairs`` (16 bytes each);
   beyond that every text is hashed in the scan, which needs no join.
3. Rows with equal full hash (SHA-256) are one group. Its size and smallest id come
   from an aggregate and are joined back, so a group with a third of all rows is
   combined before the shuffle and can be split in the join.

Cases: a null text counts as empty; a text is compared after each run of white space
(space, tab to carriage return) became one space; null ids come last when the
smallest is chosen; of repeated rows with one id exactly one is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from windrow.llm.store import saved


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None, prefix_chars: int = 256, broadcast_pairs: int = 500_000
) -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept`` and what ``carry`` adds.

    ``carry`` names further columns, as expressions over ``docs``. ``prefix_chars``
    is the length of the hashed prefix in characters.
    """
    extra = {f"_carry_{name}": column for name, column in (carry or {}).items()}
    text = normalised(docs[text_col])
    prefix = F.xxhash64(F.substring(F.col("_text"), 1, prefix_chars))
    rows = docs.select(docs[id_col].alias("_id"), text.alias("_text"), *[c.alias(n) for n, c in extra.items()])
    keyed = rows.select("*", F.length("_text").alias("_length"), prefix.alias("_prefix"))

    pairs = saved(keyed.groupBy("_length", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_length", "_prefix"), "pairs")
    if pairs.count() <= broadcast_pairs:
        keyed = keyed.join(F.broadcast(pairs.withColumn("_shared", F.lit(True))), ["_length", "_prefix"], "left")
    else:
        keyed = keyed.withColumn("_shared", F.lit(True))

    # rows that share nothing get a key of their own kind, spread by their prefix hash
    alone = F.concat_ws(":", "_length", "_prefix")
    hashed = saved(
        keyed.select("_id", *extra, F.col("_shared").isNotNull().alias("_shared"), F.when(F.col("_shared"), F.sha2("_text", 256)).otherwise(alone).alias("_hash")).withColumn("_row", F.monotonically_increasing_id()),
        "hashed",
    )
    first = F.min(F.struct(F.col("_id").isNull().alias("missing"), F.col("_id").alias("id"), F.col("_row").alias("row")))
    groups = saved(hashed.filter("_shared").groupBy("_hash").agg(first.alias("_first"), F.count(F.lit(1)).alias("_size")).filter("_size > 1"), "groups")
    joined = hashed.join(groups, "_hash", "left")
    return joined.select(
        F.col("_id").alias("doc_id"),
        F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("_first.row") == F.col("_row"), F.lit(True)).alias("kept"),
        *[F.col(n).alias(n.removeprefix("_carry_")) for n in extra],
    )

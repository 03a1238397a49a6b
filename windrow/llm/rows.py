"""Keeping the rows of a table that an operator names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NAME, DIGEST = "_windrow_name", "_windrow_digest"


def named(id_column: Column) -> Column:
    """Text form of an id, different for null and any value."""
    return F.coalesce(F.concat(F.lit("="), id_column.cast("string")), F.lit("null"))


def only(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", digest: Column | None = None) -> DataFrame:
    """The rows of ``docs`` whose id (and ``digest``, an expression over ``docs``) is in ``kept`` (``doc_id``, ``digest``).

    With a digest, rows that agree in both are one row; without one, all rows of an id in ``kept`` stay. Join keys are
    unique on the side of ``kept``, and both steps use one partitioning, so texts are shuffled once.
    """
    if digest is None:
        keys = kept.select(named(F.col("doc_id")).alias(NAME)).distinct()
        return docs.withColumn(NAME, named(docs[id_col])).join(keys, NAME, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    keys = kept.select(named(F.col("doc_id")).alias(NAME), F.col("digest").alias(DIGEST)).distinct()
    rows = docs.withColumns({NAME: named(docs[id_col]), DIGEST: digest}).join(keys, [NAME, DIGEST], "left_semi")
    return rows.dropDuplicates([NAME, DIGEST]).select(*[F.col(f"`{c}`") for c in docs.columns])

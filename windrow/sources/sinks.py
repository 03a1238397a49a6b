"""Writers: parquet and CSV tables, timelines, per-media partitions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from windrow.operators.timeline import to_json_lines


def write_table(df: DataFrame, path: str, parquet: bool = True, csv: bool = False, columns: list[str] | None = None) -> None:
    """Table to ``path.parquet`` and/or ``path.csv`` folders. Nested columns are left out of CSV; null is blank there."""
    if columns:
        df = df.select(*columns)
    if parquet:
        df.write.mode("overwrite").parquet(path + ".parquet")
    if csv:
        flat = [f.name for f in df.schema.fields if not isinstance(f.dataType, (ArrayType, MapType, StructType))]
        df.select(*flat).write.mode("overwrite").option("header", True).option("emptyValue", "").option("nullValue", "").csv(path + ".csv")


def write_media_partitions(df: DataFrame, path: str) -> None:
    """Replace only the media present in ``df``; a rerun of one recording leaves the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("media_id").parquet(path)


def write_timeline(frames: DataFrame, header: dict, path: str) -> None:
    """Timeline as JSON lines next to a one-line header document."""
    to_json_lines(frames).write.mode("overwrite").text(path + "/frames")
    write_text(frames.sparkSession, json.dumps(header), path + "/header")


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A short text (report, header, model) through Spark's writer, so that any file system works."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_model(spark: SparkSession, description: dict, path: str) -> None:
    write_text(spark, json.dumps(description), path)


#: Rows of a listing in a report; the tables next to it are whole.
SAMPLE_ROWS = 25


def write_report(path: str, title: str, samples: dict[str, tuple[DataFrame, list[str]]] | None = None, **frames: DataFrame) -> None:
    """Summary tables in full below ``path``, and an index with the number of rows of each.

    ``samples`` are tables of which the index lists the first ``SAMPLE_ROWS`` rows in the order of the named columns.
    """
    lines = [f"# {title}", ""]
    for name, frame in frames.items():
        write_table(frame, f"{path}/{name}", csv=True)
        lines.append(f"{name}: {frame.sparkSession.read.parquet(f'{path}/{name}.parquet').count()} rows")
    for name, (frame, order) in (samples or {}).items():
        known = [c for c in order if c in frame.columns]
        lines += ["", f"## {name}: first {SAMPLE_ROWS} rows by {', '.join(known)}", "", "| " + " | ".join(frame.columns) + " |", "|" + "---|" * len(frame.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in row) + " |" for row in frame.orderBy(*[F.col(c).asc_nulls_last() for c in known]).limit(SAMPLE_ROWS).collect()]
    write_text(next(iter({**frames, **{n: f for n, (f, _) in (samples or {}).items()}}.values())).sparkSession, "\n".join(lines), f"{path}/index")


def copy_tables(tables: dict[str, DataFrame], folder: str, csv: bool = True) -> None:
    """Second copy of several tables for another consumer."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}", parquet=not csv, csv=csv)


__all__ = ["write_table", "write_media_partitions", "write_timeline", "write_text", "write_model", "write_report", "copy_tables"]

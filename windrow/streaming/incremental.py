"""Picking up where the last run stopped.

Long runs save their results after every recording and, when started again,
handle only what is missing. Here the stream checkpoint keeps track of which
manifest files were handled, and each micro-batch replaces the partitions of
its own recordings, so a batch that is run twice leaves one copy.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from windrow.operators.windowing import sliding_windows
from windrow.settings import WindowSettings
from windrow.sources.sinks import write_media_partitions
from windrow.sources.tables import schema


def stream_manifests(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Manifest parquet files as they arrive."""
    return spark.readStream.schema(schema("media_manifest")).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_pending(source: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to everything not handled yet, then stop."""
    def handle(batch: DataFrame, _: int) -> None:
        write_media_partitions(work(batch), output)

    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def index_pending(spark: SparkSession, manifests: str, output: str, checkpoint: str, settings: WindowSettings = WindowSettings()) -> StreamingQuery:
    """Window index of new recordings."""
    return run_pending(stream_manifests(spark, manifests), lambda media: sliding_windows(media, settings), output, checkpoint)

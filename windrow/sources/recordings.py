"""Tables of many recordings, of which single recordings are replaced.

Rows lie in a fixed number of buckets by recording. Replacing recordings rewrites their buckets by dynamic partition overwrite; the log of
finished recordings (``media_id``, ``fingerprint``) is written afterwards and is what makes rows count: rows without their entry
are ignored, so a run that stops half way leaves a table that reads as before, plus the batches it finished.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from windrow.session import cut_lineage
from windrow.sources.tables import path_exists

KEYS = ["media_id", "fingerprint"]


class RecordingTable:
    """``path/rows`` and ``path/log``; ``buckets`` must stay the same for the life of a table."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def _bucket(self):
        return F.pmod(F.xxhash64("media_id"), F.lit(self.buckets)).cast("int")

    def log(self) -> DataFrame | None:
        """Current entry of every recording: ``media_id``, ``fingerprint``, ``version``."""
        if not path_exists(self.spark, f"{self.path}/log"):
            return None
        entries = self.spark.read.parquet(f"{self.path}/log")
        latest = entries.groupBy("media_id").agg(F.max_by(F.struct("fingerprint", "removed", "version"), "version").alias("_e"))
        return latest.select("media_id", "_e.*").filter("NOT removed").select(*KEYS, "version")

    def rows(self) -> DataFrame | None:
        """Rows of finished recordings, with ``media_id`` and ``fingerprint``."""
        log = self.log()
        if log is None or not path_exists(self.spark, f"{self.path}/rows"):
            return None
        return self.spark.read.parquet(f"{self.path}/rows").drop("bucket").join(log.select(*KEYS), KEYS, "left_semi")

    def pending(self, media: DataFrame, force: bool = False) -> DataFrame:
        """Recordings of ``media`` (with ``fingerprint``) without a finished entry of that fingerprint."""
        log = self.log()
        return media if force or log is None else media.join(log.select(*KEYS), KEYS, "left_anti")

    def _written(self, done: DataFrame, removed: bool) -> None:
        entries = f"{self.path}/log"
        last = self.spark.read.parquet(entries).agg(F.max("version")).first()[0] if path_exists(self.spark, entries) else 0
        done.select(*KEYS, F.lit(removed).alias("removed"), F.lit(last + 1).cast("bigint").alias("version")).write.mode("append").parquet(entries)

    def replace(self, done: DataFrame, rows: DataFrame) -> None:
        """Put ``rows`` in place of all rows of the recordings ``done``; other recordings stay as they are."""
        done = cut_lineage(done.select(*KEYS).dropDuplicates(["media_id"]))
        new = rows.withColumn("bucket", self._bucket())
        if path_exists(self.spark, f"{self.path}/rows"):
            touched = done.select(self._bucket().alias("bucket")).distinct()
            old = self.spark.read.parquet(f"{self.path}/rows").join(touched, "bucket", "left_semi").join(done.select("media_id"), "media_id", "left_anti")
            new = new.unionByName(old, allowMissingColumns=True)
        # rows of one bucket in one file; the bucket's size is the recordings over the number of buckets
        new.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/rows")
        self._written(done, removed=False)

    def forget(self, media: DataFrame) -> int:
        """Drop recordings that are not in ``media`` any more; their rows go when their bucket is next written."""
        log = self.log()
        gone = cut_lineage(log.join(media.select("media_id"), "media_id", "left_anti")) if log is not None else None
        count = gone.count() if gone is not None else 0
        if count:
            self._written(gone, removed=True)
        return count

    def update(self, media: DataFrame, work: Callable[[DataFrame], DataFrame], batches: int = 1, force: bool = False, failed: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Measure what is pending and keep the rest; returns the number of recordings measured.

        ``work`` turns recordings into rows with ``media_id``. With several ``batches`` each is written when it is done, so a run
        that is stopped goes on from there. ``failed`` picks from the rows the recordings (``media_id``) that shall be tried again next time.
        """
        self.forget(media)
        todo = cut_lineage(self.pending(media, force))
        measured = 0
        for k in range(batches):
            part = todo.filter(F.pmod(F.xxhash64("media_id", F.lit(1)), F.lit(batches)) == k) if batches > 1 else todo
            size = part.count()
            if not size:
                continue
            rows = cut_lineage(work(part))
            done = part if failed is None else part.join(failed(rows), "media_id", "left_anti")
            self.replace(done, rows.join(done.select(*KEYS), "media_id"))
            measured += size
        return measured

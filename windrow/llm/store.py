"""Intermediate tables in the folder that the cluster shares.

A written table cuts the lineage: losing an executor costs a re-read, not a
recomputation, and several readers see one evaluation. Files stay until they
are ``removed`` or the folder of the application is; its name is ``windrow-llm/<application>``
under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager, nullcontext
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from windrow.session import checkpoint_dir


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, label: str, keep_shuffles: bool = True) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Without ``keep_shuffles`` the files of its shuffles go as soon as it is written, and not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/windrow-llm/{spark.sparkContext.applicationId}/{label}-{uuid4().hex}"
    with nullcontext() if keep_shuffles else setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Remove the files of ``saved`` tables that nothing reads any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)

"""Session helpers.

The library never assumes it owns the session: a cluster passes its own, and
everything here only fills in what is unset.
"""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "windrow") -> SparkSession:
    """A single-machine session for tests and benchmarks."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python gets at most ``rows`` rows at once from here on, unless the session already says how many.

    Executor and Python worker each hold a batch; Spark's 10,000 rows are tens of MB of whole texts in each.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(rows))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Only when ``spark.checkpoint.dir`` is unset (tests, a laptop) is a local
    folder created; a cluster must name a folder every executor can reach.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="windrow-checkpoint-")
    context.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that several readers see one evaluation.

    A table, not an RDD checkpoint: later readers take only the columns and row groups they need.
    """
    spark = df.sparkSession
    void = [name for name, kind in df.dtypes if kind == "void"]
    path = f"{checkpoint_dir(spark).rstrip('/')}/windrow/{spark.sparkContext.applicationId}/{uuid4().hex}"
    written = df.withColumns({name: F.lit(None).cast("string") for name in void})
    written.write.parquet(path)
    return spark.read.schema(written.schema).parquet(path)


def spread(df: DataFrame, *columns: str, rows: int | None = None, each: int = 250_000) -> DataFrame:
    """Spread rows for heavy per-row work: as many partitions as shuffles use, whatever the byte size.

    With a known number of ``rows`` so many that one holds about ``each``, and one for every core at least: a task then does
    not grow with the table.
    """
    spark = df.sparkSession
    if rows is None:
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    else:
        count = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return df.repartition(count, *columns)

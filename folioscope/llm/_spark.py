"""Session helpers: the shared folder, written intermediate tables, partition counts."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that a Python worker gets or returns, about.
BATCH_BYTES = 2 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only for a local master without it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="folioscope-"))


def written(df: DataFrame) -> DataFrame:
    """The rows of ``df`` from a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioscope_path = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete the tables of frames that ``written`` returned and that no later plan reads; others are left alone."""
    for df in frames:
        if location := getattr(df, "_folioscope_path", None):
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends Python workers batches of about ``BATCH_BYTES``, unless it has a bound of its own.

    Spark's bound of 10,000 rows lets a partition of long texts be a single batch, of which executor and worker
    each hold copies outside the heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def input_bytes(df: DataFrame) -> int:
    """The size of what a plan reads, by Catalyst's estimates: for scans that of their files; reads no data.

    Sources without an estimate count as nothing.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(s for s in sizes if s < 1 << 55)


def partitions(df: DataFrame, mb: int = 16, least: int | None = None) -> int:
    """Partitions of about ``mb`` MB of input each, at least spark.sql.shuffle.partitions."""
    least = least or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(input_bytes(df) / (mb << 20)))

"""Scans of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: Bytes of a table from which its scan has enough splits by itself.
SMALL_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt over all cores if the table is small and has fewer files than there are cores.

    A small file of one row group is one task, whatever the operators above it cost.  Larger tables
    are left as they are, and nothing moves.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > SMALL_BYTES or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table, spread if it is small."""
    return spread(spark.read.parquet(path))

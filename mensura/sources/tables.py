"""Readers of the project's tables: one folder, one parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes from which on a table is left as it is: it has splits enough, and moving all of it would cost more than it gains.
LARGE = 1 << 30


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as the session has cores, for work that is heavy per row.

    Only small tables, which may be one split, are moved; the planner's estimate of the size decides, nothing is read.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    if int(str(size)) > LARGE:
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df

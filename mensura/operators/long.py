"""Observations in long form: unions and the store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unpivot(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, Column]], variable: str = "variable", value: str = "value") -> DataFrame:
    """A row for each pair of variable and value of each row whose value isn't null; a variable may come several times."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(variable), v.cast("double").alias(value)) for n, v in pairs]))
    return df.select(*keys, each.alias("_p")).select(*keys, f"_p.{variable}", f"_p.{value}").where(F.col(value).isNotNull())


def union(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of all parts by column name; columns that a part lacks are null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def append(df: DataFrame, folder: str, by: str = "paper") -> None:
    """Adds observations to a store, one folder per paper."""
    df.write.mode("append").partitionBy(by).parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The store's observations, with the file that each comes from."""
    return spark.read.parquet(folder).withColumn("source_file", F.col("_metadata.file_path"))

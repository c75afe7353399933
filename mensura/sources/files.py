"""Readers and writers of files: documents, tables of text, stores and optional formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.operators.text import stem


def binary_documents(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """(paper, path, content) of the files of a folder, in the paths' order."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    return df.select(stem(F.col("path")).alias("paper"), "path", "content").orderBy("path")


def text_documents(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(paper, text) of the plain text files of a folder, each whole."""
    df = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    return df.select(stem(F.col("_metadata.file_path")).alias("paper"), F.col("value").alias("text"))


def csv(spark: SparkSession, path: str, schema: str | None = None, header: bool = True) -> DataFrame:
    """A CSV file, typed by a schema or all as text."""
    reader = spark.read.option("header", header).option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def csv_below_preamble(spark: SparkSession, path: str, header_row: int = 6) -> DataFrame:
    """A CSV file whose header is the given row (from 0), with the data below it; all as text.

    Rows before the header are dropped; the file's row order is that of one split, as such files are small and hand-made.
    """
    raw = spark.read.option("header", False).csv(path)
    numbered = raw.coalesce(1).withColumn("_n", F.monotonically_increasing_id())
    head = numbered.where(F.col("_n") == header_row).drop("_n").first()
    names = [str(v) if v is not None else f"column_{i}" for i, v in enumerate(head)]
    return numbered.where(F.col("_n") > header_row).drop("_n").toDF(*names)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """df with an ordinal (from 1) within its keys."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def parsed(documents: DataFrame, parse: Callable[[bytes], list[dict]], schema: str) -> DataFrame:
    """Rows that a reader makes of each document's content: (paper, schema's fields, error).

    A document that can't be read gives one row of nulls with the error's text; it stops nothing. For PDF words, text,
    tables and images pass a reader from mensura.sources.optional, if its library is installed.
    """
    fields = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for paper, content in zip(batch.paper, batch.content):
                try:
                    rows += [{"paper": paper, **{f: r.get(f) for f in fields}, "error": None} for r in parse(bytes(content))]
                except Exception as e:  # noqa: BLE001
                    rows.append({"paper": paper, **dict.fromkeys(fields), "error": f"{type(e).__name__}: {e}"})
            yield pd.DataFrame(rows, columns=["paper", *fields, "error"])

    return documents.select("paper", "content").mapInPandas(run, f"paper string, {schema}, error string")

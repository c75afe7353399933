"""Extraction over a stream of documents: an extension for sources that grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from mensura.plans.extraction import observations


def append_stream(documents: DataFrame, folder: str, checkpoint: str, **kwargs: str) -> StreamingQuery:
    """Starts a query that adds the observations of each new document of a stream to a parquet store, once each."""
    return observations(documents, **kwargs).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).partitionBy("normalized_variable").trigger(availableNow=True).start()

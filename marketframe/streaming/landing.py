"""Saved odds responses as a stream, with the batch operators on it.

A landing folder grows by files; each is read once, typed and flattened as in a
batch job, and written out exactly once under the query's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from marketframe.operators.nested import PAYLOADS, nullable, odds_table


def landed_stream(spark: SparkSession, path: str, payload: str = "event", files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(nullable(PAYLOADS[payload])).option("multiLine", True)
    return reader.option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_odds(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what has landed as flat rows, then stop; call again for what lands later."""
    out = odds_table(events).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True).start()

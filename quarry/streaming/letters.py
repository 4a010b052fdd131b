"""The first-letter count over a growing folder of text files (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.operators.counting import first_letter_count


def letter_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame ``ch, n``. Its state is one row for each letter, whatever the length of the stream."""
    return first_letter_count(spark.readStream.text(folder))


def run_available(counts: DataFrame, checkpoint: str, name: str) -> StreamingQuery:
    """Take in what is there and stop; a later run with the same checkpoint goes on from there."""
    writer = counts.writeStream.outputMode("complete").format("memory").queryName(name)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Running a streaming frame to the end of what is there, with its checkpoint in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from flowlark.session import shared_folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drain_to_parquet(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Processes all available input, writes Parquet, and returns the written rows.

    Started again with the same folders it goes on where it stopped.
    """
    running = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    running.trigger(availableNow=True).start(out).awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, step, checkpoint: str, mode: str = "append") -> None:
    """Processes all available input with `step(batch, epoch)`."""
    running = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    running.trigger(availableNow=True).start().awaitTermination()

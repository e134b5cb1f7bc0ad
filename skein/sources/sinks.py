"""Sinks: tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """``df`` as a Parquet table at ``path``, and that table read again."""
    df.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> StreamingQuery:
    """A stream into a table in the driver's memory: for tests and small results."""
    return stream.writeStream.format("memory").queryName(name).outputMode(mode).start()


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """A stream into a Parquet table with a folder for each batch, which a repeated batch replaces: each row arrives once."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

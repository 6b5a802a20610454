"""Sinks: message publishing, streaming result sinks, recent-rows tables, CSV.

Every sink takes the target as an argument (Kafka options, or a folder), so
the same pipeline runs against files in tests.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ticksmith.functions.codec import encode_row
from ticksmith.schema import PROCESSED_AT


def as_messages(df: DataFrame) -> DataFrame:
    """Every row as one JSON message in ``value`` (NULL fields omitted)."""
    return df.select(encode_row().alias("value"))


def publish(df: DataFrame, *, kafka_servers: str | None = None, topic: str | None = None,
            path: str | None = None) -> None:
    """Batch publish: one message per row to a topic, or to text files."""
    msgs = as_messages(df)
    if kafka_servers:
        (msgs.write.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
         .option("topic", topic).save())
    elif path:
        msgs.write.mode("overwrite").text(path)
    else:
        raise ValueError("give kafka_servers+topic or path")


def stream_sink(df: DataFrame, *, checkpoint: str, kafka_servers: str | None = None,
                topic: str | None = None, path: str | None = None,
                memory_name: str | None = None, encode: bool = True,
                mode: str = "append") -> DataStreamWriter:
    """Writer for one streaming result, each with its own checkpoint."""
    out = as_messages(df) if encode else df
    w = out.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    if kafka_servers:
        return (w.format("kafka").option("kafka.bootstrap.servers", kafka_servers)
                .option("topic", topic).option("failOnDataLoss", "false"))
    if memory_name:
        return w.format("memory").queryName(memory_name)
    if path:
        return w.format("text" if encode else "parquet").option("path", path)
    raise ValueError("give kafka_servers+topic, path or memory_name")


def with_receive_time(df: DataFrame) -> DataFrame:
    """Stamp rows with the receive time (one value per micro-batch)."""
    return df.withColumn(PROCESSED_AT, F.current_timestamp())


def idempotent_batch_writer(paths: dict[str, str],
                            split: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function writing several outputs of one micro-batch as JSON messages.

    Each output goes to ``<path>/batch=<id>`` with overwrite, so a replayed
    batch after a failure rewrites the same files instead of duplicating
    rows. The batch is persisted while it is split.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, part in split(batch).items():
                as_messages(part).write.mode("overwrite").text(f"{paths[name]}/batch={batch_id}")
        finally:
            batch.unpersist()
    return write

"""Message streams: the Kafka topic source and a file stand-in with the same shape.

Both produce a ``value`` column of message text, so everything downstream
(decode, windows, sinks) is the same code. The Kafka connector is not part of
the PySpark distribution; ``kafka_stream`` only builds the reader and fails
at ``load`` when the connector jar is absent.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticksmith.functions.codec import decode_lenient
from ticksmith.schema import RESULT_SCHEMAS

# Topic names and consumer settings of the pipeline.
INPUT_TOPIC = "bitcoin_data"
RESULT_TOPICS = {"price": "bitcoin_processed", "sma": "bitcoin_sma", "bb": "bitcoin_bb"}
ENGINE_GROUP = "bitcoin-spark-processor"
CONSUMER_GROUP_PREFIX = "bitcoin_consumers_"


def kafka_options(servers: str, topic: str, group_id: str | None = ENGINE_GROUP,
                  starting: str = "earliest", fail_on_data_loss: bool = False,
                  max_offsets_per_trigger: int | None = None) -> dict[str, str]:
    opts = {"kafka.bootstrap.servers": servers, "subscribe": topic,
            "startingOffsets": starting, "failOnDataLoss": str(fail_on_data_loss).lower()}
    if group_id:
        opts["kafka.group.id"] = group_id
    if max_offsets_per_trigger:
        # The per-trigger cap; a DStream rate setting has no effect here.
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    return opts


# Where a message came from (topic partition or file) and its place there
# (offset, or row number given by the table writer): the order of arrival
# within one micro-batch.
ARRIVAL_PART, ARRIVAL_SEQ = "arrival_part", "arrival_seq"


class KafkaConnectorMissing(RuntimeError):
    """The Kafka data source is not on the session's classpath."""


def _load_kafka(reader, spark: SparkSession) -> DataFrame:
    try:
        return reader.load()
    except AnalysisException as e:
        if "kafka" not in str(e).lower():
            raise
        raise KafkaConnectorMissing(
            "the Kafka data source is not on the classpath; start the session with "
            f"spark.jars.packages=org.apache.spark:spark-sql-kafka-0-10_2.13:{spark.version}") from e


def kafka_stream(spark: SparkSession, servers: str, topic: str = INPUT_TOPIC, **kw) -> DataFrame:
    reader = spark.readStream.format("kafka").options(**kafka_options(servers, topic, **kw))
    return _load_kafka(reader, spark).select(F.col("value").cast("string").alias("value"),
                                             F.col("timestamp").alias("arrival"), "partition", "offset")


def file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Message text files (one message per line) as a stream of ``value``, with the file each came from."""
    reader = spark.readStream.format("text").option("recursiveFileLookup", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path).select("value", F.col("_metadata.file_path").alias(ARRIVAL_PART))


def result_topic_options(servers: str, kind: str) -> dict[str, str]:
    """Reader options of one result topic: earliest offsets, its own consumer group."""
    if kind not in RESULT_TOPICS:
        raise ValueError(f"unknown result kind: {kind!r}")
    topic = RESULT_TOPICS[kind]
    return kafka_options(servers, topic, group_id=f"{CONSUMER_GROUP_PREFIX}{topic}")


def result_messages(spark: SparkSession, servers: str, kind: str) -> DataFrame:
    """One result topic's messages (``value`` text), as a stream."""
    raw = _load_kafka(spark.readStream.format("kafka").options(**result_topic_options(servers, kind)), spark)
    return raw.select(F.col("value").cast("string").alias("value"),
                      F.col("partition").cast("string").alias(ARRIVAL_PART), F.col("offset").alias(ARRIVAL_SEQ))


def result_stream(spark: SparkSession, servers: str, kind: str) -> DataFrame:
    """Typed rows of one result topic, as a stream (feeds a recent-rows table)."""
    return decode_results(result_messages(spark, servers, kind), kind)


def decode_results(messages: DataFrame, kind: str, schema: StructType | None = None) -> DataFrame:
    """Result-topic messages -> typed rows of that topic's schema.

    Messages encoded twice (a JSON string holding JSON) decode like plain
    ones.
    """
    if schema is None:
        if kind not in RESULT_SCHEMAS:
            raise ValueError(f"unknown result kind: {kind!r}")
        schema = RESULT_SCHEMAS[kind]
    keep = [c for c in messages.columns if c != "value"]
    return messages.select(*keep, decode_lenient("value", schema).alias("d")).select(*keep, "d.*")

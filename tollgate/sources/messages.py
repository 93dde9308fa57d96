"""Where messages come from and where records go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGE_SCHEMA = (
    "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
)


def kafka_source_options(
    brokers: str, topic: str, starting: str = "latest", max_offsets: int = 5_000_000, **extra: str
) -> dict[str, str]:
    """Options of a Kafka source. A trigger is bounded, so a busy key cannot grow without limit."""
    return {
        "kafka.bootstrap.servers": brokers,
        "subscribe": topic,
        "startingOffsets": starting,
        "maxOffsetsPerTrigger": str(max_offsets),
        "failOnDataLoss": "true",
        **extra,
    }


def kafka_sink_options(brokers: str, topic: str, **extra: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": brokers,
        "topic": topic,
        "kafka.compression.type": "gzip",
        "kafka.enable.idempotence": "true",
        "kafka.acks": "all",
        **extra,
    }


def kafka_messages(spark: SparkSession, options: dict[str, str]) -> DataFrame:
    """Stream from Kafka; needs the Kafka connector on the class path."""
    return spark.readStream.format("kafka").options(**options).load().selectExpr(
        "CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value", "topic", "partition", "offset", "timestamp"
    )


def write_kafka(records: DataFrame, options: dict[str, str]) -> None:
    """Batch write of key/value records to a topic; needs the Kafka connector on the class path."""
    records.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value").write.format("kafka").options(**options).save()


def stream_kafka(records: DataFrame, options: dict[str, str], checkpoint: str):
    """Streaming write of the same; at least once, so consumers go by the records' keys."""
    rows = records.selectExpr("CAST(key AS STRING) AS key", "CAST(value AS STRING) AS value")
    return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)


def file_messages(spark: SparkSession, path: str, max_files: int = 1_000) -> DataFrame:
    """Stream from Parquet files with the same columns."""
    return (
        spark.readStream.schema(MESSAGE_SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    )


def stored_messages(spark: SparkSession, path: str) -> DataFrame:
    """The same files as a batch."""
    return spark.read.schema(MESSAGE_SCHEMA).parquet(path)


def write_records(records: DataFrame, path: str) -> None:
    """Batch sink: key/value records as gzipped JSON lines."""
    records.select("key", "value").write.mode("append").option("compression", "gzip").json(path)


def stream_records(records: DataFrame, path: str, checkpoint: str):
    """Streaming sink of the same shape; the sink's own log makes it exactly-once."""
    return (
        records.select("key", "value").writeStream.format("json")
        .option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint)
    )

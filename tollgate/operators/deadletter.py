"""Dead-letter records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN_ERROR = "UnknownError"


def dead_letters(rejected: DataFrame, now_ms: Column | None = None) -> DataFrame:
    """Key of the message and ``{originalPayload, error, timestamp}``.

    The timestamp defaults to the message's own, so that a retried batch writes the same record.
    """
    at = F.unix_millis("timestamp") if now_ms is None else now_ms
    return rejected.select(
        "key",
        F.to_json(F.struct(
            F.col("value").alias("originalPayload"), F.col("error"), at.alias("timestamp"),
        )).alias("value"),
        F.col("value").alias("original_payload"), "error", at.alias("timestamp_ms"),
    )


def dead_letters_with_provenance(
    rejected: DataFrame, source_component: str = "tollgate", now_ms: Column | None = None
) -> DataFrame:
    """Records that say where the message came from; key is ``offset:errorType``."""
    at = F.unix_millis("timestamp") if now_ms is None else now_ms
    kind = F.coalesce("error_type", F.lit(UNKNOWN_ERROR))
    origin = F.struct(
        at.alias("timestamp"),
        F.lit(source_component).alias("sourceComponent"),
        kind.alias("errorType"),
        F.col("topic").alias("originalTopic"),
        F.col("partition").alias("originalPartition"),
        F.col("offset").cast("string").alias("originalOffset"),
    )
    return rejected.select(
        F.concat_ws(":", F.col("offset").cast("string"), kind).alias("key"),
        F.to_json(
            F.struct(origin.alias("metadata"), F.col("value").alias("payload"), F.col("signature")),
            {"ignoreNullFields": "false"},
        ).alias("value"),
        kind.alias("error_type"), "topic", "partition", "offset", "signature",
    )

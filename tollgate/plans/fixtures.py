"""Payment transactions derived from the ``events`` table (the view of FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators.signing import with_wire_envelope, with_wire_payload, wrap
from tollgate.params import Params
from tollgate.session import computed_once

# Parameters under which the test data has both flagged and approved rows.
FIXTURE_PARAMS = Params(
    velocity_window_s=21_600,
    velocity_threshold=2,
    merchant_blacklist="m-7,m-13,m-42",
    fraud_threshold=0.44,
    signing_key="fixture-signing-key",
    encryption_key="fixture-encryption-key",
    crypto_salt="fixture-salt",
)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events plus, for one in twenty, a replay five seconds later."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    arrived = events.select(
        "event_id", "user_id", "event_type", "value",
        F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), "ts").alias("us"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    replay = F.when(F.col("event_id") % 20 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return arrived.select("*", F.explode(replay).alias("is_replay")).withColumn(
        "proc_us", F.col("us") + F.col("is_replay") * 5_000_000
    )


def as_transactions(arrived: DataFrame) -> DataFrame:
    """The transaction columns of each message, whatever its event type."""
    event_id, user_id = F.col("event_id"), F.col("user_id")
    late_us = F.when(event_id % 30 == 11, 21_600_000_000).otherwise(0)
    jump = F.when(event_id % 10 == 0, 40.0).otherwise(0.0)
    return arrived.select(
        (F.col("proc_us") * 2 + F.col("is_replay")).alias("seq"),
        F.expr("proc_us div 1000").alias("proc_ms"),
        "is_replay",
        F.concat(F.lit("tx-"), event_id.cast("string")).alias("transaction_id"),
        F.concat(F.lit("user-"), user_id.cast("string")).alias("user_id"),
        F.concat(F.lit("m-"), F.col("k").cast("string")).alias("merchant_id"),
        F.round(F.col("value") * 100).cast("long").alias("amount"),
        F.lit("USD").alias("currency"),
        F.when(F.col("event_type") == "signup", "TransactionInitiated")
        .otherwise("TransactionValidated").alias("type"),
        ((F.col("us") - late_us) * 1000).alias("timestamp_ns"),
        (((user_id * 37) % 120 - 60).cast("double")
         + ((event_id * 7919) % 1000).cast("double") / 1000.0).alias("latitude"),
        (((user_id * 73) % 300 - 170).cast("double")
         + ((event_id * 104729) % 1000).cast("double") / 1000.0 + jump).alias("longitude"),
        "event_id", "event_type",
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted transactions: every message that is not an ``error`` event."""
    arrived = messages(spark, sf_dir).where(F.col("event_type") != "error")
    return as_transactions(arrived).drop("event_id", "event_type")


# The same view in the oracle's SQL dialect.
TXN_SQL = """
WITH e AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
  FROM events),
m AS (
  SELECT *, us AS proc_us, 0 AS is_replay FROM e
  UNION ALL
  SELECT *, us + 5000000 AS proc_us, 1 AS is_replay FROM e WHERE event_id % 20 = 0),
all_txn AS (
  SELECT proc_us * 2 + is_replay AS seq, proc_us // 1000 AS proc_ms, is_replay,
    concat('tx-', CAST(event_id AS VARCHAR)) AS transaction_id,
    concat('user-', CAST(user_id AS VARCHAR)) AS user_id,
    concat('m-', CAST(k AS VARCHAR)) AS merchant_id,
    CAST(round(value * 100) AS BIGINT) AS amount, 'USD' AS currency,
    CASE event_type WHEN 'signup' THEN 'TransactionInitiated' ELSE 'TransactionValidated' END AS type,
    (us - CASE WHEN event_id % 30 = 11 THEN 21600000000 ELSE 0 END) * 1000 AS timestamp_ns,
    CAST((user_id * 37) % 120 - 60 AS DOUBLE)
      + CAST((event_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS latitude,
    CAST((user_id * 73) % 300 - 170 AS DOUBLE)
      + CAST((event_id * 104729) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE)
      + CASE WHEN event_id % 10 = 0 THEN CAST(40 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS longitude,
    event_id, event_type
  FROM m),
txn AS (SELECT * EXCLUDE (event_id, event_type) FROM all_txn WHERE event_type <> 'error')
"""


# --- raw messages ------------------------------------------------------------------------

def complete_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as transaction rows with the remaining declared fields filled in."""
    event_id = F.col("event_id")
    return as_transactions(messages(spark, sf_dir)).withColumns({
        "device_fingerprint": F.concat(F.lit("fp-"), (event_id % 97).cast("string")),
        "ip_address": F.when(event_id % 7 == 0, "2001:db8::17").otherwise("10.1.2.3"),
        "user_agent": F.when(event_id % 11 == 0, 'agent "x" \\ 1').otherwise("agent/1.0"),
        "validator_id": F.when(F.col("type") == "TransactionValidated", "validator-1"),
        "reason": F.lit(None).cast("string"),
        "risk_score": F.lit(None).cast("double"),
    })


def delivered(rows: DataFrame, key: str = FIXTURE_PARAMS.signing_key) -> DataFrame:
    """Complete transactions as a broker delivers them, good and bad; columns that are not used cost nothing.

    Even events come as signed envelopes, odd ones bare. ``error`` events are broken by
    ``event_id % 6``: cut off, short currency, bad address, empty merchant, fractional amount,
    null value. One even event in fifty has its amount changed after signing.
    """
    event_id = F.col("event_id")
    fault = F.when(F.col("event_type") == "error", event_id % 6)
    tampered = fault.isNull() & (event_id % 50 == 4)
    rows = rows.withColumns({
        "currency": F.when(fault == 1, "US").otherwise(F.col("currency")),
        "ip_address": F.when(fault == 2, "not-an-ip").otherwise(F.col("ip_address")),
        "merchant_id": F.when(fault == 3, "").otherwise(F.col("merchant_id")),
    })
    signed = wrap(rows, key, F.col("proc_ms") * 1_000_000, "proc:1").withColumn(
        "amount", F.when(tampered, F.col("amount") + 1).otherwise(F.col("amount"))
    )
    is_envelope = event_id % 2 == 0
    wired = with_wire_envelope(with_wire_payload(signed, "_bare", is_envelope), "_envelope", "_bare")
    wired = wired.withColumn("_text", F.when(is_envelope, F.col("_envelope")).otherwise(F.col("_bare")))
    text = F.col("_text")
    value = (
        F.when(fault == 0, text.substr(F.lit(1), F.length(text) - 5))
        .when(fault == 4, F.regexp_replace(text, '"value":"[0-9]+"', '"value":"1.5"'))
        .when(fault == 5, F.lit(None))
        .otherwise(text)
    )
    return wired.select(
        F.when(event_id % 40 != 1, F.col("transaction_id")).alias("key"),
        value.alias("value"),
        F.lit("transactions-validated").alias("topic"),
        (event_id % 4).cast("int").alias("partition"),
        F.col("seq").alias("offset"),
        F.timestamp_millis("proc_ms").alias("timestamp"),
    )


def raw_messages(spark: SparkSession, sf_dir: str, key: str = FIXTURE_PARAMS.signing_key) -> DataFrame:
    """All events as messages. Their texts are made once, whatever is filtered by them later."""
    # The test table is one small file; spread the signing over the cores, in tasks that stay short
    # when it is a large one. By key: dealing rows out in turn would sort them first.
    tasks = 4 * spark.sparkContext.defaultParallelism
    messages = delivered(complete_transactions(spark, sf_dir).repartition(tasks, "seq", "event_id"), key)
    return computed_once(messages, ["value"]).select(messages.columns)


# The rows of the raw view with the error class each message must get.
RAW_SQL = TXN_SQL + """,
raw AS (
  SELECT CASE WHEN event_id % 40 <> 1 THEN transaction_id END AS key, seq AS offset_,
    CAST(event_id % 4 AS INTEGER) AS partition_,
    event_id % 2 = 0 AS is_envelope,
    CASE WHEN event_type = 'error' THEN CASE event_id % 6
        WHEN 0 THEN 'SyntaxError' WHEN 2 THEN 'EnvelopeValidationError'
        WHEN 4 THEN 'EnvelopeValidationError' WHEN 5 THEN NULL ELSE 'SchemaValidationError' END
      WHEN event_id % 50 = 4 THEN 'SecurityViolationError' END AS error_type,
    event_type = 'error' AND event_id % 6 = 5 AS is_tombstone,
    CASE WHEN event_type = 'error' THEN event_id % 6 END AS fault,
    event_type <> 'error' AND event_id % 50 = 4 AS is_tampered,
    all_txn.* EXCLUDE (event_type)
  FROM all_txn)
"""

"""Raw messages -> validated transactions, or a reason why not.

Messages have ``key, value, topic, partition, offset, timestamp`` as a Kafka source has them
(key and value as text).
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.net import is_ip
from tollgate.functions.numeric import json_integer
from tollgate.operators.running import PIECE, Running, find_split, running
from tollgate.operators.signing import new_metadata, with_mac
from tollgate.operators.state import arrival, arrival_seq
from tollgate.session import computed_once

# The three event types.
INITIATED, VALIDATED, FLAGGED = "TransactionInitiated", "TransactionValidated", "TransactionFlagged"

# Names of the error classes that a rejected message can have.
SYNTAX_ERROR = "SyntaxError"
ENVELOPE_ERROR = "EnvelopeValidationError"
SCHEMA_ERROR = "SchemaValidationError"
SIGNATURE_ERROR = "SecurityViolationError"

NUMBER_KINDS = r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)"

def drop_tombstones(messages: DataFrame) -> DataFrame:
    """A null value is skipped without a trace; empty text is kept (it is a syntax error)."""
    return messages.where(F.col("value").isNotNull())


def with_json(messages: DataFrame) -> DataFrame:
    """Add ``json`` (VARIANT); null if the value is not exactly one JSON text.

    The parser stops after the first JSON value and ignores what follows. So the value is read
    as the first entry of an array whose second entry is a mark that is drawn anew for each plan:
    text after the value breaks the array or moves the mark, and cannot contain it.
    """
    mark = secrets.token_hex(16)
    wrapped = F.try_parse_json(F.concat(F.lit("["), F.col("value"), F.lit(f',"{mark}"]')))
    whole = F.try_variant_get(F.col("_wrapped"), "$[1]", "string") == F.lit(mark)
    return (
        messages.withColumn("_wrapped", wrapped)
        .withColumn("json", F.when(whole, F.variant_get(F.col("_wrapped"), "$[0]", "variant")))
        .drop("_wrapped")
    )


def _kind(value: Column) -> Column:
    """Type name of a JSON value; missing -> null."""
    return F.when(value.isNotNull(), F.schema_of_variant(value))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _truthy(path: str) -> Column:
    """JavaScript truth of a member: not missing, null, false, 0 or empty."""
    value = F.try_variant_get("json", path, "variant")
    kind, text = _kind(value), _text(value)
    falsy = (
        (kind == "VOID")
        | ((kind == "BOOLEAN") & (text == "false"))
        | ((kind == "STRING") & (text == ""))
        | (kind.rlike(NUMBER_KINDS) & (text.try_cast("double") == 0))
    )
    # Objects, the normal case, are recognised without spelling out their type.
    is_object = F.try_variant_get("json", path, "struct<schemaVersion: variant>").isNotNull()
    return F.when(is_object, True).otherwise(F.coalesce(~falsy, F.lit(False)))


def with_kind(parsed: DataFrame) -> DataFrame:
    """Add ``kind`` (``envelope`` or ``bare``)."""
    both = _truthy("$.metadata") & _truthy("$.payload")
    return parsed.withColumn(
        "kind", F.when(F.col("json").isNotNull(), F.when(both, "envelope").otherwise("bare"))
    )


# The declared members. Their values are taken from the parsed JSON untyped: their JSON type is part
# of the checks.
TEXTS = {
    "type": "type",
    "transaction_id": "transactionId",
    "user_id": "userId",
    "merchant_id": "merchantId",
    "currency": "amount.currency",
    "device_fingerprint": "telemetry.deviceFingerprint",
    "ip_address": "telemetry.ipAddress",
    "user_agent": "telemetry.userAgent",
    "validator_id": "validatorId",
    "reason": "reason",
}
NUMBERS = {
    "latitude": "telemetry.latitude",
    "longitude": "telemetry.longitude",
    "risk_score": "riskScore",
}


# The same members by their place, each as it is in the JSON, and those of an envelope.
TRANSACTION = (
    "struct<type: variant, transactionId: variant, userId: variant, merchantId: variant,"
    " amount: struct<value: variant, currency: variant>, timestamp: variant, telemetry: struct<latitude: variant,"
    " longitude: variant, deviceFingerprint: variant, ipAddress: variant, userAgent: variant>,"
    " validatorId: variant, reason: variant, riskScore: variant>"
)
ABOUT = (
    "struct<metadata: struct<schemaVersion: variant, createdAtNs: variant, provenanceTrace: variant>,"
    " signature: variant>"
)


def with_fields(parsed: DataFrame) -> DataFrame:
    """Add the declared fields, typed; a field of the wrong type is null, others are dropped."""
    in_envelope = F.col("kind") == "envelope"
    # The members are taken out of the JSON together: one walk over an object, not one search for each.
    read = parsed.withColumns({
        "is_json": F.col("json").isNotNull(),
        "_tx": F.when(in_envelope, F.try_variant_get("json", "$.payload", TRANSACTION))
        .otherwise(F.try_variant_get("json", "$", TRANSACTION)),
        "_about": F.when(in_envelope, F.try_variant_get("json", "$", ABOUT)),  # null for a bare message
    }).drop("json")
    integers = {
        "amount": F.col("_tx.amount.value"),
        "timestamp_ns": F.col("_tx.timestamp"),
        "created_at_ns": F.col("_about.metadata.createdAtNs"),
    }

    def text(path: str) -> Column:
        return F.when(_kind(F.col(path)) == "STRING", _text(F.col(path)))

    def number(path: str) -> Column:
        return F.when(_kind(F.col(path)).rlike(NUMBER_KINDS), F.try_variant_get(path, "$", "double"))

    typed = read.withColumns({
        **{name: text(f"_tx.{path}") for name, path in TEXTS.items()},
        **{name: number(f"_tx.{path}") for name, path in NUMBERS.items()},
        "_schema_version": text("_about.metadata.schemaVersion"),
        "_provenance": text("_about.metadata.provenanceTrace"),
        "signature": text("_about.signature"),
        **{f"_kind_{name}": _kind(value) for name, value in integers.items()},
        **{f"_text_{name}": _text(value) for name, value in integers.items()},
    }).drop("_tx", "_about")

    def integer(name: str) -> Column:
        return json_integer(F.col(f"_text_{name}"), F.col(f"_kind_{name}"))

    return typed.withColumns({
        "amount": integer("amount"),
        "timestamp_ns": integer("timestamp_ns").try_cast("bigint"),
        "metadata": F.when(in_envelope, F.struct(
            F.col("_schema_version").alias("schemaVersion"),
            integer("created_at_ns").try_cast("bigint").alias("createdAtNs"),
            F.col("_provenance").alias("provenanceTrace"),
        )),
    }).drop("_schema_version", "_provenance", *[f"_{part}_{name}" for part in ("kind", "text") for name in integers])


def _utf16_length(text: Column) -> Column:
    return F.octet_length(F.encode(text, "UTF-16BE")) / 2


def error_paths() -> Column:
    """Paths of the fields that break the schema, comma-separated; empty if it is valid."""
    def empty(name: str) -> Column:
        return F.coalesce(F.length(name), F.lit(0)) == 0

    def bad(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    kind = F.coalesce(F.col("type"), F.lit(""))
    known = kind.isin(INITIATED, VALIDATED, FLAGGED)
    transaction = {
        "transactionId": empty("transaction_id"),
        "userId": empty("user_id"),
        "merchantId": empty("merchant_id"),
        "amount.value": F.col("amount").isNull(),
        "amount.currency": bad(_utf16_length(F.col("currency")) == 3),
        "timestamp": F.col("timestamp_ns").isNull(),
        "telemetry.latitude": F.col("latitude").isNull(),
        "telemetry.longitude": F.col("longitude").isNull(),
        "telemetry.deviceFingerprint": empty("device_fingerprint"),
        "telemetry.ipAddress": bad(is_ip(F.col("ip_address"))),
        "telemetry.userAgent": empty("user_agent"),
        "validatorId": (kind == VALIDATED) & empty("validator_id"),
        "reason": (kind == FLAGGED) & empty("reason"),
        "riskScore": (kind == FLAGGED) & bad(F.col("risk_score").between(0, 1)),
    }
    envelope = {
        "metadata.schemaVersion": empty("metadata.schemaVersion"),
        "metadata.createdAtNs": F.col("metadata.createdAtNs").isNull(),
        "metadata.provenanceTrace": empty("metadata.provenanceTrace"),
        "signature": empty("signature"),
    }
    in_envelope = F.col("kind") == "envelope"
    return F.concat_ws(
        ", ",
        F.when(~known, "type"),
        *[F.when(known & failed, path) for path, failed in transaction.items()],
        *[F.when(in_envelope & failed, path) for path, failed in envelope.items()],
    )


def decode(messages: DataFrame) -> DataFrame:
    """Parse and validate: adds the fields, ``errors`` (paths), ``error_type`` and ``error``."""
    checked = with_fields(with_kind(with_json(drop_tombstones(messages)))).withColumn(
        "errors", F.when(F.col("is_json"), error_paths())
    )
    invalid = F.col("errors") != ""
    envelope = F.col("kind") == "envelope"
    return checked.withColumns({
        "error_type": F.when(~F.col("is_json"), SYNTAX_ERROR)
        .when(invalid & envelope, ENVELOPE_ERROR)
        .when(invalid, SCHEMA_ERROR),
        "error": F.when(~F.col("is_json"), "Value is not valid JSON")
        .when(invalid & envelope, F.concat(F.lit("Envelope validation failed: "), "errors"))
        .when(invalid, F.concat(F.lit("Schema validation failed: "), "errors")),
    }).drop("is_json")


def verify(decoded: DataFrame, key: str) -> DataFrame:
    """Sign bare messages on arrival, check the signature of envelopes.

    A wrong signature becomes a rejection; rows that are already rejected stay as they are.
    """
    ok = F.col("error_type").isNull()
    bare = F.col("kind") == "bare"
    arrival_ns = F.unix_micros("timestamp") * 1000
    signed = with_mac(decoded.withColumn(
        "metadata", F.when(bare, new_metadata(arrival_ns)).otherwise(F.col("metadata"))
    ), key, "_mac")
    forged = ok & ~bare & ~F.coalesce(F.lower("signature") == F.col("_mac"), F.lit(False))
    return signed.withColumns({
        "error_type": F.when(forged, SIGNATURE_ERROR).otherwise(F.col("error_type")),
        "error": F.when(
            forged, "the signature is not that of the payload"
        ).otherwise(F.col("error")),
        "signature": F.when(ok & bare, F.col("_mac")).otherwise(F.col("signature")),
    }).drop("_mac")


def ingest(messages: DataFrame, key: str) -> DataFrame:
    """Decode and verify. ``error_type`` is null for accepted messages.

    What a message came with is no result, so a reader that needs no more of it than its offset carries no more.
    """
    done = verify(decode(messages), key)
    return computed_once(done, [c for c in done.columns if c not in messages.columns]).select(done.columns)


def accepted(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("error_type").isNull()).drop("errors", "error_type", "error")


def rejected(ingested: DataFrame) -> DataFrame:
    return ingested.where(F.col("error_type").isNotNull())


def in_key_order(messages: DataFrame, group_rows: int | None = None) -> DataFrame:
    """Add ``position`` of each message among those of its key; no key counts as ``anonymous``.

    The order is by timestamp, then partition and offset, so it is the same in every run.
    """
    keyed = messages.withColumns({
        "key": F.coalesce("key", F.lit("anonymous")), "_one": F.lit(1),
        "_us": F.unix_micros("timestamp"), "_seq": arrival_seq(),
    })
    split = find_split(keyed, ("key",), "_us", group_rows, tie="_seq")
    numbered = running(
        keyed, split, ["_us", "_seq"], {"position": Running("sum", F.col("_one"))}, at=arrival("_us", "_seq")
    )
    return numbered.drop("_one", "_us", "_seq", PIECE)

"""Canonical text, signatures and encryption of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions import crypto
from tollgate.functions.text import json_text, with_js_escapes, with_json_text, with_number_text
from tollgate.params import Params

# Fixed value: version written into new envelopes.
SCHEMA_VERSION = "v1.0"


_NUMBERS = {"latitude": "_latitude", "longitude": "_longitude", "risk_score": "_risk_score"}
# The members that hold them.
_NUMBER_MEMBERS = {"latitude": "_latitude", "longitude": "_longitude", "riskScore": "_risk_score"}


def _variant_fields() -> dict[str, Column]:
    """Fields that only some event types have; null elsewhere."""
    flagged = F.col("type") == "TransactionFlagged"
    return {
        "reason": F.when(flagged, F.col("reason")),
        "riskScore": F.when(flagged, F.col("_risk_score")),
        "validatorId": F.when(F.col("type") == "TransactionValidated", F.col("validator_id")),
    }


def _struct(**members: Column | str) -> Column:
    return F.struct(*[F.col(m).alias(name) if isinstance(m, str) else m.alias(name)
                      for name, m in members.items()])


def with_canonical_payload(df: DataFrame, output: str) -> DataFrame:
    """Add the canonical JSON of transaction rows: sorted keys, no spaces, integers unquoted.

    Only declared fields take part, so a message signs the same however many keys it had.
    """
    extra = _variant_fields()
    members = _struct(
        amount=_struct(currency="currency", value="amount"),
        merchantId="merchant_id",
        reason=extra["reason"],
        riskScore=extra["riskScore"],
        telemetry=_struct(
            deviceFingerprint="device_fingerprint",
            ipAddress="ip_address",
            latitude="_latitude",
            longitude="_longitude",
            userAgent="user_agent",
        ),
        timestamp="timestamp_ns",
        transactionId="transaction_id",
        type="type",
        userId="user_id",
        validatorId=extra["validatorId"],
    )
    return with_json_text(with_number_text(df, _NUMBERS), output, members, _NUMBER_MEMBERS).drop(*_NUMBERS.values())


def with_canonical_metadata(df: DataFrame, output: str) -> DataFrame:
    return with_json_text(df, output, _struct(
        createdAtNs="metadata.createdAtNs",
        provenanceTrace="metadata.provenanceTrace",
        schemaVersion="metadata.schemaVersion",
    ))


def signed_text(metadata: Column | str, payload: Column | str) -> Column:
    """The text that is signed, from the canonical texts of its two parts."""
    def column(part):
        return F.col(part) if isinstance(part, str) else part

    return F.concat(
        F.lit('{"metadata":'), column(metadata), F.lit(',"payload":'), column(payload), F.lit("}"))


def with_mac(df: DataFrame, key: str, output: str) -> DataFrame:
    """Add the signature that transaction rows with ``metadata`` should have."""
    texts = with_canonical_metadata(with_canonical_payload(df, "_payload"), "_metadata")
    return texts.withColumn(
        output, crypto.hmac_sha256(signed_text("_metadata", "_payload"), key)
    ).drop("_payload", "_metadata")


def new_metadata(created_at_ns: Column, provenance: str = "spark:ingest") -> Column:
    return F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        created_at_ns.cast("bigint").alias("createdAtNs"),
        F.lit(provenance).alias("provenanceTrace"),
    )


def wrap(transactions: DataFrame, key: str, created_at_ns: Column, provenance: str = "spark:ingest") -> DataFrame:
    """Add ``metadata`` and ``signature`` to transaction rows."""
    return with_mac(
        transactions.withColumn("metadata", new_metadata(created_at_ns, provenance)), key, "signature"
    )


def sign_column(df: DataFrame, column: str, key: str, output: str = "signature") -> DataFrame:
    return df.withColumn(output, crypto.hmac_sha256(F.col(column), key))


def verify_column(df: DataFrame, column: str, signature: str, key: str, output: str = "is_genuine") -> DataFrame:
    return df.withColumn(output, crypto.hmac_matches(F.col(column), F.col(signature), key))


def with_wire_payload(df: DataFrame, output: str, quote_integers: Column | None = None) -> DataFrame:
    """Add transaction JSON as it is sent; big integers are quoted on the wire.

    ``quote_integers`` may leave them unquoted for some rows.
    """
    extra = _variant_fields()

    def members(quoted: bool) -> Column:
        def integer(name: str) -> Column:
            return F.col(name).cast("string") if quoted else F.col(name)

        return _struct(
            type="type",
            transactionId="transaction_id",
            userId="user_id",
            merchantId="merchant_id",
            amount=_struct(value=integer("amount"), currency="currency"),
            telemetry=_struct(
                latitude="_latitude",
                longitude="_longitude",
                deviceFingerprint="device_fingerprint",
                ipAddress="ip_address",
                userAgent="user_agent",
            ),
            **extra,
            timestamp=integer("timestamp_ns"),
        )

    text = json_text(members(True), _NUMBER_MEMBERS)
    if quote_integers is not None:
        text = F.when(quote_integers, text).otherwise(json_text(members(False), _NUMBER_MEMBERS))
    return with_js_escapes(with_number_text(df, _NUMBERS), output, text).drop(*_NUMBERS.values())


def with_wire_envelope(df: DataFrame, output: str, payload: str | None = None) -> DataFrame:
    """Add envelope JSON as it is sent; ``payload`` names an existing wire payload."""
    if payload is None:
        return with_wire_envelope(with_wire_payload(df, "_wire"), output, "_wire").drop("_wire")
    metadata = F.to_json(_struct(
        schemaVersion="metadata.schemaVersion",
        createdAtNs=F.col("metadata.createdAtNs").cast("string"),
        provenanceTrace="metadata.provenanceTrace",
    ))
    return df.withColumn(output, F.concat(
        F.lit('{"metadata":'), metadata, F.lit(',"payload":'), F.col(payload),
        F.lit(',"signature":"'), F.col("signature"), F.lit('"}'),
    ))


def encrypt_columns(df: DataFrame, columns: list[str], params: Params) -> DataFrame:
    """Replace text columns by ``{ciphertext, iv, authTag}`` structs."""
    key = crypto.derive_key(params.encryption_key, params.crypto_salt)
    return df.withColumns({c: crypto.encrypt(F.col(c), key) for c in columns})


def decrypt_columns(df: DataFrame, columns: list[str], params: Params) -> DataFrame:
    """Back to text. ``security_violation`` tells that a non-null value could not be opened."""
    key = crypto.derive_key(params.encryption_key, params.crypto_salt)
    opened = {c: crypto.decrypt(F.col(c), key) for c in columns}
    failed = F.lit(False)
    for c in columns:
        failed = failed | (F.col(c).isNotNull() & opened[c].isNull())
    return df.withColumns({**opened, "security_violation": failed})

"""Events built from transaction rows; ``alerts.flagged_events`` builds the third kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.ingest import INITIATED, VALIDATED


def _event(transactions: DataFrame, kind: str, at_ms: Column, validator: Column) -> DataFrame:
    return transactions.withColumns({
        "type": F.lit(kind),
        "timestamp_ns": at_ms.cast("bigint") * 1_000_000,
        "validator_id": validator,
        "reason": F.lit(None).cast("string"),
        "risk_score": F.lit(None).cast("double"),
    })


def initiated_events(transactions: DataFrame, at_ms: Column) -> DataFrame:
    """``TransactionInitiated`` events; time in ns from a ms clock. ``signing.wrap`` signs them."""
    return _event(transactions, INITIATED, at_ms, F.lit(None).cast("string"))


def validated_events(transactions: DataFrame, at_ms: Column, validator_id: str) -> DataFrame:
    """``TransactionValidated`` events, which say who validated."""
    if not validator_id:
        raise ValueError("a validated event needs a validator")
    return _event(transactions, VALIDATED, at_ms, F.lit(validator_id))

"""Parameters that change over time: each transaction is scored with those in force."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.numeric import at_least
from tollgate.functions.text import csv_set
from tollgate.operators import state
from tollgate.operators.rules import VELOCITY_SCORE, MerchantRule, Outcome, RuleSet, TravelRule, VelocityRule
from tollgate.operators.running import PIECE, Running, Split, find_split, running
from tollgate.params import Params

# A history of at most this many changes travels with the plan as one array.
LITERAL_ROWS = 1_000


def with_params_in_force(
    df: DataFrame, history: DataFrame, literal_rows: int = LITERAL_ROWS, group_rows: int | None = None
) -> DataFrame:
    """Add ``in_force``: the last row of ``history`` with ``effective_from <= proc_ms``.

    ``effective_from`` (ms) must be unique and not null, else this raises ``ValueError``, whatever
    the history's size. Null before the first change.
    """
    n, known, different = history.agg(
        F.count(F.lit(1)), F.count("effective_from"), F.count_distinct("effective_from")).first()
    if n != known or n != different:
        raise ValueError("effective_from must be unique and not null")
    fields = ["effective_from", *[c for c in history.columns if c != "effective_from"]]
    ordered = history.select(F.struct(*fields).alias("_p"))
    entry = ordered.schema["_p"].dataType
    rows = history.select(*fields).limit(literal_rows + 1).collect()
    if len(rows) <= literal_rows:
        entries = [F.struct(*map(F.lit, row)).cast(entry) for row in sorted(rows)]
        valid = F.filter(
            F.array(*entries).cast(T.ArrayType(entry)), lambda p: p["effective_from"] <= F.col("proc_ms")
        )
        return df.withColumn(
            "in_force", F.when(F.size(valid) > 0, F.element_at(valid, F.greatest(F.size(valid), F.lit(1))))
        )

    # Any size: changes and transactions in one time order, the last change runs along.
    all_rows = df.select(
        F.lit(0).alias("_key"), F.col("proc_ms").alias("_clock"), F.lit(1).alias("_kind"),
        F.struct(*df.columns).alias("_row"),
    )
    changes = ordered.select(
        F.lit(0).alias("_key"), F.col("_p.effective_from").alias("_clock"), F.lit(0).alias("_kind"), "_p"
    )
    merged = all_rows.unionByName(changes, allowMissingColumns=True)
    split = find_split(merged, ("_key",), "_clock", group_rows)
    found = running(
        merged, split, ["_clock", "_kind"], {"in_force": Running("max", F.col("_p"))}, at=F.col("_clock")
    )
    return found.where(F.col("_kind") == 1).select("_row.*", "in_force").drop(PIECE)


class _VelocityInForce(VelocityRule):
    """Velocity with the threshold in force and, if ``windows`` is set, in the window in force; else in the job's."""

    def __init__(self, params: Params, windows: bool = False):
        super().__init__(params)
        self.window_s = F.lit(params.velocity_window_s)
        self.windows = windows
        if windows:
            self.window_s = F.coalesce(F.col("in_force.velocity_window_s").cast("int"), self.window_s)

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        if not self.windows or "velocity_count" in df.columns:
            return super().prepare(df, split)
        return state.with_windows_in_force(df, split, self.window_s)

    def outcome(self) -> Outcome:
        threshold = F.coalesce(F.col("in_force.velocity_threshold").cast("int"), F.lit(self.params.velocity_threshold))
        fired = F.col("velocity_count") > threshold
        base = super().outcome()
        return Outcome(
            score=F.when(fired, VELOCITY_SCORE).otherwise(0.0),
            is_suspicious=fired,
            findings=F.when(fired, F.format_string(
                "%2$d transactions of %1$s in %4$d s, %3$d allowed",
                "user_id", "velocity_count", threshold, self.window_s,
            )).otherwise("few transactions in the window"),
            error=base.error,
            metadata={**base.metadata, "threshold": threshold, "windowSizeSeconds": self.window_s},
        )


class _MerchantInForce(MerchantRule):
    """Blacklist in force."""

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        listed = csv_set(F.coalesce("in_force.merchant_blacklist", F.lit(self.params.merchant_blacklist)))
        return df.withColumns({
            "is_blacklisted": F.array_contains(listed, F.col("merchant_id")),
            "blacklist_size": F.size(listed),
        })

    def outcome(self) -> Outcome:
        return replace(super().outcome(), metadata={"blacklistSize": F.col("blacklist_size")})


def rules_in_force(params: Params, windows: bool = False) -> RuleSet:
    """The default rules reading threshold and blacklist, and with ``windows`` the velocity window, from ``in_force``."""
    return RuleSet([_VelocityInForce(params, windows), TravelRule(params), _MerchantInForce(params)])


def critical_in_force(params: Params) -> Callable[[str], Column]:
    """Which rules must not fail, for ``decide``: the comma list ``critical_rule_ids`` in force, else the job's."""
    def critical(rule_id: str) -> Column:
        listed = F.array_contains(csv_set(F.col("in_force.critical_rule_ids")), F.lit(rule_id))
        return F.coalesce(listed, F.lit(params.is_critical(rule_id)))

    return critical


def decide_in_force(decisions: DataFrame, params: Params) -> DataFrame:
    """Compare the score with the flag threshold in force."""
    threshold = F.coalesce("in_force.fraud_threshold", F.lit(params.fraud_threshold))
    is_flagged = F.col("fail_closed") | at_least(F.col("risk_score"), threshold)
    return decisions.withColumn("decision", F.when(F.col("decision") == "ERROR", "ERROR")
                                .when(is_flagged, "FLAGGED").otherwise("APPROVED"))

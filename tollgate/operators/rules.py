"""Scoring rules.

A rule names the state columns it needs (``prepare``) and yields an ``Outcome`` of columns
(``outcome``). A rule that cannot be evaluated for a row reports ``error`` for that row; it
never stops the other rules or the other rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.functions.geo import haversine_km, hours_between, is_finite
from tollgate.functions.text import csv_entries
from tollgate.operators import state
from tollgate.operators.running import Split
from tollgate.params import MERCHANT_RULE, TRAVEL_RULE, VELOCITY_RULE, Params

# Score of a rule that fires; otherwise 0.0.
VELOCITY_SCORE = 0.8
TRAVEL_SCORE = 0.9
MERCHANT_SCORE = 1.0


@dataclass(frozen=True)
class Outcome:
    """Result columns of one rule for one transaction; ``error`` not null means it failed."""

    score: Column
    is_suspicious: Column
    findings: Column
    error: Column
    metadata: dict[str, Column] = field(default_factory=dict)

    @property
    def failed(self) -> Column:
        return self.error.isNotNull()

    def as_struct(self, rule_id: str) -> Column:
        pairs = [part for name, value in self.metadata.items()
                 for part in (F.lit(name), value.cast("string"))]
        metadata = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        ok = self.error.isNull()
        return F.struct(
            F.lit(rule_id).alias("rule_id"),
            F.when(ok, self.score).alias("score"),
            F.when(ok, self.is_suspicious).alias("is_suspicious"),
            F.when(ok, self.findings).alias("findings"),
            self.error.alias("error"),
            metadata.alias("metadata"),
        )


def no_error() -> Column:
    return F.lit(None).cast("string")


class VelocityRule:
    """More distinct transactions of the user in the window than allowed."""

    rule_id = VELOCITY_RULE

    def __init__(self, params: Params):
        self.params = params

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        if "velocity_count" in df.columns:  # a stream brings the state along
            return df
        return state.with_velocity(df, split, self.params.velocity_window_s)

    def outcome(self) -> Outcome:
        count = F.col("velocity_count")
        fired = count > F.lit(self.params.velocity_threshold)
        return Outcome(
            score=F.when(fired, VELOCITY_SCORE).otherwise(0.0),
            is_suspicious=fired,
            findings=F.when(fired, F.format_string(
                f"%2$d transactions of %1$s in {self.params.velocity_window_s} s, {self.params.velocity_threshold} allowed",
                "user_id", count,
            )).otherwise("few transactions in the window"),
            error=no_error(),
            metadata={
                "calculatedCount": count,
                "threshold": F.lit(self.params.velocity_threshold),
                "windowSizeSeconds": F.lit(self.params.velocity_window_s),
            },
        )


class TravelRule:
    """Speed between the last known and the current location above the limit.

    Order of the tests: no earlier telemetry -> coordinates unusable (the rule fails) -> not
    newer than the state -> speed.
    """

    rule_id = TRAVEL_RULE

    def __init__(self, params: Params):
        self.params = params

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        """Add ``prev`` and, where they are defined, ``travel_km`` and ``travel_kmh``."""
        if "prev" not in df.columns:  # a stream brings the state along
            df = state.with_previous_telemetry(df, split)
        df = state.recent_telemetry(df, self.params.telemetry_max_age_s)
        usable = F.col("prev").isNotNull()
        for name in ("prev.latitude", "prev.longitude", "latitude", "longitude"):
            usable = usable & is_finite(F.col(name))
        distance = haversine_km(
            F.col("prev.latitude"), F.col("prev.longitude"), F.col("latitude"), F.col("longitude")
        )
        hours = hours_between(F.col("prev.timestamp_ns"), F.col("timestamp_ns"))
        return df.withColumn("travel_km", F.when(usable, distance)).withColumn(
            "travel_kmh", F.when(~self.out_of_order(), F.col("travel_km") / hours)
        )

    @staticmethod
    def out_of_order() -> Column:
        return F.col("timestamp_ns") <= F.col("prev.timestamp_ns")

    def outcome(self) -> Outcome:
        known = F.col("prev").isNotNull()
        stored_ok = is_finite(F.col("prev.latitude")) & is_finite(F.col("prev.longitude"))
        speed = F.col("travel_kmh")
        too_fast = ~F.isnan(speed) & (speed > F.lit(float(self.params.speed_limit_kmh)))
        fired = F.coalesce(too_fast, F.lit(False))

        def place(prefix: str, lat: str, lon: str) -> Column:
            return F.concat(
                F.lit(f"{prefix} {lat}="), F.coalesce(F.col(self._column(lat)).cast("string"), F.lit("null")),
                F.lit(f", {lon}="), F.coalesce(F.col(self._column(lon)).cast("string"), F.lit("null")),
            )

        return Outcome(
            score=F.when(fired, TRAVEL_SCORE).otherwise(0.0),
            is_suspicious=fired,
            findings=F.when(~known, "no earlier location of the user")
            .when(self.out_of_order(),
                  "not newer than the last location")
            .when(fired, F.format_string("travelled at %.2f km/h over %.2f km", speed, "travel_km"))
            .otherwise("possible travel speed"),
            error=F.when(
                known & F.col("travel_km").isNull(),
                F.when(~stored_ok, place("stored location unusable:", "lat1", "lon1"))
                .otherwise(place("location unusable:", "lat2", "lon2")),
            ),
        )

    @staticmethod
    def _column(label: str) -> str:
        name = {"lat": "latitude", "lon": "longitude"}[label[:3]]
        return f"prev.{name}" if label.endswith("1") else name


class MerchantRule:
    """Merchant is on the blacklist: exact, case-sensitive.

    The list comes from the comma-list parameter or from a table with ``merchant_id``.
    """

    rule_id = MERCHANT_RULE

    def __init__(self, params: Params, blacklist: DataFrame | None = None):
        self.params = params
        self.blacklist = blacklist
        self.entries = csv_entries(params.merchant_blacklist)

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        if self.blacklist is None:
            return df.withColumn("is_blacklisted", F.col("merchant_id").isin(self.entries))
        return with_blacklist(df, self.blacklist)

    def outcome(self) -> Outcome:
        fired = F.col("is_blacklisted")
        return Outcome(
            score=F.when(fired, MERCHANT_SCORE).otherwise(0.0),
            is_suspicious=fired,
            findings=F.when(fired, F.concat(
                F.lit("listed merchant "), F.col("merchant_id")
            )).otherwise("merchant not listed"),
            error=no_error(),
            metadata={"blacklistSize": F.lit(len(self.entries)) if self.blacklist is None
                      else F.col("blacklist_size")},
        )


def with_blacklist(df: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Add ``is_blacklisted`` from a table of any size; ``df`` may be a stream.

    The planner chooses the join from the list's size; the list's side has one row for each
    merchant, so a merchant that dominates the transactions can be split.
    """
    listed = blacklist.select("merchant_id").distinct()
    size = listed.count()
    return (
        df.join(listed.withColumn("_hit", F.lit(True)), "merchant_id", "left")
        .withColumn("is_blacklisted", F.coalesce("_hit", F.lit(False)))
        .withColumn("blacklist_size", F.lit(size))
        .drop("_hit")
    )


class SpendRule:
    """Opt-in: amount spent in the window above the limit."""

    rule_id = "spend-volume-rule-v1"

    def __init__(self, params: Params):
        if params.spend_limit is None:
            raise ValueError("the spend rule needs Params.spend_limit")
        self.params = params

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        if "spend" in df.columns:  # a stream brings the state along
            return df
        if "is_new" not in df.columns:
            df = state.with_first_seen(df, split, self.params.velocity_window_s)
        return state.with_spend(df, split, self.params.spend_window_s)

    def outcome(self) -> Outcome:
        fired = F.col("spend") > F.lit(self.params.spend_limit)
        return Outcome(
            score=F.when(fired, VELOCITY_SCORE).otherwise(0.0),
            is_suspicious=fired,
            findings=F.when(fired, F.concat(
                F.lit("spent in the window: "), F.col("spend").cast("string")
            )).otherwise("little spent in the window"),
            error=no_error(),
        )


class PandasRule:
    """A user rule in Python: ``score(pdf) -> DataFrame(score, is_suspicious, findings)``.

    It runs on Arrow batches. A batch that raises is halved and tried again, so only the rows that
    really fail are reported as failed, and a few of them don't cost a call for each row.
    """

    def __init__(self, rule_id: str, columns: list[str], score: Callable[[pd.DataFrame], pd.DataFrame]):
        self.rule_id = rule_id
        self.columns = columns
        self.score = score

    def prepare(self, df: DataFrame, split: Split) -> DataFrame:
        score = self.score
        fields = ["score", "is_suspicious", "findings", "error"]

        def attempt(rows: pd.DataFrame) -> pd.DataFrame:
            try:
                return score(rows).assign(error=None)[fields].set_axis(rows.index)
            except Exception as problem:  # a failing rule is a result, not a job failure
                if len(rows) == 1:
                    failed = [[None, None, None, str(problem) or type(problem).__name__]]
                    return pd.DataFrame(failed, columns=fields, index=rows.index)
                half = len(rows) // 2
                return pd.concat([attempt(rows.iloc[:half]), attempt(rows.iloc[half:])])

        @F.pandas_udf("score double, is_suspicious boolean, findings string, error string")
        def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
            return attempt(rows)

        return df.withColumn(self.rule_id, evaluate(F.struct(*self.columns)))

    def outcome(self) -> Outcome:
        result = F.col(f"`{self.rule_id}`")
        return Outcome(
            result["score"], result["is_suspicious"], result["findings"], result["error"]
        )


class RuleSet:
    """Rules in registration order."""

    def __init__(self, rules=()):
        self._rules = {}
        for rule in rules:
            self.register(rule)

    def register(self, rule) -> None:
        if not callable(getattr(rule, "outcome", None)):
            raise TypeError(f"{rule.rule_id} has no outcome()")
        if rule.rule_id in self._rules:
            raise ValueError(f"{rule.rule_id} is already registered")
        self._rules[rule.rule_id] = rule

    def __iter__(self):
        return iter(self._rules.values())

    def __len__(self):
        return len(self._rules)


def default_rules(params: Params, blacklist: DataFrame | None = None) -> RuleSet:
    """Velocity, travel, merchant - and spend if a limit is set."""
    rules = RuleSet([VelocityRule(params), TravelRule(params), MerchantRule(params, blacklist)])
    if params.spend_limit is not None:
        rules.register(SpendRule(params))
    return rules


def rule_results(df: DataFrame, rules: RuleSet) -> DataFrame:
    """One row per (transaction, rule): score and findings, or the error of a failed rule."""
    results = F.array(*[rule.outcome().as_struct(rule.rule_id) for rule in rules])
    return df.select("*", F.explode(results).alias("result"))


RULE_RESULT = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("is_suspicious", T.BooleanType()),
    T.StructField("findings", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


def bad_score(score: Column) -> Column:
    """Whether a score is missing or outside [0, 1]."""
    return score.isNull() | (~F.isnan(score) & ((score < 0) | (score > 1)))


def contract_violations(results: DataFrame) -> DataFrame:
    """Add ``violations`` to long-form results (``result`` of the ``RULE_RESULT`` shape).

    A successful result needs a score in [0, 1] and a non-empty reason. Only the score check
    fails a transaction; NaN passes it, as a comparison with NaN is never true there.
    """
    findings = F.col("result.findings")
    ok = F.col("result.error").isNull()
    return results.withColumn("violations", F.array_compact(F.array(
        F.when(ok & bad_score(F.col("result.score")), "riskScore"),
        F.when(ok & (F.coalesce(F.length(findings), F.lit(0)) == 0), "reason"),
    )))

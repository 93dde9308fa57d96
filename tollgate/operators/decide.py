"""From rule outcomes to a decision per transaction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.functions.numeric import at_least, clamp01
from tollgate.operators import state
from tollgate.operators.rules import Outcome, RuleSet, bad_score, default_rules
from tollgate.params import UNLISTED_WEIGHT, Params
from tollgate.session import computed_once

VALIDATED = "TransactionValidated"
APPROVED, FLAGGED, ERROR = "APPROVED", "FLAGGED", "ERROR"


# What a job can be given instead of ``weighted_mean``: rule outcomes with their weights to a score.
# Failed outcomes have no score; a score may be NaN.
Aggregator = Callable[[list[tuple[Outcome, Column | float]]], Column]


def total(columns: list[Column]) -> Column:
    """Sum in the given order, so that floating-point results are reproducible."""
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def weighted_mean(outcomes: list[tuple[Outcome, Column | float]]) -> Column:
    """Mean of the clamped scores by weight; failed rules are left out; nothing left -> 0."""
    weights = [F.when(~o.failed, F.lit(w) if isinstance(w, float) else w).otherwise(0.0)
               for o, w in outcomes]
    scores = [F.when(~o.failed, clamp01(o.score)).otherwise(0.0) for o, _ in outcomes]
    weight = total(weights)
    mean = total([s * w for s, w in zip(scores, weights)]) / F.nullif(weight, F.lit(0.0))
    return clamp01(F.when(weight > 0, mean).otherwise(0.0))


def noisy_or(outcomes: list[tuple[Outcome, Column | float]]) -> Column:
    """1 less the product of (1 - score) ^ weight: any one sure rule is enough, weak ones add up.

    Failed rules, and rules without a score, are left out; nothing left -> 0; NaN -> NaN.
    """
    doubts = [F.when(o.failed | o.score.isNull(), 1.0).otherwise(F.pow(1 - clamp01(o.score), F.lit(w) if isinstance(w, float) else w))
              for o, w in outcomes]
    return clamp01(1 - reduce(lambda a, b: a * b, doubts, F.lit(1.0)))


def plain_mean(outcomes: list[tuple[Outcome, Column | float]]) -> Column:
    """Mean that goes by no weights and counts failed rules, and rules without a score, as 0; no rules -> 0."""
    if not outcomes:
        return F.lit(0.0)
    return total([F.when(o.failed | o.score.isNull(), 0.0).otherwise(o.score) for o, _ in outcomes]) / len(outcomes)


def any_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns, F.lit(False))


def reasons(outcomes: list[Outcome]) -> Column:
    """Findings of the suspicious, successful rules in registration order; may be empty."""
    return F.concat_ws(" | ", *[F.when(~o.failed & o.is_suspicious, o.findings) for o in outcomes])


def prepare(df: DataFrame, rules: RuleSet, params: Params, split=None) -> DataFrame:
    """Add every rule's state. All transactions change state, whatever their type."""
    split = split or state.user_split(df)
    df = state.by_user(df, split)
    for rule in rules:
        df = rule.prepare(df, split)
    return df.drop(state.PIECE)


def decide(
    df: DataFrame, rules: RuleSet, params: Params, aggregate: Aggregator = weighted_mean,
    critical: Callable[[str], Column] | None = None,
) -> DataFrame:
    """Score prepared rows: guard, rules, fail-closed, aggregate, threshold.

    ``critical`` tells of a rule's id whether it must not fail; by default as ``params`` says.

    Rows that are not validated transactions, and rows for which a rule that didn't fail has no
    score or one outside [0, 1], get the decision ``ERROR`` and an ``error`` text. NaN is no such
    score; it goes into the mean, and a mean of NaN reaches no threshold.
    """
    df, outcomes = with_outcomes(df, rules)
    only = [o for _, o in outcomes]
    critical = critical or (lambda rule_id: F.lit(params.is_critical(rule_id)))
    closed = any_of([o.failed & critical(rule.rule_id) for rule, o in outcomes])
    outside = any_of([~o.failed & bad_score(o.score) for o in only])
    score = aggregate([(o, params.weight(rule.rule_id)) for rule, o in outcomes])
    decided = (
        df.withColumns({
            "error": F.when(F.col("type") != VALIDATED, "not a validated transaction, so it is not scored")
            .when(outside, "a rule gave no score from 0 to 1"),
            "fail_closed": closed,
            "_score": F.when(closed, 1.0).otherwise(score),
            "reason": reasons(only),
            "failed_rules": F.concat_ws(",", *[F.when(o.failed, rule.rule_id) for rule, o in outcomes]),
        })
        .withColumns({
            "decision": F.when(F.col("error").isNotNull(), ERROR)
            .when(F.col("fail_closed") | at_least(F.col("_score"), params.fraud_threshold), FLAGGED)
            .otherwise(APPROVED),
            "risk_score": F.when(F.col("error").isNull(), F.col("_score")),
            "orchestration_version": F.lit(params.orchestration_version),
        })
        .drop("_score", *[c for c in df.columns if c.startswith("_rule")])
    )
    return computed_once(decided, ["error", "fail_closed", "risk_score", "decision"])


def with_outcomes(df: DataFrame, rules: RuleSet) -> tuple[DataFrame, list]:
    """Compute each rule's outcome as columns; returns the outcomes as references to them."""
    columns, named = {}, []
    for i, rule in enumerate(rules):
        outcome = rule.outcome()
        parts = {"score": outcome.score, "is_suspicious": outcome.is_suspicious,
                 "findings": outcome.findings, "error": outcome.error}
        columns.update({f"_rule{i}_{part}": value for part, value in parts.items()})
        named.append((rule, Outcome(**{part: F.col(f"_rule{i}_{part}") for part in parts})))
    return df.withColumns(columns), named


def score_transactions(
    df: DataFrame, params: Params, rules: RuleSet | None = None, strict: bool = False, split=None,
    aggregate: Aggregator = weighted_mean, critical: Callable[[str], Column] | None = None,
) -> DataFrame:
    """The whole scoring job over a table of accepted transactions.

    The state sees all rows; only validated transactions are scored. ``strict`` keeps the other
    rows as errors instead of skipping them.
    """
    rules = rules or default_rules(params)
    prepared = prepare(df, rules, params, split)
    if not strict:
        prepared = prepared.where(F.col("type") == VALIDATED)
    return decide(prepared, rules, params, aggregate, critical)


def evaluate_all(prepared: DataFrame, rules: RuleSet, params: Params, aggregate: Aggregator = plain_mean) -> DataFrame:
    """The other aggregation: by default a plain mean over all rules, with every rule's result kept."""
    prepared, outcomes = with_outcomes(prepared, rules)
    critical = any_of([o.failed for rule, o in outcomes if params.is_critical(rule.rule_id)])
    score = F.when(critical, 1.0).otherwise(aggregate([(o, params.weight(rule.rule_id)) for rule, o in outcomes]))
    # A failed rule is kept as a harmless result that says why it failed.
    results = F.array(*[
        F.struct(
            F.lit(rule.rule_id).alias("rule_id"),
            F.when(o.failed, 0.0).otherwise(o.score).alias("risk_score"),
            F.coalesce(~o.failed & o.is_suspicious, F.lit(False)).alias("is_suspicious"),
            F.when(o.failed, F.concat(F.lit(f"Rule {rule.rule_id} failed: "), o.error))
            .otherwise(o.findings).alias("reason"),
        )
        for rule, o in outcomes
    ])
    return prepared.withColumns({
        "aggregate_score": score,
        "is_suspicious": critical | at_least(score, params.fraud_threshold),
        "results": results,
    }).drop(*[c for c in prepared.columns if c.startswith("_rule")])


def weighted_risk_long(results: DataFrame, weights: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted mean over long-form results with weights from a (rule_id, weight) table.

    Unlisted rules weigh 1. A rule listed twice with different weights fails the job.
    """
    twice = F.raise_error(F.concat(F.lit("two weights for "), F.col("rule_id"))).cast("double")
    once = weights.groupBy("rule_id").agg(F.min("weight").alias("_least"), F.max("weight").alias("_most"))
    once = once.select("rule_id", F.when(F.col("_least").eqNullSafe(F.col("_most")), F.col("_least")).otherwise(twice).alias("weight"))
    weighted = results.select(*keys, "result.rule_id", "result.score", "result.error").join(once, "rule_id", "left")
    weight = F.coalesce("weight", F.lit(UNLISTED_WEIGHT))
    ok = F.col("error").isNull()
    total_weight = F.sum(F.when(ok, weight))
    mean = F.sum(F.when(ok, clamp01(F.col("score")) * weight)) / F.nullif(total_weight, F.lit(0.0))
    return weighted.groupBy(*keys).agg(clamp01(F.coalesce(mean, F.lit(0.0))).alias("risk_score"))


def errors_of(decisions: DataFrame) -> DataFrame:
    """(rule_id, error_type) of every failed rule and every failed transaction."""
    failed = F.transform(
        F.filter(F.split("failed_rules", ","), lambda rule: rule != ""),
        lambda rule: F.struct(rule.alias("rule_id"), F.lit("RULE_EXECUTION_FAILURE").alias("error_type")),
    )
    whole = F.struct(F.lit(None).cast("string").alias("rule_id"), F.lit("INTERNAL_SYSTEM_ERROR").alias("error_type"))
    guarded = F.col("type") != VALIDATED
    return decisions.select(F.inline(F.concat(
        F.when(guarded, F.array().cast("array<struct<rule_id:string,error_type:string>>")).otherwise(failed),
        F.when(F.col("error").isNotNull(), F.array(whole)).otherwise(
            F.array().cast("array<struct<rule_id:string,error_type:string>>")),
    )))

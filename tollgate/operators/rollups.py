"""Operational figures: counts, latency histograms, percentiles, gauges.

All of them aggregate map-side first, so a dominating label value is not a hot spot.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.running import Running, find_split, running

# Latency bucket bounds in seconds, by what is measured.
BUCKETS = {
    "operation": [0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0],
    "decision": [0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.07, 0.08, 0.09, 0.1,
                 0.25, 0.5, 1.0, 2.0],
    "produce": [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    "consume": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0],
    "velocity_rule": [0.001, 0.002, 0.005, 0.01, 0.025, 0.05],
    "evaluate_all": [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0],
    "event_log": [0.0001, 0.0005, 0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0],
    "dead_letter": [0.005, 0.01, 0.05, 0.1, 0.5, 1.0],
    "consumer_cycle": [0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 1.0, 2.0],
}

# Names of the alert states in reports.
ALERT_SENT, ALERT_SKIPPED, ALERT_FAILED = "total_alerts_sent", "alert_deduplication_skipped", "kafka_producer_error"


def counts(df: DataFrame, **labels: Column) -> DataFrame:
    """Number of rows per label combination."""
    return df.groupBy(*[value.alias(name) for name, value in labels.items()]).agg(
        F.count(F.lit(1)).alias("n")
    )


def outcome_counts(decisions: DataFrame) -> DataFrame:
    return counts(decisions, outcome=F.when(F.col("decision") == "FLAGGED", "flagged").otherwise("approved"))


def error_counts(errors: DataFrame) -> DataFrame:
    """Errors by rule and type; errors of no rule count under ``system``."""
    return counts(errors, rule_id=F.coalesce("rule_id", F.lit("system")), error_type=F.col("error_type"))


def dead_letter_counts(rejected: DataFrame) -> DataFrame:
    return counts(rejected, stream=F.col("topic"), reason=F.coalesce("error_type", F.lit("UnknownError")))


def blacklist_hits(prepared: DataFrame) -> DataFrame:
    return counts(prepared.where("is_blacklisted"), merchant_id=F.col("merchant_id"))


def alert_status_counts(suppressed: DataFrame) -> DataFrame:
    """Alerts by status; of those that went out some may have a ``sink_error`` (``outbox``)."""
    failed = F.col("sink_error").isNotNull() if "sink_error" in suppressed.columns else F.lit(False)
    status = F.when(~F.col("is_sent"), ALERT_SKIPPED).when(failed, ALERT_FAILED).otherwise(ALERT_SENT)
    return counts(suppressed, status=status)


def stream_counts(ingested: DataFrame) -> DataFrame:
    """Messages by stream and what became of them."""
    outcome = F.when(F.col("error_type").isNull(), "processed").otherwise("dead_letter")
    return counts(ingested, stream=F.col("topic"), outcome=outcome)


def log_operation_counts(operations: DataFrame) -> DataFrame:
    return counts(operations, operation=F.col("operation"),
                  outcome=F.when(F.col("is_ok"), "success").otherwise("failure"))


def cache_misses(lookups: DataFrame, entity: str) -> DataFrame:
    return lookups.agg(F.count_if("is_miss").alias("misses")).select(F.lit(entity).alias("entity"), "misses")


def latency_histogram(values: DataFrame, labels: list[str], seconds: Column, bounds: list[float]) -> DataFrame:
    """Cumulative buckets, count and sum per label set; ``+Inf`` is the count.

    All buckets are counted in one pass and turned into rows afterwards.
    """
    wide = values.select(*labels, seconds.alias("_v")).groupBy(*labels).agg(
        *[F.count_if(F.col("_v") <= bound).alias(f"_b{i}") for i, bound in enumerate(bounds)],
        F.count("_v").alias("total"),
        F.sum("_v").alias("sum_seconds"),
    )
    rows = [F.struct(F.lit(str(bound)).alias("le"), F.col(f"_b{i}").alias("cumulative"))
            for i, bound in enumerate(bounds)]
    rows.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("cumulative")))
    return wide.select(*labels, "total", "sum_seconds", F.inline(F.array(*rows)))


def latency_percentiles(
    values: DataFrame, labels: list[str], ticks: Column, points: list[float], group_rows: int | None = None
) -> DataFrame:
    """Exact interpolated percentiles of integer clock ticks; null ticks don't count.

    Equal ticks are counted first. A running sum over the ticks, cut where a label has very many,
    gives their ranks; the values at the ranks a percentile lies between are then minima, so no
    label's ticks are gathered.
    """
    distinct = (
        values.select(*labels, ticks.alias("_tick")).where(F.col("_tick").isNotNull())
        .groupBy(*labels, "_tick").agg(F.count(F.lit(1)).alias("_n"))
    )
    split = find_split(distinct, labels, "_tick", group_rows)
    upto = running(distinct, split, ["_tick"], {"_upto": Running("sum", F.col("_n"))}, at=F.col("_tick"))
    totals = distinct.groupBy(*labels).agg(F.sum("_n").alias("_total"))
    same = reduce(lambda a, b: a & b, [F.col(f"v.{c}").eqNullSafe(F.col(f"t.{c}")) for c in labels], F.lit(True))
    ranked = upto.alias("v").join(totals.alias("t"), same).select(*[F.col(f"v.{c}").alias(c) for c in labels], "_tick", "_upto", "_total")

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_tick")))

    def place(point: float) -> Column:
        return F.lit(point) * (F.col("_total") - 1)

    found = ranked.groupBy(*labels).agg(F.first("_total").alias("_total"), *[
        side for k, point in enumerate(points)
        for side in (at(F.floor(place(point))).alias(f"_low{k}"), at(F.ceil(place(point))).alias(f"_high{k}"))
    ])
    between = lambda k, point: F.col(f"_low{k}") + (F.col(f"_high{k}") - F.col(f"_low{k}")) * (place(point) - F.floor(place(point)))
    return found.select(*labels, *[between(k, point).alias(f"p{round(point * 100)}") for k, point in enumerate(points)])


# Of a quantile sketch: its accuracy parameter, and the share of ranks by which its quantiles may be off.
SKETCH_K = 400
SKETCH_ERROR = 0.01


def latency_sketches(values: DataFrame, labels: list[Column | str], ticks: Column) -> DataFrame:
    """``sketch``: a mergeable summary of the integer clock ticks of each label set; of a stream, of each window among the labels.

    It takes a few KB whatever it has seen, and is combined before rows are shuffled.
    """
    return values.groupBy(*labels).agg(F.kll_sketch_agg_bigint(ticks, F.lit(SKETCH_K)).alias("sketch"))


def sketch_percentiles(sketches: DataFrame, labels: list[str], points: list[float]) -> DataFrame:
    """``n`` and percentiles of label sets from any number of sketches each; a rank is off by ``SKETCH_ERROR`` of ``n`` or less, almost always."""
    merged = sketches.groupBy(*labels).agg(F.kll_merge_agg_bigint("sketch", F.lit(SKETCH_K)).alias("_all"))
    found = {f"p{round(point * 100)}": F.kll_sketch_get_quantile_bigint("_all", F.lit(point)) for point in points}
    return merged.select(*labels, F.kll_sketch_get_n_bigint("_all").alias("n"), *[c.alias(name) for name, c in found.items()])


def histogram_quantile(histogram: DataFrame, labels: list[str], point: float) -> DataFrame:
    """Quantile estimated from cumulative buckets, linear inside the bucket it falls into.

    A rank beyond the last finite bound gives that bound. One group holds only the buckets.
    """
    bucket = F.struct(F.col("le").try_cast("double").alias("bound"), F.col("cumulative"))
    buckets = F.array_sort(F.filter(
        F.collect_list(F.when(F.col("le") != "+Inf", bucket)), lambda b: b.isNotNull()))
    grouped = histogram.groupBy(*labels).agg(buckets.alias("_b"), F.max("total").alias("total"))
    rank = F.col("total") * F.lit(point)
    at = F.size(F.filter("_b", lambda b: b["cumulative"] < rank)) + 1
    inside = at <= F.size("_b")
    upper = F.when(inside, F.element_at("_b", F.least(at, F.size("_b"))))
    lower = F.when(at > 1, F.element_at("_b", F.greatest(at - 1, F.lit(1))))
    start = F.coalesce(lower["bound"], F.lit(0.0))
    below = F.coalesce(lower["cumulative"], F.lit(0))
    share = (rank - below) / (upper["cumulative"] - below)
    return grouped.select(
        *labels,
        F.when(inside, start + (upper["bound"] - start) * share)
        .otherwise(F.element_at("_b", -1)["bound"]).alias("quantile"),
    )


def gauge_latest(samples: DataFrame, labels: list[str], value: str, at: list[str]) -> DataFrame:
    """Last value set per label set; ``at`` orders the samples."""
    return samples.groupBy(*labels).agg(F.max_by(value, F.struct(*at)).alias(value))

"""From flagged decisions to alerts: suppression of repeats, alert records."""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.operators.running import Running, find_split, running
from tollgate.operators.signing import with_wire_envelope, wrap
from tollgate.params import Params
from tollgate.session import use_checkpoints

# Topic of the alerts and prefix of the idempotency key.
ALERT_TOPIC = "fraud-alerts-high-priority"
IDEMPOTENCY_PREFIX = "fraud:alert:processed:"

KEY = "transaction_id"
# Ids with at most this many distinct alert times are folded as one array per id.
FOLD_ROWS = 1_000


def with_suppression(alerts: DataFrame, ttl_s: int, fold_rows: int = FOLD_ROWS, among: DataFrame | None = None) -> DataFrame:
    """Add ``is_sent``: the first alert of an id, then the first one a full TTL after the last sent.

    Suppressed repeats do not extend the silence. Of alerts of one id at the same millisecond the
    earliest counts (by ``seq``, which is unique). Without a TTL (zero or less) all are sent. A null id
    is never sent.

    ``among``: rows that the alerts are some of and that are cheap to count by id, such as those that
    were scored. If no id has more than ``fold_rows`` of them, one shuffle by id does all. Otherwise,
    and without them, the alerts are checkpointed first, as they have to be counted.
    """
    ttl_ms = ttl_s * 1000
    if ttl_ms <= 0:
        return alerts.withColumn("is_sent", F.lit(True))
    marked = _fold_rows(alerts, ttl_ms) if _is_bounded(among, fold_rows) else _with_any_ids(alerts, ttl_ms, fold_rows)
    return marked.select(*alerts.columns, "is_sent")


def _is_bounded(among: DataFrame | None, fold_rows: int) -> bool:
    if among is None:
        return False
    largest = among.groupBy(KEY).count().agg(F.max("count")).first()[0]
    return largest is None or largest <= fold_rows


def _fold_rows(alerts: DataFrame, ttl_ms: int) -> DataFrame:
    """Each id's rows, a bounded number, side by side with those sent of them."""
    each = alerts.groupBy(KEY).agg(_sent(ttl_ms)["seq"].alias("_sent"), F.collect_list(F.struct(*alerts.columns)).alias("_rows"))
    rows = each.select("_sent", F.inline("_rows"))
    return rows.withColumn("is_sent", F.col(KEY).isNotNull() & F.array_contains("_sent", F.col("seq")))


def _with_any_ids(alerts: DataFrame, ttl_ms: int, fold_rows: int) -> DataFrame:
    """The same with ids of any number of rows: only distinct times are gathered, and of long ids not these either."""
    # The alerts are read three times below; they are few, what they were computed from is not.
    use_checkpoints(alerts.sparkSession)
    alerts = alerts.checkpoint()
    times = alerts.groupBy(KEY, "proc_ms").agg(F.min("seq").alias("seq"))
    per_id = times.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("_times"),
        F.min("proc_ms").alias("_first"), F.max("proc_ms").alias("_last"),
    )
    largest, longest = per_id.agg(
        F.max("_times"), F.max(F.when(F.col("_times") > fold_rows, F.col("_last") - F.col("_first")))
    ).first()
    if largest is None or largest <= fold_rows:
        sent = _fold(times, ttl_ms)
    else:
        long_ids = per_id.where(F.col("_times") > fold_rows).select(KEY)
        short = times.join(long_ids, KEY, "left_anti")
        long = times.join(long_ids, KEY, "left_semi")
        sent = _fold(short, ttl_ms).unionByName(_follow(long, ttl_ms, longest))
    marks = sent.select(KEY, "proc_ms", "seq", F.lit(True).alias("is_sent"))
    return alerts.join(marks, [KEY, "proc_ms", "seq"], "left").withColumn(
        "is_sent", F.coalesce("is_sent", F.lit(False))
    )


def _sent(ttl_ms: int) -> Column:
    """Greedy choice over a group's sorted times; every array has a checked size."""
    return F.aggregate(
        F.array_sort(F.collect_list(F.struct("proc_ms", "seq"))),
        F.array().cast("array<struct<proc_ms:bigint,seq:bigint>>"),
        lambda sent, at: F.when(
            (F.size(sent) == 0) | (at["proc_ms"] >= F.element_at(sent, -1)["proc_ms"] + ttl_ms),
            F.concat(sent, F.array(at)),
        ).otherwise(sent),
    )


def _fold(times: DataFrame, ttl_ms: int) -> DataFrame:
    return times.groupBy(KEY).agg(_sent(ttl_ms).alias("_sent")).select(KEY, F.inline("_sent"))


def _follow(times: DataFrame, ttl_ms: int, longest_ms: int) -> DataFrame:
    """The same choice for ids with very many alert times, without gathering an id.

    Every time points to the first time at least a TTL later. The sent alerts are those reached
    from an id's first time. Each round doubles the length of the pointers and of the part of
    the chain that is known, so the rounds grow with the logarithm of history / TTL.
    """
    # Searching the pointer target is a running maximum over descending time.
    search = times.select(KEY, "proc_ms", F.explode(F.array(
        F.struct((-F.col("proc_ms")).alias("back"), F.lit(0).alias("is_query")),
        F.struct((-F.col("proc_ms") - ttl_ms).alias("back"), F.lit(1).alias("is_query")),
    )).alias("_at")).select(KEY, "proc_ms", "_at.*")
    split = find_split(search, (KEY,), "back")
    candidate = F.when(F.col("is_query") == 0, F.col("back"))
    found = running(
        search, split, ["back", "is_query"], {"_next": Running("max", candidate)}, at=F.col("back")
    )
    jump = (
        found.where(F.col("is_query") == 1)
        .select(KEY, "proc_ms", (-F.col("_next")).alias("next_ms"))
        .where(F.col("next_ms").isNotNull())
        .checkpoint()
    )
    reached = times.groupBy(KEY).agg(F.min("proc_ms").alias("proc_ms"))
    for _ in range(ceil(log2(longest_ms // ttl_ms + 2))):
        step = reached.join(jump, [KEY, "proc_ms"]).select(KEY, F.col("next_ms").alias("proc_ms"))
        reached = reached.unionByName(step).checkpoint()
        target = jump.select(KEY, F.col("proc_ms").alias("next_ms"), F.col("next_ms").alias("_after"))
        jump = jump.join(target, [KEY, "next_ms"]).select(
            KEY, "proc_ms", F.col("_after").alias("next_ms")
        ).checkpoint()
    return times.join(reached, [KEY, "proc_ms"], "left_semi").select(KEY, "proc_ms", "seq")


def flagged(decisions: DataFrame) -> DataFrame:
    return decisions.where(F.col("decision") == "FLAGGED")


def flagged_events(decisions: DataFrame, created_at_ms: Column | None = None) -> DataFrame:
    """``TransactionFlagged`` events of flagged decisions; time in ns from a ms clock."""
    at = F.col("proc_ms") if created_at_ms is None else created_at_ms
    return flagged(decisions).withColumns({
        "type": F.lit("TransactionFlagged"),
        "timestamp_ns": at * 1_000_000,
    })


def alert_events(decisions: DataFrame, params: Params, among: DataFrame | None = None) -> DataFrame:
    """Alerts that go out: flagged, not suppressed, as events; ``among``: the rows that were scored."""
    return (
        with_suppression(flagged_events(decisions), params.alert_ttl_s, among=among)
        .where("is_sent").drop("is_sent")
        .withColumn("idempotency_key", F.concat(F.lit(IDEMPOTENCY_PREFIX), F.col(KEY)))
    )


def alert_records(events: DataFrame, params: Params) -> DataFrame:
    """Key/value records for a sink: one signed envelope per alert, keyed by transaction."""
    signed = wrap(events, params.signing_key, F.col("timestamp_ns"), "spark:alerts")
    return with_wire_envelope(signed, "value").select(F.col(KEY).alias("key"), "value")

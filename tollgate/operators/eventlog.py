"""The versioned event log: one row per accepted message, versions 1, 2, ... per user."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.functions.crypto import hmac_matches
from tollgate.operators.running import FIRST, PIECE, Running, find_split, running
from tollgate.operators.state import arrival, arrival_seq
from tollgate.operators.signing import signed_text, with_canonical_metadata, with_canonical_payload

AGGREGATE = ("aggregate_id",)


def log_rows(accepted: DataFrame) -> DataFrame:
    """Log columns of accepted messages, still without a version.

    The id is made from topic, partition and offset, so a retried write repeats it.
    """
    position = F.md5(F.concat_ws(":", "topic", "partition", "offset"))
    event_id = F.concat_ws(
        "-", *[F.substring(position, start, length)
               for start, length in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    )
    texts = with_canonical_metadata(with_canonical_payload(accepted, "_payload"), "_metadata")
    return texts.select(
        event_id.alias("event_id"),
        F.col("user_id").alias("aggregate_id"),
        F.col("type").alias("event_type"),
        F.col("_metadata").alias("metadata"),
        F.col("_payload").alias("payload"),
        "signature",
        F.col("timestamp").alias("created_at"),
        F.to_date("timestamp").alias("created_date"),
        arrival_seq().alias("seq"),
    )


def heads(log: DataFrame) -> DataFrame:
    """The latest version of each aggregate, from a log or from heads of several times."""
    return log.groupBy(*AGGREGATE).agg(F.max("version").alias("version"))


def next_versions(batch: DataFrame, log: DataFrame) -> DataFrame:
    """Version that the next event of each aggregate in the batch gets."""
    wanted = batch.select(*AGGREGATE).distinct()
    return wanted.join(heads(log), list(AGGREGATE), "left").select(
        *AGGREGATE, (F.coalesce("version", F.lit(0)) + 1).cast("bigint").alias("next_version")
    )


def with_versions(batch: DataFrame, log: DataFrame | None = None, group_rows: int | None = None) -> DataFrame:
    """Number the batch per aggregate in the order of (``created_at``, ``seq``), going on from the log.

    The log's latest version of an aggregate takes part as one leading row that counts as many
    versions, so numbering and looking up the base are a single pass over one shuffle. ``log`` may
    be the log itself or its ``heads``.
    """
    batch = batch.withColumn("_us", F.unix_micros("created_at"))
    split = find_split(batch, AGGREGATE, "_us", group_rows, tie="seq")
    steps = batch.withColumn("_step", F.lit(1).cast("bigint"))
    if log is not None:
        base = (
            log.groupBy(*AGGREGATE).agg(F.max("version").alias("_step"))
            .join(batch.select(*AGGREGATE).distinct(), list(AGGREGATE), "left_semi")
            .withColumn("_is_base", F.lit(True))
        )
        steps = steps.withColumn("_is_base", F.lit(False)).unionByName(base, allowMissingColumns=True)
    steps = steps.withColumn("_us", F.coalesce("_us", F.lit(FIRST)))  # the log's row comes first
    numbered = running(steps, split, ["_us", F.col("seq").asc_nulls_first()],
                       {"version": Running("sum", F.col("_step"))}, at=arrival("_us"))
    if log is not None:
        numbered = numbered.where(~F.col("_is_base")).drop("_is_base")
    return numbered.drop("_step", "_us", PIECE)


def append(
    batch: DataFrame, path: str, log: DataFrame | None = None, batch_id: int | None = None, writer: str | None = None
) -> None:
    """Write numbered rows, partitioned by date and in order of aggregate and version within files.

    With a ``batch_id`` the rows go to the batch's own directory under its ``writer``, which a
    retry overwrites. Another writer, such as a query with a new checkpoint, has its own batches.
    Files in order let a search for one aggregate skip the row groups of others.
    """
    target = path if batch_id is None else f"{path}/writer={writer}/batch_id={batch_id}"
    mode = "append" if batch_id is None else "overwrite"
    numbered = with_versions(batch, log).sortWithinPartitions("created_date", *AGGREGATE, "version")
    numbered.write.mode(mode).partitionBy("created_date").parquet(target)


def load(log: DataFrame, aggregate_id: str) -> DataFrame:
    """Events of one aggregate in version order."""
    return log.where(F.col("aggregate_id") == aggregate_id).orderBy("version")


def by_payload(log: DataFrame, path: str, value: str) -> DataFrame:
    """Events whose payload has a text field of the given value, e.g. ``$.merchantId``."""
    return log.where(F.get_json_object("payload", path) == value)


def by_time(log: DataFrame, start: str, end: str) -> DataFrame:
    """Events created in ``[start, end)``; the date predicate prunes partitions."""
    since, until = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    return log.where(
        F.col("created_date").between(F.to_date(since), F.to_date(until))
        & (F.col("created_at") >= since) & (F.col("created_at") < until)
    )


def with_integrity(log: DataFrame, key: str) -> DataFrame:
    """Add ``is_genuine``: whether the stored texts still carry their signature."""
    text = signed_text("metadata", "payload")
    return log.withColumn("is_genuine", hmac_matches(text, F.col("signature"), key))


def load_verified(log: DataFrame, aggregate_id: str, key: str) -> DataFrame:
    """Like ``load``, but reading a row with a wrong signature fails the job."""
    checked = with_integrity(load(log, aggregate_id), key)
    problem = F.concat(
        F.lit("signature is not the event's: "), F.col("aggregate_id"),
        F.lit(" "), F.col("event_id"),
    )
    return checked.where(
        F.when(F.col("is_genuine"), True).otherwise(F.raise_error(problem).cast("boolean"))
    ).drop("is_genuine")


def quarantine(log: DataFrame, key: str) -> DataFrame:
    """The rows that do not verify, over all aggregates at once."""
    return with_integrity(log, key).where(~F.col("is_genuine")).drop("is_genuine")


def version_conflicts(candidates: DataFrame) -> DataFrame:
    """(aggregate, version) pairs taken more than once; check before a commit."""
    return (
        candidates.groupBy(*AGGREGATE, "version").agg(F.count(F.lit(1)).alias("writers"))
        .where(F.col("writers") > 1)
    )


"""The product as chained streaming queries over durable tables.

    messages -> ingested -> event log            (versions per user)
                         -> dead letters
                         -> decisions -> alerts

Ingested messages, decisions, dead letters and alerts are written by file sinks, whose own logs make
a retried micro-batch harmless; the event log commits each batch once (``operators/storedlog.py``).
State is in the state store (``processors.py``). No message is dropped for being late.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tollgate.operators import alerts, deadletter, decide, eventlog, history, ingest, rollups
from tollgate.operators.outbox import Outbox, Send
from tollgate.operators.rules import RuleSet, SpendRule, default_rules
from tollgate.operators.state import arrival_seq
from tollgate.operators.storedlog import StoredLog
from tollgate.params import Params
from tollgate.session import remove_folder, tune
from tollgate.sources.messages import stream_kafka, stream_records
from tollgate.streaming.processors import STATE_COLUMNS, AlertSuppression, UserState

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = (
    "transaction_id", "user_id", "merchant_id", "amount", "currency", "type", "timestamp_ns",
    "latitude", "longitude", "device_fingerprint", "ip_address", "user_agent", "validator_id",
)
# So far behind the newest message a row of an unordered stream may be and still find its user's window.
SLACK_S = 86_400
# The type of a row that only says how far time has come.
TICK = "Tick"


class Pipeline:
    """All tables and checkpoints under one folder that every executor can reach.

    ``lateness_s``: how much older than the newest message another may be that still takes its place
    in the order. Rows wait until no such message can come, then are scored as a batch job scores
    them, however a backlog was cut into micro-batches. Without it (None) rows are scored as they
    come, and windows are remembered for ``SLACK_S`` longer than they last. Either way a row that comes
    after a later one of its user was scored is scored then, and counted as late.
    """

    def __init__(
        self, spark: SparkSession, folder: str, params: Params, lateness_s: int | None = None,
        aggregate: decide.Aggregator = decide.weighted_mean,
    ):
        self.spark = tune(spark)
        self.folder = folder
        self.params = params
        self.lateness_s = lateness_s
        self.aggregate = aggregate
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    @property
    def delay_s(self) -> int:
        """How far the watermark is behind the newest message."""
        return SLACK_S if self.lateness_s is None else self.lateness_s

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def checkpoint(self, name: str) -> str:
        return f"{self.folder}/checkpoints/{name}"

    def _write(self, df: DataFrame, table: str, *partitions: str):
        writer = df.writeStream.format("parquet").option("path", self.path(table))
        if partitions:
            writer = writer.partitionBy(*partitions)
        return writer.option("checkpointLocation", self.checkpoint(table))

    def _send(self, records: DataFrame, table: str, kafka: dict[str, str] | None):
        """Records to a topic if its options are given (``kafka_sink_options``), else to files."""
        if kafka is not None:
            return stream_kafka(records, kafka, self.checkpoint(table))
        return stream_records(records, self.path(table), self.checkpoint(table))

    def _follow(self, table: str, schema: T.StructType) -> DataFrame:
        return self.spark.readStream.schema(schema).parquet(self.path(table))

    # --- ingest ---

    def ingested(self, messages: DataFrame) -> DataFrame:
        checked = ingest.ingest(messages, self.params.signing_key)
        return checked.withColumn(
            "outcome", F.when(F.col("error_type").isNull(), "accepted").otherwise("rejected")
        ).observe(
            "ingest", F.count(F.lit(1)).alias("messages"),
            F.count_if(F.col("error_type").isNotNull()).alias("rejected"),
        )

    def write_ingested(self, messages: DataFrame):
        return self._write(self.ingested(messages), "ingested", "outcome")

    def _accepted(self, schema: T.StructType) -> DataFrame:
        return ingest.accepted(self._follow("ingested", schema).where(F.col("outcome") == "accepted"))

    def write_dead_letters(self, schema: T.StructType, kafka: dict[str, str] | None = None):
        bad = self._follow("ingested", schema).where(F.col("outcome") == "rejected")
        bad = bad.observe("dead letters", F.count(F.lit(1)).alias("messages"))
        return self._send(deadletter.dead_letters(bad), "dead_letters", kafka)

    # --- event log ---

    @property
    def log(self) -> StoredLog:
        return StoredLog(self.spark, self.path("log"))

    def write_log(self, schema: T.StructType):
        """Append to the log, which other queries may append to at the same time."""
        rows = eventlog.log_rows(self._accepted(schema)).observe("log", F.count(F.lit(1)).alias("messages"))

        def append(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            try:
                self.log.append(batch, self.writer("log"), batch_id)
            finally:
                batch.unpersist()

        return rows.writeStream.foreachBatch(append).option("checkpointLocation", self.checkpoint("log"))

    def writer(self, name: str) -> str:
        """The id of the query that has this checkpoint; a new checkpoint gives a new one."""
        stored = self.spark.read.text(f"{self.checkpoint(name)}/metadata").first()[0]
        return json.loads(stored)["id"]

    # --- scoring ---

    @staticmethod
    def rows(accepted: DataFrame) -> DataFrame:
        return accepted.select(arrival_seq().alias("seq"), F.unix_millis("timestamp").alias("proc_ms"), *FIELDS)

    def prepared(self, accepted: DataFrame, rules: RuleSet, ticks: DataFrame | None = None) -> DataFrame:
        """Accepted messages of a stream with each user's state, which is in the state store."""
        spends = any(isinstance(rule, SpendRule) for rule in rules)
        timed = accepted.select(*FIELDS, "partition", "offset", "timestamp")
        if ticks is not None:
            # No null among the numbers: pandas would make floats of a column that has one.
            blank = {f.name: F.lit(None if f.dataType == T.StringType() else 0).cast(f.dataType) for f in timed.schema if f.name not in ("type", "timestamp")}
            timed = timed.unionByName(ticks.withColumns(blank))
        timed = timed.withWatermark("timestamp", f"{self.delay_s} seconds")
        # Without the watermark's column the state gets late rows too, instead of losing them.
        rows = self.rows(timed)
        layout = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        found = rows.groupBy("user_id").transformWithStateInPandas(
            statefulProcessor=UserState(
                rows.schema, self.params.velocity_window_s, self.params.spend_window_s if spends else None,
                wait=self.lateness_s is not None, ignore=TICK),
            outputStructType=f"{layout}, {STATE_COLUMNS}", outputMode="append", timeMode="EventTime",
        ).withColumn("prev", F.when(F.col("prev_timestamp_ns").isNotNull(), F.struct(
            F.col("prev_timestamp_ns").alias("timestamp_ns"),
            F.col("prev_latitude").alias("latitude"), F.col("prev_longitude").alias("longitude"),
        ))).drop("prev_timestamp_ns", "prev_latitude", "prev_longitude")
        return found if spends else found.drop("spend")

    def scored(self, accepted: DataFrame, rules: RuleSet | None = None, ticks: DataFrame | None = None) -> DataFrame:
        """Decisions of a stream of accepted messages."""
        rules = rules or default_rules(self.params)
        df = self.prepared(accepted, rules, ticks)
        for rule in rules:
            df = rule.prepare(df, None)
        decided = decide.decide(df.where(F.col("type") == decide.VALIDATED), rules, self.params, self.aggregate)
        return decided.observe(
            "scoring", F.count(F.lit(1)).alias("messages"),
            F.count_if(F.col("decision") == decide.ERROR).alias("rejected"), F.count_if("is_late").alias("late"),
        )

    def write_decisions(self, schema: T.StructType, rules: RuleSet | None = None):
        accepted = self._accepted(schema)
        return self._write(self.scored(accepted, rules, self._ticks()), "decisions")

    def write_decisions_in_force(self, schema: T.StructType, changes: str):
        """Decisions by the parameters in force at each row, from the table of changes at ``changes``, read anew for each micro-batch.

        Thresholds, blacklist and critical rules change without a restart; the length of the window is
        the job's. The changes that a micro-batch found are kept under its number, so a retry scores
        with the same, whatever has been added since, as long as Spark can retry it. Each micro-batch has its own directory, which a
        retry overwrites.
        """
        rules = history.rules_in_force(self.params)

        def score(batch: DataFrame, batch_id: int) -> None:
            known = self._changes_of(changes, batch_id)
            df = history.with_params_in_force(batch, known)
            for rule in rules:
                df = rule.prepare(df, None)
            critical = history.critical_in_force(self.params) if "critical_rule_ids" in known.columns else None
            decided = decide.decide(df.where(F.col("type") == decide.VALIDATED), rules, self.params, self.aggregate, critical)
            decided = history.decide_in_force(decided, self.params)
            decided.write.mode("overwrite").parquet(f"{self.path('decisions_in_force')}/batch={batch_id}")

        rows = self.prepared(self._accepted(schema), rules, self._ticks())
        return rows.writeStream.foreachBatch(score).option("checkpointLocation", self.checkpoint("decisions_in_force"))

    def _changes_of(self, changes: str, batch_id: int) -> DataFrame:
        kept = f"{self.path('changes_used')}/batch={batch_id}"
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{kept}/_SUCCESS")
        if not at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at):
            self.spark.read.parquet(changes).coalesce(1).write.mode("overwrite").parquet(kept)
            # No batch comes again of which Spark has dropped the log.
            old = batch_id - int(self.spark.conf.get("spark.sql.streaming.minBatchesToRetain"))
            remove_folder(self.spark, f"{self.path('changes_used')}/batch={old}")
        return self.spark.read.parquet(kept)

    def _ticks(self) -> DataFrame:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path("ticks"))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(at)
        return self.spark.readStream.schema("type string, timestamp timestamp").parquet(self.path("ticks"))

    def tick(self, upto_ms: int) -> None:
        """Say that all messages older than this have come: rows that wait for them are scored when the query runs next."""
        at = upto_ms + 1000 * self.delay_s
        row = self.spark.createDataFrame([(TICK, at)], "type string, ms bigint").select("type", F.timestamp_millis("ms").alias("timestamp"))
        row.coalesce(1).write.mode("append").parquet(self.path("ticks"))

    # --- alerts ---

    def alert_events(self, decisions: DataFrame) -> DataFrame:
        """Alerts that go out. Ordered decisions let an id be forgotten a TTL after its last alert."""
        flagged = self._flagged(decisions, SLACK_S if self.lateness_s is None else 0).drop("at")
        return flagged.groupBy("transaction_id").transformWithStateInPandas(
            statefulProcessor=AlertSuppression(self.params.alert_ttl_s),
            outputStructType=flagged.schema, outputMode="append", timeMode="EventTime",
        )

    def alert_events_within_watermark(self, decisions: DataFrame) -> DataFrame:
        """The same by Spark's own de-duplication, without Python.

        An id is silent until the watermark, itself a TTL behind the newest decision, is past its
        first alert. So unlike above its silence lasts between one and two TTLs, as far as the
        stream has come; a stream that has stopped keeps it silent.
        """
        flagged = self._flagged(decisions, self.params.alert_ttl_s)
        return flagged.dropDuplicatesWithinWatermark(["transaction_id"]).drop("at")

    def _flagged(self, decisions: DataFrame, delay_s: int) -> DataFrame:
        events = alerts.flagged_events(decisions).select(
            "seq", "proc_ms", *FIELDS, "reason", "risk_score", F.timestamp_millis("proc_ms").alias("at"))
        return events.withWatermark("at", f"{delay_s} seconds")

    def write_alerts(self, schema: T.StructType, kafka: dict[str, str] | None = None):
        """The alerts as records."""
        sent = self.alert_events(self._follow("decisions", schema))
        sent = sent.observe("alerts", F.count(F.lit(1)).alias("messages"))
        return self._send(alerts.alert_records(sent, self.params), "alerts", kafka)

    @property
    def outbox(self) -> Outbox:
        return Outbox(self.spark, self.path("outbox"))

    def deliver_alerts(self, schema: T.StructType, send: Send):
        """The alerts to a sink that answers for each record; what it has not confirmed is sent again with the next batch."""
        sent = self.alert_events(self._follow("decisions", schema))

        def deliver(batch: DataFrame, batch_id: int) -> None:
            self.outbox.add(alerts.alert_records(batch, self.params), f"{self.writer('outbox')}-{batch_id}")
            self.outbox.deliver(send)

        return sent.writeStream.foreachBatch(deliver).option("checkpointLocation", self.checkpoint("outbox"))

    # --- reading the live state ---

    def state(self, variable: str, query: str = "decisions", batch_id: int | None = None) -> DataFrame:
        """A state variable of a query as of a batch (by default the last one), from its checkpoint; the query may be running."""
        reader = self.spark.read.format("statestore").option("stateVarName", variable)
        if batch_id is not None:
            reader = reader.option("batchId", batch_id)
        return reader.load(self.checkpoint(query))

    def balances(self, batch_id: int | None = None) -> DataFrame:
        """``user_id``, ``balance`` after a batch of the scoring query."""
        return self.state("account", batch_id=batch_id).select("key.user_id", "value.balance")

    def recent_transactions(self, batch_id: int | None = None) -> DataFrame:
        """The transactions that users are remembered by, for ``state.lookup_counts``."""
        rows = self.state("recent", batch_id=batch_id)
        return rows.select("key.user_id", "list_element.transaction_id", "list_element.proc_ms")

    # --- all of it ---

    def run_available(self, messages: DataFrame, upto_ms: int | None = None) -> None:
        """Process everything that has arrived, stage after stage, then stop; with ``upto_ms`` nothing older waits any longer."""
        def finish(writer) -> StreamingQuery:
            started = writer.trigger(availableNow=True).start()
            started.awaitTermination()
            return started

        ingested = self.ingested(messages).schema
        finish(self.write_ingested(messages))
        finish(self.write_log(ingested))
        finish(self.write_dead_letters(ingested))
        if upto_ms is not None:
            self.tick(upto_ms)
        finish(self.write_decisions(ingested))
        finish(self.write_alerts(self.spark.read.parquet(self.path("decisions")).schema))


def counts_per_minute(df: DataFrame, at: str, delay: str, *labels: str) -> DataFrame:
    """Rows per minute and label set; the only place where lateness closes a window."""
    return (
        df.withWatermark(at, delay).groupBy(F.window(at, "1 minute"), *labels)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("minute"), *labels, "n")
    )


def sketches_per_minute(df: DataFrame, at: str, delay: str, ticks: str, *labels: str) -> DataFrame:
    """A mergeable quantile sketch per minute and label set, for ``rollups.sketch_percentiles`` over any time."""
    timed = df.withWatermark(at, delay)
    return rollups.latency_sketches(timed, [F.window(at, "1 minute"), *labels], F.col(ticks)).select(F.col("window.start").alias("minute"), *labels, "sketch")

"""Sending records in two steps: first they are stored, then each is sent until the sink has confirmed it.

A record is named by its batch, key and value: a retry of the batch brings the same records, and a
record that a batch has twice is sent once.

A sink that fails for some records stops nothing: its errors are rows. What was never confirmed is
sent again by the next delivery, so a record is sent at least once; a crash between a sink's answer
and the stored result sends it twice, and consumers go by the records' keys.

    records/batch=<name>/...   key, value, record (a hash); a retry of a batch overwrites it
    results/batch=<name>/...   record, attempt, sink_error (null if confirmed)
    open/<name>                there while a record of the batch may not be confirmed

A delivery reads the open batches only, however many were delivered before.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.session import let_workers_import, remove_folder

RECORDS = "key string, value string, record string, batch string"
RESULTS = "record string, attempt int, sink_error string, batch string"
# A sink: takes keys and values, and gives for each the error text, or None if it is confirmed.
Send = Callable[[Sequence[str], Sequence[str]], Sequence[str | None]]
SEND_ROWS = 500


def sent_by(pending: DataFrame, send: Send, rows: int = SEND_ROWS) -> DataFrame:
    """``record``, ``attempt``, ``sink_error``, ``batch`` of each record after one more try. A sink that raises has failed for all records of that call."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                keys, values = part.column(2).to_pylist(), part.column(3).to_pylist()
                try:
                    errors = list(send(keys, values))
                    if len(errors) != len(keys):
                        errors = ["the sink did not answer for each record"] * len(keys)
                except Exception as problem:  # a failing sink is a result, not a job failure
                    errors = [str(problem) or type(problem).__name__] * len(keys)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(errors, pa.string()), part.column(4)], ["record", "attempt", "sink_error", "batch"])

    let_workers_import(pending.sparkSession)
    return pending.select("record", (F.col("attempts") + 1).alias("attempt"), "key", "value", "batch").mapInArrow(run, RESULTS)


class Outbox:
    """Records to send, under ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        at, files = self._folder(path)
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _read(self, table: str, schema: str, batches: Sequence[str] | None) -> DataFrame:
        parts = [table] if batches is None else [f"{table}/batch={b}" for b in batches]
        parts = [f"{self.path}/{part}" for part in parts if self._names(part)]
        if not parts:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*parts)

    def add(self, records: DataFrame, batch: str) -> None:
        """Store what is to be sent; the same batch again replaces it."""
        if not re.fullmatch(r"[\w-]+", batch, re.ASCII):
            raise ValueError(f"a batch is named by letters, digits, - and _: {batch}")
        at, files = self._folder(f"open/{batch}")
        files.create(at, True).close()  # first, so that no stored batch is overlooked
        name = F.sha2(F.to_json(F.struct(F.lit(batch).alias("batch"), "key", "value")), 256)
        named = records.select("key", "value", name.alias("record")).dropDuplicates(["record"])
        named.write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")

    def open_batches(self) -> list[str]:
        """The stored batches of which a record may not be confirmed; one whose storing failed comes again."""
        return sorted(b for b in self._names("open") if "_SUCCESS" in self._names(f"records/batch={b}"))

    def records(self, batches: Sequence[str] | None = None) -> DataFrame:
        return self._read("records", RECORDS, batches)

    def results(self, batches: Sequence[str] | None = None) -> DataFrame:
        return self._read("results", RESULTS, batches)

    def status(self, batches: Sequence[str] | None = None) -> DataFrame:
        """``batch``, ``record``, ``key``, ``attempts``, ``is_confirmed``, ``sink_error`` (of the last try, null once confirmed) of each record, by default of all batches."""
        tries = self.results(batches).groupBy("batch", "record").agg(
            F.max("attempt").alias("attempts"), F.bool_or(F.col("sink_error").isNull()).alias("is_confirmed"),
            F.max_by("sink_error", "attempt").alias("sink_error"))
        return self.records(batches).join(tries, ["batch", "record"], "left").select(
            "batch", "record", "key", F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("is_confirmed", F.lit(False)).alias("is_confirmed"),
            F.when(~F.col("is_confirmed"), F.col("sink_error")).alias("sink_error"))

    def pending(self) -> DataFrame:
        """Records that no sink has confirmed, with the tries so far."""
        batches = self.open_batches()
        left = self.status(batches).where(~F.col("is_confirmed")).select("batch", "record", "attempts")
        return self.records(batches).join(left, ["batch", "record"])

    def deliver(self, send: Send) -> None:
        """Send all that is pending once, store the sink's answers, and close the batches of which nothing is left."""
        batches = self.open_batches()
        if not batches:
            return
        sent_by(self.pending(), send).write.mode("append").partitionBy("batch").parquet(f"{self.path}/results")
        unfinished = {row.batch for row in self.status(batches).where(~F.col("is_confirmed")).select("batch").distinct().collect()}
        for batch in set(batches) - unfinished:
            remove_folder(self.spark, f"{self.path}/open/{batch}")

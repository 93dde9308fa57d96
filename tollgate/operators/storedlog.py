"""The event log as stored tables that several writers may append to.

A writer numbers its rows on top of the versions it has read, writes them under an attempt of its
own, and then claims the next commit number with a file that only one writer can create. Rows count
once their attempt is claimed. A writer that finds the number taken looks at what was committed
since: if no aggregate got the same version twice, the attempt stands and the following number is
tried; otherwise its rows are numbered anew, or, if the caller said so, the append is a conflict.

    data/attempt=<id>/created_date=<day>/...   rows, in order of aggregate and version within files
    commits/<number>                           one line of JSON: number, attempt, writer, batch
    heads/upto=<number>/...                    versions of all aggregates, every so many commits
    index/upto=<number>/...                    all commits up to then, as a table

An append lists and opens the commits and attempts since the last stored heads and index, however
many there were before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.operators import eventlog
from tollgate.session import remove_folder

COMMIT = "number bigint, attempt string, writer string, batch_id bigint"
# So many commits apart are the stored heads and indexes, and so many of them are kept.
HEADS_EVERY = 20
HEADS_KEPT = 2
# The folders of so many commits are opened by name; to read more, all folders are listed.
NAMED = 200
ATTEMPTS = 100
# Payload fields that can be searched by an index, and the columns that hold them.
INDEXED = {
    "$.merchantId": "merchant_id", "$.transactionId": "transaction_id",
    "$.telemetry.deviceFingerprint": "device_fingerprint", "$.telemetry.ipAddress": "ip_address",
}


class VersionConflict(Exception):
    """Another writer has taken a version of one of the aggregates; ``aggregates`` names some."""

    def __init__(self, aggregates: Sequence[str]):
        super().__init__(f"versions taken by another writer: {', '.join(map(str, aggregates))}")
        self.aggregates = list(aggregates)


@dataclass(frozen=True)
class Attempt:
    """Written rows of a batch, numbered on top of commit ``base``."""

    name: str
    base: int
    writer: str
    batch_id: int


class StoredLog:
    """An event log in ``path``, a folder that every executor can reach."""

    def __init__(self, spark: SparkSession, path: str, indexed: dict[str, str] | None = None):
        self.spark, self.path = spark, path
        self.indexed = INDEXED if indexed is None else indexed

    # --- files ---

    def _folder(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, table: str) -> list[str]:
        at, files = self._folder(f"{self.path}/{table}")
        return [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []

    def _create(self, path: str, text: str) -> bool:
        """Make a file with this content unless there is one; whether it was made.

        It appears with its content: written aside, then renamed, which fails if the name is taken.
        """
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        aside, files = self._folder(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = files.create(aside, False)
        out.write(text.encode())
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(path)
        files.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, target, options)
            return True
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" not in error.java_exception.getClass().getName():
                raise
            return False
        finally:
            files.delete(aside, False)

    # --- reading ---

    def latest(self) -> int:
        """The number of the last commit, 0 if there is none: from the last index on, the numbers that follow are tried."""
        number = max(self._stored("index"), default=0)
        while True:
            at, files = self._folder(self._commit_file(number + 1))
            if not files.exists(at):
                return number
            number += 1

    def commits(self, after: int = 0, upto: int | None = None) -> DataFrame:
        """The commits of these numbers: up to an index from its table, the others from their files."""
        upto = self.latest() if upto is None else upto
        known = max((n for n in self._stored("index") if n <= upto), default=0)
        found = self.spark.createDataFrame([], COMMIT)
        if known > after:
            found = self.spark.read.schema(COMMIT).parquet(f"{self.path}/index/upto={known}").where(F.col("number") > after)
        later = [self._commit_file(n) for n in range(max(known, after) + 1, upto + 1)]
        return found.unionByName(self.spark.read.schema(COMMIT).json(later)) if later else found

    def read(self, after: int = 0, upto: int | None = None) -> DataFrame | None:
        """The committed rows, with their ``commit``, or those of some commits; None if nothing was written by these.

        The attempts that count prune the folders of the others; those of few commits are opened by name.
        """
        upto = self.latest() if upto is None else upto
        if upto <= after:
            return None
        data, chosen = f"{self.path}/data", self.commits(after, upto).select("attempt", F.col("number").alias("commit"))
        folders = [data]
        if upto - after <= NAMED:
            named = [f"{data}/attempt={row.attempt}" for row in chosen.collect()]
            folders = [folder for folder in named if not self._is_blank(folder)]
        if not folders:
            return None
        rows = self.spark.read.option("basePath", data).parquet(*folders)
        return rows.join(chosen, "attempt").drop("attempt")

    def heads(self, upto: int) -> DataFrame | None:
        """``aggregate_id``, ``version`` as of a commit: the last stored heads, and what was committed after them."""
        known = max((n for n in self._stored("heads") if n <= upto), default=0)
        parts = [self.spark.read.parquet(f"{self.path}/heads/upto={known}")] if known else []
        later = self.read(known, upto)
        if later is not None:
            parts.append(later.select(*eventlog.AGGREGATE, "version"))
        return eventlog.heads(reduce(DataFrame.unionByName, parts)) if parts else None

    def _commit_file(self, number: int) -> str:
        return f"{self.path}/commits/{number:012d}"

    def _is_blank(self, folder: str) -> bool:
        """Whether an attempt had no rows; a lost one is not blank, reading it fails."""
        at, files = self._folder(folder)
        return files.exists(at) and not any(f.isDirectory() for f in files.listStatus(at))

    def _stored(self, table: str) -> list[int]:
        numbers = [int(n.removeprefix("upto=")) for n in self._names(table) if n.startswith("upto=")]
        return [n for n in numbers if "_SUCCESS" in self._names(f"{table}/upto={n}")]

    # --- writing ---

    def prepare(self, batch: DataFrame, writer: str, batch_id: int) -> Attempt:
        """Number the rows on top of what is committed now, and write them; they don't count yet."""
        # Of digits alone a name would be read back as a number.
        return self._written(batch, Attempt(f"a{uuid.uuid4().hex}", self.latest(), writer, batch_id))

    def _written(self, batch: DataFrame, attempt: Attempt) -> Attempt:
        numbered = eventlog.with_versions(batch, self.heads(attempt.base))
        fields = {column: F.get_json_object("payload", field) for field, column in self.indexed.items()}
        numbered = numbered.withColumns({f"field_{column}": value for column, value in fields.items()})
        writer = numbered.sortWithinPartitions("created_date", *eventlog.AGGREGATE, "version").write
        for column in (*eventlog.AGGREGATE, *(f"field_{c}" for c in self.indexed.values())):
            writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.partitionBy("created_date").parquet(f"{self.path}/data/attempt={attempt.name}")
        return attempt

    def commit(self, attempt: Attempt, batch: DataFrame, on_conflict: str = "renumber") -> int:
        """Make an attempt count; its commit number. ``batch`` is what it was prepared from.

        ``on_conflict``: ``renumber`` the rows, as a writer of a stream does, or ``fail`` with a
        ``VersionConflict``, as a caller does who has decided by the versions it read.
        """
        for _ in range(ATTEMPTS):
            number = attempt.base + 1
            if self._claimed(number, attempt):
                if number % HEADS_EVERY == 0:
                    self._store_heads(number)
                return number
            newest = self.latest()
            taken = self._taken(attempt, newest)
            if not taken:  # other aggregates: the numbers still hold
                attempt = Attempt(attempt.name, newest, attempt.writer, attempt.batch_id)
            elif on_conflict == "fail":
                raise VersionConflict([row.aggregate_id for row in taken])
            else:
                stale = f"{self.path}/data/attempt={attempt.name}"
                attempt = self.prepare(self._rows_of(stale, batch), attempt.writer, attempt.batch_id)
                remove_folder(self.spark, stale)  # never counted
        raise RuntimeError(f"no commit in {ATTEMPTS} attempts")

    def _taken(self, attempt: Attempt, newest: int) -> list:
        """Some aggregates of which the attempt has a version that a commit after its base has too."""
        others, folder = self.read(attempt.base, newest), f"{self.path}/data/attempt={attempt.name}"
        if others is None or self._is_blank(folder):
            return []
        versions = [df.select(*eventlog.AGGREGATE, "version") for df in (self.spark.read.parquet(folder), others)]
        return eventlog.version_conflicts(reduce(DataFrame.unionByName, versions)).select(*eventlog.AGGREGATE).distinct().limit(5).collect()

    def _rows_of(self, folder: str, batch: DataFrame) -> DataFrame:
        """The rows an attempt has written, as they were before they got versions: signing them again costs more than reading them."""
        stored = self.spark.read.parquet(folder)
        return stored.select(*[F.col(f.name).cast(f.dataType) for f in batch.schema])

    def _claimed(self, number: int, attempt: Attempt) -> bool:
        line = {"number": number, "attempt": attempt.name, "writer": attempt.writer, "batch_id": attempt.batch_id}
        return self._create(self._commit_file(number), json.dumps(line))

    def append(self, batch: DataFrame, writer: str, batch_id: int, on_conflict: str = "renumber") -> int:
        """Number, write and commit the rows of a writer's batch once, whatever is retried; its commit number."""
        done = self.commits().where((F.col("writer") == writer) & (F.col("batch_id") == batch_id)).agg(F.min("number")).first()[0]
        if done is not None:
            return done
        return self.commit(self.prepare(batch, writer, batch_id), batch, on_conflict)

    def _store_heads(self, number: int) -> None:
        """Heads and index as of a commit; those before stay a while, for writers that have begun to read them."""
        heads = self.heads(number)
        if heads is not None:
            heads.write.mode("overwrite").parquet(f"{self.path}/heads/upto={number}")
        self.commits(upto=number).coalesce(1).sortWithinPartitions("writer", "batch_id").write.mode("overwrite").parquet(f"{self.path}/index/upto={number}")
        for table in ("heads", "index"):
            for old in sorted(self._stored(table))[:-HEADS_KEPT]:
                remove_folder(self.spark, f"{self.path}/{table}/upto={old}")

    # --- searching ---

    def by_payload(self, field: str, value: str) -> DataFrame | None:
        """Committed events whose payload has a text field of this value; None while nothing was written.

        A field with an index is compared in its own column, whose Bloom filters let the scan skip
        row groups; any other is read from every payload.
        """
        rows = self.read()
        if rows is None:
            return None
        if field in self.indexed:
            return rows.where(F.col(f"field_{self.indexed[field]}") == value)
        return eventlog.by_payload(rows, field, value)

"""Success and error counts of running streams, from what their queries observe."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class OutcomeCounts(StreamingQueryListener):
    """Adds up what ``Pipeline``'s queries observe (ingest, log, dead letters, scoring, alerts); register it with ``spark.streams.addListener``.

    A query that stops with an error counts once as ``failed``.
    """

    def __init__(self):
        self.counts: Counter[tuple[str, str]] = Counter()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for operation, row in event.progress.observedMetrics.items():
            seen = {name: n or 0 for name, n in row.asDict().items()}
            rejected = seen.pop("rejected", 0)
            self.counts[operation, "error"] += rejected
            self.counts[operation, "success"] += seen.pop("messages", 0) - rejected
            for outcome, n in seen.items():  # such as late
                self.counts[operation, outcome] += n

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            self.counts["query", "failed"] += 1

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(operation, outcome, n) for (operation, outcome), n in sorted(self.counts.items())]
        return spark.createDataFrame(rows, "operation string, outcome string, n bigint")

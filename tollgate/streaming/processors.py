"""Keyed state of the streaming jobs, in Spark's state store.

A handler gets the rows of one key in one micro-batch and what the key is remembered by. All that
it computes is computed for all these rows at once, with arrays. What is no longer needed is
forgotten by timers on the stream's own clock, the watermark, so a key that falls silent doesn't
keep its window for ever, and a replay forgets at the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACCOUNT = T.StructType([
    T.StructField("balance", T.DecimalType(38, 0)),
    T.StructField("timestamp_ns", T.LongType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("last_ms", T.LongType()),
])
RECENT = T.StructType([
    T.StructField("transaction_id", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("proc_ms", T.LongType()),
    T.StructField("amount", T.DecimalType(38, 0)), T.StructField("is_new", T.BooleanType()),
])
CLOCK = T.StructType([T.StructField("proc_ms", T.LongType())])
STATE_COLUMNS = (
    "is_new boolean, balance decimal(38,0), velocity_count bigint, spend decimal(38,0), "
    "prev_timestamp_ns bigint, prev_latitude double, prev_longitude double, is_late boolean"
)
NEVER = np.iinfo(np.int64).min


def stored(rows: pd.DataFrame) -> list[tuple]:
    """The rows as the state store takes them."""
    return list(rows.astype(object).where(rows.notna(), None).itertuples(index=False, name=None))


def previous(ids: np.ndarray, clock: np.ndarray) -> np.ndarray:
    """For each row the clock of the row before that has the same id, ``NEVER`` if there is none."""
    codes = pd.factorize(ids)[0]
    order = np.argsort(codes, kind="stable")
    out = np.full(len(clock), NEVER)
    again = np.flatnonzero(codes[order][1:] == codes[order][:-1])
    out[order[again + 1]] = clock[order[again]]
    return out


def alive_counts(clock: np.ndarray, seq: np.ndarray, prev: np.ndarray, window_ms: int) -> np.ndarray:
    """Distinct ids in ``(now - window, now]`` at each row: a running sum over ids that enter, leave and stay on."""
    alive = (prev != NEVER) & (prev > clock - window_ms)
    n, kept = len(clock), prev[alive] + window_ms
    at = np.concatenate((clock, clock + window_ms, kept))
    enters = np.arange(len(at)) < n
    change = np.concatenate((1 - alive, np.full(n, -1), np.ones(len(kept), np.int64)))
    order = np.lexsort((np.concatenate((seq, np.zeros(len(at) - n, np.int64))), enters, at))
    out = np.empty(len(at), np.int64)
    out[order] = np.cumsum(change[order])
    return out[:n]


class UserState(StatefulProcessor):
    """Balance, recent transactions, what was spent lately and last telemetry of a user.

    Adds the columns of ``STATE_COLUMNS`` to each row, with the meaning of the batch operators.

    ``wait`` keeps a row until the watermark has passed it, so that rows meet the state in the
    order of clock and number whatever micro-batches bring them. A row that comes after a later one
    of its user was let through is late: it goes through at once and is marked. Rows of the type
    ``ignore`` only move the watermark.

    What a user is remembered by: ``account``, one row, for ever; ``recent``, the rows of the longest
    window, until the watermark is a window past the last of them; ``waiting``.
    """

    def __init__(self, columns: T.StructType, window_s: int, spend_window_s: int | None = None, wait: bool = True, ignore: str | None = None):
        self.columns, self.wait, self.ignore = columns, wait, ignore
        self.window_ms = window_s * 1000
        self.spend_ms = None if spend_window_s is None else spend_window_s * 1000
        self.keep_ms = max(self.window_ms, self.spend_ms or 0)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.account = handle.getValueState("account", ACCOUNT)
        self.recent = handle.getListState("recent", RECENT)
        self.waiting = handle.getListState("waiting", self.columns)
        self.first_waiting = handle.getValueState("first_waiting", CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        if self.ignore is not None and not isinstance(key[0], str):
            batch = batch[batch["type"] != self.ignore]
        if len(batch):
            yield from self._advance(batch, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._advance(None, timerValues.getCurrentWatermarkInMs())

    def _advance(self, batch: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        ready = self._released(batch, watermark) if self.wait else batch
        if ready is not None and len(ready):
            yield self._with_state(ready.sort_values(["proc_ms", "seq"], ignore_index=True), watermark)
        elif self.account.exists() and self.account.get()[4] + self.keep_ms < watermark and self.recent.exists():
            self.recent.clear()

    def _released(self, batch: pd.DataFrame | None, watermark: int) -> pd.DataFrame | None:
        """The rows that nothing older can come before any more; the others are put aside."""
        first = self.first_waiting.get()[0] if self.first_waiting.exists() else None
        open_ = first is not None and first < watermark  # something that waits can go
        rows = batch
        if open_:
            kept = pd.DataFrame(list(self.waiting.get()), columns=self.columns.names)
            rows = kept if batch is None else pd.concat([kept, batch], ignore_index=True)
        if rows is None:
            return None
        held_back = rows["proc_ms"] >= watermark
        rest = rows[held_back]
        if open_:
            if len(rest):
                self.waiting.put(stored(rest[self.columns.names]))
            else:
                self.waiting.clear()
                self.first_waiting.clear()
        elif len(rest):
            self.waiting.appendList(stored(rest[self.columns.names]))
        if len(rest):
            least = int(rest["proc_ms"].min())
            if open_ or first is None or least < first:
                self.first_waiting.update((least,))
                self.handle.registerTimer(least + 1)
        return rows[~held_back]

    def _with_state(self, ready: pd.DataFrame, watermark: int) -> pd.DataFrame:
        balance, *last, last_ms = self.account.get() if self.account.exists() else (0, None, None, None, None)
        old = list(self.recent.get()) if self.recent.exists() else []
        ids, seqs, clocks, amounts, was_new = (list(c) for c in zip(*old)) if old else ([], [], [], [], [])

        ids = np.array([*ids, *ready["transaction_id"]], object)
        seq = np.array([*seqs, *ready["seq"]], np.int64)
        clock = np.array([*clocks, *ready["proc_ms"]], np.int64)
        amount = np.array([*map(int, amounts), *map(int, ready["amount"])], object)
        source = np.arange(len(clock)) - len(old)  # row of ``ready``, negative for what is remembered
        order = np.lexsort((seq, clock))
        ids, seq, clock, amount, source = ids[order], seq[order], clock[order], amount[order], source[order]
        fresh = source >= 0

        prev = previous(ids, clock)
        call = np.concatenate(([NEVER], clock[:-1]))
        is_new = (prev == NEVER) | (call >= prev + self.window_ms)
        is_new[~fresh] = np.array(was_new, bool)[source[~fresh] + len(old)]
        paid = np.where(is_new, amount, 0)
        velocity = alive_counts(clock, seq, prev, self.window_ms)
        total = np.cumsum(np.where(fresh, paid, 0)) + int(balance)

        state = pd.DataFrame({"is_new": is_new, "balance": total, "velocity_count": velocity})
        if self.spend_ms:
            upto = np.concatenate(([0], np.cumsum(paid)))
            state["spend"] = upto[1:] - upto[np.searchsorted(clock, clock - self.spend_ms, side="right")]
        else:
            state["spend"] = None
        state = state[fresh].set_index(source[fresh]).sort_index()
        telemetry, last = self._telemetry(ready, last)
        state = pd.concat([state, telemetry], axis=1)
        state["is_late"] = False if last_ms is None else ready["proc_ms"] < last_ms

        now = int(clock[-1])
        if last_ms is not None and last_ms != now:
            self.handle.deleteTimer(last_ms + self.keep_ms + 1)
        self.account.update((Decimal(int(total[-1])), *last, now))
        if now + self.keep_ms < watermark:  # a timer would come too late
            self.recent.clear()
            return pd.concat([ready, state], axis=1)
        self.handle.registerTimer(now + self.keep_ms + 1)
        keep = clock > now - self.keep_ms
        self.recent.put(list(zip(ids[keep].tolist(), seq[keep].tolist(), clock[keep].tolist(), map(Decimal, amount[keep]), is_new[keep].tolist())))
        return pd.concat([ready, state], axis=1)

    @staticmethod
    def _telemetry(ready: pd.DataFrame, last: list) -> tuple[pd.DataFrame, list]:
        """The newest telemetry before each row, by its own clock, the first to arrive on ties; and that after all."""
        at = np.concatenate(([last[0] or 0], ready["timestamp_ns"].to_numpy(np.int64)))
        newest = np.maximum.accumulate(np.maximum(at, 0))
        takes = np.concatenate(([last[0] is not None], at[1:] > newest[:-1]))
        holder = np.maximum.accumulate(np.where(takes, np.arange(len(at)), -1))
        places = [[last[1], *ready["latitude"]], [last[2], *ready["longitude"]]]
        pick = lambda values: [None if k < 0 else values[k] for k in holder[:-1]]
        # A plain float column would round nanoseconds.
        found = pd.DataFrame({
            "prev_timestamp_ns": pd.array(pick(at), dtype="Int64"), "prev_latitude": pick(places[0]), "prev_longitude": pick(places[1])})
        end = int(holder[-1])
        return found, [None, None, None] if end < 0 else [int(at[end]), float(places[0][end]), float(places[1][end])]

    def close(self) -> None:
        pass


class AlertSuppression(StatefulProcessor):
    """Passes the first alert of an id and the first one a full TTL after the last passed.

    An id is forgotten when the watermark is a TTL past its last alert, from when on any alert of
    it passes anyway; only one that is later than the watermark allows could tell the difference.
    """

    def __init__(self, ttl_s: int):
        self.ttl_ms = ttl_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sent = handle.getValueState("sent", CLOCK)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True).sort_values(["proc_ms", "seq"], ignore_index=True)
        last = self.sent.get()[0] if self.sent.exists() else None
        passed = passing(batch["proc_ms"].to_numpy(np.int64), last, self.ttl_ms)
        if len(passed):
            if last is not None:
                self.handle.deleteTimer(last + self.ttl_ms)
            last = int(batch["proc_ms"][passed[-1]])
            self.sent.update((last,))
            self.handle.registerTimer(last + self.ttl_ms)
            yield batch.iloc[passed]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sent.exists() and self.sent.get()[0] + self.ttl_ms <= timerValues.getCurrentWatermarkInMs():
            self.sent.clear()
        return iter(())

    def close(self) -> None:
        pass


def passing(clock: np.ndarray, last: int | None, ttl_ms: int) -> list[int]:
    """Which of an id's alerts, in order, go out: one search for each that does."""
    if ttl_ms <= 0:
        return list(range(len(clock)))
    out = []
    at = 0 if last is None else int(np.searchsorted(clock, last + ttl_ms))
    while at < len(clock):
        out.append(at)
        at = int(np.searchsorted(clock, clock[at] + ttl_ms))
    return out

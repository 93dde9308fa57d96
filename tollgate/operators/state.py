"""Per-user state seen by each transaction: balance, velocity, last telemetry.

Input columns: ``user_id, transaction_id, seq, proc_ms`` and, where needed, ``amount``,
``timestamp_ns, latitude, longitude``. Rows arrive in the order of (``proc_ms``, ``seq``): the
processing clock, and a number that tells rows of one instant apart (``arrival_seq`` makes one from
partition and offset). So the clock never falls along the order, whatever ``seq`` does.
``timestamp_ns`` is the event clock and may be in any order.

The operators keep every row, so they can be chained on one table with one split: get it from
``user_split(df)``, start with ``by_user(df, split)``, and do not filter in between.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.operators.running import FIRST, PIECE, Running, Split, find_split, running

ORDER = ("proc_ms", "seq")
USER = ("user_id",)
OCCURRENCE = ("user_id", "transaction_id")


# Bits of the offset in an arrival number; the partition is above them.
OFFSET_BITS = 52


def arrival_seq(partition: Column | str = "partition", offset: Column | str = "offset") -> Column:
    """One number for a message's place: unique for partitions below 2,048 and offsets below 2^52.

    Others fail the job. A missing partition counts as 0.
    """
    column = lambda c: F.col(c) if isinstance(c, str) else c
    part, at = F.coalesce(column(partition).cast("bigint"), F.lit(0)), column(offset)
    fits = part.between(0, 2**11 - 1) & at.between(0, 2**OFFSET_BITS - 1)
    outside = F.raise_error(F.concat_ws(" ", F.lit("no arrival number for"), part, at)).cast("bigint")
    return F.when(at.isNull() | fits, F.shiftleft(part, OFFSET_BITS).bitwiseOR(at)).otherwise(outside)


def arrival(clock: str = "proc_ms", seq: str = "seq") -> Column:
    """Where a row is along the order, for cutting."""
    return F.struct(F.col(clock).alias("at"), F.coalesce(F.col(seq), F.lit(FIRST)).alias("tie"))


def user_split(df: DataFrame, group_rows: int | None = None) -> Split:
    """Find users with too many rows for one task; share the result between the operators."""
    split = find_split(df, USER, "proc_ms", group_rows, tie="seq")
    if split.cuts is None:
        return split
    # Ids of a large user spread by (user, id); a single id may again be large.
    return replace(split, finer=find_split(split.large, OCCURRENCE, "proc_ms", tie="seq"))


def by_user(df: DataFrame, split: Split) -> DataFrame:
    """Put each user's rows (or each piece of a large user) together, once for all operators."""
    if split.cuts is None:
        return df.repartition(*USER)
    return split.place(df, arrival())


def with_previous_occurrence(df: DataFrame, split: Split) -> DataFrame:
    """Add ``prev_ms``: clock of the same transaction id's previous arrival for the user."""
    if split.cuts is None:
        window = Window.partitionBy(*OCCURRENCE).orderBy(*ORDER)
        return df.withColumn("prev_ms", F.lag("proc_ms").over(window))
    found = _previous_occurrence(df.drop(PIECE), split)
    return split.place(found, arrival())


def _previous_occurrence(df: DataFrame, split: Split) -> DataFrame:
    last = Running("max", F.struct(*ORDER), inclusive=False)
    found = running(df, split.finer, ORDER, {"_last": last}, at=arrival())
    return found.withColumn("prev_ms", F.col("_last.proc_ms")).drop(PIECE, "_last")


def with_first_seen(df: DataFrame, split: Split, window_s: int) -> DataFrame:
    """Add ``is_new``: whether an arrival changes the balance.

    An id is remembered until a call of the same user finds it older than the window, and that
    clean-up runs after the call's own insertion. So a repeat is new again only if the user's
    preceding call came a full window after the id's last arrival.
    """
    if "prev_ms" not in df.columns:
        df = with_previous_occurrence(df, split)
    call = Running("max", F.struct(*ORDER), inclusive=False)
    df = running(df, split, ORDER, {"_call": call}, at=arrival(), totals_of=split.large)
    forgotten = F.col("_call.proc_ms") >= F.col("prev_ms") + F.lit(window_s * 1000)
    return df.withColumn("is_new", F.col("prev_ms").isNull() | forgotten).drop("_call")


def with_balance(df: DataFrame, split: Split, per_currency: bool = False) -> DataFrame:
    """Add ``balance``: sum of the amounts of new transactions so far, in minor units.

    Like the state it models, the sum ignores the currency unless ``per_currency`` is set.
    """
    if per_currency:
        df = df.drop(PIECE)
        keys = (*USER, "currency")
        split = Split(keys) if split.cuts is None else find_split(df, keys, "proc_ms", tie="seq")
    counted = F.when(F.col("is_new"), F.col("amount")).otherwise(F.lit(0))
    return running(df, split, ORDER, {"balance": Running("sum", counted)}, at=arrival())


def with_velocity(
    df: DataFrame, split: Split, window_s: int, output: str = "velocity_count"
) -> DataFrame:
    """Add the number of distinct transaction ids in ``(now - window, now]``, own row included.

    Counted as a sweep over time instead of a set per row: an arrival adds one unless its id is
    still in the window, and every arrival is taken out again one window later. A repeat keeps
    its id alive, so it cancels the removal its previous arrival had scheduled. The count is a
    running sum over these steps, whatever the number of ids in a window.
    """
    if "prev_ms" not in df.columns:
        df = with_previous_occurrence(df, split)
    window_ms = F.lit(window_s * 1000)
    alive = F.col("prev_ms").isNotNull() & (F.col("prev_ms") > F.col("proc_ms") - window_ms)
    fresh = F.when(alive, 0).otherwise(1)
    cancelled = F.when(alive, F.col("prev_ms") + window_ms)
    totals = None
    if split.cuts is not None:
        slim = split.large.select(*OCCURRENCE, "seq", "proc_ms")
        totals = _steps(_previous_occurrence(slim, split), window_ms, fresh, F.lit(-1), cancelled)
    swept = running(
        _steps(df, window_ms, fresh, F.lit(-1), cancelled), split, STEP_ORDER,
        {output: Running("sum", F.col("_step.change"))},
        at=arrival("_step.clock", "_step.row.seq"), totals_of=totals,
    )
    return _arrivals(swept, df, split, output)


STEP_ORDER = ["_step.clock", "_step.kind", "_step.row.seq"]


def _steps(df: DataFrame, window_ms: Column, enter: Column, leave: Column, cancelled: Column | None = None) -> DataFrame:
    """Rows -> steps of a sweep: entering (with the row), leaving a window later, cancelling.

    Leaving sorts before entering at the same time.
    """
    payload = F.struct(*[c for c in df.columns if c not in (*USER, PIECE)])

    def step(clock: Column, kind: int, change: Column, row: Column) -> Column:
        return F.struct(clock.alias("clock"), F.lit(kind).alias("kind"), change.alias("change"), row.alias("row"))

    nothing = F.when(F.lit(False), payload)
    usual = [step(F.col("proc_ms"), 1, enter, payload), step(F.col("proc_ms") + window_ms, 0, leave, nothing)]
    steps = F.array(*usual)
    if cancelled is not None:
        extra = step(cancelled, 0, F.lit(1), nothing)
        steps = F.when(cancelled.isNotNull(), F.array(*usual, extra)).otherwise(steps)
    return df.select(*USER, F.explode(steps).alias("_step"))


def _arrivals(swept: DataFrame, df: DataFrame, split: Split, output: str) -> DataFrame:
    """The rows of a finished sweep."""
    row = [c for c in df.columns if c not in (*USER, PIECE)]
    kept = [PIECE] if split.cuts is not None else []
    return swept.where(F.col("_step.kind") == 1).select(
        *USER, *[F.col(f"_step.row.{c}").alias(c) for c in row], *kept, output
    )


def with_windows_in_force(df: DataFrame, split: Split, window_s: Column, output: str = "velocity_count") -> DataFrame:
    """``is_new`` and the count of ``with_velocity`` where the window's length is the one in force at each row.

    Each call forgets what is older than its own window, for good: a longer window later does not
    bring it back. So what a row still sees is what came after its ``reach``, the latest clock that
    any call so far has forgotten up to, which never falls. An id is new again if the calls before
    had forgotten it. The count takes two running sums: ids that enter, over arrivals; and what
    has left, over clocks, asked for at each row's reach.
    """
    if "prev_ms" not in df.columns:
        df = with_previous_occurrence(df, split)
    forgets = F.col("proc_ms") - window_s * 1000
    df = running(df, split, ORDER, {
        "_reach": Running("max", forgets), "_before": Running("max", forgets, inclusive=False)}, at=arrival())
    known = F.col("prev_ms").isNotNull()
    df = df.withColumns({
        "is_new": ~known | (F.col("prev_ms") <= F.col("_before")),
        "_alive": known & (F.col("prev_ms") > F.col("_reach")),
    })
    df = running(df, split, ORDER, {"_entered": Running("sum", F.when(F.col("_alive"), 0).otherwise(1))}, at=arrival())

    payload = F.struct(*[c for c in df.columns if c not in (*USER, PIECE)])
    nothing = F.when(F.lit(False), payload)

    def step(clock: str, kind: int, change: int, row: Column) -> Column:
        return F.struct(F.col(clock).alias("clock"), F.lit(kind).alias("kind"), F.lit(change).alias("change"), row.alias("row"))

    usual = [step("proc_ms", 0, -1, nothing), step("_reach", 1, 0, payload)]
    steps = F.when(F.col("_alive"), F.array(*usual, step("prev_ms", 0, 1, nothing))).otherwise(F.array(*usual))
    swept = running(
        df.select(*USER, F.explode(steps).alias("_step")), split, STEP_ORDER,
        {"_left": Running("sum", F.col("_step.change"))}, at=arrival("_step.clock", "_step.row.seq"))
    found = _arrivals(swept, df, split, "_left").withColumn(output, (F.col("_entered") + F.col("_left")).cast("bigint"))
    found = found.drop("_reach", "_before", "_alive", "_entered", "_left", PIECE)
    return split.place(found, arrival())


def telemetry() -> Column:
    """A row's telemetry, in an order in which the largest is the one to keep; null if it has none."""
    return F.when(
        F.col("timestamp_ns") > 0,
        F.struct(
            F.col("timestamp_ns"), (-F.col("proc_ms")).alias("neg_ms"), (-F.col("seq")).alias("neg_seq"),
            F.col("latitude"), F.col("longitude"),
        ),
    )


def with_previous_telemetry(
    df: DataFrame, split: Split, max_age_s: int | None = None
) -> DataFrame:
    """Add ``prev``: the newest telemetry (by event clock) among the user's earlier arrivals.

    Equal event times keep the first arrival, times of zero or less never become state. A late
    event therefore sees telemetry newer than itself. ``max_age_s`` drops older telemetry.
    """
    df = running(
        df, split, ORDER, {"prev": Running("max", telemetry(), inclusive=False)},
        at=arrival(), totals_of=split.large,
    )
    return recent_telemetry(df, max_age_s)


def recent_telemetry(df: DataFrame, max_age_s: int | None) -> DataFrame:
    """Without ``prev`` where it is more than ``max_age_s`` older than the row."""
    if max_age_s is None:
        return df
    recent = F.col("timestamp_ns") - F.col("prev.timestamp_ns") <= F.lit(max_age_s * 1_000_000_000)
    return df.withColumn("prev", F.when(recent, F.col("prev")))


def with_spend(df: DataFrame, split: Split, window_s: int) -> DataFrame:
    """Add ``spend``: amount of new transactions in ``(now - window, now]``, as a sweep."""
    counted = F.when(F.col("is_new"), F.col("amount")).otherwise(
        F.lit(0).cast(df.schema["amount"].dataType)
    )
    swept = running(
        _steps(df, F.lit(window_s * 1000), counted, -counted), split, STEP_ORDER,
        {"spend": Running("sum", F.col("_step.change"))},
        at=arrival("_step.clock", "_step.row.seq"),
    )
    return _arrivals(swept, df, split, "spend")


def user_balances(df: DataFrame) -> DataFrame:
    """Final balance of each user from rows that carry ``is_new``."""
    counted = F.when(F.col("is_new"), F.col("amount")).otherwise(F.lit(0))
    return df.groupBy(*USER).agg(F.sum(counted).alias("balance"))


def lookup_counts(wanted: DataFrame, df: DataFrame, at_ms: Column | int, window_s: int) -> DataFrame:
    """Distinct transactions of each wanted user whose last arrival up to ``at_ms`` is at most a window old."""
    at = F.lit(at_ms) if isinstance(at_ms, int) else at_ms
    last = df.where(F.col("proc_ms") <= at).groupBy(*OCCURRENCE).agg(F.max("proc_ms").alias("_last"))
    counts = last.where(F.col("_last") >= at - window_s * 1000).groupBy(*USER).agg(F.count(F.lit(1)).alias("transactions"))
    return wanted.join(counts, list(USER), "left").withColumn("transactions", F.coalesce("transactions", F.lit(0)))


def lookup_balances(wanted: DataFrame, balances: DataFrame) -> DataFrame:
    """Balance of each wanted user; unknown users get 0 and ``is_miss``."""
    return wanted.join(balances, list(USER), "left").select(
        *wanted.columns,
        F.coalesce(F.col("balance"), F.lit(0)).alias("balance"),
        F.col("balance").isNull().alias("is_miss"),
    )

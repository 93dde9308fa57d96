"""The state operators against a sequential model of the store they replace."""

import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import state


def arrivals(seed, users=12, calls=60):
    """Tied clocks, repeated ids, late event times; user 0 is much busier than the others."""
    rng = random.Random(seed)
    rows, seq = [], 0
    clock = 1_000_000
    for _ in range(users * calls):
        seq += 1
        clock += rng.choice([0, 0, 1, 200, 900, 1000, 2500])
        user = 0 if rng.random() < 0.4 else rng.randrange(users)
        tx = rng.randrange(12)
        at = (clock - rng.choice([0, 0, 3000, 10_000])) * 1_000_000 * rng.choice([1] * 20 + [0])
        rows.append((seq, clock, f"u{user}", f"t{tx}", rng.randrange(-50, 500), at,
                     rng.uniform(-80, 80), rng.uniform(-170, 170)))
    return rows


def model(rows, window_s):
    """One call after the other, as the store does it."""
    users, found = {}, {}
    for seq, now, user, tx, amount, at, lat, lon in rows:
        recent, account = users.setdefault(user, ({}, {"balance": 0, "last": None}))
        is_new = tx not in recent
        recent[tx] = now
        if is_new:
            account["balance"] += amount
        for old in [t for t, ms in recent.items() if ms <= now - window_s * 1000]:
            del recent[old]
        last = account["last"]
        if at > (last[0] if last else 0):
            account["last"] = (at, lat, lon)
        found[seq] = (is_new, account["balance"], len(recent), last)
    return found


@pytest.mark.parametrize("group_rows", [None, 20])
@pytest.mark.parametrize("window_s", [1, 5, 60])
def test_state_matches_the_sequential_model(spark, window_s, group_rows):
    rows = arrivals(window_s)
    df = spark.createDataFrame(
        rows, "seq long, proc_ms long, user_id string, transaction_id string, amount long, "
        "timestamp_ns long, latitude double, longitude double")
    split = state.user_split(df, group_rows)
    assert (split.cuts is not None) == (group_rows is not None)
    df = state.by_user(df, split)
    df = state.with_balance(state.with_first_seen(df, split, window_s), split)
    df = state.with_previous_telemetry(state.with_velocity(df, split, window_s), split)
    expected = model(rows, window_s)
    got = {r.seq: (r.is_new, r.balance, r.velocity_count,
                   r.prev and (r.prev.timestamp_ns, r.prev.latitude, r.prev.longitude))
           for r in df.collect()}
    assert got == expected


@pytest.mark.parametrize("group_rows", [None, 20])
def test_rows_arrive_by_clock_whatever_their_numbers(spark, group_rows):
    rng = random.Random(11)
    rows = arrivals(7)
    numbers = rng.sample(range(10**6), len(rows))
    rows = [(n, *row[1:]) for n, row in zip(numbers, rows)]
    df = spark.createDataFrame(
        rows, "seq long, proc_ms long, user_id string, transaction_id string, amount long, "
        "timestamp_ns long, latitude double, longitude double")
    split = state.user_split(df, group_rows)
    df = state.with_balance(state.with_first_seen(state.by_user(df, split), split, 5), split)
    df = state.with_previous_telemetry(state.with_velocity(df, split, 5), split)
    expected = model(sorted(rows, key=lambda r: (r[1], r[0])), 5)
    got = {r.seq: (r.is_new, r.balance, r.velocity_count,
                   r.prev and (r.prev.timestamp_ns, r.prev.latitude, r.prev.longitude)) for r in df.collect()}
    assert got == expected


def test_a_user_with_all_rows_at_one_instant_is_cut(spark):
    df = spark.range(100_000).selectExpr(
        "id AS seq", "5L AS proc_ms", "'hot' AS user_id", "concat('t', id % 1000) AS transaction_id", "1L AS amount", "true AS is_new")
    split = state.user_split(df, 1000)
    placed = state.by_user(df, split)
    sizes = [r["count"] for r in placed.groupBy("_piece").count().collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 4000
    balances = state.with_balance(placed, split)
    assert balances.where("balance = seq + 1").count() == 100_000
    assert state.with_velocity(state.by_user(df, split), split, 60).where("velocity_count = least(seq + 1, 1000)").count() == 100_000


def test_arrival_numbers(spark):
    df = spark.createDataFrame([(0, 5), (1, 5), (2047, 2**52 - 1), (None, 7), (1, None)], "partition int, offset bigint")
    got = [r[0] for r in df.select(state.arrival_seq()).collect()]
    assert got == [5, 2**52 + 5, 2**63 - 1, 7, None]
    for bad in ((2048, 0), (0, 2**52), (-1, 0)):
        with pytest.raises(Exception, match="no arrival number"):
            spark.createDataFrame([bad], "partition int, offset bigint").select(state.arrival_seq()).collect()


def test_a_user_with_a_third_of_the_rows_is_cut(spark):
    df = spark.range(300_000).selectExpr(
        "id AS seq", "id AS proc_ms", "IF(id % 3 = 0, 'hot', concat('u', id % 5000)) AS user_id",
        "concat('t', id % 1000) AS transaction_id", "1L AS amount", "true AS is_new")
    split = state.user_split(df)
    assert [r.user_id for r in split.cuts.collect()] == ["hot"]
    placed = state.by_user(df, split).groupBy("user_id", "_piece").count()
    sizes = [r["count"] for r in placed.where("user_id = 'hot'").collect()]
    assert sum(sizes) == 100_000 and max(sizes) <= 25_000
    balances = state.with_balance(state.by_user(df, split), split).where("user_id = 'hot'")
    assert balances.selectExpr("max(balance)", "count(*)", "count(distinct balance)").first() == (
        100_000, 100_000, 100_000)


def test_hot_transaction_id_is_cut_too(spark):
    df = spark.range(120_000).selectExpr(
        "id AS seq", "id AS proc_ms", "'hot' AS user_id",
        "IF(id % 2 = 0, 'same', concat('t', id)) AS transaction_id", "1L AS amount")
    split = state.user_split(df)
    counted = state.with_velocity(state.by_user(df, split), split, 1)
    # In any second: 500 arrivals of distinct ids, and the one id that repeats.
    late = counted.where("seq > 2000").selectExpr("min(velocity_count)", "max(velocity_count)").first()
    assert late == (501, 501)


def test_missing_balance_is_zero(spark):
    balances = spark.createDataFrame([("a", 5)], "user_id string, balance long")
    wanted = spark.createDataFrame([("a",), ("b",)], "user_id string")
    got = {(r.user_id, r.balance, r.is_miss) for r in state.lookup_balances(wanted, balances).collect()}
    assert got == {("a", 5, False), ("b", 0, True)}


@pytest.mark.parametrize("group_rows", [None, 20])
def test_windows_in_force_against_a_replay(spark, group_rows):
    """Calls forget by their own window, for good; ids that are forgotten are new again."""
    rng = random.Random(11)
    rows = [(k, f"u{k % 3 if rng.random() < 0.5 else 0}", f"t{rng.randrange(25)}", 1_000 * (k // 2) + rng.choice([0, 5]), rng.choice([1, 5, 30])) for k in range(240)]
    rows = sorted(rows, key=lambda r: (r[3], r[0]))
    plain, known = [], {}
    for seq, user, tx, now, window in rows:
        recent = known.setdefault(user, {})
        is_new = tx not in recent
        recent[tx] = now
        known[user] = recent = {k: v for k, v in recent.items() if v > now - window * 1000}
        plain.append((seq, is_new, len(recent)))
    df = spark.createDataFrame(rows, "seq long, user_id string, transaction_id string, proc_ms long, window_s int")
    split = state.user_split(df, group_rows)
    got = state.with_windows_in_force(state.by_user(df, split), split, F.col("window_s"))
    got = state.with_balance(got.withColumn("amount", F.lit(1)), split)  # the pieces still fit
    assert sorted((r.seq, r.is_new, r.velocity_count) for r in got.collect()) == sorted(plain)

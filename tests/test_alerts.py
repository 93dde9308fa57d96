import random

import pytest
from pyspark.sql import functions as F

from tollgate.operators import alerts, history, rollups, state


def greedy(rows, ttl_ms):
    sent, last = set(), {}
    for seq, at, tx in sorted(rows, key=lambda r: (r[1], r[0])):
        if tx not in last or at >= last[tx] + ttl_ms:
            last[tx] = at
            sent.add(seq)
    return sent


@pytest.mark.parametrize("fold_rows", [10_000, 20])
def test_suppression_equals_the_sequential_rule(spark, fold_rows):
    rng = random.Random(3)
    rows = [(i, rng.randrange(0, 400_000), f"t{0 if rng.random() < 0.4 else rng.randrange(6)}") for i in range(900)]
    rows += [(1000 + i, 100_000, "t0") for i in range(50)]  # copies at one instant
    df = spark.createDataFrame(rows, "seq long, proc_ms long, transaction_id string")
    for among in (None, df):
        got = alerts.with_suppression(df, 7, fold_rows, among).collect()
        assert len(got) == len(rows)
        assert {r.seq for r in got if r.is_sent} == greedy(rows, 7000)


def test_bounded_ids_need_neither_checkpoint_nor_join(spark):
    rows = [(1, 0, "t", {"k": 1}), (2, 5000, "t", {}), (3, 7000, "t", None), (4, 0, None, {}), (5, 0, "u", {})]
    df = spark.createDataFrame(rows, "seq long, proc_ms long, transaction_id string, extra map<string,int>")
    one = alerts.with_suppression(df, 7, among=df)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    other = alerts.with_suppression(df, 7, 1, among=df)
    assert one.columns == other.columns
    for got in (one, other):
        assert {r.seq: (r.is_sent, r.extra) for r in got.collect()} == {
            1: (True, {"k": 1}), 2: (False, {}), 3: (True, None), 4: (False, {}), 5: (True, {})}
    assert alerts.with_suppression(df.limit(0), 7, among=df.limit(0)).count() == 0


def test_repeats_do_not_extend_the_silence(spark):
    df = spark.createDataFrame([(1, 0, "t"), (2, 3000, "t"), (3, 3600, "t"), (4, 7199, "t"), (5, 7200, "t")],
                               "seq long, proc_ms long, transaction_id string")
    got = alerts.with_suppression(df.withColumn("proc_ms", F.col("proc_ms") * 1000), 3600)
    assert sorted(r.seq for r in got.where("is_sent").collect()) == [1, 3, 5]


@pytest.mark.parametrize("ttl_s", [0, -5])
@pytest.mark.parametrize("fold_rows", [10_000, 1])
def test_without_a_ttl_all_are_sent(spark, ttl_s, fold_rows):
    df = spark.createDataFrame([(1, 0, "t"), (2, 0, "t"), (3, 5, "t"), (4, 5, None)], "seq long, proc_ms long, transaction_id string")
    assert alerts.with_suppression(df, ttl_s, fold_rows).where("is_sent").count() == 4


def test_one_alert_for_one_instant_on_two_partitions(spark):
    rows = [(state.arrival_seq(F.lit(p), F.lit(7)), p) for p in (0, 3)]
    df = spark.range(1).select(F.explode(F.array(*[r for r, _ in rows])).alias("seq"), F.lit(9).cast("long").alias("proc_ms"), F.lit("t").alias("transaction_id"))
    assert alerts.with_suppression(df, 60).where("is_sent").count() == 1


@pytest.mark.parametrize("literal_rows", [1000, 0])
@pytest.mark.parametrize("changes", [[(None, "a"), (5, "b")], [(5, "a"), (5, "b")]])
def test_unusable_histories_are_refused(spark, literal_rows, changes):
    df = spark.range(3).selectExpr("id AS seq", "id AS proc_ms")
    with pytest.raises(ValueError):
        history.with_params_in_force(df, spark.createDataFrame(changes, "effective_from long, p string"), literal_rows)


@pytest.mark.parametrize("literal_rows", [1000, 0])
def test_params_in_force(spark, literal_rows):
    df = spark.range(100).selectExpr("id AS seq", "id * 10 AS proc_ms")
    changes = spark.createDataFrame([(100, "a"), (105, "b"), (700, "c")], "effective_from long, p string")
    got = {r.seq: r.in_force and r.in_force.p
           for r in history.with_params_in_force(df, changes, literal_rows, group_rows=15).collect()}
    assert got == {i: None if i < 10 else "a" if i == 10 else "b" if i < 70 else "c" for i in range(100)}


def test_histogram_and_quantile(spark):
    df = spark.createDataFrame([("x", v) for v in (0.0005, 0.003, 0.003, 0.7, 9.0)], "op string, s double")
    hist = rollups.latency_histogram(df, ["op"], F.col("s"), rollups.BUCKETS["operation"])
    got = {r.le: r.cumulative for r in hist.collect()}
    assert got == {"0.001": 1, "0.005": 3, "0.01": 3, "0.05": 3, "0.1": 3, "0.5": 3, "1.0": 4, "2.0": 4, "5.0": 4, "+Inf": 5}
    quantile = rollups.histogram_quantile(hist, ["op"], 0.5).first().quantile
    assert quantile == pytest.approx(0.001 + 0.004 * (2.5 - 1) / 2)
    assert rollups.histogram_quantile(hist, ["op"], 0.99).first().quantile == 5.0


@pytest.mark.parametrize("group_rows", [None, 5])
def test_percentiles_of_any_number_of_ticks(spark, group_rows):
    rng = random.Random(2)
    rows = [(op, rng.randrange(60) ** 2) for op in ("a", "b", None) for _ in range(300)] + [("a", None), ("c", 7)]
    df = spark.createDataFrame(rows, "op string, t long")
    found = {r.op: (r.p50, r.p95) for r in rollups.latency_percentiles(df, ["op"], F.col("t"), [0.5, 0.95], group_rows).collect()}
    exact = {r.op: (r.a, r.b) for r in df.groupBy("op").agg(F.percentile("t", 0.5).alias("a"), F.percentile("t", 0.95).alias("b")).collect()}
    assert found.keys() == exact.keys()
    for op in exact:
        assert found[op] == pytest.approx(exact[op])


def test_error_label_defaults_to_system(spark):
    df = spark.createDataFrame([(None, "E"), ("r", "E"), ("r", "E")], "rule_id string, error_type string")
    got = {(r.rule_id, r.error_type, r.n) for r in rollups.error_counts(df).collect()}
    assert got == {("system", "E", 1), ("r", "E", 2)}

"""The streaming pipeline, over several micro-batches and a restart, against the batch jobs."""

import bisect
import random
import time
import uuid
from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.operators import alerts, decide, eventlog, history, ingest, rollups, state
from tollgate.operators.outbox import Outbox
from tollgate.operators.storedlog import StoredLog, VersionConflict
from tollgate.plans.fixtures import FIXTURE_PARAMS, raw_messages
from tollgate.sources import messages as sources
from tollgate.streaming.metrics import OutcomeCounts
from tollgate.streaming.pipeline import Pipeline, counts_per_minute, sketches_per_minute
from tollgate.streaming.processors import AlertSuppression, UserState

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each partition of a keyed state starts a Python worker in each micro-batch."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("pipeline"))
    stored = f"{root}/all"
    raw_messages(spark, SF).write.parquet(stored)
    everything = sources.stored_messages(spark, stored)
    low, high = everything.select(F.unix_millis("timestamp").alias("ms")).approxQuantile("ms", [0.4, 0.7], 0.01)
    clock = F.unix_millis("timestamp")
    parts = [everything.where(clock <= low), everything.where((clock > low) & (clock <= high)), everything.where(clock > high)]
    # Two parts before the first run, one before the second; each in files that are in no order.
    for part in parts[:2]:
        part.repartition(3).write.mode("append").parquet(f"{root}/in")
    pipeline = Pipeline(spark, root, FIXTURE_PARAMS)
    pipeline.run_available(sources.file_messages(spark, f"{root}/in"))
    parts[2].repartition(2).write.mode("append").parquet(f"{root}/in")
    restarted = Pipeline(spark, root, FIXTURE_PARAMS)
    restarted.run_available(sources.file_messages(spark, f"{root}/in"))
    return everything, restarted


def batch_decisions(everything, params=FIXTURE_PARAMS):
    good = ingest.accepted(ingest.ingest(everything, params.signing_key))
    rows = good.drop("reason", "risk_score").withColumns(
        {"seq": state.arrival_seq(), "proc_ms": F.unix_millis("timestamp")})
    return decide.score_transactions(rows, params)


def test_decisions_equal_batch(spark, finished):
    everything, pipeline = finished
    columns = ["seq", "transaction_id", "velocity_count", "risk_score", "decision", "reason"]
    streamed = spark.read.parquet(pipeline.path("decisions")).select(columns)
    batch = batch_decisions(everything).select(columns)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


LATE = 40 * 86_400  # more than the test month


@pytest.fixture(scope="module")
def backlog(spark, tmp_path_factory):
    """All messages, dealt so that each file holds a partition's whole month, in no order."""
    root = str(tmp_path_factory.mktemp("backlog"))
    raw_messages(spark, SF).write.parquet(f"{root}/all")
    everything = sources.stored_messages(spark, f"{root}/all")
    for part in [r.partition for r in everything.select("partition").distinct().collect()]:
        everything.where(F.col("partition") == part).orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(f"{root}/in")
    return root, everything, everything.agg(F.unix_millis(F.max("timestamp"))).first()[0]


@pytest.mark.parametrize("max_files", [1, 100])
def test_what_a_trigger_brings_changes_nothing(spark, backlog, tmp_path, max_files):
    """Partitions are read one after the other, or all at once: the decisions are those of the batch job."""
    root, everything, end = backlog
    params = FIXTURE_PARAMS.with_(spend_limit=20_000, spend_window_s=43_200, telemetry_max_age_s=3600)
    pipeline = Pipeline(spark, str(tmp_path), params, lateness_s=LATE)
    messages = sources.file_messages(spark, f"{root}/in", max_files)
    schema = pipeline.ingested(messages).schema
    finish(pipeline.write_ingested(messages))
    finish(pipeline.write_decisions(schema))
    waiting = spark.read.parquet(pipeline.path("decisions")).count()
    pipeline.tick(end - 86_400_000)
    finish(pipeline.write_decisions(schema))
    columns = ["seq", "transaction_id", "velocity_count", "spend", "balance", "risk_score", "decision", "reason"]
    read = lambda: spark.read.parquet(pipeline.path("decisions"))
    assert waiting == 0 and read().count() > 0
    assert read().agg(F.max("proc_ms")).first()[0] < end - 86_400_000
    pipeline.tick(end + 1)
    finish(pipeline.write_decisions(schema))
    batch = batch_decisions(everything, params)
    batch = batch.join(balances(everything, params), "seq").selectExpr(*columns)
    found = sorted(map(tuple, read().selectExpr(*columns).collect()))
    assert found == sorted(map(tuple, batch.collect()))
    assert any(row[-1].count("spent") for row in found)
    assert read().where("is_late").count() == 0


def balances(everything, params):
    """The balance that each message met, by the batch operators."""
    rows = Pipeline.rows(ingest.accepted(ingest.ingest(everything, params.signing_key)))
    split = state.user_split(rows)
    df = state.with_first_seen(state.by_user(rows, split), split, params.velocity_window_s)
    return state.with_balance(df, split).select("seq", "balance")


def test_rows_beyond_the_lateness_are_scored_and_counted(spark, backlog, tmp_path):
    """One partition after the other is read, each a month long: most rows of the later ones are late."""
    root, everything, end = backlog
    pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS, lateness_s=3600)
    schema = pipeline.ingested(everything).schema
    listener = OutcomeCounts()
    spark.streams.addListener(listener)
    try:
        for partition in range(4):
            everything.where(F.col("partition") == partition).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            finish(pipeline.write_ingested(sources.file_messages(spark, f"{tmp_path}/in")))
            finish(pipeline.write_decisions(schema))
        pipeline.tick(end + 1)
        finish(pipeline.write_decisions(schema))
        found = spark.read.parquet(pipeline.path("decisions"))
        late = found.where("is_late").count()
        deadline = time.time() + 30
        while listener.counts["scoring", "late"] < late and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert found.count() == batch_decisions(everything).count() and late > found.count() / 4
    assert listener.counts["scoring", "late"] == late
    assert listener.counts["scoring", "success"] + listener.counts["scoring", "error"] == found.count()


def test_state_forgets(spark, backlog, tmp_path):
    """After a month only what the window and the TTL need is left, and one account a user; the live state can be read."""
    root, everything, end = backlog
    pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS, lateness_s=LATE)
    pipeline.run_available(sources.file_messages(spark, f"{root}/in", 2), upto_ms=end + 1)
    rows = Pipeline.rows(ingest.accepted(ingest.ingest(everything, FIXTURE_PARAMS.signing_key))).cache()
    window_ms = FIXTURE_PARAMS.velocity_window_s * 1000
    recent = {(r.user_id, r.transaction_id) for r in pipeline.recent_transactions().collect()}
    last = rows.groupBy("user_id").agg(F.max("proc_ms").alias("last"))
    needed = rows.join(last, "user_id").where((F.col("last") > end + 1 - window_ms) & (F.col("proc_ms") > F.col("last") - window_ms))
    assert recent == {(r.user_id, r.transaction_id) for r in needed.select("user_id", "transaction_id").distinct().collect()}
    assert len(recent) < rows.count() / 20
    assert pipeline.state("waiting").count() == 0

    split = state.user_split(rows)
    df = state.with_first_seen(state.by_user(rows, split), split, FIXTURE_PARAMS.velocity_window_s)
    expected = {r.user_id: r.balance for r in state.user_balances(df).collect()}
    assert {r.user_id: r.balance for r in pipeline.balances().collect()} == expected
    at = end + 1
    counts = state.lookup_counts(last.select("user_id"), rows, at, FIXTURE_PARAMS.velocity_window_s)
    live = state.lookup_counts(last.select("user_id"), pipeline.recent_transactions(), at, FIXTURE_PARAMS.velocity_window_s)
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, counts.collect()))

    ttl_ms = FIXTURE_PARAMS.alert_ttl_s * 1000
    newest = spark.read.parquet(pipeline.path("decisions")).where("decision = 'FLAGGED'").agg(F.max("proc_ms")).first()[0]
    kept = [r.value.proc_ms for r in pipeline.state("sent", "alerts").collect()]
    assert kept and min(kept) > newest - ttl_ms - 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["alerts", "checkpoints", "dead_letters", "decisions", "ingested", "log", "ticks"]


def test_the_state_as_of_a_batch(spark, tmp_path):
    """Between two micro-batches the balances are those after the first."""
    raw_messages(spark, SF).write.parquet(f"{tmp_path}/all")
    everything = sources.stored_messages(spark, f"{tmp_path}/all")
    clock = F.unix_millis("timestamp")
    middle = everything.select(clock.alias("ms")).approxQuantile("ms", [0.5], 0.01)[0]
    pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS)
    for part in (everything.where(clock <= middle), everything.where(clock > middle)):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        messages = sources.file_messages(spark, f"{tmp_path}/in")
        schema = pipeline.ingested(messages).schema
        finish(pipeline.write_ingested(messages))
        finish(pipeline.write_decisions(schema))
    early = Pipeline.rows(ingest.accepted(ingest.ingest(everything.where(clock <= middle), FIXTURE_PARAMS.signing_key)))
    split = state.user_split(early)
    df = state.with_first_seen(state.by_user(early, split), split, FIXTURE_PARAMS.velocity_window_s)
    expected = {r.user_id: r.balance for r in state.user_balances(df).collect()}
    assert {r.user_id: r.balance for r in pipeline.balances(batch_id=0).collect()} == expected
    assert {r.user_id: r.balance for r in pipeline.balances().collect()} != expected


class Store:
    """What a processor needs of Spark's state store, in memory."""

    def __init__(self):
        self.values, self.timers = {}, set()

    def variable(self, name, *_, **__):
        store = self.values

        class Variable:
            def exists(self):
                return name in store

            def get(self):
                return iter(store[name]) if isinstance(store[name], list) else store[name]

            def update(self, value):
                store[name] = value

            def put(self, rows):
                store[name] = list(rows)

            def appendList(self, rows):
                store[name] = store.get(name, []) + list(rows)

            def clear(self):
                store.pop(name, None)

        return Variable()

    getValueState = getListState = variable

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def replay(processor, store, batches, lateness):
    """Run one key's micro-batches as the engine does: input, then timers, then the watermark moves."""
    processor.init(store)
    out, watermark, newest = [], 0, 0
    for batch in batches:
        if len(batch):
            out += list(processor.handleInputRows(("u",), iter([batch]), Clock(watermark)))
            newest = max(newest, batch["proc_ms"].max())
        for at in sorted(store.timers):
            if at <= watermark:
                store.timers.discard(at)
                out += list(processor.handleExpiredTimer(("u",), Clock(watermark), None))
        watermark = max(watermark, newest - lateness)
    return pd.concat([f.astype({"prev_timestamp_ns": object}) if "prev_timestamp_ns" in f else f for f in out], ignore_index=True)


def one_by_one(rows, window, spend_window):
    """What the state is after each transaction, replayed one after the other."""
    balance, last, recent, paid, call, out = 0, None, {}, [], None, []
    for r in rows.sort_values(["proc_ms", "seq"]).itertuples():
        known = recent.get(r.transaction_id)
        is_new = known is None
        recent[r.transaction_id] = r.proc_ms
        if is_new:
            balance += r.amount
            paid.append((r.proc_ms, r.amount))
        recent = {k: v for k, v in recent.items() if v > r.proc_ms - window}
        spend = sum(a for t, a in paid if t > r.proc_ms - spend_window)
        out.append((r.seq, is_new, balance, len(recent), spend, last))
        if r.timestamp_ns > (last or 0):
            last = r.timestamp_ns
    return out


@pytest.mark.parametrize("seed", range(12))
def test_user_state_equals_a_replay(seed):
    """Random micro-batches in any order within the lateness, against one transaction after the other."""
    rng = random.Random(seed)
    window, spend_window, lateness = rng.choice([5, 40]), rng.choice([10, 90]), 60_000
    n = 150
    clock = sorted(rng.choice([0, 1, 2, 700]) + 1_000 * rng.randint(0, 200) for _ in range(n))
    rows = pd.DataFrame({
        "seq": rng.sample(range(10**6), n), "proc_ms": clock, "transaction_id": [f"t{rng.randint(0, 60)}" for _ in range(n)],
        "amount": [rng.randint(1, 99) for _ in range(n)], "timestamp_ns": [rng.choice([0, -5, c * 10**6 - rng.randint(0, 10**10)]) for c in clock],
        "latitude": [rng.random() for _ in range(n)], "longitude": [rng.random() for _ in range(n)], "type": "T"})
    columns = T.StructType([T.StructField(c, T.StringType()) for c in rows.columns])
    in_order = UserState(columns, window, spend_window, wait=False)
    cuts = sorted(rng.sample(range(n), 6))
    batches = [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    # A micro-batch ends where the clock moves on, or the rows after it would be late.
    edges = [0, *sorted({int(rows["proc_ms"].searchsorted(rows["proc_ms"].iloc[c])) for c in cuts}), n]
    plain = one_by_one(rows, window * 1000, spend_window * 1000)
    strip = lambda f: [(r.seq, bool(r.is_new), int(r.balance), r.velocity_count, int(r.spend), None if pd.isna(r.prev_timestamp_ns) else int(r.prev_timestamp_ns)) for r in f.itertuples()]
    assert strip(replay(in_order, Store(), [rows.iloc[a:b].sample(frac=1, random_state=seed) for a, b in zip(edges, edges[1:])], 0)) == plain

    # Rows come up to the lateness out of order; a last row, far ahead, lets all others through.
    delayed = rows.iloc[sorted(range(n), key=lambda k: clock[k] + rng.randint(0, lateness))]
    batches = [delayed.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, n])]
    tick = rows.tail(1).assign(proc_ms=10**9, transaction_id="far", seq=10**7)
    store = Store()
    got = replay(UserState(columns, window, spend_window), store, [*batches, tick, rows.iloc[:0]], lateness)
    assert strip(got) == plain and not got["is_late"].any()
    assert len(store.values["waiting"]) == 1 and "recent" not in store.values or all(r[2] > clock[-1] - 90_000 for r in store.values["recent"])


@pytest.mark.parametrize("seed", range(8))
def test_suppression_of_alerts_against_the_sequential_model(seed):
    rng = random.Random(seed)
    clock = sorted(rng.randint(0, 60_000) for _ in range(80))
    last, plain = None, []
    for k, now in enumerate(clock):
        if last is None or now >= last + 7_000:
            plain.append(k)
            last = now
    rows = pd.DataFrame({"proc_ms": clock, "seq": range(80)})
    store = Store()
    cuts = sorted(rng.sample(range(80), 5))
    got = replay(AlertSuppression(7), store, [rows.iloc[a:b] for a, b in zip([0, *cuts], [*cuts, 80])], 0)
    assert got["seq"].tolist() == plain
    processor = AlertSuppression(7)
    processor.init(store)
    list(processor.handleExpiredTimer(("t",), Clock(last + 6_999), None))
    assert "sent" in store.values
    list(processor.handleExpiredTimer(("t",), Clock(last + 7_000), None))
    assert not store.values  # forgotten a TTL after the last alert


def test_deduplication_by_the_watermark(spark, finished, tmp_path):
    """Spark's own operator: no alert is less than a TTL after the one before, none that is two TTLs after is lost."""
    _, pipeline = finished
    schema = spark.read.parquet(pipeline.path("decisions")).schema
    sent = pipeline.alert_events_within_watermark(pipeline._follow("decisions", schema))
    finish(sent.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c"))
    flagged = alerts.flagged(spark.read.parquet(pipeline.path("decisions"))).select("transaction_id", "proc_ms").collect()
    got = spark.read.parquet(f"{tmp_path}/out").select("transaction_id", "proc_ms").collect()
    ttl = FIXTURE_PARAMS.alert_ttl_s * 1000
    times = lambda rows, i: sorted(r.proc_ms for r in rows if r.transaction_id == i)
    assert {r.transaction_id for r in got} == {r.transaction_id for r in flagged}
    for i in {r.transaction_id for r in flagged}:
        sent_at = times(got, i)
        assert all(b - a > ttl for a, b in zip(sent_at, sent_at[1:]))


def log_batch(spark, rows):
    frame = spark.createDataFrame(rows, "event_id string, aggregate_id string, payload string, seq bigint")
    at = F.timestamp_millis(F.lit(5))
    return frame.withColumns({"event_type": F.lit("T"), "metadata": F.lit("{}"), "signature": F.lit("s"), "created_at": at, "created_date": F.to_date(at)})


def versions(log):
    return sorted((r.event_id, r.aggregate_id, r.version, r.commit) for r in log.read().collect())


def test_two_writers_never_take_a_version_twice(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    assert log.read() is None and log.heads(0) is None and log.latest() == 0
    one, two = log_batch(spark, [("a1", "u", "{}", 1), ("a2", "v", "{}", 2)]), log_batch(spark, [("b1", "u", "{}", 1), ("b2", "w", "{}", 2)])
    ahead, behind = log.prepare(one, "A", 0), log.prepare(two, "B", 0)  # both see an empty log
    assert log.commit(ahead, one) == 1
    assert versions(log) == [("a1", "u", 1, 1), ("a2", "v", 1, 1)]  # B's rows don't count yet
    assert log.commit(behind, two) == 2
    assert versions(log) == [("a1", "u", 1, 1), ("a2", "v", 1, 1), ("b1", "u", 2, 2), ("b2", "w", 1, 2)]
    other = log_batch(spark, [("c1", "x", "{}", 1)])
    ahead, behind = log.prepare(one, "A", 1), log.prepare(other, "C", 0)
    assert log.commit(ahead, one) == 3
    data = sorted(p.name for p in (tmp_path / "log" / "data").iterdir())
    assert log.commit(behind, other) == 4  # no aggregate in common: what was written stands
    assert data == sorted(p.name for p in (tmp_path / "log" / "data").iterdir())
    late, quick = log.prepare(one, "A", 2), log.prepare(two, "B", 1)
    log.commit(quick, two)
    with pytest.raises(VersionConflict) as conflict:
        log.commit(late, one, on_conflict="fail")
    assert conflict.value.aggregates == ["u"]
    assert eventlog.version_conflicts(log.read()).count() == 0


def test_a_writer_numbers_what_it_has_written_anew(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    made = spark.sparkContext.accumulator(0)

    def counted(part):
        for row in part:
            made.add(1)
            yield row

    one, two = log_batch(spark, [("a1", "u", "{}", 1)]), log_batch(spark, [("b1", "u", '{"merchantId":"m-1"}', 1), ("b2", "w", "{}", 2)])
    slow = spark.createDataFrame(two.rdd.mapPartitions(counted), two.schema)
    ahead, behind = log.prepare(one, "A", 0), log.prepare(slow, "B", 0)
    log.commit(ahead, one)
    before = made.value
    assert log.commit(behind, slow) == 2 and made.value == before  # the batch is not made again
    assert versions(log) == [("a1", "u", 1, 1), ("b1", "u", 2, 2), ("b2", "w", 1, 2)]
    assert [r.event_id for r in log.by_payload("$.merchantId", "m-1").collect()] == ["b1"]
    assert len(list((tmp_path / "log" / "data").glob("attempt=*"))) == 2


def test_a_retried_batch_is_appended_once(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    batch = log_batch(spark, [("a1", "u", "{}", 1)])
    assert [log.append(batch, "A", 0), log.append(batch, "A", 0), log.append(batch, "B", 0), log.append(batch, "A", 1)] == [1, 1, 2, 3]
    log.prepare(batch, "C", 0)  # crashed before its commit
    assert [v[2] for v in versions(log)] == [1, 2, 3]


def test_writers_at_the_same_time(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    batches = {w: [log_batch(spark, [(f"{w}{k}{i}", f"u{i}", "{}", i) for i in range(3)]) for k in range(3)] for w in "ABC"}
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(lambda w: [log.append(b, w, k) for k, b in enumerate(batches[w])], "ABC"))
    assert sorted(n for each in numbers for n in each) == list(range(1, 10))
    for i in range(3):
        assert sorted(r.version for r in log.read().where(f"aggregate_id = 'u{i}'").collect()) == list(range(1, 10))


def test_heads_are_stored_now_and_then(spark, tmp_path, monkeypatch):
    from tollgate.operators import storedlog

    monkeypatch.setattr(storedlog, "HEADS_EVERY", 3)
    log = StoredLog(spark, f"{tmp_path}/log")
    for k in range(10):
        log.append(log_batch(spark, [(f"e{k}", f"u{k % 4}", "{}", k)]), "A", k)
        found = {r.aggregate_id: r.version for r in log.heads(log.latest()).collect()}
        assert found == {f"u{i}": sum(j % 4 == i for j in range(k + 1)) for i in range(min(k + 1, 4))}
    assert sorted(p.name for p in (tmp_path / "log" / "heads").iterdir()) == ["upto=6", "upto=9"]


def test_an_append_opens_what_came_after_the_last_heads(spark, tmp_path, monkeypatch):
    from tollgate.operators import storedlog

    monkeypatch.setattr(storedlog, "HEADS_EVERY", 3)
    log = StoredLog(spark, f"{tmp_path}/log")
    for k in range(8):
        assert log.append(log_batch(spark, [(f"e{k}", "u", "{}", k)]), "A", k) == k + 1 == log.latest()
    assert [log.append(log_batch(spark, []), "A", k) for k in (0, 3, 7)] == [1, 4, 8]  # known from the index, and from files
    assert [v[2:] for v in versions(log)] == [(n, n) for n in range(1, 9)]
    assert [r.version for r in log.read(2, 5).orderBy("commit").collect()] == [3, 4, 5]
    assert sorted((r.number, r.batch_id) for r in log.commits(4).collect()) == [(n, n - 1) for n in range(5, 9)]
    tables = lambda frame: sorted({f.split("/log/")[1].rsplit("/", 1)[0] for f in frame.inputFiles()})
    assert tables(log.commits()) == ["commits", "index/upto=6"] and len(log.commits(6).inputFiles()) == 2
    late = {r.attempt for r in log.commits(6).collect()}
    assert {t.split("/")[1] for t in tables(log.heads(8)) if t.startswith("data")} == {f"attempt={a}" for a in late}
    assert sorted(p.name for p in (tmp_path / "log" / "index").iterdir()) == ["upto=3", "upto=6"]
    by_name = versions(log)
    monkeypatch.setattr(storedlog, "NAMED", 1)
    assert versions(log) == by_name and len(log.read(2, 5).collect()) == 3


def test_batches_without_rows_are_commits_too(spark, tmp_path, monkeypatch):
    from tollgate.operators import storedlog

    monkeypatch.setattr(storedlog, "HEADS_EVERY", 2)
    log = StoredLog(spark, f"{tmp_path}/log")
    none, one = log_batch(spark, []), log_batch(spark, [("a1", "u", "{}", 1)])
    assert [log.append(none, "A", 0), log.append(none, "A", 1)] == [1, 2]
    assert log.read() is None and log.heads(2) is None and log.by_payload("$.merchantId", "m") is None
    behind, blank = log.prepare(one, "B", 0), log.prepare(none, "C", 0)
    assert log.append(none, "A", 2) == 3 and log.commit(behind, one) == 4 and log.commit(blank, none) == 5
    assert log.append(none, "A", 3) == 6 and log.append(one, "A", 4) == 7
    assert versions(log) == [("a1", "u", 1, 4), ("a1", "u", 2, 7)]


def test_search_by_field_skips_row_groups(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    for k in range(6):
        rows = [(f"e{k}-{i}", f"u{i}", f'{{"merchantId":"m-{k}-{i}","note":"n{k}"}}', i) for i in range(500)]
        log.append(log_batch(spark, rows).coalesce(1), "A", k)
    found = log.by_payload("$.merchantId", "m-3-77")
    assert [r.event_id for r in found.collect()] == ["e3-77"]
    assert [r.event_id for r in eventlog.by_payload(log.read(), "$.merchantId", "m-3-77").collect()] == ["e3-77"]
    assert log.by_payload("$.note", "n4").count() == 500
    assert "EqualTo(field_merchant_id,m-3-77)" in found._jdf.queryExecution().executedPlan().toString()
    assert rows_scanned(log.by_payload("$.merchantId", "m-3-77")) == 500 and rows_scanned(eventlog.by_payload(log.read(), "$.merchantId", "m-3-77")) == 3000


def rows_scanned(frame):
    """What the scan of the log's data gave, by the plan's own count."""
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().toRdd().count()
    most, queue = 0, [plan]
    while queue:
        node = queue.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            queue.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            queue.append(node.plan())
        if name == "FileSourceScanExec" and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        queue += [children.apply(i) for i in range(children.size())]
    return most


def test_a_new_writer_goes_on_from_the_log(spark, finished):
    _, pipeline = finished
    log = pipeline.log
    everyone = {r.aggregate_id: r.version for r in eventlog.heads(log.read()).collect()}
    assert {r.aggregate_id: r.version for r in log.heads(log.latest()).collect()} == everyone


def test_an_unreadable_log_is_an_error(spark, tmp_path):
    log = StoredLog(spark, f"{tmp_path}/log")
    log.append(log_batch(spark, [("a1", "u", "{}", 1)]), "A", 0)
    for attempt in (tmp_path / "log" / "data").iterdir():
        attempt.rename(tmp_path / "elsewhere")
    with pytest.raises(Exception, match="(?i)infer schema|path"):
        log.read().count()


def test_listener_counts_outcomes(spark, tmp_path):
    raw_messages(spark, SF).limit(60).write.parquet(f"{tmp_path}/in")
    checked = ingest.ingest(sources.stored_messages(spark, f"{tmp_path}/in"), FIXTURE_PARAMS.signing_key)
    bad, all_rows = ingest.rejected(checked).count(), checked.count()
    listener = OutcomeCounts()
    spark.streams.addListener(listener)
    try:
        pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS)
        writer = pipeline.write_ingested(sources.file_messages(spark, f"{tmp_path}/in"))
        writer.trigger(availableNow=True).start().awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        deadline = time.time() + 30
        while sum(listener.counts.values()) < all_rows and time.time() < deadline:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    got = {(r.operation, r.outcome): r.n for r in listener.table(spark).collect()}
    assert got == {("ingest", "success"): all_rows - bad, ("ingest", "error"): bad} and bad > 0


def test_alerts_equal_batch(spark, finished):
    everything, pipeline = finished
    sent = alerts.with_suppression(alerts.flagged(batch_decisions(everything)), FIXTURE_PARAMS.alert_ttl_s)
    expected = sorted(r.transaction_id for r in sent.where("is_sent").collect())
    got = sorted(r.key for r in spark.read.json(pipeline.path("alerts")).collect())
    assert got == expected and len(got) > 5


class Borrowing(Pipeline):
    """A pipeline of its own that reads the tables of another."""

    def __init__(self, spark, folder, other, *tables):
        super().__init__(spark, folder, other.params)
        self.other, self.tables = other, tables

    def path(self, table):
        return self.other.path(table) if table in self.tables else super().path(table)


def finish(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_alerts_after_a_failed_sink_are_neither_lost_nor_doubled(spark, finished, tmp_path):
    _, done = finished
    pipeline = Borrowing(spark, str(tmp_path), done, "decisions")
    schema = spark.read.parquet(done.path("decisions")).schema
    (tmp_path / "alerts").write_text("in the way")
    with pytest.raises(Exception):
        finish(pipeline.write_alerts(schema))
    (tmp_path / "alerts").unlink()
    finish(pipeline.write_alerts(schema))
    rows = lambda p: sorted(r.key for r in spark.read.json(p.path("alerts")).collect())
    assert rows(pipeline) == rows(done) and rows(done)


def test_a_crash_inside_a_log_batch_is_repaired(spark, finished, tmp_path, monkeypatch):
    everything, done = finished
    schema = done.ingested(everything).schema
    crashed = Borrowing(spark, str(tmp_path), done, "ingested")
    with monkeypatch.context() as patch:
        patch.setattr(StoredLog, "_claimed", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            finish(crashed.write_log(schema))
    assert crashed.log.read() is None  # written, never claimed
    with monkeypatch.context() as patch:
        claim = StoredLog._claimed
        patch.setattr(StoredLog, "_claimed", lambda *a: claim(*a) and 1 / 0)
        with pytest.raises(Exception):
            finish(crashed.write_log(schema))
    again = Borrowing(spark, str(tmp_path), done, "ingested")
    finish(again.write_log(schema))
    rows = lambda p: sorted(map(tuple, p.log.read().select("event_id", "aggregate_id", "version").collect()))
    assert rows(again) == rows(done)


def test_alert_records_verify(spark, finished):
    _, pipeline = finished
    records = spark.read.json(pipeline.path("alerts")).select(
        "key", "value", F.lit("alerts").alias("topic"), F.lit(0).alias("partition"),
        F.monotonically_increasing_id().alias("offset"), F.timestamp_seconds(F.lit(0)).alias("timestamp"))
    checked = ingest.ingest(records, FIXTURE_PARAMS.signing_key)
    assert {r.error for r in checked.select("error").distinct().collect()} == {None}
    assert {r.type for r in checked.select("type").distinct().collect()} == {"TransactionFlagged"}


def test_log_and_dead_letters(spark, finished):
    everything, pipeline = finished
    checked = ingest.ingest(everything, FIXTURE_PARAMS.signing_key)
    log = pipeline.log.read()
    assert log.count() == ingest.accepted(checked).count()
    per_user = log.groupBy("aggregate_id").agg(F.count("*").alias("n"), F.max("version").alias("v"),
                                               F.countDistinct("version").alias("d"))
    assert per_user.where("n <> v or n <> d").count() == 0
    assert {r.writer for r in pipeline.log.commits().collect()} == {pipeline.writer("log")}
    assert spark.read.json(pipeline.path("dead_letters")).count() == ingest.rejected(checked).count()


def test_counts_per_minute(spark):
    df = spark.range(120).selectExpr("timestamp_seconds(id) AS at", "'s' AS stream")
    got = [(r.stream, r.n) for r in counts_per_minute(df, "at", "1 minute", "stream").orderBy("minute").collect()]
    assert got == [("s", 60), ("s", 60)]


def test_parameters_change_between_micro_batches(spark, tmp_path, monkeypatch):
    """A change before the second micro-batch counts there; one that is added after its crash doesn't count in the retry."""
    raw_messages(spark, SF).write.parquet(f"{tmp_path}/all")
    everything = sources.stored_messages(spark, f"{tmp_path}/all")
    clock = F.unix_millis("timestamp")
    middle = everything.select(clock.alias("ms")).approxQuantile("ms", [0.5], 0.01)[0]
    fields = "effective_from long, velocity_threshold int, fraud_threshold double, merchant_blacklist string, critical_rule_ids string"
    changes = [(0, 2, 0.44, "m-7,m-13", ""), (int(middle) + 1, 1, 0.15, "m-1,m-2,m-3", "geospatial-rule-v1")]
    add = lambda rows: spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(f"{tmp_path}/changes")
    pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS)
    schema = pipeline.ingested(everything).schema

    def bring(part):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        finish(pipeline.write_ingested(sources.file_messages(spark, f"{tmp_path}/in")))

    path = f"{tmp_path}/changes"
    add(changes[:1])
    bring(everything.where(clock <= middle))
    finish(pipeline.write_decisions_in_force(schema, path))
    add(changes[1:])
    bring(everything.where(clock > middle))
    with monkeypatch.context() as patch:
        patch.setattr(history, "decide_in_force", lambda *a: 1 / 0)
        with pytest.raises(Exception):
            finish(pipeline.write_decisions_in_force(schema, path))
    add([(5, 1, 0.0, "", "")])  # backdated, after the crash
    finish(pipeline.write_decisions_in_force(schema, path))

    columns = ["seq", "velocity_count", "risk_score", "fail_closed", "decision", "reason"]
    rows = Pipeline.rows(ingest.accepted(ingest.ingest(everything, FIXTURE_PARAMS.signing_key)))
    df = history.with_params_in_force(rows, spark.createDataFrame(changes, fields))
    batch = decide.score_transactions(df, FIXTURE_PARAMS, rules=history.rules_in_force(FIXTURE_PARAMS), critical=history.critical_in_force(FIXTURE_PARAMS))
    expected = sorted(map(tuple, history.decide_in_force(batch, FIXTURE_PARAMS).select(columns).collect()))
    got = spark.read.parquet(pipeline.path("decisions_in_force"))
    assert sorted(map(tuple, got.select(columns).collect())) == expected
    assert got.where(clock_after(middle)).select("decision").distinct().count() == 2


def clock_after(ms):
    return F.col("proc_ms") > ms


def test_sketches_of_a_stream_merge(spark, tmp_path):
    """Minutes are stored by a stream, and merged: within the stated error of the exact percentiles."""
    rows = spark.range(20_000).selectExpr("timestamp_seconds(id div 50) AS at", "CASE WHEN id % 3 = 0 THEN 'a' ELSE 'b' END AS stream", "(id * 7919) % 10007 AS ticks")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    far = rows.limit(1).withColumn("at", F.timestamp_seconds(F.lit(10**6)))
    sketched = sketches_per_minute(source, "at", "1 minute", "ticks", "stream")
    out = lambda: sketched.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    finish(out())
    far.write.mode("append").parquet(f"{tmp_path}/in")
    finish(out())
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert stored.count() == 14
    for r in rollups.sketch_percentiles(stored, ["stream"], [0.5, 0.99]).collect():
        ticks = sorted(x.ticks for x in rows.where(F.col("stream") == r.stream).collect())
        assert r.n == len(ticks)
        for point, found in ((0.5, r.p50), (0.99, r.p99)):
            assert abs(bisect.bisect_left(ticks, found) / r.n - point) <= rollups.SKETCH_ERROR + 1 / r.n


def test_alerts_through_an_outbox(spark, finished, tmp_path):
    """A sink that fails for some records, then for none: nothing is lost, what was confirmed is not sent again."""
    _, done = finished
    pipeline = Borrowing(spark, str(tmp_path), done, "decisions")
    schema = spark.read.parquet(done.path("decisions")).schema
    folder = str(tmp_path / "calls")
    (tmp_path / "calls").mkdir()

    def flaky(keys, values):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write("\n".join(keys))
        return ["refused" if int(k.removeprefix("tx-")) % 2 else None for k in keys]

    finish(pipeline.deliver_alerts(schema, flaky))
    keys = sorted(r.key for r in spark.read.json(done.path("alerts")).collect())  # an id may have several alerts
    odd = [k for k in keys if int(k.removeprefix("tx-")) % 2]
    status = pipeline.outbox.status().collect()
    assert sorted(r.key for r in status) == keys and sorted(r.key for r in status if r.sink_error == "refused") == odd
    assert sorted(r.key for r in pipeline.outbox.pending().collect()) == odd and odd and odd != keys
    calls = Counter(k for f in (tmp_path / "calls").iterdir() for k in f.read_text().split("\n"))
    tries = max(r.attempts for r in status)  # one a micro-batch for those that were refused
    assert calls == Counter(k for k in keys for _ in range(tries if k in odd else 1))

    pipeline.outbox.deliver(lambda keys, values: 1 / 0)
    errors = {r.sink_error for r in pipeline.outbox.status().where("NOT is_confirmed").collect()}
    assert errors == {"division by zero"} and pipeline.outbox.pending().count() == len(odd)
    pipeline.outbox.deliver(lambda keys, values: [None] * (len(keys) + 1))
    assert pipeline.outbox.pending().count() == len(odd)  # an answer that fits no records confirms none
    pipeline.outbox.deliver(lambda keys, values: [None] * len(keys))
    assert pipeline.outbox.pending().count() == 0
    assert sorted((r.key, r.attempts) for r in pipeline.outbox.status().collect()) == [(k, tries + 3 if k in odd else 1) for k in keys]


def test_a_delivery_reads_open_batches_only(spark, tmp_path):
    outbox = Outbox(spark, f"{tmp_path}/outbox")
    records = lambda *keys: spark.createDataFrame([(k, f"v{k}") for k in keys], "key string, value string")
    tries = lambda: {(r.batch, r.key): (r.attempts, r.is_confirmed) for r in outbox.status().collect()}
    refuse = lambda bad: lambda keys, values: ["refused" if k in bad else None for k in keys]
    assert outbox.status().count() == 0 and outbox.pending().count() == 0
    outbox.deliver(refuse(""))  # nothing to send
    outbox.add(records("a", "b", "b"), "q-0")
    outbox.add(records("b", "c"), "q-1")
    outbox.deliver(refuse("c"))
    assert tries() == {("q-0", "a"): (1, True), ("q-0", "b"): (1, True), ("q-1", "b"): (1, True), ("q-1", "c"): (1, False)}
    assert outbox.open_batches() == ["q-1"]
    assert {f.split("/outbox/")[1].split("/")[1] for f in outbox.pending().inputFiles()} == {"batch=q-1"}
    (tmp_path / "outbox" / "open" / "q-2").touch()  # a crash before its records were stored
    outbox.add(records("a", "b"), "q-0")  # a retry of what was confirmed
    assert outbox.open_batches() == ["q-0", "q-1"]
    outbox.deliver(refuse(""))
    assert tries() == {("q-0", "a"): (1, True), ("q-0", "b"): (1, True), ("q-1", "b"): (1, True), ("q-1", "c"): (2, True)}
    assert outbox.open_batches() == [] and outbox.pending().count() == 0
    outbox.add(records(), "q-3")
    outbox.deliver(refuse(""))
    assert outbox.open_batches() == []
    with pytest.raises(ValueError):
        outbox.add(records("a"), "../q")


def test_changes_that_no_retry_needs_are_removed(spark, tmp_path):
    spark.createDataFrame([(0, 2)], "effective_from long, velocity_threshold int").write.parquet(f"{tmp_path}/changes")
    pipeline = Pipeline(spark, str(tmp_path), FIXTURE_PARAMS)
    kept = spark.conf.get("spark.sql.streaming.minBatchesToRetain")
    spark.conf.set("spark.sql.streaming.minBatchesToRetain", "2")
    try:
        for number in (0, 1, 2, 3, 3):
            assert pipeline._changes_of(f"{tmp_path}/changes", number).count() == 1
    finally:
        spark.conf.set("spark.sql.streaming.minBatchesToRetain", kept)
    assert sorted(p.name for p in (tmp_path / "changes_used").iterdir()) == ["batch=2", "batch=3"]


def test_kafka_options():
    source = sources.kafka_source_options("b:9092", "transactions-validated")
    assert source["startingOffsets"] == "latest" and int(source["maxOffsetsPerTrigger"]) > 0
    sink = sources.kafka_sink_options("b:9092", alerts.ALERT_TOPIC)
    assert sink["kafka.compression.type"] == "gzip" and sink["topic"] == "fraud-alerts-high-priority"

"""Every registered query against its oracle, and the plans of the main ones."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    pytest.importorskip("duckdb")
    return connect(SF)


@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, duck, name):
    assert compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), SF) is None


def plan(spark, name):
    frame = entry.queries()[name](spark, SF)
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["q_decisions", "q_velocity_count", "q_prev_telemetry", "q_running_balance"])
def test_one_shuffle_by_user(spark, name):
    text = plan(spark, name)
    assert len(re.findall(r"Exchange hashpartitioning\(user_id", text)) == 1
    assert text.count("Exchange") == 1


@pytest.mark.parametrize("name", [
    "q_decisions", "q_decisions_split", "q_evaluate_all", "q_verify_envelopes", "q_event_log_append",
    "q_spend_volume", "q_rule_params_asof", "q_latency_histogram", "q_encrypt_roundtrip",
])
def test_no_python_and_no_cartesian_in_batch_plans(spark, name):
    text = plan(spark, name)
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_scan_reads_only_needed_columns(spark):
    text = plan(spark, "q_user_balance")
    columns = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in columns.split(",")} == {"event_id", "ts", "user_id", "event_type", "value"}
    assert "PushedFilters: [IsNotNull(event_type), Not(EqualTo(event_type,error))]" in text


def test_stored_log_is_pruned(spark, tmp_path):
    """One aggregate's history is searched by pushed filters, a period by partitions."""
    from tollgate.operators import eventlog
    from tollgate.plans.queries import log_batch

    path = f"{tmp_path}/log"
    eventlog.append(log_batch(spark, SF), path, None, 0, "w")
    log = spark.read.parquet(path)
    one = eventlog.load(log, "user-7")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(aggregate_id,user-7)" in re.search(r"PushedFilters: \[([^\n]*)", one).group(1)
    period = eventlog.by_time(log, "2024-01-10 06:00:00", "2024-01-12 18:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "created_date" in re.search(r"PartitionFilters: \[([^\n]*)", period).group(1)
    assert eventlog.load(log, "user-7").count() == eventlog.with_versions(log_batch(spark, SF)).where("aggregate_id = 'user-7'").count()


def test_entry(spark):
    assert entry.entry(spark).count() == 631

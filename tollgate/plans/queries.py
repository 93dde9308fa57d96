"""Every registered query, next to the SQL an independent engine checks it with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.functions import crypto, net
from tollgate.functions.numeric import json_integer
from tollgate.functions.text import csv_set
from tollgate.operators import alerts, deadletter, decide, eventlog, events, history, ingest, rollups, rules
from tollgate.operators import signing, state
from tollgate.operators.outbox import Outbox
from tollgate.operators.storedlog import StoredLog
from tollgate.params import MERCHANT_RULE, SPEC_PRESET, TRAVEL_RULE, VELOCITY_RULE
from tollgate.plans.fixtures import (
    FIXTURE_PARAMS,
    RAW_SQL,
    TXN_SQL,
    complete_transactions,
    delivered,
    raw_messages,
    transactions,
)
from tollgate.session import shared_folder, tune
from tollgate.sources.messages import stored_messages

P = FIXTURE_PARAMS
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The id of the event a transaction comes from; the test view deals events out over four partitions.
EVENT_SQL = "CAST(substr(transaction_id, 4) AS BIGINT)"

HALF_MS = 1705276800000  # middle of the test month

# Group size that makes the test data's users large enough to be cut into pieces.
FORCED_SPLIT = 25


def query(sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return function(tune(spark), sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def own_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run of a query, which all executors can reach."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def rounded(value: Column | str, places: int = 6) -> Column:
    return F.round(value, places)


# --- SQL building blocks -------------------------------------------------------------------

W = P.velocity_window_s * 1000
LIST = ", ".join(f"'{m}'" for m in P.merchant_blacklist.split(","))
PREV = "max(CASE WHEN timestamp_ns > 0 THEN {'ts': timestamp_ns, 'neg': -seq, 'lat': latitude, 'lon': longitude} END)"


def state_sql(source: str = "txn") -> str:
    """All state columns of each row of ``source`` as ``st``."""
    return f""",
lagged AS (
  SELECT *, lag(proc_ms) OVER (PARTITION BY user_id, transaction_id ORDER BY seq) AS prev_ms,
    lag(proc_ms) OVER (PARTITION BY user_id ORDER BY seq) AS call_ms
  FROM {source}),
flagged_new AS (SELECT *, prev_ms IS NULL OR call_ms >= prev_ms + {W} AS is_new FROM lagged),
st AS (
  SELECT *,
    CAST(sum(CASE WHEN is_new THEN amount ELSE 0 END) OVER (
      PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance,
    count(DISTINCT transaction_id) OVER (
      PARTITION BY user_id ORDER BY proc_ms RANGE BETWEEN {W - 1} PRECEDING AND CURRENT ROW) AS velocity_count,
    {PREV} OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM flagged_new)
"""


TRAVEL = """,
dist AS (
  SELECT *, least(1.0, greatest(0.0,
      pow(sin(radians(latitude - prev.lat) / 2), 2)
      + cos(radians(prev.lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - prev.lon) / 2), 2))) AS a
  FROM st),
geo AS (
  SELECT *, 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) AS km,
    prev IS NOT NULL AND timestamp_ns <= prev.ts AS is_out_of_order
  FROM dist),
speed AS (
  SELECT *, CASE WHEN prev IS NOT NULL AND NOT is_out_of_order
    THEN km / (CAST(timestamp_ns - prev.ts AS DOUBLE) / 3.6e12) END AS kmh
  FROM geo)
"""


def score_sql(limit: float = 900.0, threshold: int = P.velocity_threshold) -> str:
    """Rule scores and both means of scored rows as ``scored``."""
    return f""",
hit AS (
  SELECT *, velocity_count > {threshold} AS v, coalesce(kmh > {limit}, false) AS g,
    merchant_id IN ({LIST}) AS m
  FROM speed WHERE type = 'TransactionValidated'),
scored AS (
  SELECT *, (CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END * 1.0 + CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END * 1.5
      + CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END * 2.0) / 4.5 AS risk,
    (CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END
      + CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END) / 3 AS mean
  FROM hit)
"""


FULL = TXN_SQL + state_sql() + TRAVEL + score_sql()
ALERTS_SQL = FULL + f", al AS (SELECT * FROM scored WHERE risk >= {P.fraud_threshold})"


def sent_sql(ttl_ms: int) -> str:
    """Sent alerts of ``al`` as ``sent(transaction_id, t)``."""
    return f""",
sent AS (
  SELECT transaction_id, min(proc_ms) AS t FROM al GROUP BY transaction_id
  UNION ALL
  SELECT s.transaction_id, min(a.proc_ms) AS t
  FROM sent s JOIN al a ON a.transaction_id = s.transaction_id AND a.proc_ms >= s.t + {ttl_ms}
  GROUP BY s.transaction_id),
marked AS (
  SELECT al.*, s.t IS NOT NULL AND seq = min(seq) OVER (PARTITION BY al.transaction_id, proc_ms) AS is_sent
  FROM al LEFT JOIN sent s ON s.transaction_id = al.transaction_id AND s.t = al.proc_ms)
"""


def recursive(sql: str) -> str:
    return sql.replace("WITH e AS", "WITH RECURSIVE e AS", 1)


# --- state ---------------------------------------------------------------------------------

def with_states(spark: SparkSession, sf_dir: str, group_rows: int | None = None):
    df = transactions(spark, sf_dir)
    split = state.user_split(df, group_rows)
    return state.by_user(df, split), split


@query(TXN_SQL + state_sql() + "SELECT seq, user_id, transaction_id, is_new FROM st")
def q_first_seen(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    return state.with_first_seen(df, split, P.velocity_window_s).select(
        "seq", "user_id", "transaction_id", "is_new")


def running_balance(spark, sf_dir, group_rows=None):
    df, split = with_states(spark, sf_dir, group_rows)
    df = state.with_balance(state.with_first_seen(df, split, P.velocity_window_s), split)
    return df.select("seq", "user_id", "balance")


BALANCE_SQL = TXN_SQL + state_sql() + "SELECT seq, user_id, balance FROM st"


@query(BALANCE_SQL)
def q_running_balance(spark, sf_dir):
    return running_balance(spark, sf_dir)


@query(BALANCE_SQL)
def q_running_balance_split(spark, sf_dir):
    return running_balance(spark, sf_dir, FORCED_SPLIT)


@query(TXN_SQL + state_sql() + """
SELECT seq, user_id, currency, CAST(sum(CASE WHEN is_new THEN amount ELSE 0 END) OVER (
  PARTITION BY user_id, currency ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS balance FROM st""")
def q_running_balance_per_currency(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    df = state.with_first_seen(df, split, P.velocity_window_s)
    return state.with_balance(df, split, per_currency=True).select("seq", "user_id", "currency", "balance")


@query(TXN_SQL + state_sql() + """
SELECT user_id, CAST(sum(CASE WHEN is_new THEN amount ELSE 0 END) AS BIGINT) AS balance FROM st GROUP BY user_id""")
def q_user_balance(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    return state.user_balances(state.with_first_seen(df, split, P.velocity_window_s))


def balance_lookups(spark, sf_dir):
    """Customers looked up by key: most of them have no transactions."""
    df, split = with_states(spark, sf_dir)
    balances = state.user_balances(state.with_first_seen(df, split, P.velocity_window_s))
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id"))
    return state.lookup_balances(wanted, balances)


LOOKUP_SQL = TXN_SQL + state_sql() + """,
bal AS (SELECT user_id, CAST(sum(CASE WHEN is_new THEN amount ELSE 0 END) AS BIGINT) AS balance
  FROM st GROUP BY user_id),
looked AS (SELECT concat('user-', CAST(c_custkey AS VARCHAR)) AS user_id, coalesce(balance, 0) AS balance,
    balance IS NULL AS is_miss
  FROM customer LEFT JOIN bal ON bal.user_id = concat('user-', CAST(c_custkey AS VARCHAR)))
"""


@query(LOOKUP_SQL + "SELECT user_id, balance, is_miss FROM looked")
def q_user_balance_lookup(spark, sf_dir):
    return balance_lookups(spark, sf_dir)


@query(LOOKUP_SQL + "SELECT 'balance' AS entity, count(*) FILTER (is_miss) AS misses FROM looked")
def q_cache_misses(spark, sf_dir):
    return rollups.cache_misses(balance_lookups(spark, sf_dir), "balance")


@query(TXN_SQL + f""",
last AS (SELECT user_id, transaction_id, max(proc_ms) AS ms FROM txn WHERE proc_ms <= {HALF_MS} GROUP BY ALL),
n AS (SELECT user_id, count(*) AS transactions FROM last WHERE ms >= {HALF_MS} - 86400000 GROUP BY user_id),
u AS (SELECT concat('user-', CAST(c_custkey AS VARCHAR)) AS user_id FROM customer)
SELECT u.user_id, coalesce(transactions, 0) AS transactions FROM u LEFT JOIN n ON n.user_id = u.user_id""")
def q_user_count_lookup(spark, sf_dir):
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("user_id"))
    return state.lookup_counts(wanted, transactions(spark, sf_dir), HALF_MS, 86_400)


def velocity(spark, sf_dir, group_rows=None):
    df, split = with_states(spark, sf_dir, group_rows)
    return state.with_velocity(df, split, P.velocity_window_s).select("seq", "user_id", "velocity_count")


VELOCITY_SQL = TXN_SQL + state_sql() + "SELECT seq, user_id, velocity_count FROM st"


@query(VELOCITY_SQL)
def q_velocity_count(spark, sf_dir):
    return velocity(spark, sf_dir)


@query(VELOCITY_SQL)
def q_velocity_count_split(spark, sf_dir):
    return velocity(spark, sf_dir, FORCED_SPLIT)


def previous(spark, sf_dir, group_rows=None):
    df, split = with_states(spark, sf_dir, group_rows)
    return state.with_previous_telemetry(df, split).select(
        "seq", "user_id", F.col("prev.timestamp_ns").alias("prev_timestamp_ns"),
        rounded("prev.latitude").alias("prev_latitude"), rounded("prev.longitude").alias("prev_longitude"))


PREVIOUS_SQL = TXN_SQL + state_sql() + """
SELECT seq, user_id, prev.ts AS prev_timestamp_ns, round(prev.lat, 6) AS prev_latitude,
  round(prev.lon, 6) AS prev_longitude FROM st"""


@query(PREVIOUS_SQL)
def q_prev_telemetry(spark, sf_dir):
    return previous(spark, sf_dir)


@query(PREVIOUS_SQL)
def q_prev_telemetry_split(spark, sf_dir):
    return previous(spark, sf_dir, FORCED_SPLIT)


@query(TXN_SQL + state_sql() + "SELECT seq, user_id, coalesce(timestamp_ns <= prev.ts, false) AS is_out_of_order FROM st")
def q_out_of_order(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    late = F.coalesce(rules.TravelRule.out_of_order(), F.lit(False))
    return state.with_previous_telemetry(df, split).select("seq", "user_id", late.alias("is_out_of_order"))


@query(TXN_SQL + f""",
card AS (SELECT seq, user_id, proc_ms, transaction_id, count(DISTINCT transaction_id) OVER (
    PARTITION BY user_id ORDER BY proc_ms RANGE BETWEEN {SPEC_PRESET.velocity_window_s * 1000 - 1} PRECEDING
    AND CURRENT ROW) AS velocity_count FROM txn)
SELECT seq, user_id, velocity_count, velocity_count > {SPEC_PRESET.velocity_threshold} AS is_card_testing FROM card""")
def q_card_testing(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    counted = state.with_velocity(df, split, SPEC_PRESET.velocity_window_s)
    return counted.select("seq", "user_id", "velocity_count",
                          (F.col("velocity_count") > SPEC_PRESET.velocity_threshold).alias("is_card_testing"))


SPEND_LIMIT, SPEND_WINDOW_S = 10_000, 86_400


@query(TXN_SQL + state_sql() + f""",
sp AS (SELECT seq, user_id, CAST(sum(CASE WHEN is_new THEN amount ELSE 0 END) OVER (
    PARTITION BY user_id ORDER BY proc_ms RANGE BETWEEN {SPEND_WINDOW_S * 1000 - 1} PRECEDING AND CURRENT ROW)
    AS BIGINT) AS spend FROM st)
SELECT seq, user_id, spend, spend > {SPEND_LIMIT} AS is_over FROM sp""")
def q_spend_volume(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    df = state.with_first_seen(df, split, P.velocity_window_s)
    return state.with_spend(df, split, SPEND_WINDOW_S).select(
        "seq", "user_id", "spend", (F.col("spend") > SPEND_LIMIT).alias("is_over"))


# --- rules and decisions -------------------------------------------------------------------

def rule_query(spark, sf_dir, rule):
    df, split = with_states(spark, sf_dir)
    prepared = rule.prepare(df, split)
    outcome = rule.outcome()
    return prepared.where(F.col("type") == decide.VALIDATED).select(
        "seq", "transaction_id", rounded(outcome.score).alias("score"),
        outcome.is_suspicious.alias("is_suspicious"))


@query(FULL + "SELECT seq, transaction_id, CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END AS score, v AS is_suspicious FROM scored")
def q_velocity_rule(spark, sf_dir):
    return rule_query(spark, sf_dir, rules.VelocityRule(P))


@query(FULL + "SELECT seq, transaction_id, CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END AS score, g AS is_suspicious FROM scored")
def q_geo_rule(spark, sf_dir):
    return rule_query(spark, sf_dir, rules.TravelRule(P))


@query(TXN_SQL + state_sql() + TRAVEL + """
SELECT seq, transaction_id, coalesce(kmh > 5000 AND timestamp_ns - prev.ts <= 3600000000000, false) AS is_suspicious
FROM speed WHERE type = 'TransactionValidated'""")
def q_geo_rule_spec_preset(spark, sf_dir):
    return rule_query(spark, sf_dir, rules.TravelRule(SPEC_PRESET)).drop("score")


@query(FULL + "SELECT seq, transaction_id, CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END AS score, m AS is_suspicious FROM scored")
def q_merchant_rule(spark, sf_dir):
    return rule_query(spark, sf_dir, rules.MerchantRule(P))


@query(TXN_SQL + f"SELECT seq, transaction_id, merchant_id FROM txn WHERE merchant_id IN ({LIST})")
def q_blacklist_hits(spark, sf_dir):
    listed = spark.createDataFrame([(P.merchant_blacklist,)], "list string").select(
        F.explode(csv_set(F.col("list"))).alias("merchant_id"))
    return rules.with_blacklist(transactions(spark, sf_dir), listed).where("is_blacklisted").select(
        "seq", "transaction_id", "merchant_id")


@query(TXN_SQL + f"SELECT merchant_id, count(*) AS n FROM txn WHERE merchant_id IN ({LIST}) GROUP BY merchant_id")
def q_blacklist_hits_by_merchant(spark, sf_dir):
    df = transactions(spark, sf_dir)
    return rollups.blacklist_hits(rules.MerchantRule(P).prepare(df, None))


@query(FULL + "SELECT seq, transaction_id, round(km, 6) AS km FROM speed WHERE prev IS NOT NULL")
def q_haversine(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    travelled = rules.TravelRule(P).prepare(df, split).select("seq", "transaction_id", rounded("travel_km").alias("km"))
    return travelled.where(F.col("km").isNotNull())


@query(FULL + "SELECT seq, transaction_id, round(kmh, 3) AS kmh FROM speed WHERE kmh IS NOT NULL")
def q_travel_speed(spark, sf_dir):
    df, split = with_states(spark, sf_dir)
    speeds = rules.TravelRule(P).prepare(df, split).select(
        "seq", "transaction_id", rounded("travel_kmh", 3).alias("kmh"))
    return speeds.where(F.col("kmh").isNotNull())


def decisions(spark, sf_dir, params=P, group_rows=None):
    df = transactions(spark, sf_dir)
    split = None if group_rows is None else state.user_split(df, group_rows)
    return decide.score_transactions(df, params, split=split)


def decision_columns(df):
    return df.select("seq", "transaction_id", "user_id", "velocity_count",
                     rounded("risk_score").alias("risk_score"), "fail_closed", "decision")


def decision_sql(threshold):
    return FULL + f"""SELECT seq, transaction_id, user_id, velocity_count, round(risk, 6) AS risk_score,
      false AS fail_closed, CASE WHEN risk >= {threshold} THEN 'FLAGGED' ELSE 'APPROVED' END AS decision
    FROM scored"""


@query(decision_sql(P.fraud_threshold))
def q_decisions(spark, sf_dir):
    return decision_columns(decisions(spark, sf_dir))


@query(FULL + f"""SELECT seq, transaction_id, round(doubt, 6) AS risk_score, CASE WHEN doubt >= {P.fraud_threshold} THEN 'FLAGGED' ELSE 'APPROVED' END AS decision
FROM (SELECT *, 1 - CASE WHEN v THEN pow(1 - 0.8::DOUBLE, 1.0) ELSE 1 END * CASE WHEN g THEN pow(1 - 0.9::DOUBLE, 1.5) ELSE 1 END * CASE WHEN m THEN 0 ELSE 1 END AS doubt
  FROM scored)""")
def q_decisions_noisy_or(spark, sf_dir):
    """The same rules under another aggregator."""
    scored = decide.score_transactions(transactions(spark, sf_dir), P, aggregate=decide.noisy_or)
    return scored.select("seq", "transaction_id", rounded("risk_score").alias("risk_score"), "decision")


@query(decision_sql(P.fraud_threshold))
def q_decisions_split(spark, sf_dir):
    return decision_columns(decisions(spark, sf_dir, group_rows=FORCED_SPLIT))


ARRIVAL_SQL = f"({EVENT_SQL} % 4) * {2**state.OFFSET_BITS} + ({EVENT_SQL} // 4) * 2 + is_replay"


def multi_partition(spark, sf_dir):
    """Transactions of four partitions whose offsets repeat, and in which replays have low offsets."""
    event_id = F.substring("transaction_id", 4, 20).cast("bigint")
    placed = F.expr("div(_id, 4)") * 2 + F.col("is_replay")
    df = transactions(spark, sf_dir).withColumn("_id", event_id)
    return df.withColumn("seq", state.arrival_seq(F.col("_id") % 4, placed)).drop("_id")


# Ranks along the arrival order stand in for it in the oracle.
MULTI_SQL = TXN_SQL + f""",
multi AS (SELECT * REPLACE (row_number() OVER (ORDER BY proc_ms, {ARRIVAL_SQL}) AS seq), {ARRIVAL_SQL} AS place FROM txn)
""" + state_sql("multi") + TRAVEL + score_sql() + f"""
SELECT place AS seq, transaction_id, user_id, velocity_count, round(risk, 6) AS risk_score,
  false AS fail_closed, CASE WHEN risk >= {P.fraud_threshold} THEN 'FLAGGED' ELSE 'APPROVED' END AS decision FROM scored"""


@query(MULTI_SQL)
def q_multi_partition_decisions(spark, sf_dir):
    return decision_columns(decide.score_transactions(multi_partition(spark, sf_dir), P))


@query(MULTI_SQL)
def q_multi_partition_decisions_split(spark, sf_dir):
    df = multi_partition(spark, sf_dir)
    return decision_columns(decide.score_transactions(df, P, split=state.user_split(df, FORCED_SPLIT)))


class AmountRule:
    """A rule that breaks the contract: of seven scores one is missing, one NaN, one above 1."""

    rule_id = "amount-rule"

    def prepare(self, df, split):
        return df

    def outcome(self):
        rest = F.col("seq") % 7
        score = F.when(rest == 0, None).when(rest == 1, float("nan")).when(rest == 2, 1.5).otherwise(rest / 7.0)
        return rules.Outcome(score.cast("double"), rest > 4, F.lit("amount"), F.lit(None).cast("string"))


def python_amounts(rows):
    rest = rows["seq"] % 7
    score = (rest / 7.0).where(rest > 2, 1.5).where(rest > 1, float("nan"))
    return rows.assign(score=score, is_suspicious=rest > 4, findings="amount")[["score", "is_suspicious", "findings"]]


def bad_scores(spark, sf_dir, rule):
    scored = decide.score_transactions(transactions(spark, sf_dir), P, rules=rules.RuleSet([rule]))
    return scored.select("seq", "transaction_id", F.round(F.nanvl("risk_score", F.lit(-1.0)), 6).alias("risk_score"), "decision", "reason")


def bad_scores_sql(nan: str) -> str:
    """``nan``: what a NaN score leads to."""
    return TXN_SQL + f""",
s AS (SELECT *, seq % 7 AS rest FROM txn WHERE type = 'TransactionValidated')
SELECT seq, transaction_id, CASE WHEN rest IN (0, 2) THEN NULL WHEN rest = 1 THEN {nan} ELSE round(rest / 7.0::DOUBLE, 6) END AS risk_score,
  CASE WHEN rest IN (0, 2) OR rest = 1 AND {nan} IS NULL THEN 'ERROR' WHEN rest > 2 AND rest / 7.0::DOUBLE >= {P.fraud_threshold}
    THEN 'FLAGGED' ELSE 'APPROVED' END AS decision,
  CASE WHEN rest > 4 THEN 'amount' ELSE '' END AS reason
FROM s"""


@query(bad_scores_sql("(-1.0)::DOUBLE"))
def q_decisions_bad_scores(spark, sf_dir):
    """No score and a score above 1 are errors; NaN flags nothing."""
    return bad_scores(spark, sf_dir, AmountRule())


@query(bad_scores_sql("NULL::DOUBLE"))
def q_decisions_bad_scores_python(spark, sf_dir):
    """From Python, NaN is a missing score."""
    return bad_scores(spark, sf_dir, rules.PandasRule("amount-rule", ["seq"], python_amounts))


@query(decision_sql(0.8))
def q_decisions_default_threshold(spark, sf_dir):
    return decision_columns(decisions(spark, sf_dir, P.with_(fraud_threshold=0.8)))


@query(FULL + "SELECT seq, transaction_id, round(risk, 6) AS risk_score FROM scored")
def q_weighted_risk(spark, sf_dir):
    return decisions(spark, sf_dir).select("seq", "transaction_id", rounded("risk_score").alias("risk_score"))


def evaluated(spark, sf_dir, params=P):
    ruleset = rules.default_rules(params)
    prepared = decide.prepare(transactions(spark, sf_dir), ruleset, params)
    scored = prepared.where(F.col("type") == decide.VALIDATED)
    return decide.evaluate_all(scored, ruleset, params)


@query(FULL + "SELECT seq, transaction_id, round(mean, 6) AS aggregate_score FROM scored")
def q_mean_risk(spark, sf_dir):
    return evaluated(spark, sf_dir).select(
        "seq", "transaction_id", rounded("aggregate_score").alias("aggregate_score"))


@query(FULL + f"""SELECT seq, transaction_id, round(mean, 6) AS aggregate_score,
  mean >= {P.fraud_threshold} AS is_suspicious, CAST(v AS INT) + CAST(g AS INT) + CAST(m AS INT) AS suspicious_rules
FROM scored""")
def q_evaluate_all(spark, sf_dir):
    fired = F.size(F.filter("results", lambda r: r["is_suspicious"]))
    return evaluated(spark, sf_dir).select(
        "seq", "transaction_id", rounded("aggregate_score").alias("aggregate_score"), "is_suspicious",
        fired.alias("suspicious_rules"))


@query(FULL + f"""
SELECT seq, transaction_id, '{VELOCITY_RULE}' AS rule_id, CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END AS score, v AS is_suspicious FROM scored
UNION ALL SELECT seq, transaction_id, '{TRAVEL_RULE}', CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END, g FROM scored
UNION ALL SELECT seq, transaction_id, '{MERCHANT_RULE}', CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END, m FROM scored""")
def q_rule_results_long(spark, sf_dir):
    return rule_rows(spark, sf_dir).select(
        "seq", "transaction_id", "result.rule_id", rounded("result.score").alias("score"), "result.is_suspicious")


def rule_rows(spark, sf_dir):
    ruleset = rules.default_rules(P)
    prepared = decide.prepare(transactions(spark, sf_dir), ruleset, P)
    return rules.rule_results(prepared.where(F.col("type") == decide.VALIDATED), ruleset)


@query(FULL + f""",
long AS (SELECT seq, '{VELOCITY_RULE}' AS rule_id, CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END AS score FROM scored
  UNION ALL SELECT seq, '{TRAVEL_RULE}', CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END FROM scored
  UNION ALL SELECT seq, '{MERCHANT_RULE}', CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END FROM scored),
w(rule_id, weight) AS (VALUES ('{TRAVEL_RULE}', 2.0::DOUBLE), ('{MERCHANT_RULE}', 0.5::DOUBLE))
SELECT seq, round(sum(score * coalesce(weight, 1.0)) / sum(coalesce(weight, 1.0)), 6) AS risk_score
FROM long LEFT JOIN w ON w.rule_id = long.rule_id GROUP BY seq""")
def q_rule_weights(spark, sf_dir):
    weights = spark.createDataFrame([(TRAVEL_RULE, 2.0), (MERCHANT_RULE, 0.5)], "rule_id string, weight double")
    return decide.weighted_risk_long(rule_rows(spark, sf_dir), weights, ["seq"]).select(
        "seq", rounded("risk_score").alias("risk_score"))


REASON_SQL = f"""concat_ws(' | ',
  CASE WHEN v THEN concat(velocity_count, ' transactions of ', user_id, ' in {P.velocity_window_s} s, {P.velocity_threshold} allowed') END,
  CASE WHEN g THEN printf('travelled at %.2f km/h over %.2f km', kmh, km) END,
  CASE WHEN m THEN concat('listed merchant ', merchant_id) END)"""


@query(FULL + f"SELECT seq, transaction_id, {REASON_SQL} AS reason FROM scored")
def q_alert_reasons(spark, sf_dir):
    return decisions(spark, sf_dir).select("seq", "transaction_id", "reason")


def with_bad_coordinates(df):
    """One transaction in 101 has an unusable latitude."""
    return df.withColumn("latitude", F.when(F.col("seq") % 101 == 0, float("inf")).otherwise(F.col("latitude")))


BAD_SQL = TXN_SQL + """,
bad AS (SELECT * REPLACE (CASE WHEN seq % 101 = 0 THEN 'Infinity'::DOUBLE ELSE latitude END AS latitude) FROM txn)
""" + state_sql("bad") + """,
f AS (SELECT *, coalesce(prev IS NOT NULL AND (isinf(latitude) OR isinf(prev.lat)), false) AS travel_failed FROM st),
fd AS (
  SELECT *, CASE WHEN travel_failed OR prev IS NULL THEN 0.0 ELSE least(1.0, greatest(0.0,
      pow(sin(radians(latitude - prev.lat) / 2), 2)
      + cos(radians(prev.lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - prev.lon) / 2), 2))) END AS a
  FROM f),
fs AS (
  SELECT *, NOT travel_failed AND prev IS NOT NULL AND timestamp_ns > prev.ts
      AND 2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) / (CAST(timestamp_ns - prev.ts AS DOUBLE) / 3.6e12) > 900 AS g,
    velocity_count > 2 AS v, merchant_id IN (""" + LIST + """) AS m
  FROM fd WHERE type = 'TransactionValidated')
"""


@query(BAD_SQL + f"""
SELECT seq, transaction_id, travel_failed AS fail_closed,
  CASE WHEN travel_failed THEN 1.0 ELSE round((CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END
    + CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END * 1.5 + CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END * 2.0) / 4.5, 6) END AS risk_score,
  CASE WHEN travel_failed THEN '{TRAVEL_RULE}' ELSE '' END AS failed_rules
FROM fs""")
def q_fail_closed(spark, sf_dir):
    df = with_bad_coordinates(transactions(spark, sf_dir))
    return decide.score_transactions(df, P).select(
        "seq", "transaction_id", "fail_closed", rounded("risk_score").alias("risk_score"), "failed_rules")


@query(BAD_SQL + """
SELECT seq, transaction_id, round((CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN m THEN 2.0::DOUBLE ELSE 0 END
  + CASE WHEN g AND NOT travel_failed THEN 1.35::DOUBLE ELSE 0 END)
  / (3.0 + CASE WHEN travel_failed THEN 0 ELSE 1.5 END), 6) AS risk_score FROM fs""")
def q_fail_open(spark, sf_dir):
    """No rule is critical: a failed rule is left out of the weighted mean."""
    df = with_bad_coordinates(transactions(spark, sf_dir))
    return decide.score_transactions(df, P.with_(critical_rule_ids=())).select(
        "seq", "transaction_id", rounded("risk_score").alias("risk_score"))


@query(BAD_SQL + f"""
SELECT '{TRAVEL_RULE}' AS rule_id, 'RULE_EXECUTION_FAILURE' AS error_type, count(*) AS n
  FROM fs WHERE travel_failed HAVING count(*) > 0
UNION ALL
SELECT 'system', 'INTERNAL_SYSTEM_ERROR', count(*) FROM txn WHERE type <> 'TransactionValidated' HAVING count(*) > 0""")
def q_error_counts(spark, sf_dir):
    df = with_bad_coordinates(transactions(spark, sf_dir))
    scored = decide.score_transactions(df, P, strict=True)
    return rollups.error_counts(decide.errors_of(scored))


@query(TXN_SQL + "SELECT seq, transaction_id, type, 'ERROR' AS decision FROM txn WHERE type <> 'TransactionValidated'")
def q_reject_unvalidated(spark, sf_dir):
    scored = decide.score_transactions(transactions(spark, sf_dir), P, strict=True)
    return scored.where(F.col("decision") == "ERROR").select("seq", "transaction_id", "type", "decision")


@query(TXN_SQL + """
SELECT seq, CASE WHEN seq % 11 = 0 THEN NULL WHEN seq % 11 = 1 THEN -1 ELSE amount / 20000.0::DOUBLE END AS score,
  concat_ws(',', CASE WHEN seq % 11 = 0 OR seq % 11 > 1 AND amount > 20000 THEN 'riskScore' END, CASE WHEN seq % 7 = 0 THEN 'reason' END) AS violations
FROM txn""")
def q_rule_contract(spark, sf_dir):
    """Results of a rule that sometimes breaks the contract: missing scores, NaN (shown as -1), scores above 1, missing reasons."""
    none = F.lit(None).cast("string")
    score = F.when(F.col("seq") % 11 == 0, None).when(F.col("seq") % 11 == 1, float("nan")).otherwise(F.col("amount") / F.lit(20000.0))
    result = F.struct(
        F.lit("amount-rule").alias("rule_id"), score.alias("score"),
        F.lit(False).alias("is_suspicious"), F.when(F.col("seq") % 7 == 0, "").otherwise("ok").alias("findings"),
        none.alias("error"))
    checked = rules.contract_violations(transactions(spark, sf_dir).withColumn("result", result))
    return checked.select("seq", F.nanvl(F.col("result.score"), F.lit(-1.0)).alias("score"),
                          F.array_join("violations", ",").alias("violations"))


@query(FULL + f"""SELECT CASE WHEN risk >= {P.fraud_threshold} THEN 'flagged' ELSE 'approved' END AS outcome,
  count(*) AS n FROM scored GROUP BY 1""")
def q_outcome_counts(spark, sf_dir):
    return rollups.outcome_counts(decisions(spark, sf_dir))


PARAM_CHANGES = [  # (effective from, velocity threshold, flag threshold, blacklist)
    (0, 2, 0.44, "m-7,m-13,m-42"),
    (1704700000000, 1, 0.30, "m-7"),
    (1705900000000, 3, 0.17, "m-1, m-2 ,,m-3"),
]


def param_history(spark):
    return spark.createDataFrame(
        PARAM_CHANGES,
        "effective_from bigint, velocity_threshold int, fraud_threshold double, merchant_blacklist string")


PARAMS_SQL = FULL + """,
h(effective_from, velocity_threshold, fraud_threshold, merchant_blacklist) AS (VALUES
""" + ", ".join(f"({a}::BIGINT, {b}, {c}::DOUBLE, '{d}')" for a, b, c, d in PARAM_CHANGES) + """),
inforce AS (SELECT s.*, h.* FROM scored s ASOF JOIN h ON s.proc_ms >= h.effective_from),
re AS (SELECT *, velocity_count > velocity_threshold AS v2,
    list_contains(list_transform(string_split(merchant_blacklist, ','), lambda x: trim(x)), merchant_id) AS m2
  FROM inforce),
res AS (SELECT *, (CASE WHEN v2 THEN 0.8::DOUBLE ELSE 0 END * 1.0 + CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END * 1.5
    + CASE WHEN m2 THEN 1.0::DOUBLE ELSE 0 END * 2.0) / 4.5 AS risk2 FROM re)
SELECT seq, transaction_id, effective_from, round(risk2, 6) AS risk_score,
  CASE WHEN risk2 >= fraud_threshold THEN 'FLAGGED' ELSE 'APPROVED' END AS decision FROM res"""


def decided_with_history(spark, sf_dir, **options):
    df = history.with_params_in_force(transactions(spark, sf_dir), param_history(spark), **options)
    scored = decide.score_transactions(df, P, rules=history.rules_in_force(P))
    return history.decide_in_force(scored, P).select(
        "seq", "transaction_id", F.col("in_force.effective_from").alias("effective_from"),
        rounded("risk_score").alias("risk_score"), "decision")


@query(PARAMS_SQL)
def q_rule_params_asof(spark, sf_dir):
    return decided_with_history(spark, sf_dir)


@query(PARAMS_SQL)
def q_rule_params_asof_large(spark, sf_dir):
    """The same through the path for histories of any size."""
    return decided_with_history(spark, sf_dir, literal_rows=0, group_rows=500)


WINDOW_CHANGES = [  # (effective from, window in seconds, velocity threshold, critical rules)
    (0, 21_600, 2, MERCHANT_RULE),
    (1704700000000, 1_800, 1, f"{TRAVEL_RULE}, {MERCHANT_RULE}"),
    (1705400000000, 172_800, 4, ""),
    (1705900000000, 43_200, 2, TRAVEL_RULE),
]

WINDOWS_SQL = TXN_SQL + """,
h(effective_from, window_s, threshold, critical) AS (VALUES
""" + ", ".join(f"({a}::BIGINT, {b}, {c}, '{d}')" for a, b, c, d in WINDOW_CHANGES) + f"""),
placed AS (SELECT t.* REPLACE (CASE WHEN seq % 17 = 0 THEN 'nan'::DOUBLE ELSE latitude END AS latitude), h.*
  FROM txn t ASOF JOIN h ON t.proc_ms >= h.effective_from),
reached AS (SELECT *, lag(proc_ms) OVER (PARTITION BY user_id, transaction_id ORDER BY seq) AS prev_ms,
    max(proc_ms - window_s * 1000) OVER (PARTITION BY user_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS reach,
    max(proc_ms - window_s * 1000) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_,
    {PREV} OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM placed),
seen AS (SELECT a.seq, count(DISTINCT b.transaction_id) AS velocity_count
  FROM reached a JOIN reached b ON b.user_id = a.user_id AND b.seq <= a.seq AND b.proc_ms > a.reach GROUP BY a.seq),
st AS (SELECT *, prev_ms IS NULL OR prev_ms <= before_ AS is_new, prev IS NOT NULL AND (isnan(latitude) OR isnan(prev.lat)) AS failed
  FROM reached JOIN seen USING (seq))
""" + TRAVEL + f""",
ruled AS (SELECT *, velocity_count > threshold AS v, NOT failed AND coalesce(kmh > 900, false) AS g, merchant_id IN ({LIST}) AS m,
    failed AND list_contains(list_transform(string_split(critical, ','), lambda x: trim(x)), '{TRAVEL_RULE}') AS fail_closed
  FROM speed WHERE type = 'TransactionValidated'),
res AS (SELECT *, CASE WHEN fail_closed THEN 1.0::DOUBLE ELSE (CASE WHEN v THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN g THEN 0.9::DOUBLE ELSE 0 END * 1.5
    + CASE WHEN m THEN 1.0::DOUBLE ELSE 0 END * 2.0) / CASE WHEN failed THEN 3.0::DOUBLE ELSE 4.5::DOUBLE END END AS risk FROM ruled)
SELECT seq, window_s, velocity_count, is_new, fail_closed, round(risk, 6) AS risk_score,
  CASE WHEN fail_closed OR risk >= {P.fraud_threshold} THEN 'FLAGGED' ELSE 'APPROVED' END AS decision FROM res"""


def decided_in_windows(spark, sf_dir, group_rows=None):
    """Windows and critical rules change over time; some places are unusable, so that the travel rule fails."""
    changes = spark.createDataFrame(WINDOW_CHANGES, "effective_from bigint, velocity_window_s int, velocity_threshold int, critical_rule_ids string")
    changes = changes.withColumn("merchant_blacklist", F.lit(P.merchant_blacklist))
    rows = transactions(spark, sf_dir).withColumn("latitude", F.when(F.col("seq") % 17 == 0, float("nan")).otherwise(F.col("latitude")))
    df = history.with_params_in_force(rows, changes)
    scored = decide.score_transactions(
        df, P, rules=history.rules_in_force(P, windows=True), split=state.user_split(df, group_rows), critical=history.critical_in_force(P))
    return scored.select(
        "seq", F.col("in_force.velocity_window_s").alias("window_s"), "velocity_count", "is_new", "fail_closed",
        rounded("risk_score").alias("risk_score"), "decision")


@query(WINDOWS_SQL)
def q_window_in_force(spark, sf_dir):
    return decided_in_windows(spark, sf_dir)


@query(WINDOWS_SQL)
def q_window_in_force_split(spark, sf_dir):
    """The same with users cut into pieces."""
    return decided_in_windows(spark, sf_dir, FORCED_SPLIT)


# --- alerts --------------------------------------------------------------------------------

def suppressed(spark, sf_dir):
    return alerts.with_suppression(alerts.flagged(decisions(spark, sf_dir)), P.alert_ttl_s)


@query(recursive(ALERTS_SQL + sent_sql(P.alert_ttl_s * 1000)) + "SELECT seq, transaction_id, is_sent FROM marked")
def q_alert_dedup(spark, sf_dir):
    return suppressed(spark, sf_dir).select("seq", "transaction_id", "is_sent")


REPEATED_TTL_S = 86_400
REPEATED_SQL = recursive(
    TXN_SQL + ", al AS (SELECT * REPLACE (user_id AS transaction_id) FROM txn)" + sent_sql(REPEATED_TTL_S * 1000)
) + "SELECT seq, transaction_id, is_sent FROM marked"


def repeated_alerts(spark, sf_dir):
    """Alerts that return again and again under the same id."""
    return transactions(spark, sf_dir).withColumn("transaction_id", F.col("user_id"))


@query(REPEATED_SQL)
def q_alert_dedup_repeats(spark, sf_dir):
    return alerts.with_suppression(repeated_alerts(spark, sf_dir), REPEATED_TTL_S).select(
        "seq", "transaction_id", "is_sent")


@query(REPEATED_SQL)
def q_alert_dedup_repeats_large(spark, sf_dir):
    """The same through the path for ids with very many alerts."""
    return alerts.with_suppression(repeated_alerts(spark, sf_dir), REPEATED_TTL_S, fold_rows=50).select(
        "seq", "transaction_id", "is_sent")


@query(recursive(ALERTS_SQL + sent_sql(P.alert_ttl_s * 1000)) + """
SELECT CASE WHEN is_sent THEN 'total_alerts_sent' ELSE 'alert_deduplication_skipped' END AS status, count(*) AS n
FROM marked GROUP BY 1""")
def q_alert_status_counts(spark, sf_dir):
    return rollups.alert_status_counts(suppressed(spark, sf_dir))


def answers(keys, values):
    """A sink that refuses every third id."""
    return ["refused" if int(key.removeprefix("tx-")) % 3 == 0 else None for key in keys]


@query(recursive(ALERTS_SQL + sent_sql(P.alert_ttl_s * 1000)) + f"""
SELECT CASE WHEN NOT is_sent THEN 'alert_deduplication_skipped' WHEN {EVENT_SQL} % 3 = 0 THEN 'kafka_producer_error' ELSE 'total_alerts_sent' END AS status,
  count(*) AS n FROM marked GROUP BY 1""")
def q_alert_delivery_counts(spark, sf_dir):
    """Alerts through an outbox to a sink that refuses some of them, by what became of them."""
    marked = suppressed(spark, sf_dir).withColumn("key", F.concat_ws("@", "transaction_id", "seq"))
    outbox = Outbox(spark, own_folder(spark, "outbox"))
    outbox.add(marked.where("is_sent").select("key", F.col("transaction_id").alias("value")), "0")
    outbox.deliver(lambda keys, values: answers(values, values))
    failed = outbox.status().select("key", "sink_error")
    return rollups.alert_status_counts(marked.join(failed, "key", "left"))


def complete_rows(spark, sf_dir):
    return complete_transactions(spark, sf_dir).where(F.col("event_type") != "error").drop("reason", "risk_score")


def complete_decisions(spark, sf_dir):
    return decide.score_transactions(complete_rows(spark, sf_dir), P)


@query(recursive(ALERTS_SQL + sent_sql(P.alert_ttl_s * 1000)) + """
SELECT transaction_id, user_id, merchant_id, amount, currency, 'TransactionFlagged' AS type,
  proc_ms * 1000000 AS timestamp_ns, round(risk, 6) AS risk_score,
  concat('fraud:alert:processed:', transaction_id) AS idempotency_key, 'v1.0.0' AS orchestration_version
FROM marked WHERE is_sent""")
def q_alerts(spark, sf_dir):
    return alerts.alert_events(complete_decisions(spark, sf_dir), P, among=complete_rows(spark, sf_dir)).select(
        "transaction_id", "user_id", "merchant_id", "amount", "currency", "type", "timestamp_ns",
        rounded("risk_score").alias("risk_score"), "idempotency_key", "orchestration_version")


@query(ALERTS_SQL + """SELECT seq, transaction_id, 'TransactionFlagged' AS type, proc_ms * 1000000 AS timestamp_ns,
  round(risk, 6) AS risk_score FROM al""")
def q_build_flagged(spark, sf_dir):
    return alerts.flagged_events(decisions(spark, sf_dir)).select(
        "seq", "transaction_id", "type", "timestamp_ns", rounded("risk_score").alias("risk_score"))


# --- ingest --------------------------------------------------------------------------------

def ingested(spark, sf_dir):
    return ingest.ingest(raw_messages(spark, sf_dir), P.signing_key)


@query(RAW_SQL + """SELECT offset_ AS "offset", partition_ AS "partition", 'transactions-validated' AS topic, key,
  is_tombstone, proc_ms AS timestamp_ms FROM raw""")
def q_read_messages(spark, sf_dir):
    """From a stored table, through the source."""
    path = own_folder(spark, "messages")
    raw_messages(spark, sf_dir).write.parquet(path)
    return stored_messages(spark, path).select(
        "offset", "partition", "topic", "key", F.col("value").isNull().alias("is_tombstone"),
        F.unix_millis("timestamp").alias("timestamp_ms"))


@query(RAW_SQL + """SELECT offset_ AS "offset", key FROM raw WHERE NOT is_tombstone""")
def q_drop_tombstones(spark, sf_dir):
    return ingest.drop_tombstones(raw_messages(spark, sf_dir)).select("offset", "key")


@query(RAW_SQL + """SELECT offset_ AS "offset", coalesce(error_type, '') <> 'SyntaxError' AS is_json
FROM raw WHERE NOT is_tombstone""")
def q_json_decode(spark, sf_dir):
    parsed = ingest.with_json(ingest.drop_tombstones(raw_messages(spark, sf_dir)))
    return parsed.select("offset", F.col("json").isNotNull().alias("is_json"))


@query(RAW_SQL + """SELECT offset_ AS "offset", CASE WHEN coalesce(error_type, '') <> 'SyntaxError' THEN
  CASE WHEN is_envelope THEN 'envelope' ELSE 'bare' END END AS kind FROM raw WHERE NOT is_tombstone""")
def q_envelope_kind(spark, sf_dir):
    parsed = ingest.with_json(ingest.drop_tombstones(raw_messages(spark, sf_dir)))
    return ingest.with_kind(parsed).select("offset", "kind")


@query(RAW_SQL + """SELECT offset_ AS "offset",
  CASE error_type WHEN 'SecurityViolationError' THEN NULL ELSE error_type END AS error_type,
  CASE fault WHEN 0 THEN NULL WHEN 1 THEN 'amount.currency' WHEN 2 THEN 'telemetry.ipAddress' WHEN 3 THEN 'merchantId'
    WHEN 4 THEN 'amount.value' ELSE '' END AS errors
FROM raw WHERE NOT is_tombstone""")
def q_schema_validation(spark, sf_dir):
    return ingest.decode(raw_messages(spark, sf_dir)).select("offset", "error_type", "errors")


@query(RAW_SQL + """SELECT offset_ AS "offset", error_type FROM raw WHERE NOT is_tombstone""")
def q_verify_envelopes(spark, sf_dir):
    return ingested(spark, sf_dir).select("offset", "error_type")


@query(RAW_SQL + """SELECT offset_ AS "offset", type, transaction_id, user_id, merchant_id, amount, currency, timestamp_ns,
  round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
FROM raw WHERE NOT is_tombstone AND error_type IS NULL""")
def q_validated_transactions(spark, sf_dir):
    return ingest.accepted(ingested(spark, sf_dir)).select(
        "offset", "type", "transaction_id", "user_id", "merchant_id", F.col("amount").cast("bigint").alias("amount"),
        "currency", "timestamp_ns", rounded("latitude").alias("latitude"), rounded("longitude").alias("longitude"))


@query(RAW_SQL + """SELECT type, count(*) AS n FROM raw WHERE NOT is_tombstone AND error_type IS NULL GROUP BY type""")
def q_filter_by_type(spark, sf_dir):
    return rollups.counts(ingest.accepted(ingested(spark, sf_dir)), type=F.col("type"))


@query(RAW_SQL + """SELECT offset_ AS "offset", coalesce(key, 'anonymous') AS key,
  row_number() OVER (PARTITION BY coalesce(key, 'anonymous') ORDER BY proc_ms, partition_, offset_) AS position FROM raw""")
def q_batch_key_groups(spark, sf_dir):
    messages = delivered(complete_transactions(spark, sf_dir))  # without the texts, which no position depends on
    return ingest.in_key_order(messages).select("offset", "key", "position")


COERCED = """
SELECT event_id, CAST(CASE event_id % 8 WHEN 0 THEN CAST(round(value * 100) AS BIGINT) WHEN 1 THEN -event_id
  WHEN 2 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN event_id * 1000003 WHEN 7 THEN event_id END AS BIGINT) AS coerced FROM events"""


@query(COERCED)
def q_bigint_coerce(spark, sf_dir):
    """Integers in every spelling; fractions (5) and null (6) are refused."""
    event_id = F.col("event_id")
    forms = [
        F.round(F.col("value") * 100).cast("bigint").cast("string"),
        F.concat(F.lit('" -'), event_id.cast("string"), F.lit(' "')),
        F.lit('""'),
        F.lit("true"),
        F.concat(F.lit('"0x'), F.hex(event_id * 1000003), F.lit('"')),
        F.concat((event_id * 2 + 1).cast("string"), F.lit(".5")),
        F.lit("null"),
        F.concat(event_id.cast("string"), F.lit(".0")),
    ]
    text = F.element_at(F.array(*forms), (event_id % 8 + 1).cast("int"))
    values = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.parse_json(text).alias("v"))
    read = json_integer(F.try_variant_get("v", "$", "string"), F.schema_of_variant("v"))
    return values.select("event_id", read.cast("bigint").alias("coerced"))


@query("""
SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN event_id % 300 < 256 WHEN 2 THEN true WHEN 3 THEN false
  WHEN 4 THEN true ELSE false END AS is_ip FROM events""")
def q_ip_valid(spark, sf_dir):
    event_id = F.col("event_id")
    text = event_id.cast("string")
    forms = [
        F.concat(F.lit("10.0.0."), (event_id % 250).cast("string")),
        F.concat(F.lit("10.0.0."), (event_id % 300).cast("string")),
        F.concat(F.lit("2001:db8::"), F.hex(event_id % 65536)),
        F.concat(F.lit("host-"), text),
        F.concat(F.lit("::ffff:1.2.3."), (event_id % 200).cast("string")),
        F.concat(F.lit("1:2:3:4:5:6:7:8:"), text),
    ]
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id", net.is_ip(F.element_at(F.array(*forms), (event_id % 6 + 1).cast("int"))).alias("is_ip"))


@query("""
SELECT p_partkey, list_sort(list_distinct(list_filter(list_transform(string_split(t, ','), lambda x: trim(x)), lambda x: x <> '')))::VARCHAR AS entries
FROM (SELECT p_partkey, concat(' ', p_brand, ',, ', p_type, ' ,', p_brand, ', ') AS t FROM part)""")
def q_csv_set(spark, sf_dir):
    text = F.concat(F.lit(" "), "p_brand", F.lit(",, "), "p_type", F.lit(" ,"), "p_brand", F.lit(", "))
    entries = F.array_sort(csv_set(text))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        "p_partkey", F.concat(F.lit("["), F.array_join(entries, ", "), F.lit("]")).alias("entries"))


# --- dead letters --------------------------------------------------------------------------

@query(RAW_SQL + """SELECT key, error_type, proc_ms AS timestamp_ms, transaction_id, 'error,originalPayload,timestamp' AS fields
FROM raw WHERE error_type IS NOT NULL""")
def q_dlq_records(spark, sf_dir):
    """All but the key is read back from the records' text, the transaction from the payload in it, whether that can be parsed or not."""
    records = deadletter.dead_letters(ingest.rejected(ingested(spark, sf_dir))).select("key", "value")
    error, payload = F.get_json_object("value", "$.error"), F.get_json_object("value", "$.originalPayload")
    kind = (
        F.when(error.startswith("Value is not"), "SyntaxError")
        .when(error.startswith("Envelope validation failed: "), "EnvelopeValidationError")
        .when(error.startswith("Schema validation failed: "), "SchemaValidationError")
        .otherwise("SecurityViolationError"))
    return records.select(
        "key", kind.alias("error_type"), F.get_json_object("value", "$.timestamp").cast("bigint").alias("timestamp_ms"),
        F.regexp_extract(payload, r'"transactionId":\s*"([^"]+)"', 1).alias("transaction_id"),
        F.array_join(F.array_sort(F.json_object_keys("value")), ",").alias("fields"))


@query(RAW_SQL + """SELECT concat_ws(':', CAST(offset_ AS VARCHAR), error_type) AS key, error_type,
  'transactions-validated' AS topic, partition_ AS "partition", offset_ AS "offset"
FROM raw WHERE error_type IS NOT NULL""")
def q_dlq_provenance(spark, sf_dir):
    bad = ingest.rejected(ingested(spark, sf_dir))
    return deadletter.dead_letters_with_provenance(bad).select("key", "error_type", "topic", "partition", "offset")


@query(RAW_SQL + """SELECT 'transactions-validated' AS stream, error_type AS reason, count(*) AS n
FROM raw WHERE error_type IS NOT NULL GROUP BY error_type""")
def q_dlq_by_reason(spark, sf_dir):
    return rollups.dead_letter_counts(ingest.rejected(ingested(spark, sf_dir)))


@query(RAW_SQL + """SELECT 'transactions-validated' AS stream,
  CASE WHEN error_type IS NULL THEN 'processed' ELSE 'dead_letter' END AS outcome, count(*) AS n
FROM raw WHERE NOT is_tombstone GROUP BY 2""")
def q_stream_counts(spark, sf_dir):
    return rollups.stream_counts(ingested(spark, sf_dir))


# --- signing and encryption ----------------------------------------------------------------

def hmac_sql(text: str, key: str = P.signing_key) -> str:
    inner, outer = (pad.hex() for pad in crypto.hmac_pads(key))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({text}))))"


def envelope_mac_sql(created_ns: str, provenance: str, payload: str = "payload") -> str:
    """Signature of an envelope whose canonical payload is given."""
    return hmac_sql(f"""concat('{{"metadata":{{"createdAtNs":', CAST({created_ns} AS VARCHAR), ',"provenanceTrace":"{provenance}","schemaVersion":"v1.0"}},"payload":', {payload}, '}}')""")


def number_sql(name: str) -> str:
    return f"CASE WHEN {name} = 0 THEN '0' ELSE regexp_replace(CAST({name} AS VARCHAR), '\\.0$', '') END"


CANONICAL_SQL = RAW_SQL + """,
can AS (SELECT *, concat('{"amount":{"currency":"USD","value":', CAST(amount AS VARCHAR), '},"merchantId":"', merchant_id,
  '","telemetry":{"deviceFingerprint":"fp-', CAST(event_id % 97 AS VARCHAR), '","ipAddress":"',
  CASE WHEN event_id % 7 = 0 THEN '2001:db8::17' ELSE '10.1.2.3' END, '","latitude":', """ + number_sql("latitude") + """,
  ',"longitude":', """ + number_sql("longitude") + """, ',"userAgent":"',
  CASE WHEN event_id % 11 = 0 THEN 'agent \\"x\\" \\\\ 1' ELSE 'agent/1.0' END, '"},"timestamp":', CAST(timestamp_ns AS VARCHAR),
  ',"transactionId":"', transaction_id, '","type":"', type, '","userId":"', user_id, '"',
  CASE WHEN type = 'TransactionValidated' THEN ',"validatorId":"validator-1"' ELSE '' END, '}') AS payload
  FROM raw)
"""


@query(CANONICAL_SQL + "SELECT seq, payload FROM can")
def q_canonical_json(spark, sf_dir):
    return signing.with_canonical_payload(complete_transactions(spark, sf_dir), "payload").select("seq", "payload")


SIGNED_TEXT_SQL = "concat_ws('|', transaction_id, user_id, merchant_id, CAST(amount AS VARCHAR), 'é')"


def texts(spark, sf_dir):
    text = F.concat_ws("|", "transaction_id", "user_id", "merchant_id", F.col("amount").cast("string"), F.lit("é"))
    return transactions(spark, sf_dir).withColumn("text", text)


@query(TXN_SQL + f"SELECT seq, {hmac_sql(SIGNED_TEXT_SQL)} AS signature FROM txn")
def q_hmac_sign(spark, sf_dir):
    return signing.sign_column(texts(spark, sf_dir), "text", P.signing_key).select("seq", "signature")


@query(TXN_SQL + "SELECT seq, seq % 5 < 2 AS is_genuine FROM txn")
def q_hmac_verify(spark, sf_dir):
    """Of five signatures: right, right in upper case, changed, not hex, missing."""
    signed = signing.sign_column(texts(spark, sf_dir), "text", P.signing_key)
    signature = F.col("signature")
    altered = (
        F.when(F.col("seq") % 5 == 0, signature).when(F.col("seq") % 5 == 1, F.upper(signature))
        .when(F.col("seq") % 5 == 2, F.lpad(signature.substr(2, 63), 64, "z"))
        .when(F.col("seq") % 5 == 3, "not hex"))
    return signing.verify_column(signed.withColumn("signature", altered), "text", "signature", P.signing_key).select(
        "seq", "is_genuine")


AGENT_SQL = """CASE WHEN event_id % 11 = 0 THEN 'agent \\"x\\" \\\\ 1' ELSE 'agent/1.0' END"""
TELEMETRY_SQL = f"""'"telemetry":{{"latitude":', {number_sql("latitude")}, ',"longitude":', {number_sql("longitude")},
  ',"deviceFingerprint":"fp-', CAST(event_id % 97 AS VARCHAR), '","ipAddress":"',
  CASE WHEN event_id % 7 = 0 THEN '2001:db8::17' ELSE '10.1.2.3' END, '","userAgent":"', {AGENT_SQL}, '"}}'"""


def envelope_sql(created_ns: str, provenance: str, kind: str, extra: str, timestamp: str, mac: str) -> str:
    """An envelope as it is sent; ``extra`` is what the type adds to the payload."""
    return f"""concat('{{"metadata":{{"schemaVersion":"v1.0","createdAtNs":"', CAST({created_ns} AS VARCHAR),
  '","provenanceTrace":"{provenance}"}},"payload":{{"type":"', {kind}, '","transactionId":"', transaction_id, '","userId":"', user_id,
  '","merchantId":"', merchant_id, '","amount":{{"value":"', CAST(amount AS VARCHAR), '","currency":"USD"}},', {TELEMETRY_SQL},
  {extra}, ',"timestamp":"', CAST({timestamp} AS VARCHAR), '"}},"signature":"', {mac}, '"}}')"""


VALIDATOR_SQL = """CASE WHEN type = 'TransactionValidated' THEN ',"validatorId":"validator-1"' ELSE '' END"""


@query(CANONICAL_SQL + f"""SELECT seq, {envelope_sql("timestamp_ns", "spark:ingest", "type", VALIDATOR_SQL, "timestamp_ns",
  envelope_mac_sql("timestamp_ns", "spark:ingest"))} AS envelope FROM can WHERE fault IS NULL""")
def q_envelope_create(spark, sf_dir):
    rows = complete_transactions(spark, sf_dir).where(F.col("event_type") != "error")
    signed = signing.wrap(rows, P.signing_key, F.col("timestamp_ns"))
    return signing.with_wire_envelope(signed, "envelope").select("seq", "envelope")


@query(TXN_SQL + "SELECT seq, user_id, merchant_id, false AS security_violation, true AS was_hidden FROM txn")
def q_encrypt_roundtrip(spark, sf_dir):
    plain = transactions(spark, sf_dir).select("seq", "user_id", "merchant_id", F.col("user_id").alias("_plain"))
    sealed = signing.encrypt_columns(plain, ["user_id", "merchant_id"], P)
    opened = signing.decrypt_columns(
        sealed.withColumn("was_hidden", ~F.contains("user_id.ciphertext", "_plain")), ["user_id", "merchant_id"], P)
    return opened.select("seq", "user_id", "merchant_id", "security_violation", "was_hidden")


@query(TXN_SQL + """SELECT seq, CASE WHEN seq % 3 = 0 THEN user_id END AS user_id, seq % 3 <> 0 AS security_violation
FROM txn""")
def q_decrypt_tampered(spark, sf_dir):
    """Of three rows one is left alone, one gets a zeroed tag, one a cut-off ciphertext."""
    sealed = signing.encrypt_columns(transactions(spark, sf_dir).select("seq", "user_id"), ["user_id"], P)
    part = F.col("user_id")
    changed = F.struct(
        F.when(F.col("seq") % 3 == 2, F.lit("")).otherwise(part["ciphertext"]).alias("ciphertext"),
        part["iv"].alias("iv"),
        F.when(F.col("seq") % 3 == 1, F.lit("0" * 32)).otherwise(part["authTag"]).alias("authTag"))
    return signing.decrypt_columns(sealed.withColumn("user_id", changed), ["user_id"], P).select(
        "seq", "user_id", "security_violation")


def built_sql(kind: str, validator: str) -> str:
    return TXN_SQL + f"""SELECT seq, transaction_id, user_id, merchant_id, amount, currency, '{kind}' AS type,
  (proc_ms + 7) * 1000000 AS timestamp_ns, {validator} AS validator_id FROM txn"""


def built(events_of):
    return events_of.select("seq", "transaction_id", "user_id", "merchant_id", "amount", "currency", "type", "timestamp_ns", "validator_id")


@query(built_sql("TransactionInitiated", "NULL::VARCHAR"))
def q_build_initiated(spark, sf_dir):
    return built(events.initiated_events(transactions(spark, sf_dir), F.col("proc_ms") + 7))


@query(built_sql("TransactionValidated", "'checker-2'"))
def q_build_validated(spark, sf_dir):
    return built(events.validated_events(transactions(spark, sf_dir), F.col("proc_ms") + 7, "checker-2"))


FLAGGED_SQL = """concat('{"amount":{"currency":"USD","value":', CAST(amount AS VARCHAR), '},"merchantId":"', merchant_id,
  '","reason":"', reason, '","riskScore":', CAST(risk AS VARCHAR), ',"telemetry":{"deviceFingerprint":"fp-', CAST(event_id % 97 AS VARCHAR),
  '","ipAddress":"', CASE WHEN event_id % 7 = 0 THEN '2001:db8::17' ELSE '10.1.2.3' END, '","latitude":', """ + number_sql("latitude") + """,
  ',"longitude":', """ + number_sql("longitude") + """, ',"userAgent":"', """ + AGENT_SQL + """, '"},"timestamp":', CAST(proc_ms * 1000000 AS VARCHAR),
  ',"transactionId":"', transaction_id, '","type":"TransactionFlagged","userId":"', user_id, '"}')"""


@query(recursive(ALERTS_SQL + sent_sql(P.alert_ttl_s * 1000)) + f""",
told AS (SELECT *, {EVENT_SQL} AS event_id, {REASON_SQL} AS reason FROM marked WHERE is_sent)
SELECT transaction_id AS key, {envelope_sql("proc_ms * 1000000", "spark:alerts", "'TransactionFlagged'",
  """',"reason":"', reason, '","riskScore":', CAST(risk AS VARCHAR)""", "proc_ms * 1000000",
  envelope_mac_sql("proc_ms * 1000000", "spark:alerts", FLAGGED_SQL))} AS value
FROM told""")
def q_alert_records(spark, sf_dir):
    return alerts.alert_records(alerts.alert_events(complete_decisions(spark, sf_dir), P, among=complete_rows(spark, sf_dir)), P)


# --- event log -----------------------------------------------------------------------------


def log_batch(spark, sf_dir):
    """Log rows of the accepted messages, built without the JSON round trip."""
    rows = complete_transactions(spark, sf_dir).where(F.col("event_type") != "error")
    signed = signing.wrap(rows, P.signing_key, F.col("proc_ms") * 1_000_000, "proc:1")
    return eventlog.log_rows(signed.withColumns({
        "topic": F.lit("transactions-validated"),
        "partition": (F.col("event_id") % 4).cast("int"),
        "offset": F.col("seq"),
        "timestamp": F.timestamp_millis("proc_ms"),
    }))


def halves(spark, sf_dir):
    batch = log_batch(spark, sf_dir)
    first = F.unix_millis("created_at") < HALF_MS
    return batch.where(first), batch.where(~first)


def event_log(spark, sf_dir):
    return with_offset(eventlog.with_versions(log_batch(spark, sf_dir)))


LOG_SQL = TXN_SQL + f""",
log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY proc_ms, {EVENT_SQL} % 4, seq) AS version FROM txn)
"""


def with_offset(df):
    """The offset back from the arrival number, as the oracles know it."""
    return df.withColumn("seq", F.col("seq").bitwiseAND(F.lit(2**state.OFFSET_BITS - 1)))


def appended(spark, sf_dir, group_rows=None):
    early, late = halves(spark, sf_dir)
    return with_offset(eventlog.with_versions(late, eventlog.with_versions(early), group_rows)).select(
        "seq", "aggregate_id", "event_type", "version", "signature")


APPEND_SQL = CANONICAL_SQL + f""",
log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY proc_ms, event_id % 4, seq) AS version
  FROM can WHERE coalesce(fault, -1) = -1)
SELECT seq, user_id AS aggregate_id, type AS event_type, version,
  {envelope_mac_sql("proc_ms * 1000000", "proc:1")} AS signature
FROM log WHERE proc_ms >= {HALF_MS}"""


@query(APPEND_SQL)
def q_event_log_append(spark, sf_dir):
    return appended(spark, sf_dir)


@query(APPEND_SQL)
def q_event_log_append_split(spark, sf_dir):
    return appended(spark, sf_dir, FORCED_SPLIT)


@query(LOG_SQL + f""", first_half AS (SELECT user_id, max(version) AS v FROM log WHERE proc_ms < {HALF_MS} GROUP BY user_id)
SELECT DISTINCT l.user_id AS aggregate_id, coalesce(v, 0) + 1 AS next_version
FROM log l LEFT JOIN first_half f ON f.user_id = l.user_id WHERE proc_ms >= {HALF_MS}""")
def q_next_version(spark, sf_dir):
    early, late = halves(spark, sf_dir)
    return eventlog.next_versions(late, eventlog.with_versions(early))


@query(LOG_SQL + "SELECT version, seq, type AS event_type FROM log WHERE user_id = 'user-7'")
def q_event_log_load(spark, sf_dir):
    return eventlog.load(event_log(spark, sf_dir), "user-7").select("version", "seq", "event_type")


@query(LOG_SQL + "SELECT user_id AS aggregate_id, version, seq FROM log WHERE merchant_id = 'm-7'")
def q_event_log_by_payload(spark, sf_dir):
    return eventlog.by_payload(event_log(spark, sf_dir), "$.merchantId", "m-7").select("aggregate_id", "version", "seq")


@query(LOG_SQL + """SELECT user_id AS aggregate_id, version, seq FROM log
WHERE proc_ms >= epoch_ms(TIMESTAMP '2024-01-10 06:00:00') AND proc_ms < epoch_ms(TIMESTAMP '2024-01-12 18:00:00')""")
def q_event_log_by_time(spark, sf_dir):
    found = eventlog.by_time(event_log(spark, sf_dir), "2024-01-10 06:00:00", "2024-01-12 18:00:00")
    return found.select("aggregate_id", "version", "seq")


@query(LOG_SQL + "SELECT user_id AS aggregate_id, version, seq % 13 <> 0 AS is_genuine FROM log")
def q_log_integrity(spark, sf_dir):
    """One stored payload in thirteen was changed after signing."""
    changed = F.when(F.col("seq") % 13 == 0, F.replace("payload", F.lit('"USD"'), F.lit('"EUR"'))).otherwise(F.col("payload"))
    stored = event_log(spark, sf_dir).withColumn("payload", changed)
    return eventlog.with_integrity(stored, P.signing_key).select("aggregate_id", "version", "is_genuine")


@query(LOG_SQL + f""",
second_half AS (SELECT * FROM log WHERE proc_ms >= {HALF_MS}),
base AS (SELECT user_id, max(version) AS v FROM log WHERE proc_ms < {HALF_MS} GROUP BY user_id),
writers AS (SELECT s.user_id, coalesce(v, 0) + row_number() OVER (PARTITION BY s.user_id, seq % 2 ORDER BY proc_ms, {EVENT_SQL} % 4, seq) AS version
  FROM second_half s LEFT JOIN base b ON b.user_id = s.user_id)
SELECT user_id AS aggregate_id, version, count(*) AS writers FROM writers GROUP BY ALL HAVING count(*) > 1""")
def q_version_conflicts(spark, sf_dir):
    """Two writers number odd and even messages from the same base."""
    early, late = halves(spark, sf_dir)
    log = eventlog.with_versions(early)
    odd, even = (late.where(F.col("seq").bitwiseAND(F.lit(2**state.OFFSET_BITS - 1)) % 2 == rest) for rest in (1, 0))
    both = eventlog.with_versions(odd, log).unionByName(eventlog.with_versions(even, log))
    return eventlog.version_conflicts(both)


@query(LOG_SQL + """
SELECT operation, outcome, count(*) AS n FROM (
  SELECT 'append' AS operation, 'success' AS outcome FROM log
  UNION ALL SELECT 'load', CASE WHEN seq % 13 <> 0 THEN 'success' ELSE 'failure' END FROM log) GROUP BY ALL""")
def q_log_operation_counts(spark, sf_dir):
    appends = log_batch(spark, sf_dir).select(F.lit("append").alias("operation"), F.lit(True).alias("is_ok"))
    loads = q_log_integrity(spark, sf_dir).select(F.lit("load").alias("operation"), F.col("is_genuine").alias("is_ok"))
    return rollups.log_operation_counts(appends.unionByName(loads))


@query(LOG_SQL + f"""
SELECT user_id AS aggregate_id, seq, CASE WHEN proc_ms < {HALF_MS} THEN 1 WHEN seq % 2 = 1 THEN 2 ELSE 3 END AS "commit",
  row_number() OVER (PARTITION BY user_id ORDER BY "commit", proc_ms, {EVENT_SQL} % 4, seq) AS version FROM log""")
def q_log_two_writers(spark, sf_dir):
    """Two writers prepare odd and even messages on the same versions; the second to commit has to number its rows anew."""
    early, late = halves(spark, sf_dir)
    odd, even = (late.where(F.col("seq").bitwiseAND(F.lit(2**state.OFFSET_BITS - 1)) % 2 == rest) for rest in (1, 0))
    log = StoredLog(spark, own_folder(spark, "log"))
    log.append(early, "first", 0)
    ahead, behind = log.prepare(odd, "odd", 0), log.prepare(even, "even", 0)
    log.commit(ahead, odd)
    log.commit(behind, even)
    return with_offset(log.read()).select("aggregate_id", "seq", "commit", "version")


@query(LOG_SQL + "SELECT user_id AS aggregate_id, version, seq FROM log WHERE merchant_id = 'm-7'")
def q_log_by_indexed_field(spark, sf_dir):
    """The search of ``q_event_log_by_payload`` in a stored log, through the field's own column and its Bloom filters."""
    log = StoredLog(spark, own_folder(spark, "log"))
    for number, half in enumerate(halves(spark, sf_dir)):
        log.append(half, "writer", number)
    return with_offset(log.by_payload("$.merchantId", "m-7")).select("aggregate_id", "version", "seq")


# --- operational figures -------------------------------------------------------------------

def operations(spark, sf_dir):
    """Durations in ticks of 10 microseconds."""
    return transactions(spark, sf_dir).select(
        F.col("type").alias("operation"), F.col("amount").alias("ticks"), "seq", "proc_ms")


def seconds() -> Column:
    return F.col("ticks") / F.lit(100000.0)


BOUNDS = rollups.BUCKETS["operation"]
HISTOGRAM_SQL = TXN_SQL + ", d AS (SELECT type AS operation, amount / 100000.0::DOUBLE AS s FROM txn), hist AS (" + " UNION ALL ".join(
    f"SELECT operation, '{b}' AS le, {b}::DOUBLE AS bound, count(*) FILTER (s <= {b}::DOUBLE) AS cumulative, count(*) AS total, "
    "round(sum(s), 5) AS sum_seconds FROM d GROUP BY operation" for b in BOUNDS
) + " UNION ALL SELECT operation, '+Inf', NULL, count(*), count(*), round(sum(s), 5) FROM d GROUP BY operation)"


@query(HISTOGRAM_SQL + "SELECT operation, le, cumulative, total, sum_seconds FROM hist")
def q_latency_histogram(spark, sf_dir):
    return rollups.latency_histogram(operations(spark, sf_dir), ["operation"], seconds(), BOUNDS).select(
        "operation", "le", "cumulative", "total", rounded("sum_seconds", 5).alias("sum_seconds"))


@query(TXN_SQL + """SELECT type AS operation, round(quantile_cont(amount, 0.95), 6) AS p95,
  round(quantile_cont(amount, 0.99), 6) AS p99 FROM txn GROUP BY type""")
def q_latency_percentiles(spark, sf_dir):
    found = rollups.latency_percentiles(operations(spark, sf_dir), ["operation"], F.col("ticks"), [0.95, 0.99])
    return found.select("operation", rounded("p95").alias("p95"), rounded("p99").alias("p99"))


@query(TXN_SQL + "SELECT type AS operation, count(*) AS n, true AS p95_is_close, true AS p99_is_close FROM txn GROUP BY type")
def q_latency_percentiles_from_sketches(spark, sf_dir):
    """Sketches of each day, merged; their percentiles held against the exact ranks."""
    rows = operations(spark, sf_dir).withColumn("day", F.floor(F.col("proc_ms") / 86_400_000))
    found = rollups.sketch_percentiles(rollups.latency_sketches(rows, ["operation", "day"], F.col("ticks")), ["operation"], [0.95, 0.99])
    below = lambda name: F.count_if(F.col("ticks") < F.col(name)) / F.first("n")
    upto = lambda name: F.count_if(F.col("ticks") <= F.col(name)) / F.first("n")
    close = lambda name, point: ((below(name) <= point + rollups.SKETCH_ERROR) & (upto(name) >= point - rollups.SKETCH_ERROR)).alias(f"{name}_is_close")
    return rows.join(found, "operation").groupBy("operation").agg(F.first("n").alias("n"), close("p95", 0.95), close("p99", 0.99))


@query(HISTOGRAM_SQL + """,
steps AS (SELECT *, lag(bound, 1, 0.0::DOUBLE) OVER (PARTITION BY operation ORDER BY bound) AS low,
    lag(cumulative, 1, 0) OVER (PARTITION BY operation ORDER BY bound) AS below FROM hist WHERE bound IS NOT NULL),
pick AS (SELECT operation, min(bound) AS bound FROM steps WHERE cumulative >= 0.95 * total GROUP BY operation)
SELECT s.operation, round(low + (s.bound - low) * (0.95::DOUBLE * total - below) / (cumulative - below), 6) AS quantile
FROM steps s JOIN pick p ON p.operation = s.operation AND p.bound = s.bound""")
def q_latency_quantile_from_histogram(spark, sf_dir):
    histogram = rollups.latency_histogram(operations(spark, sf_dir), ["operation"], seconds(), BOUNDS)
    return rollups.histogram_quantile(histogram, ["operation"], 0.95).select(
        "operation", rounded("quantile").alias("quantile"))


@query(TXN_SQL + "SELECT user_id, arg_max(amount, seq) AS value FROM txn GROUP BY user_id")
def q_gauge_latest(spark, sf_dir):
    samples = transactions(spark, sf_dir).withColumnRenamed("amount", "value")
    return rollups.gauge_latest(samples, ["user_id"], "value", ["seq"])

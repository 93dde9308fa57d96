import math

import pytest
from pyspark.sql import functions as F

from tollgate.operators import decide, rules
from tollgate.operators.rules import Outcome
from tollgate.params import MERCHANT_RULE, SPEC_PRESET, TRAVEL_RULE, VELOCITY_RULE, Params

NY, PARIS = (40.7128, -74.0060), (48.8566, 2.3522)
HOUR_NS = 3_600_000_000_000
BASE = 1_700_000_000 * 10**9


def txn(spark, prev, now, velocity=1, merchant="m9", kind="TransactionValidated"):
    """One prepared row; prev and now are (lat, lon, ns)."""
    schema = ("user_id string, merchant_id string, type string, velocity_count long, timestamp_ns long, "
              "latitude double, longitude double, "
              "prev struct<timestamp_ns: long, latitude: double, longitude: double>")
    before = None if prev is None else (prev[2], prev[0], prev[1])
    return spark.createDataFrame(
        [("u", merchant, kind, velocity, now[2], now[0], now[1], before)], schema)


def outcome(spark, rule, df):
    result = rule.outcome
    row = rule.prepare(df, None)
    return row.select(result().as_struct(rule.rule_id).alias("r")).first().r


@pytest.mark.parametrize("count,score", [(11, 0.8), (10, 0.0), (5, 0.0)])
def test_velocity(spark, count, score):
    r = outcome(spark, rules.VelocityRule(Params()), txn(spark, None, (*NY, BASE), velocity=count))
    assert (r.score, r.is_suspicious) == (score, score > 0)
    assert r.metadata == {"calculatedCount": str(count), "threshold": "10", "windowSizeSeconds": "60"}
    if score:
        assert r.findings == "11 transactions of u in 60 s, 10 allowed"


@pytest.mark.parametrize("hours,score", [(0.5, 0.9), (10, 0.0)])
def test_travel_new_york_to_paris(spark, hours, score):
    df = txn(spark, (*NY, BASE), (*PARIS, BASE + int(hours * HOUR_NS)))
    r = outcome(spark, rules.TravelRule(Params()), df)
    assert r.score == score and r.error is None
    assert r.findings.startswith("travelled at") == (score > 0)


def test_travel_order_of_tests(spark):
    rule = rules.TravelRule(Params())
    nan, inf = float("nan"), float("inf")
    assert "no earlier location" in outcome(spark, rule, txn(spark, None, (nan, 0.0, BASE))).findings
    bad_now = outcome(spark, rule, txn(spark, (*NY, BASE), (inf, 0.0, BASE - 1)))
    assert bad_now.error.startswith("location unusable") and bad_now.score is None
    bad_before = outcome(spark, rule, txn(spark, (nan, 0.0, BASE), (*NY, BASE + 1)))
    assert bad_before.error.startswith("stored location unusable")
    same_age = outcome(spark, rule, txn(spark, (*NY, BASE), (*PARIS, BASE)))
    assert same_age.score == 0.0 and "not newer" in same_age.findings
    antipode = outcome(spark, rule, txn(spark, (0.0, 0.0, BASE), (0.0, 180.0, BASE + HOUR_NS)))
    assert antipode.score == 0.9


def test_merchant_list_is_trimmed_and_case_sensitive(spark):
    rule = rules.MerchantRule(Params(merchant_blacklist="m1, m2 ,,m2, m3"))
    hit = outcome(spark, rule, txn(spark, None, (*NY, BASE), merchant="m2"))
    assert hit.score == 1.0 and hit.metadata == {"blacklistSize": "3"}
    assert outcome(spark, rule, txn(spark, None, (*NY, BASE), merchant="M2")).score == 0.0


@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_blacklist_table_with_either_join(spark, threshold):
    df = spark.range(100).selectExpr("concat('m', id % 10) AS merchant_id", "id")
    listed = spark.createDataFrame([("m1",), ("m3",), ("zz",), ("m1",), (None,)], "merchant_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        found = rules.with_blacklist(df, listed).where("is_blacklisted").select("id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(found) == 20


def test_blacklist_table_against_a_stream(spark, tmp_path):
    spark.range(30).selectExpr("concat('m', id % 10) AS merchant_id", "id").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("merchant_id string, id bigint").parquet(f"{tmp_path}/in")
    listed = spark.createDataFrame([("m1",), ("m3",)], "merchant_id string")
    out = rules.with_blacklist(stream, listed).where("is_blacklisted").writeStream.format("parquet")
    out = out.option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c")
    out.trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def results(**scores):
    return [(rules.Outcome(F.lit(s).cast("double"), F.lit(True), F.lit(k),
                           F.lit("boom" if s is None else None).cast("string")), w)
            for k, (s, w) in scores.items()]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_weighted_mean(spark):
    assert value(spark, decide.weighted_mean(results(a=(0.8, 2.0), b=(0.2, 1.0)))) == pytest.approx(0.6)
    assert value(spark, decide.weighted_mean([])) == 0.0
    assert value(spark, decide.weighted_mean(results(a=(0.5, Params().weight("other"))))) == 0.5
    assert value(spark, decide.weighted_mean(results(a=(None, 2.0), b=(0.4, 1.0)))) == pytest.approx(0.4)
    assert value(spark, decide.weighted_mean(results(a=(0.9, 0.0)))) == 0.0
    assert value(spark, decide.weighted_mean(results(a=(7.0, 1.0), b=(-3.0, 1.0)))) == 0.5


def test_noisy_or(spark):
    """The aggregator as an interface: null and failed results are left out, scores are clamped, NaN stays."""
    of = lambda **scores: value(spark, decide.noisy_or(results(**scores)))
    assert of(a=(0.8, 1.0), b=(0.5, 1.0)) == pytest.approx(0.9)
    assert of(a=(0.8, 2.0), b=(0.0, 1.0)) == pytest.approx(0.96)
    assert of(a=(None, 2.0), b=(0.4, 1.0)) == pytest.approx(0.4)  # failed
    assert of(a=(1.0, 0.5), b=(0.1, 1.0)) == 1.0 and of(a=(7.0, 1.0), b=(-3.0, 1.0)) == 1.0
    assert of(a=(None, 1.0)) == 0.0 and value(spark, decide.noisy_or([])) == 0.0
    missing = [(Outcome(F.lit(None).cast("double"), F.lit(False), F.lit(""), F.lit(None).cast("string")), 1.0), *results(b=(0.4, 1.0))]
    assert value(spark, decide.noisy_or(missing)) == pytest.approx(0.4)
    assert math.isnan(of(a=(math.nan, 1.0), b=(0.4, 1.0)))


def test_plain_mean(spark):
    two = results(a=(0.8, 1.0), b=(0.6, 1.0))
    assert value(spark, decide.plain_mean(two)) == pytest.approx(0.7)
    failed = results(a=(0.8, 1.0), b=(None, 1.0))
    assert value(spark, decide.plain_mean(failed)) == pytest.approx(0.4)
    assert value(spark, decide.plain_mean([])) == 0.0
    assert value(spark, decide.clamp01(F.lit(None).cast("double"))) is None


def test_a_rule_with_two_weights_fails_the_job(spark):
    results = spark.createDataFrame([(1, ("a", 0.5, None)), (1, ("b", 1.0, None))], "seq int, result struct<rule_id: string, score: double, error: string>")
    weigh = lambda rows: decide.weighted_risk_long(results, spark.createDataFrame(rows, "rule_id string, weight double"), ["seq"]).first().risk_score
    assert weigh([("a", 3.0), ("a", 3.0)]) == pytest.approx(0.625)
    with pytest.raises(Exception, match="two weights for a"):
        weigh([("a", 3.0), ("a", 2.0)])


SCORES = {  # which rules fire -> (weighted, plain)
    "": (0.0, 0.0), "V": (0.178, 0.267), "G": (0.300, 0.300), "M": (0.444, 0.333), "VG": (0.478, 0.567),
    "VM": (0.622, 0.600), "GM": (0.744, 0.633), "VGM": (0.922, 0.900),
}


@pytest.mark.parametrize("fired", SCORES)
def test_score_table(spark, fired):
    params = Params(merchant_blacklist="bad")
    ruleset = rules.default_rules(params)
    df = txn(spark, (*NY, BASE), (*(PARIS if "G" in fired else NY), BASE + HOUR_NS),
             velocity=11 if "V" in fired else 1, merchant="bad" if "M" in fired else "ok")
    for rule in ruleset:
        df = rule.prepare(df, None)
    row = decide.decide(df, ruleset, params).first()
    both = decide.evaluate_all(df, ruleset, params).first()
    assert (round(row.risk_score, 3), round(both.aggregate_score, 3)) == SCORES[fired]
    assert row.decision == ("FLAGGED" if fired == "VGM" else "APPROVED")
    assert both.is_suspicious == (fired == "VGM")
    assert len([p for p in row.reason.split(" | ") if p]) == len(fired)


class FailingRule:
    def __init__(self, rule_id, score=None):
        self.rule_id, self.score = rule_id, score

    def prepare(self, df, split):
        return df

    def outcome(self):
        error = F.lit("boom" if self.score is None else None).cast("string")
        return rules.Outcome(F.lit(self.score).cast("double"), F.lit(False), F.lit("x"), error)


class NoScoreRule(FailingRule):
    def outcome(self):
        return rules.Outcome(F.lit(None).cast("double"), F.lit(False), F.lit("x"), F.lit(None).cast("string"))


def decided(spark, *extra, kind="TransactionValidated"):
    params = Params()
    ruleset = rules.RuleSet(extra)
    df = txn(spark, None, (*NY, BASE), kind=kind)
    return decide.decide(df, ruleset, params).first()


def test_critical_failure_flags_with_full_score_and_empty_reason(spark):
    row = decided(spark, FailingRule(TRAVEL_RULE), FailingRule("other", 0.1))
    assert (row.decision, row.risk_score, row.fail_closed, row.reason) == ("FLAGGED", 1.0, True, "")


def test_other_failures_are_ignored(spark):
    row = decided(spark, FailingRule(VELOCITY_RULE), FailingRule(MERCHANT_RULE, 0.5))
    assert (row.decision, row.risk_score, row.fail_closed) == ("APPROVED", 0.5, False)


def test_score_out_of_range_and_unvalidated_are_errors(spark):
    assert decided(spark, FailingRule("a", 1.5)).decision == "ERROR"
    assert decided(spark, FailingRule("a", float("nan"))).decision == "APPROVED"
    assert decided(spark, NoScoreRule("a")).decision == "ERROR"
    row = decided(spark, FailingRule("a", 0.5), kind="TransactionInitiated")
    assert (row.decision, row.risk_score) == ("ERROR", None)


def test_registry(spark):
    ruleset = rules.default_rules(Params())
    assert [r.rule_id for r in ruleset] == [VELOCITY_RULE, TRAVEL_RULE, MERCHANT_RULE]
    with pytest.raises(ValueError):
        ruleset.register(rules.VelocityRule(Params()))

    class NoOutcome:
        rule_id = "x"

    with pytest.raises(TypeError):
        ruleset.register(NoOutcome())


def test_pandas_rule_isolates_failing_rows(spark):
    def score(rows):
        if (rows.n == 13).any():
            raise RuntimeError("unlucky")
        return rows.assign(score=rows.n / 100, is_suspicious=rows.n > 50, findings="seen")

    rule = rules.PandasRule("py", ["n"], score)
    df = rule.prepare(spark.range(40).selectExpr("id AS n"), None)
    got = {r.n: r.r for r in df.select("n", rule.outcome().as_struct("py").alias("r")).collect()}
    assert got[13].error == "unlucky" and got[13].score is None
    assert all(got[n].error is None and got[n].score == n / 100 for n in range(40) if n != 13)


def test_contract(spark):
    schema = "result struct<rule_id: string, score: double, is_suspicious: boolean, findings: string, error: string>"
    rows = [(("a", 0.5, False, "ok", None),), (("a", 1.5, False, "ok", None),), (("a", 0.5, False, "", None),),
            (("a", None, None, None, "boom"),), (("a", float("nan"), False, "ok", None),), (("a", None, False, "ok", None),)]
    got = [r.violations for r in rules.contract_violations(spark.createDataFrame(rows, schema)).collect()]
    assert got == [[], ["riskScore"], ["reason"], [], [], ["riskScore"]]


def test_params():
    given = Params.from_settings({"FRAUD_THRESHOLD": "0.7", "CRITICAL_RULE_IDS": "a, b", "VELOCITY_THRESHOLD": "3"})
    assert (given.fraud_threshold, given.critical_rule_ids, given.velocity_threshold) == (0.7, ("a", "b"), 3)
    assert Params.from_settings({}) == Params()
    with pytest.raises(ValueError):
        Params.from_settings({"FRAUD_THRESHOLD": "high"})
    assert SPEC_PRESET.weight(TRAVEL_RULE) == 2.0 and SPEC_PRESET.weight("unknown") == 1.0

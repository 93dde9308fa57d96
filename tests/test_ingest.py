import hashlib
import hmac
import json
import math

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tollgate.functions import crypto, net, text
from tollgate.functions.numeric import json_integer
from tollgate.operators import deadletter, eventlog, ingest, signing
from tollgate.params import Params

KEY = "test-key"
TX = {
    "type": "TransactionValidated", "transactionId": "tx1", "userId": "u1", "merchantId": "m1",
    "amount": {"value": "50", "currency": "USD"}, "timestamp": "1700000000000000001",
    "telemetry": {"latitude": 40.5, "longitude": -74, "deviceFingerprint": "fp", "ipAddress": "10.0.0.1",
                  "userAgent": "ua"},
    "validatorId": "v1",
}


def canonical(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def envelope(tx=TX, **changes):
    """A signed envelope as another producer makes it: integers unquoted in the signed text."""
    metadata = {"schemaVersion": "v1.0", "createdAtNs": 1700000000000000002, "provenanceTrace": "proc:1"}
    payload = json.loads(json.dumps(tx))
    payload["amount"]["value"] = int(payload["amount"]["value"])
    payload["timestamp"] = int(payload["timestamp"])
    text_ = canonical({"metadata": metadata, "payload": payload})
    signature = hmac.new(KEY.encode(), text_.encode(), hashlib.sha256).hexdigest()
    return {"metadata": metadata, "payload": tx, "signature": signature, **changes}


def run(spark, *values):
    rows = [(None, v if isinstance(v, (str, type(None))) else json.dumps(v), "t", 0, i, 1_700_000_000)
            for i, v in enumerate(values)]
    df = spark.createDataFrame(
        rows, "key string, value string, topic string, partition int, offset long, s long"
    ).withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    return {r.offset: r for r in ingest.ingest(df, KEY).collect()}


def changed(**changes):
    return {**TX, **changes}


def test_good_messages(spark):
    got = run(spark, TX, envelope(), changed(unknown=1, amount={"value": 7, "currency": "EUR", "x": 1}))
    assert [got[i].error_type for i in range(3)] == [None] * 3
    assert [got[i].kind for i in range(3)] == ["bare", "envelope", "bare"]
    assert (got[1].user_id, int(got[1].amount), got[1].transaction_id) == ("u1", 50, "tx1")
    assert got[1].timestamp_ns == 1700000000000000001 and got[1].metadata.createdAtNs == 1700000000000000002
    assert int(got[2].amount) == 7 and len(got[0].signature) == 64


def test_json_syntax(spark):
    good = json.dumps(TX)
    bad = ["", "{", "{'a': 1}", good + " x", good + good, good + "] x", "[1,", "NaN", good + ',"x"', "01", None]
    got = run(spark, *bad, f"  {good}\n", "[]", "null", "5", '"text"')
    n = len(bad) - 1
    assert [got[i].error_type for i in range(n)] == ["SyntaxError"] * n
    assert n not in got  # a tombstone leaves no trace
    assert got[n + 1].error_type is None
    assert [got[n + i].error_type for i in range(2, 6)] == ["SchemaValidationError"] * 4


def test_envelope_or_bare(spark):
    meta_only = {**TX, "metadata": {"schemaVersion": 1}}
    empty_payload = {**TX, "metadata": {"schemaVersion": 1}, "payload": ""}
    got = run(spark, meta_only, empty_payload, {"metadata": "x", "payload": "y"}, {"metadata": 1, "payload": TX}, {})
    assert [(got[i].kind, got[i].error_type) for i in range(5)] == [
        ("bare", None), ("bare", None), ("envelope", "EnvelopeValidationError"),
        ("envelope", "EnvelopeValidationError"), ("bare", "SchemaValidationError")]


@pytest.mark.parametrize("change,path", [
    ({"type": "Other"}, "type"), ({"userId": ""}, "userId"), ({"userId": 5}, "userId"),
    ({"merchantId": None}, "merchantId"), ({"validatorId": ""}, "validatorId"),
    ({"timestamp": "soon"}, "timestamp"), ({"timestamp": None}, "timestamp"),
    ({"amount": {"value": "1.5", "currency": "USD"}}, "amount.value"),
    ({"amount": {"value": "1", "currency": "US"}}, "amount.currency"),
    ({"amount": {"value": "1", "currency": "💰a"}}, None),
    ({"amount": 5}, "amount.value, amount.currency"),
    ({"telemetry": {**TX["telemetry"], "latitude": "40"}}, "telemetry.latitude"),
    ({"telemetry": {**TX["telemetry"], "latitude": 4000}}, None),
    ({"telemetry": {**TX["telemetry"], "ipAddress": "not-an-ip"}}, "telemetry.ipAddress"),
    ({"type": "TransactionFlagged"}, "reason, riskScore"),
    ({"type": "TransactionFlagged", "reason": "r", "riskScore": 1.5}, "riskScore"),
    ({"type": "TransactionFlagged", "reason": "r", "riskScore": 1}, None),
    ({"type": "TransactionInitiated", "validatorId": ""}, None),
])
def test_schema(spark, change, path):
    row = run(spark, changed(**change))[0]
    assert (row.errors or None) == path
    assert row.error_type == (None if path is None else "SchemaValidationError")


def test_signatures(spark):
    tampered = envelope()
    tampered["payload"] = {**TX, "amount": {"value": "51", "currency": "USD"}}
    cases = [tampered, envelope(signature="zz"), envelope(signature="a" * 64), envelope(signature="")]
    upper = envelope()
    upper["signature"] = upper["signature"].upper()
    got = run(spark, *cases, upper)
    assert [got[i].error_type for i in range(5)] == ["SecurityViolationError"] * 3 + ["EnvelopeValidationError", None]


def test_canonical_text_round_trip(spark):
    special = changed(userId='quote " slash \\ \\u000B tab \t bell \x07 vt \x0b esc \x1b é 💰')
    special["telemetry"] = {**TX["telemetry"], "latitude": 1.0, "longitude": -0.000123}
    special["telemetry"]["latitude"] = 1
    assert run(spark, envelope(special))[0].error_type is None


def javascript_number(x):
    """Number to text as in the language definition, from Python's shortest digits."""
    if x == 0:
        return "0"
    if not math.isfinite(x):
        return "null"
    sign, x = ("-" if x < 0 else ""), abs(x)
    mantissa, exponent = f"{x!r}e0".split("e")[:2] if "e" not in repr(x) else repr(x).split("e")
    whole, _, fraction = mantissa.partition(".")
    point = len(whole) + int(exponent)
    digits = (whole + fraction).lstrip("0")
    point -= len(whole + fraction) - len(digits)
    digits = digits.rstrip("0")
    k = len(digits)
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return sign + digits[:point] + "." + digits[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + digits
    e = point - 1
    return sign + digits[0] + ("." + digits[1:] if k > 1 else "") + "e" + ("+" if e > 0 else "-") + str(abs(e))


def test_number_text(spark):
    import random

    rng = random.Random(7)
    values = [0.0, -0.0, 1.0, -74.006, 0.1 + 0.2, 1e21, 1e-7, 123456789012345680000.0, 1.5e300, 2e-3, 9.999e22,
              2.0**-44, 1e7, 12345678.9, 1e-6, float("inf"), float("nan"), 100.0, 1e16, 4.35, 2.2250738585072014e-308]
    values += [rng.uniform(-180, 180) for _ in range(2000)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 16) for _ in range(2000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r.i: r.t for r in text.with_number_text(df, {"v": "t"}).collect()}
    wrong = [(v, got[i]) for i, v in enumerate(values) if got[i] != javascript_number(v)]
    assert wrong == []


@pytest.mark.parametrize("source,expected", [
    ("5", 5), ("5.0", 5), ("1e3", 1000), ("1.5", None), ('"5"', 5), ('" -5\\n"', -5), ('"+5"', 5), ('""', 0),
    ('"  "', 0), ("true", 1), ("false", 0), ("null", None), ('"0x1F"', 31), ('"-0x1F"', None), ('"0o17"', 15),
    ('"0b101"', 5), ('"0xffffffffffffffffffff"', 0xFFFFFFFFFFFFFFFFFFFF), ('"1.0"', None), ('"abc"', None),
    ('"99999999999999999999999999999999999999"', 10**38 - 1), ("1e999", None), ("9007199254740993", 9007199254740993),
    ('"0x"', None), ("{}", None), ('"1 2"', None),
])
def test_integers(spark, source, expected):
    df = spark.createDataFrame([(source,)], "s string").select(F.parse_json("s").alias("v"))
    got = df.select(json_integer(F.try_variant_get("v", "$", "string"), F.schema_of_variant("v")).alias("n")).first().n
    assert (None if got is None else int(got)) == expected


@pytest.mark.parametrize("address,expected", [
    ("1.2.3.4", True), ("255.255.255.255", True), ("256.1.1.1", False), ("01.2.3.4", False), ("1.2.3", False),
    ("::", True), ("::1", True), ("1:2:3:4:5:6:7:8", True), ("1:2:3:4:5:6:7:8:9", False), ("1::8", True),
    ("1:2:3:4:5:6:7::", True), ("::ffff:1.2.3.4", True), ("1:2:3:4:5:6:1.2.3.4", True), ("1::2::3", False),
    ("12345::", False), ("g::", False), ("", False), ("fe80::1:2", True),
])
def test_ip(spark, address, expected):
    assert spark.createDataFrame([(address,)], "a string").select(net.is_ip(F.col("a"))).first()[0] is expected


def test_hmac_equals_library(spark):
    for key in ("k", "x" * 64, "y" * 200):
        got = spark.createDataFrame([("héllo",)], "t string").select(crypto.hmac_sha256(F.col("t"), key)).first()[0]
        assert got == hmac.new(key.encode(), "héllo".encode(), hashlib.sha256).hexdigest()
    with pytest.raises(ValueError):
        crypto.hmac_sha256(F.col("t"), "")


def test_encryption(spark):
    params = Params(encryption_key="secret", crypto_salt="salt-salt")
    df = spark.createDataFrame([("é plain",), (None,)], "t string")
    sealed = signing.encrypt_columns(df, ["t"], params)
    row = sealed.where("t.iv is not null").first().t
    assert (len(row.iv), len(row.authTag), len(row.ciphertext)) == (24, 32, 2 * len("é plain".encode()))
    opened = {(r.t, r.security_violation) for r in signing.decrypt_columns(sealed, ["t"], params).collect()}
    assert ("é plain", False) in opened
    other = params.with_(encryption_key="other")
    assert signing.decrypt_columns(sealed.where("t.iv is not null"), ["t"], other).first().security_violation
    with pytest.raises(ValueError):
        crypto.derive_key("secret", "short")


def test_dead_letters(spark):
    rows = [("k", "{", "t", 3, 17, 1_700_000_000, "bad", "SyntaxError", None)]
    df = spark.createDataFrame(
        rows, "key string, value string, topic string, partition int, offset long, s long, error string, "
        "error_type string, signature string").withColumn("timestamp", F.timestamp_seconds("s"))
    letter = deadletter.dead_letters(df).first()
    assert letter.key == "k" and json.loads(letter.value) == {
        "originalPayload": "{", "error": "bad", "timestamp": 1_700_000_000_000}
    traced = deadletter.dead_letters_with_provenance(df, "ingest-7").first()
    assert traced.key == "17:SyntaxError"
    assert json.loads(traced.value) == {
        "metadata": {"timestamp": 1_700_000_000_000, "sourceComponent": "ingest-7",
                     "errorType": "SyntaxError", "originalTopic": "t", "originalPartition": 3, "originalOffset": "17"},
        "payload": "{", "signature": None}


def test_event_log(spark, tmp_path):
    def batch(*events):
        rows = [(i, u, 1_700_000_000 + i) for i, u in events]
        df = spark.createDataFrame(rows, "seq long, aggregate_id string, s long")
        return df.select("seq", "aggregate_id", F.timestamp_seconds("s").alias("created_at"),
                         F.to_date(F.timestamp_seconds("s")).alias("created_date"))

    path = str(tmp_path / "log")
    eventlog.append(batch((1, "a"), (2, "b"), (3, "a")), path, batch_id=0)
    stored = spark.read.parquet(path)
    second = batch((4, "a"), (5, "c"), (6, "b"), (7, "a"))
    for _ in range(2):  # a retried batch replaces its own files
        eventlog.append(second, path, stored.where("batch_id = 0"), batch_id=1)
    log = spark.read.parquet(path)
    got = [(r.aggregate_id, r.version, r.seq) for r in log.orderBy("aggregate_id", "version").collect()]
    assert got == [("a", 1, 1), ("a", 2, 3), ("a", 3, 4), ("a", 4, 7), ("b", 1, 2), ("b", 2, 6), ("c", 1, 5)]
    assert eventlog.version_conflicts(log).count() == 0
    assert eventlog.version_conflicts(log.unionByName(log.where("seq = 7"))).first().version == 4
    assert [r.version for r in eventlog.load(log, "a").collect()] == [1, 2, 3, 4]


def test_log_integrity(spark):
    value = json.dumps(envelope())
    df = spark.createDataFrame([(None, value, "t", 0, 1, 1_700_000_000)],
                               "key string, value string, topic string, partition int, offset long, s long")
    messages = df.withColumn("timestamp", F.timestamp_seconds("s")).drop("s")
    log = eventlog.with_versions(eventlog.log_rows(ingest.accepted(ingest.ingest(messages, KEY))))
    assert eventlog.load_verified(log, "u1", KEY).count() == 1
    broken = log.withColumn("payload", F.replace("payload", F.lit('"u1"'), F.lit('"u2"')))
    assert eventlog.quarantine(broken, KEY).count() == 1 and eventlog.quarantine(log, KEY).count() == 0
    with pytest.raises(SparkRuntimeException, match="signature is not the event"):
        eventlog.load_verified(broken, "u1", KEY).collect()


def test_positions_do_not_make_the_texts(spark, tmp_path):
    from tollgate.plans.queries import QUERIES

    rows = [(i, 1_704_067_200 + i, i % 5, "error" if i % 9 == 0 else "view", 1.5, '{"k": 3}') for i in range(400)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    events = events.withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["q_batch_key_groups"](spark, str(tmp_path))
    assert "sha2(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = found.collect()
    assert len(got) == 420
    assert sorted(r.position for r in got if r.key == "anonymous") == list(range(1, 11))
    assert sorted(r.position for r in got if r.key == "tx-20") == [1, 2]


def test_outcomes_do_not_carry_the_message(spark):
    df = spark.createDataFrame([], "key string, value string, topic string, partition int, offset long, timestamp timestamp")
    found = ingest.ingest(df.repartition(2, "offset"), KEY).select("offset", "error_type")
    kept = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate inline" in line]
    assert kept and not any("value, value#" in line or "topic, topic#" in line for line in kept)

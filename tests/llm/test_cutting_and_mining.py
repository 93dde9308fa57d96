"""Hard negatives, fill-in-the-middle and removal of repeated passages, against plain versions and on awkward input."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tollgate.llm import fim, negatives, queries, repeats, suffixes

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_fill_in_the_middle"])
def test_oracles(spark, name):
    assert compare(spark, connect(SMALL), name, queries.QUERIES[name], queries.ORACLES[name], SMALL) is None


# --- 11 --------------------------------------------------------------------------------------


def plain_negatives(rows, settings, is_anchor):
    rows = [(i, label, [math.floor(settings.scale * x) for x in v]) for i, label, v in rows
            if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (anchor, label, vector) in enumerate(rows):
        if not is_anchor(anchor):
            continue
        scored = sorted((-sum(x * y for x, y in zip(vector, v)), i, other) for k, (i, other, v) in enumerate(rows) if k != a)
        for p, positive, _ in [s for s in scored if s[2] == label][: settings.positives]:
            fits = [(s, i) for s, i, other in scored if other != label and settings.per_hundred * -p <= 100 * -s <= 100 * -p]
            out += [(anchor, positive, rank, i, -p, -s) for rank, (s, i) in enumerate(fits[: settings.negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_negatives_of_awkward_rows(spark, monkeypatch, blocks):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 1, 1]), [float(rng.choice([0, 0.25, 0.5, 1, -0.3])) for _ in range(4)]) for i in range(60)]
    rows += [rows[20], rows[20], (20, 0, [1.0, 1.0, 0.0, 0.0]), (61, 1, None), (62, None, [1.0] * 4), (None, 1, [1.0] * 4),
             (63, 1, [1.0, None, 1.0, 1.0]), (64, 1, [math.nan, 1.0, 1.0, 1.0]), (65, 0, [math.inf, 1.0, 1.0, 1.0]),
             (-70, 0, [0.75, 0.75]), (90, 0, []), (100, 5, [1.0] * 4), (2**40 * 10, 0, [0.5] * 4)]
    frame = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    for name in ("_row", "_block", "key", "anchor", "tops"):
        frame = frame.withColumn(name, F.lit("clash"))
    monkeypatch.setattr(negatives, "ROWS", blocks[0])
    monkeypatch.setattr(negatives, "ANCHORS", blocks[1])
    monkeypatch.setattr(negatives, "PART_BLOCKS", 2)
    for settings in (negatives.Settings(), negatives.Settings(positives=2, negatives=3, per_hundred=50, scale=10)):
        got = negatives.hard_negatives(frame, F.col("vec_id") % 10 == 0, settings)
        # doubles of what a float holds, as the operator sees them
        plain = plain_negatives([(i, label, v and [x if x is None else float(np.float32(x)) for x in v]) for i, label, v in rows], settings, lambda i: i % 10 == 0)
        assert sorted(map(tuple, got.collect())) == plain and plain


def test_negatives_of_nothing(spark):
    frame = spark.createDataFrame([(1, 1, [1.0])], "vec_id bigint, label int, embedding array<float>")
    assert negatives.hard_negatives(frame, F.lit(False)).count() == 0
    assert negatives.hard_negatives(frame.where("false"), F.lit(True)).count() == 0
    assert negatives.hard_negatives(frame, F.lit(True)).count() == 0


def test_scores_are_exact_or_fail():
    a = np.array([[2.0**27 + 1, 3.0]])
    assert negatives.scores(a, a)[0, 0] == (2**27 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        negatives.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_packed_keys_sort_as_numbers():
    rng = random.Random(1)
    rows = [(rng.choice([-5, 0, 7]), rng.choice([0, 9]), rng.randint(-(2**40), 2**40), rng.choice([0, 1]), rng.choice([-1, 1, 2**62])) for _ in range(500)]
    keys = negatives.packed(*map(np.array, zip(*rows)))
    back = list(zip(*(c.tolist() for c in negatives.unpacked(keys))))
    assert back == rows
    by_bytes = sorted(range(500), key=lambda k: (keys[k].tobytes(), k))
    assert by_bytes == sorted(range(500), key=lambda k: (rows[k][0], rows[k][1], -rows[k][2], rows[k][3], rows[k][4], k))


# --- 12 --------------------------------------------------------------------------------------


def offsets(kind, rng):
    if kind == "sparse":
        return sorted(rng.sample(range(1, 500_000), 300))
    if kind == "dense":
        return sorted(rng.sample(range(1, 200_000), 90_000))
    return [i for start in (5, 65_530, 70_000, 196_608) for i in range(start, start + 3_000)]


@pytest.mark.parametrize("kind", ["sparse", "dense", "runs"])
def test_select_of_boundaries(kind):
    rng = random.Random(2)
    values = offsets(kind, rng)
    cuts = sorted(rng.sample(range(len(values)), 5))
    bounds = fim.Boundaries(np.array(values[a:b], np.int64) for a, b in zip([0, *cuts], [*cuts, len(values)]))
    assert len(bounds) == len(values) and bounds.select(0) == 0
    assert [bounds.select(k + 1) for k in range(len(values))] == values
    wanted = {"sparse": fim.ArrayContainer, "dense": fim.BitmapContainer, "runs": fim.RunContainer}[kind]
    assert wanted in {type(c) for c in bounds.containers}
    with pytest.raises(IndexError):
        bounds.select(len(values) + 1)


def test_no_boundaries():
    assert len(fim.Boundaries()) == 0 and fim.Boundaries().select(0) == 0


def lines(text):
    return text.splitlines(keepends=True) if "\n" not in text else [x + "\n" for x in text.split("\n")[:-1]] + ([text.split("\n")[-1]] if not text.endswith("\n") else [])


def test_fill_in_the_middle(spark, monkeypatch):
    monkeypatch.setattr(fim, "BLOCK_BYTES", 7)
    monkeypatch.setattr(fim, "OUT_BYTES", 100)
    rng = random.Random(4)
    texts = ["", None, "\n", "one", "a\nb", "a\nb\n", "\n\n\n", "x<P>y\nz", "<M>", "a<\nP>b\n<S\n>", "é\n日本\n\U0001F600\n z", "\r\n\x0b \n", "long\n" * 40_000]
    texts += ["".join(rng.choice("ab\né<") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(3, "one"), (2**62, "a\nb\nc")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in ("h0", "n", "form", "output"):
        frame = frame.withColumn(name, F.lit("clash"))
    made = fim.transform(frame).withColumn("again", fim.restored(F.col("output"), F.col("form")))
    plain = []
    for i, t in rows:
        t = t or ""
        u = [x for x in (lines(t) if "\n" in t else [t]) if x]
        h = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[k : k + 8], 16) for k in range(0, 32, 8))
        low, high = sorted((h1 % (len(u) + 1), h2 % (len(u) + 1)))
        p, m, s = "".join(u[:low]), "".join(u[low:high]), "".join(u[high:])
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")):
            plain.append((i, len(u), "plain", None, None, t, t))
        elif h4 % 100 < 50:
            plain.append((i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", t))
        else:
            plain.append((i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", t))
    got = [tuple(r) for r in made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()]
    assert sorted(got, key=repr) == sorted(plain, key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_shares_of_forms(spark):
    frame = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    settings = fim.Settings(prefix="<|pre|>", suffix="<|suf|>", middle="<|mid|>", cut_percent=60, spm_percent=25)
    made = fim.transform(frame, settings).withColumn("again", fim.restored(F.col("output"), F.col("form"), settings))
    share = {r["form"]: r["count"] / 4_000 for r in made.groupBy("form").count().collect()}
    assert abs(share["plain"] - 0.4) < 0.04 and abs(share["spm"] - 0.15) < 0.03
    assert made.where("again <> 'a\nb\nc\n'").count() == 0


def test_empty_table_has_no_outputs(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.transform(none).count() == 0 and repeats.without_repeats(none).count() == 0


# --- 13 --------------------------------------------------------------------------------------


def test_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(60):
        alphabet = rng.choice([b"ab", b"abcdefgh", b"a", bytes(range(256))])
        text = bytes(rng.choice(alphabet) for _ in range(rng.choice([60, 200, 1_500])))
        text += text[: len(text) // 2] + b"zz" + text[len(text) // 3 :]
        length = rng.choice([18, 31, 50])
        starts = np.array(rng.sample(range(len(text) - length + 1), (len(text) - length) // 2))
        order, fresh = suffixes.classes(np.frombuffer(text, np.uint8), starts, length)
        found = [text[s : s + length] for s in starts[order]]
        assert found == sorted(found)
        assert fresh.tolist() == [True, *(a != b for a, b in zip(found, found[1:]))]


def test_cover_has_every_difference():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.mark.parametrize("block", [40, 97, 1 << 18])
def test_stretches_hold_every_window_once(block):
    """Each window is in one stretch, and equal windows have the same gram at the same place."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(rng.choice([0, 10, 49, 50, 51, 300]))).encode() for _ in range(40)] + [b"z" * 120]
    data, ends = repeats._joined(texts)
    whole, seen, gram_of = data.tobytes(), [], {}
    for begins, counts, hashes in repeats.stretches(data, ends, 50, block):
        for a, n, h in zip(begins.tolist(), counts.tolist(), hashes.tolist()):
            for k in range(a, a + n):
                seen.append(k)
                assert gram_of.setdefault(whole[k : k + 50], h) == h
    wanted = [e - len(t) + k for t, e in zip(texts, ends.tolist()) for k in range(len(t) - 49)]
    assert sorted(seen) == wanted


def plain_removal(rows, length):
    key = lambda i: math.inf if i is None else i
    least = {}
    for i, t in rows:
        t = (t or "").encode()
        for k in range(len(t) - length + 1):
            least[t[k : k + length]] = min(key(i), least.get(t[k : k + length], math.inf))
    out = []
    for i, t in rows:
        t = (t or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if least[t[k : k + length]] < key(i):
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, bytes(b for b, g in zip(t, gone) if not g)))
    return out


def as_rows(frame):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("small_blocks", [False, True])
def test_repeated_passages_go(spark, monkeypatch, small_blocks):
    if small_blocks:
        monkeypatch.setattr(repeats, "BUCKET_BYTES", 1_000)
        monkeypatch.setattr(repeats, "BUCKET_WINDOWS", 60)  # most buckets have too many windows
        monkeypatch.setattr(repeats, "RANGE_GRAMS", 50)
    rng = random.Random(6)
    random_text = lambda n: "".join(rng.choice("abcdefgh é日\n") for _ in range(n))
    passages = [random_text(n) for n in (36, 47, 50, 51, 64, 90, 200)]
    rows = []
    for i in range(120):
        parts = [random_text(rng.choice([0, 1, 10, 60])) for _ in range(4)]
        for _ in range(3):
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((rng.choice([i, i, i, i // 2, -i]), "".join(parts)))
    rows += [(500, None), (501, ""), (502, "x" * 5_000), (503, "x" * 300 + passages[6]), (504, "xy" * 200), (505, "y" + "xy" * 60), (506, passages[6][:49]),
             (None, passages[6]), (None, passages[6] + "tail"), (None, random_text(80) * 2), (7, passages[5] * 2), (7, passages[5] * 2), (2**63 - 2, passages[4] + "end"), (600, rows[3][1]), (600, rows[3][1])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    for name in ("id", "text_id", "gram", "piece", "start", "data", "found", "bytes"):
        frame = frame.withColumn(name, F.lit("clash"))
    got = repeats.without_repeats(frame)
    assert as_rows(got) == sorted(plain_removal(rows, 50), key=repr)
    for row in got.collect():
        assert sum(s["end"] - s["start"] for s in row["spans"]) == row["n_removed"]


def test_repeats_of_the_small_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in queries.QUERIES["op13_suffix_array_dedup"](spark, SMALL).collect()}
    for i, n_bytes, n_removed, n_spans, kept in plain_removal(rows, 50):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n_bytes, n_removed, n_spans, hashlib.sha256(kept).hexdigest())


def test_merged_spans():
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), a, a + rng.randint(1, 9)) for a in (rng.randint(0, 60) for _ in range(80))]
    plain = []
    for t in range(6):
        on = sorted({k for text, a, b in rows if text == t for k in range(a, b)})
        plain += [(t, k, next(j for j in range(k, 99) if j not in on)) for k in on if k - 1 not in on]
    got = repeats.merged(*(np.array(c) for c in zip(*rows)))
    assert list(zip(*(c.tolist() for c in got))) == plain


def test_collisions_only_cost_work(spark):
    """A table of a few bits marks nearly every gram; the result is the same."""
    rows = [(i, f"{i % 3} some words that several documents of this table have in common, and {i} of them not") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert as_rows(repeats.without_repeats(frame, table_bits=7)) == sorted(plain_removal(rows, 50), key=repr)


def test_other_ids_are_refused(spark):
    with pytest.raises(ValueError):
        repeats.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
    with pytest.raises(ValueError):
        repeats.without_repeats(spark.createDataFrame([(1, "b")], "doc_id bigint, text string"), length=10)

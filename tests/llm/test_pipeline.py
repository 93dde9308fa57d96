"""The pipeline, stage by stage, against a plain version of each stage on its own input; and on awkward input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
import zlib
from pyspark.sql import functions as F
from test_operators import brute_components, docs, plain_fingerprint, words  # noqa: F401

from tollgate.llm import mixing, quality, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last."""
    folder = tmp_path_factory.mktemp("stages")
    frame, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(frame)
        stage(spark, frame, SF).write.parquet(f"{folder}/{number}")
        frame = spark.read.parquet(f"{folder}/{number}")
    return [*out, frame]


def rows(frame):
    return [tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def fails(text):
    w = words(text)
    runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    inside = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    lines = [line for line in text.split("\n") if words(line)]
    letters = [c for c in text if re.match(r"[^\W\d_]", c)]
    chars = sum(map(len, w))
    return (
        len(w) < 10 or 100 * len(inside) > 20 * len(w) or 10 * sum(map(text.count, quality.SYMBOLS)) > len(w)
        or not 2 * len(w) <= chars <= 25 * len(w) or len(lines) >= 4 and 2 * (len(lines) - len(set(lines))) > len(lines)
        or len(letters) >= 20 and 10 * sum(c.isupper() for c in letters) > 6 * len(letters)
        or 10 * text.count("!") > 3 * len(w) or 4 * len(letters) < chars
    )


def test_quality_stage(stages):
    assert sorted(rows(stages[1])) == sorted(r for r in rows(stages[0]) if not fails(r[1]))


def test_quality_keeps_what_is_labelled_good(spark, stages):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r[0] for r in rows(stages[1])}
    good = [r for r in rows(stages[0]) if labels.get(r[0]) == 1 and len(words(r[1])) >= 10]
    bad = [r for r in rows(stages[0]) if labels.get(r[0]) == 0]
    assert sum(r[0] in kept for r in good) > 0.97 * len(good)
    assert sum(r[0] in kept for r in bad) < 0.03 * len(bad)


def test_language_stage(stages):
    assert sorted(rows(stages[2])) == sorted(r for r in rows(stages[1]) if re.search(r"[^\W\d_]", r[1]))


def test_near_dedup_stage(stages):
    prints = {r[0]: plain_fingerprint(r[1]) for r in rows(stages[2])}
    roots = brute_components(set(prints.values()))
    least = defaultdict(lambda: 10**18)
    for doc, p in prints.items():
        least[roots[p]] = min(least[roots[p]], doc)
    assert sorted(rows(stages[3])) == sorted(r for r in rows(stages[2]) if r[0] in set(least.values()))
    assert 0 < len(set(least.values())) < len(prints)


def test_mixing_stage(stages):
    copies = {r.doc_id: r._copies for r in mixing.mix(stages[3]).collect()}
    assert Counter(rows(stages[4])) == Counter({r: copies[r[0]] for r in rows(stages[3]) if copies[r[0]]})
    assert stages[4].columns == stages[0].columns


def test_packing_stage(stages):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.PACKING_TOKENIZER)
    want = Counter()
    for r in rows(stages[4]):
        ids = [*tokenizer.encode(r[1], add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for number, start in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[start : first + 2048 * number]
            want[r[0], number, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = stages[5].collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence = defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= 1.02 * sum(r.length for r in found) / 2048 + 1


def test_run_is_the_stages_in_a_row(spark, stages):
    key = ["doc_id", "piece", "length", "ids_crc32"]
    assert Counter(corpus_pipeline.run(spark, SF).select(key).collect()) == Counter(stages[5].select(key).collect())


@pytest.mark.parametrize("number", range(5))
def test_awkward_input(spark, docs, number):  # noqa: F811
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, docs, SF)
    assert out.count() > 0
    if number < 4:
        assert out.columns == docs.columns
        assert {r["length"] for r in out.select("length").distinct().collect()} == {"clash"}
        assert {r["failed"] for r in out.select("failed").distinct().collect()} == {"clash"}
        assert {r["_size"] for r in out.select("_size").distinct().collect()} == {"clash"}
    none = stage(spark, docs.where("false"), SF)
    assert none.count() == 0
    if number < 4:
        assert none.columns == docs.columns


def test_missing_labels_are_filled_in(spark, docs):  # noqa: F811
    out = corpus_pipeline.language_id(spark, docs, SF)
    assert out.where("lang IS NULL").count() == 0
    assert {r.doc_id for r in docs.where(~F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).collect()}.isdisjoint(r.doc_id for r in out.collect())


def test_language_stage_rejects_and_corrects(spark, stages):
    """Texts that pass the quality rules: gibberish and an unlearned language go, a wrong label is set right; without labels all stay."""
    rng = np.random.default_rng(4)
    gibberish = " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(80))
    greek = "η γλώσσα αυτού του κειμένου δεν είναι καμία από εκείνες που έχουν ετικέτες και γι αυτό το κείμενο δεν μένει " * 1
    base = stages[1].select("doc_id", "text", "lang", "source", "n_chars")
    german = base.where("lang = 'de' AND n_chars > 1000").orderBy("doc_id").first()
    more = [(-1, gibberish, "en", "s", 1), (-2, greek, None, "s", 1), (-3, german.text + " ende", "en", "s", 1)]
    rows = base.unionByName(spark.createDataFrame(more, base.schema))
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, rows, SF).where("doc_id < 0").collect()} == {-1, -2, -3}
    out = {r.doc_id: r.lang for r in corpus_pipeline.language_id(spark, rows, SF).collect()}
    assert {k: v for k, v in out.items() if k < 0} == {-3: "de"}
    assert len(out) == base.count() + 1
    assert corpus_pipeline.language_id(spark, base.withColumn("lang", F.lit(None).cast("string")), SF).count() == base.count()

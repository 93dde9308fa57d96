"""Each operator against a plain version of what it should do, and on awkward input."""

import hashlib
import html
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tollgate.llm import common, components, langid, licenses, mixing, packing, pages, quality, queries, simhash, sketches, tokens, urls

SMALL = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return BLANK.findall(text or "")


def column(frame, name):
    return [row[name] for row in frame.select(name).collect()]


@pytest.fixture(scope="module")
def docs(spark):
    """Awkward documents: nulls, empty, long, ties, repeats, odd characters; and columns with clashing names."""
    rng = random.Random(5)
    vocabulary = ["the", "of", "Ünder", "naïve", "x1", "日本", "and", "for", "###", "straße", "a"]
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    base = " ".join(rng.choice(vocabulary) for _ in range(60))
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, "   \n\t ", "en", None), (4, base, "en", "s1"), (4, base, "en", "s1"),
        (5, base + " end", "de", "s2"), (6, long, "de", "s2"), (7, long, None, "s2"), (None, base, "fr", "s2"), (8, "one two", "fr", None),
        (9, "x" * 70_000, None, "é"), (10, "a  b \n c\u00a0d\t<|endoftext|> </s> ▁ x ", "en", "é"), (11, "line\nline\nline\nother\nline", "en", "é"),
        (12, " ".join(["again and again we say it"] * 9), "en", "s1"), (13, "\U0001F600 \u0301 0 1 2 3 4 5 6 7 8 9", "en", "s1"),
        (15, "A clean text of plain words that says one thing after another and then ends here.", "en", "s1"),
        (14, "words with  two spaces  and\u2003others\x1cin\x85between", "en", "s1"),
    ]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    for name in ("failed", "n_words", "_size", "_copies", "_mix_key", "n", "sketch", "fingerprint", "length", "offset", "doc", "score"):
        frame = frame.withColumn(name, F.lit("clash"))
    return frame


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_empty_tables(docs, spark):
    none = docs.where("false")
    path = queries.PACKING_TOKENIZER
    assert packing.packed_documents(none, path).count() == 0
    assert langid.classify(none, langid.train(none)).count() == 0
    assert sketches.edited(none).count() == 0
    assert quality.ledger(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_of_each(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert tokens.token_counts(none, queries.COUNTING_TOKENIZER).count() == 0
    assert licenses.licenses(none.withColumn("path", F.lit("a/b"))).count() == 0
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert pages.main_text(empty).count() == 0
    assert urls.judge(empty, queries.RULES).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 600)] + [(None, 1), (7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {x: find(x) for x in parent if find(x) != x}


# --- 1 ---------------------------------------------------------------------------------------


def test_packing_gives_the_tokenizers_ids(docs, small):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.PACKING_TOKENIZER)
    table = docs.select("doc_id", "text").union(small.select("doc_id", "text")).withColumn("doc_id", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.coalesce("text", F.lit("null"))))
    texts = {r.doc_id: r.text for r in table.collect()}
    packed = packing.packed_documents(table.dropDuplicates(["doc_id"]), queries.PACKING_TOKENIZER).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in packed:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    assert by_doc.keys() == texts.keys()
    for doc, rows in by_doc.items():
        ids = [*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert sum(r.length for r in rows) == len(ids)
        assert len(rows) == -(-len(ids) // 2048) and all(r.length == 2048 for r in rows[1:])
        for r in rows:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r.offset)
        assert [r.offset for r in rows] == [0, *itertools.accumulate(r.length for r in rows)][:-1]
        assert sum(r.length for r in rows) <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_packing_plan_places_every_rank_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([8, 60, 2048])
    counts = {length: rng.choice([0, 1, 2, 7, 1000]) for length in rng.sample(range(1, capacity + 1), min(capacity, 50))}
    filled, large = defaultdict(list), Counter()
    seen = defaultdict(int)
    for length, rank, number, sequence, offset in packing.plan(counts, capacity).tolist():
        assert rank == seen[length]
        seen[length] += number
        for k in range(number):
            filled[sequence + k].append((offset, length))
            large[sequence + k] += 3 * length > capacity
    assert seen == {k: n for k, n in counts.items() if n}
    assert max(large.values(), default=0) <= 2
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    # Best-fit decreasing, one by one, is the yardstick.
    gaps = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        best = min((g for g in gaps if g >= length), default=None)
        if best is None:
            best = capacity
        else:
            gaps.remove(best)
        gaps.append(best - length)
        if len(gaps) > 3000:
            return
    assert len(filled) <= len(gaps) * 1.02 + 1


def test_packed_sequences_hold_the_ids(spark, small):
    coded = packing.pieces(small, queries.PACKING_TOKENIZER, capacity=512)
    packed = common.held(packing.pack(common.held(coded), 512))
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        ids = whole[r.sequence_id].ids
        assert bytes(ids[4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
    assert all(len(r.ids) == 4 * r.length <= 2048 for r in whole.values())


# --- 2 ---------------------------------------------------------------------------------------


def longest_phrases(sample, text):
    count = 0
    for at in range(0, len(text), langid.PIECE):
        piece, k = text[at : at + langid.PIECE], 0
        while k < len(piece):
            n = 1
            while k + n <= len(piece) and piece[k : k + n] in sample:
                n += 1
            k += max(1, n - 1)
            count += 1
    return count


def test_phrases_are_longest_matches():
    rng = random.Random(2)
    samples = {"x": bytes(rng.choices(b"abc ", k=400)), "y": bytes(rng.choices(b"bcd ", k=300))}
    model = langid.build(samples)
    texts = [bytes(rng.choices(b"abcdz ", k=n)) for n in (0, 1, 5, 511, 512, 513, 1500)]
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    found = langid.phrases(model, np.frombuffer(b"".join(texts), np.uint8), offsets)
    assert found.tolist() == [[longest_phrases(samples[lang], t) for lang in "xy"] for t in texts]


def test_language_of_held_out_texts(spark):
    found = queries.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    rows = found.join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows) > 200
    assert all(0 <= r.score <= 1 for r in rows)


def test_a_tiny_label_costs_the_others_nothing(spark, small):
    """One labelled text of two letters neither cuts the other samples nor wins by being short."""
    rows = small.select("doc_id", "text", "lang")
    model = langid.train(rows.unionByName(spark.createDataFrame([(10**9, "ok", "xx")], rows.schema)))
    alone = langid.train(rows)
    assert set(model.languages) == {*alone.languages, "xx"}
    assert [model.bits[model.languages.index(x)] for x in alone.languages] == alone.bits.tolist()
    found = langid.classify(rows, model, keep=("lang",)).collect()
    assert sum(r.lang == r.lang_pred for r in found) > 0.97 * len(found) > 100
    assert langid.classify(spark.createDataFrame([(1, "ok")], "doc_id bigint, text string"), model).first().lang_pred == "xx"


def test_language_of_awkward_texts(docs):
    labelled = docs.where("doc_id <> 9")
    model = langid.train(labelled)
    assert set(model.languages) == {"de", "en", "fr"}
    rows = langid.classify(docs, model, keep=("text", "score")[:1]).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert (r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or ""))
        assert 0 <= r.score <= 1


# --- 3 ---------------------------------------------------------------------------------------


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints_of_edited_texts(docs, small):
    table = docs.select("doc_id", "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).union(small.select(F.col("doc_id") + 100, "text"))
    order = sorted(table.collect(), key=lambda r: -r.doc_id)
    found = {r.doc_id: r for r in sketches.edited(table).collect()}
    errors = []
    for row, after in zip(order, order[1:] + order[:1]):
        text, other, r = row.text or "", after.text or "", found[row.doc_id]
        half = len(text) // 2
        changed = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited) == (len(text), changed)
        for near, second in ((r.near_edited, changed), (r.near_next, other)):
            a, b = shingles(text), shingles(second)
            true = len(a & b) / len(a | b) if a | b else 1.0
            if len(a) <= sketches.K and len(b) <= sketches.K and len(a | b) <= sketches.K:
                assert near == pytest.approx(true)
            errors.append(abs(near - true))
            assert 0 <= near <= 1
    assert max(errors) < 0.2 and sum(errors) / len(errors) < 0.03
    sketched = sketches.fingerprints(docs).collect()
    assert len({tuple(r.sketch) for r in sketched if r.text == order[-3].text}) <= 1
    for r in sketched:
        assert r.n_shingles == pytest.approx(len(shingles(r.text)), rel=0.35)


def test_sketches_merge(spark):
    rng = random.Random(1)
    sets = [rng.sample(range(10**12), n) for n in (0, 3, 200, 500)]
    rows = [("g", sorted(x)[: sketches.K]) for x in sets] + [(None, [5]), ("none", [])]
    frame = spark.createDataFrame(rows, "key string, sketch array<bigint>")
    merged = {r.key: r.sketch for r in sketches.merge_groups(frame, "key").collect()}
    assert merged == {"g": sorted(set().union(*sets))[: sketches.K], None: [5], "none": []}
    two = spark.createDataFrame([(list(range(100)), list(range(50, 90)))], "a array<bigint>, b array<bigint>")
    r = two.select(sketches.containment(F.col("b"), F.col("a")), sketches.containment(F.col("a"), F.col("b")), sketches.resemblance(F.col("a"), F.col("b"))).first()
    assert tuple(r) == pytest.approx((1.0, 0.4, 0.4))


# --- 4 ---------------------------------------------------------------------------------------


def test_quality_measurements(docs):
    rows = quality.ledger(docs).select("doc_id", "text", *"n_words word_chars n_symbols n_dup_lines n_repeat_words failed".split()).collect()
    for r in rows:
        text, w = r.text or "", words(r.text)
        runs = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {j for k in range(len(w) - 4) if runs[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
        lines = [line for line in text.split("\n") if words(line)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside))
        assert (r.failed & 3 != 0) == (len(w) < 10 or 100 * len(inside) > 20 * len(w))


def test_policies_and_ablations(spark):
    masks = [0, 1, 1, 2, 3, 4, 6, 256]
    ledger = spark.createDataFrame([(m,) for m in masks], "failed bigint")
    assert column(quality.apply(ledger, quality.BASE), "kept_base-1") == [m & 3 == 0 for m in masks]
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality.ablations(ledger, quality.BASE).collect()}
    assert found == {"few_words": (3, 2, 5), "repeated_words": (3, 2, 5)}


# --- 5 ---------------------------------------------------------------------------------------


def test_licenses_and_inheritance(spark):
    text = "Ordinary words of a text that says nothing of the sort.\n" * 5
    files = [
        ("a/LICENSE", "Released under the MIT License.\n"), ("a/b/x.txt", text), ("a/b/c/y.txt", text + "Licensed under CC BY-NC 4.0.\n" + text),
        ("a/b/c/COPYING", text + "Licensed under the Apache License, Version 2.0." ), ("a/b/c/d/z.txt", text), ("q/only.txt", text),
        ("top.txt", text), (None, text), ("e/n.txt", None), ("ab/x.txt", text), ("a/b/x.txt", text),
    ]
    rows = spark.createDataFrame(files, "path string, text string").withColumn("license", F.lit("clash"))
    found = [(r.path, r.license, r.license_source, r.is_license_file) for r in licenses.licenses(rows).collect()]
    assert sorted(found, key=str) == sorted([
        ("a/LICENSE", "MIT", "own", True), ("a/b/x.txt", "MIT", "inherited", False), ("a/b/x.txt", "MIT", "inherited", False),
        ("a/b/c/y.txt", "CC-BY-NC-4.0", "own", False), ("a/b/c/COPYING", "Apache-2.0", "own", True), ("a/b/c/d/z.txt", "Apache-2.0", "inherited", False),
        ("q/only.txt", None, None, False), ("top.txt", None, None, False), (None, None, None, False), ("e/n.txt", None, None, False), ("ab/x.txt", None, None, False),
    ], key=str)


def test_license_cosine_is_tf_idf(spark, small, monkeypatch):
    monkeypatch.setattr(licenses, "PART", 50)
    files = small.select(F.concat(F.lit("d/"), F.col("doc_id")).alias("path"), "text")
    words_of = lambda line: [t for t in (w.strip(licenses.EDGES) for w in line.lower().split()) if t]
    rows, n_lines, df = [], 0, Counter()  # path, kind, first line, words
    for r in files.collect():
        each = [(k, words_of(line)) for k, line in enumerate(r.text.split("\n")) if words_of(line)]
        n_lines += len(each)
        df.update(t for _, ts in each for t in set(ts))
        rows += [(r.path, "line", k, ts) for k, ts in each]
        for _, run in itertools.groupby(enumerate(each), key=lambda x: x[1][0] - x[0]):  # neighbouring lines; no comments here
            run = [x for _, x in run]
            if 1 < len(run) < len(each):
                rows.append((r.path, "block", run[0][0], [t for _, ts in run for t in ts]))
        if each:
            rows.append((r.path, "text", each[0][0], [t for _, ts in each for t in ts]))
    notices = [text for texts in licenses.TEMPLATES.values() for text in texts]
    others = [text for texts in licenses.TEXTS.values() for text in texts]
    weigh = lambda t: math.log((1 + n_lines) / max(df[t], 1)) + 1
    vector = lambda ts: {t: n * weigh(t) for t, n in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    known = {kind: [(v, norm(v)) for v in (vector(words_of(t)) for t in (notices if kind == "line" else notices + others))] for kind in ("line", "block", "text")}
    wanted = {}
    for path, kind, line, ts in rows:
        own = vector(ts)
        best = max(sum(w * own.get(t, 0) for t, w in v.items()) / length / norm(own) for v, length in known[kind])
        if best >= licenses.THRESHOLD:
            wanted[(path, kind, line)] = round(best, 9)
    assert wanted == {(r.path, r.kind, r.line): round(r.cosine, 9) for r in licenses.scan(files).collect()} and wanted


def wrapped(text, mark="", width=60):
    return "\n".join(f"{mark}{line}" for line in textwrap.wrap(text, width))


def test_headers_and_license_texts_of_several_lines(spark):
    """A wrapped header belongs to its file; a whole license text holds below, whatever the file is called."""
    prose = "\n".join(" ".join(f"word{(7 * k + j) % 50}" for j in range(9)) for k in range(40))
    code = "\n".join(f"int value{k} = other{k % 7} + {k};" for k in range(60))
    gpl, mit = licenses.TEXTS["GPL-3.0"][0], licenses.TEXTS["MIT"][0]
    bsd = max(licenses.TEXTS["BSD-3-Clause"], key=len)
    files = [
        ("p/terms.txt", "Copyright 2020 Someone\n\n" + wrapped(mit)), ("p/a/prose.txt", prose), ("p/a/b/main.c", "/*\n" + wrapped(gpl, " * ") + "\n */\n" + code),
        ("q/near.c", wrapped(gpl, "// ") + "\n" + code), ("q/one.txt", mit), ("r/words.md", bsd.replace(". ", ".\n\n")), ("r/s/prose.txt", prose),
        ("u/quoted.txt", prose + "\n\n" + wrapped(mit) + "\n\n" + prose), ("u/prose.txt", prose), ("v/crlf.txt", wrapped(mit).replace("\n", "\r\n")),
    ]
    found = {r.path: (r.license, r.license_source, r.is_license_file) for r in licenses.licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert found == {
        "p/terms.txt": ("MIT", "own", True), "p/a/prose.txt": ("MIT", "inherited", False), "p/a/b/main.c": ("GPL-3.0", "own", False),
        "q/near.c": ("GPL-3.0", "own", False), "q/one.txt": ("MIT", "own", True), "r/words.md": ("BSD-3-Clause", "own", True),
        "r/s/prose.txt": ("BSD-3-Clause", "inherited", False), "u/quoted.txt": ("MIT", "own", False), "u/prose.txt": (None, None, False),
        "v/crlf.txt": ("MIT", "own", True),
    }


def test_units_of_a_text():
    found = [(kind, line, sorted(words.elements())) for kind, line, words in licenses.units("// a b\n// c\nd e\n\n---\nf\ng\n")]
    assert [x for x in found if x[0] != "line"] == [("block", 0, ["a", "b", "c"]), ("block", 5, ["f", "g"]), ("text", 0, list("abcdefg"))]
    assert [line for kind, line, _ in found if kind == "line"] == [0, 1, 2, 5, 6]
    assert list(licenses.units(None)) == list(licenses.units("\n ... \n")) == []
    assert [kind for kind, *_ in licenses.units("a\nb")] == ["line", "line", "text"]


def test_license_sql_on_headers_and_texts(spark, tmp_path):
    """The SQL finds the same in blocks and whole texts."""
    duckdb = pytest.importorskip("duckdb")
    prose = "\n".join(" ".join(f"word{(7 * k + j) % 50}" for j in range(9)) for k in range(40))
    texts = [wrapped(t, mark) for texts in licenses.TEXTS.values() for t in texts for mark in ("", "# ", " * ")]
    texts += [prose, None, "", *[f"{t}\n{prose}" for t in texts], *[f"{prose}\n\n{t}\n\n{prose}" for t in texts]]
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.execute(queries.ORACLES["op5_license_scans"])
    columns = [d[0] for d in sql.description]
    wanted = sorted(sql.fetchall(), key=str)
    found = queries.QUERIES["op5_license_scans"](spark, str(tmp_path)).select(*columns).collect()
    assert sorted((tuple(r) for r in found), key=str) == wanted
    assert sum(r[columns.index("license_source")] == "own" for r in wanted) > len(texts) / 2


# --- 6 ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("sent", [100, 0])
def test_ordinary_words_weigh_as_often_as_they_are(spark, monkeypatch, sent):
    """A notice with ordinary words around it, against a dense TF-IDF of all words."""
    monkeypatch.setattr(licenses, "SENT", sent)
    rng = random.Random(3)
    ordinary = "see that file for more about it the of and to in is was not this with".split()
    rows = [(f"d/{k}", "\n".join(" ".join(rng.sample(ordinary, 9)) for _ in range(10))) for k in range(300)]
    rows += [("d/a", "Released under the MIT License; see that file for more about it\n" + rows[0][1]), ("d/b", "Released under zyx qwv vut the license of plk.")]
    every = [licenses.terms(line) for _, text in rows for line in text.split("\n")]
    df = Counter(t for ts in every for t in set(ts))
    vector = lambda ts: {t: n * (math.log((1 + len(every)) / max(df[t], 1)) + 1) for t, n in Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own, notice = vector(every[3000]), vector(licenses.terms("Released under the MIT License."))
    cosine = sum(w * own.get(t, 0) for t, w in notice.items()) / norm(own) / norm(notice)
    assert cosine > licenses.THRESHOLD
    found = licenses.scan(spark.createDataFrame(rows, "path string, text string")).where("kind = 'line'").collect()
    assert [(r.path, r.line, r.license, round(r.cosine, 9), r.whole) for r in found] == [("d/a", 0, "MIT", round(cosine, 9), False)]


def plain_fingerprint(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(text)]
    runs = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 2:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


def test_simhash_groups(docs, spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK_BYTES", 1000)
    table = docs.select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.col("doc_id") + 100, "text"))
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in table.collect()]
    roots = brute_components({p for _, p in rows})
    least = defaultdict(lambda: math.inf)
    for doc, p in rows:
        if doc is not None:
            least[roots[p]] = min(least[roots[p]], doc)
    found = simhash.near_duplicates(table).collect()
    assert Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in found) == Counter((d, p, least[roots[p]]) for d, p in rows)


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    prints = set()
    for _ in range(30):
        at = rng.getrandbits(64)
        prints.add(at)
        for _ in range(rng.choice([0, 1, 5, 60])):
            prints.add(at)
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= 1 << bit
            prints.add(at)
    frame = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fingerprint bigint")
    for bits in (0, 1, 2):
        pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= bits]
        linked = spark.createDataFrame([(a - 2**63, b - 2**63) for a, b in pairs], "a bigint, b bigint")
        ours = {(r.node, r.root) for r in components.components(simhash.links(frame, bits)).collect()}
        groups = defaultdict(set)
        for r in components.components(linked).collect():
            groups[r.root] |= {r.node + 2**63, r.root + 2**63}
        mine = defaultdict(set)
        for node, root in ours:
            mine[root] |= {node % 2**64, root % 2**64}
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))
    with pytest.raises(ValueError):
        simhash.links(frame, 3)


def test_one_of_each(docs):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = simhash.near_duplicates(docs.where("doc_id IS NOT NULL")).collect()
    assert Counter(column(kept, "doc_id")) == Counter({r.component_id: 1 for r in groups})  # the row without an id repeats document 4


def test_one_of_each_goes_by_text_where_ids_clash(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(60)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (None, texts[3]), (3, texts[3]), (3, texts[3]), (None, None), (4, ""), (None, texts[4])]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert Counter(map(tuple, kept.collect())) == Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (3, texts[3]), (4, ""), (None, texts[4])])


# --- 7 ---------------------------------------------------------------------------------------


def test_main_text_of_marked_pages(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r.text for r in pages.main_text(table).collect()}
    for r in table.collect():
        article = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|article)>", article)]
        assert found[r.page_id] == "\n\n".join(p for p in parts if p)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div id=cookie-notice>We use cookies</div>%s<aside>Side</aside><form><p>Mail</p></form><div class="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>"""


def test_main_text_by_structure(spark):
    inside = "<article class='post'><h1>A &amp; B</h1><p>One\n  two&nbsp;three<br>four <b>bold</b><p class=ad>Buy</p><script>if (a<b) x('</p>')</script><ul><li>x<li>y</ul><div hidden>no</div>last 1 < 2</article>"
    rows = [(1, "http://h/a", PAGE % inside), (2, None, None), (3, "x", ""), (4, "http://h/b", "<article><p>cut sho"), (5, "http://h/c", "plain <b>text"), (5, "http://h/c", "plain <b>text"), (None, "http://h/d", "<main>m<nav>n</nav></main>")]
    found = [(r.page_id, r.text) for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))).collect()]
    assert Counter(found) == Counter([
        (1, "A & B\n\nOne two three four bold\n\nx\n\ny\n\nlast 1 < 2"), (2, ""), (3, ""), (4, "cut sho"), (5, "plain text"), (5, "plain text"), (None, "m")])


def test_pages_whose_mark_is_no_article(spark):
    """Marks in comments, scripts and chrome are none; head may be left open; forms may enclose the page."""
    def of(*htmls):
        rows = [(k, f"http://h{k}.org/", page) for k, page in enumerate(htmls)]
        found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
        return [found[k] for k in range(len(rows))]

    story = "<div><p>The story that is told here.</p></div>"
    told = "The story that is told here."
    assert of(
        f"<body><!-- <article> -->{story}</body>", f"<body><script>x='<main >'</script>{story}</body>",
        f"<body>{story}<aside><article><p>Teaser</p></article></aside></body>",
        f"<html><head><title>T</title><meta charset=utf-8><body><article>{story}</article></body>",
        f"<html><head><title>T</title><div>{story}</div>",
        f"<body><form id=aspnetForm><nav>Home</nav><p>Top</p><article>{story}<form><p>Mail</p></form></article></form></body>",
        f"<body><form id=aspnetForm><div id=header>Site</div>{story}</form></body>",
        f"<body><form id=f><header>Site</header>{story}<form>",
        f"<body>{story}<form><p>Mail</p></form></body>", f"<body><div role='main'>{story}</div><div>Other</div></body>",
    ) == [told] * 10


def test_repeated_runs_of_unmarked_pages(spark):
    boiler = "read more about our great offers every single day right here"
    rng = random.Random(8)
    own = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(1000)) for _ in range(40))
    texts = [own() for _ in range(6)]
    rows = [(k, f"http://h.org/{k}", f"<div>{boiler}</div><div>{t} {boiler}</div><p>{boiler} too</p>") for k, t in enumerate(texts)]
    rows.append((50, "http://other.org/", f"<div>{boiler}</div>"))
    rows.append((51, "http://h.org/copy", rows[0][2]))
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == {**{k: t + "\n\ntoo" for k, t in enumerate(texts)}, 50: boiler, 51: texts[0] + "\n\ntoo"} or {k: v.replace("\n\ntoo", "") for k, v in found.items()} == {**dict(enumerate(texts)), 50: boiler, 51: texts[0]}


def test_runs_are_boilerplate_on_a_share_of_the_texts(spark):
    """In articles too; copies, quotations and short blocks stay."""
    rng = random.Random(9)
    own = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    notice, quoted, copied = "subscribe now to get the best of our stories by mail every day", own(20), own(30)
    texts = [own(30) for _ in range(8)]
    html = [f"<article><h1>Introduction</h1><p>{t}</p>{f'<p>{quoted}</p>' if k < 2 else ''}<p>{notice}</p></article>" for k, t in enumerate(texts)]
    html += [f"<nav>{k}</nav><div>{copied}</div>" for k in range(6)]
    rows = [(k, f"http://h.org/{k}", page) for k, page in enumerate(html)]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = [f"Introduction\n\n{t}" + (f"\n\n{quoted}" if k < 2 else "") for k, t in enumerate(texts)] + [copied] * 6
    assert found == dict(enumerate(want))


def extracted(spark, htmls, host="h.org"):
    rows = [(k, f"http://{host}/{k}", page) for k, page in enumerate(htmls)]
    found = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    return [found[k] for k in range(len(rows))]


def test_articles_keep_what_only_sounds_like_a_part_of_the_page(spark):
    page = """<article><h1>On <label>labels</label></h1><pre><code>x = 1 <span class="hljs-comment"># a comment</span>
y <span class="token comment">// too</span></code></pre><p>As <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> says</p>
<object data=x><p>Fallback</p></object><section class="banner-history"><p>Banners of old</p></section><p id="notice">Notice of the patent</p>
<div class="comments"><p>First!</p></div><div class="notice">We changed our terms</div><div id="related-posts-2"><p>More</p></div><p class="ad-top">Buy</p>
<pre><div class="comment">kept in code</div></pre></article>"""
    assert extracted(spark, [page]) == [
        "On labels\n\nx = 1 # a comment y // too\n\nAs a=2 says\n\nFallback\n\nBanners of old\n\nNotice of the patent\n\nkept in code"]


def test_versions_of_an_article_stay(spark):
    """Four near copies among ten marked pages are no boilerplate, whatever their share."""
    rng = random.Random(12)
    own = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n))
    story = own(60)
    texts = [f"{story} ending{k}" for k in range(4)] + [own(50) for _ in range(6)]
    assert extracted(spark, [f"<article><p>{t}</p></article>" for t in texts]) == texts
    assert extracted(spark, [f"<div>{t}</div>" for t in texts]) == texts  # unmarked: the versions count as one or two texts


def test_repeated_runs_against_a_plain_search(spark):
    """Token runs of a host's pages, by looking each up in every other page."""
    rng = random.Random(21)
    own = lambda n: [rng.choice("abcdefgh") + str(rng.randrange(10**6)) for _ in range(n)]
    common = [own(rng.choice([7, 8, 9, 15])) for _ in range(6)]
    texts = []
    for k in range(24):
        tokens_ = own(60)
        for c in rng.sample(common, 3) if k % 3 else common[:2]:
            at = rng.randint(0, len(tokens_))
            tokens_[at:at] = c
        texts.append(tokens_)
    runs = [{tuple(t[i : i + 8]) for i in range(len(t) - 7)} for t in texts]
    plain = []
    for t in texts:
        gone = set()
        for i in range(len(t) - 7):
            n = sum(tuple(t[i : i + 8]) in r for r in runs)
            if n >= max(4, math.ceil(0.3 * len(texts))):
                gone |= set(range(i, i + 8))
        plain.append(" ".join(w for i, w in enumerate(t) if i not in gone))
    assert extracted(spark, [f"<div>{' '.join(t)}</div>" for t in texts]) == plain
    assert any(len(p.split()) < len(t) for p, t in zip(plain, texts))


# --- 8 ---------------------------------------------------------------------------------------


def test_token_counts(docs, spark, monkeypatch):
    import sentencepiece

    monkeypatch.setattr(tokens, "PART_CHARS", 100)
    monkeypatch.setattr(tokens, "BATCH_CHARS", 500)
    processor = sentencepiece.SentencePieceProcessor(model_file=queries.COUNTING_TOKENIZER)
    counter = tokens.Counter(queries.COUNTING_TOKENIZER)
    assert counter.cuts
    texts = column(docs.union(docs.limit(0)), "text") + column(spark.read.parquet(f"{SMALL}/documents.parquet"), "text")
    texts += [" " * 300, "a " * 200, "a ▁" * 150, "a\x00b " * 90, " x" * 120 + "  "]
    assert counter.counts(texts) == [len(processor.encode(t or "")) for t in texts]
    rows = tokens.token_counts(docs, queries.COUNTING_TOKENIZER, limit=100).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(processor.encode(r.text or ""))) for r in docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_token_counts_of_a_tokenizers_file(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.PACKING_TOKENIZER)
    rows = tokens.token_counts(docs, queries.PACKING_TOKENIZER).collect()
    want = Counter((r.doc_id, len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == want


# --- 9 ---------------------------------------------------------------------------------------


def test_mix_meets_targets(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text").union(docs.select("doc_id", "source", "text"))
    rows = mixing.mix(table).collect()
    sizes = defaultdict(int)
    for r in rows:
        assert r._size == len(words(r.text))
        sizes[r.source] += r._size
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        unit = (total - sum(2 * sizes[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        more = {s for s in names if s not in capped and unit * weight[s] > 2 * sizes[s]}
        if not more:
            break
        capped |= more
    target = {s: 2 * sizes[s] if s in capped else unit * weight[s] for s in names}
    taken = defaultdict(int)
    for r in rows:
        assert r._source_size == sizes[r.source] and r._target == pytest.approx(target[r.source])
        assert 0 <= r._copies <= 2
        taken[r.source] += r._copies * r._size
    largest = defaultdict(int)
    for r in rows:
        largest[r.source] = max(largest[r.source], r._size)
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert Counter(mixing.mix(table).select("doc_id", "_copies").collect()) == Counter((r.doc_id, r._copies) for r in rows)


def test_mix_keeps_columns(docs):
    out = mixing.mix(docs)
    assert set(docs.columns) <= set(out.columns) and out.count() == docs.count()
    copies = sum(column(out, "_copies"))
    emitted = mixing.emitted(docs)
    assert emitted.columns == docs.columns and emitted.count() == copies


# --- 10 --------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    cases = {
        None: ("", "", None), "nothing": ("", "", None), "http://A.Example.NET/en/x?q#f": ("a.example.net", "/en/x", "example.net/en/"),
        "http://net/": ("net", "/", "net/"), "http://net": ("net", "", None), "x://y.org/fr/://z.net/": ("y.org", "/fr/://z.net/", "org/fr/"),
        "http://example.com/de": ("example.com", "/de", None), "http://b.example.com/de/?x": ("b.example.com", "/de/", "example.com/de/"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None), "http://a.net?x/en/": ("a.net", "", None), "http://ÀB.org/fr/1": ("Àb.org", "/fr/1", "org/fr/"),
    }
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(cases)], "page_id bigint, url string").withColumn("host", F.lit("clash"))
    found = {r.page_id: r for r in urls.judge(frame, queries.RULES).collect()}
    for k, want in enumerate(cases.values()):
        assert (found[k].host, found[k].path, found[k].rule) == want
        verdict = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow", None: "allow"}[want[2]]
        assert found[k].verdict == verdict


def test_template_tree(spark):
    rules = [urls.Rule("block", "h.org", "/spam/7"), urls.Rule("allow", "h.org", "/news/")]
    rows = [f"http://h.org/spam/{k}" for k in range(700, 730)] + [f"http://h.org/spam/{k}" for k in range(100, 110)]
    rows += [f"http://h.org/news/{k}.html" for k in range(20)] + [f"http://h.org/blog/post-{chr(97 + k)}{chr(98 + k)}" for k in range(20)] + ["http://h.org/blog/about"] * 3
    frame = spark.createDataFrame(list(enumerate(rows)), "page_id bigint, url string")
    found = {rows[r.page_id]: (r.template, r.verdict) for r in urls.judge(frame, rules).collect()}
    assert found["http://h.org/spam/100"][1] == "block"
    assert found["http://h.org/news/3.html"][1] == "allow"
    assert found["http://h.org/blog/post-ab"][1] == "allow"
    assert found["http://h.org/news/3.html"][0].endswith("/*.html")


# --- queries ---------------------------------------------------------------------------------


def leaves(frame):
    plan, queue, n = frame._jdf.queryExecution().optimizedPlan(), [], 0
    queue.append(plan)
    while queue:
        node = queue.pop()
        children = node.children()
        n += children.isEmpty()
        queue += [children.apply(i) for i in range(children.size())]
    return n


def test_the_tree_s_plan_grows_by_a_constant_a_level(spark):
    sizes, settings = [], urls.TreeSettings(distinct=2, support=3.0)
    for depth in (2, 4, 6, 8, 10):
        rows = [("h", "/" + "/".join(f"{'ab'[k >> i & 1]}{i}" for i in range(depth)), 1, 0, 0) for k in range(8)]
        sizes.append(leaves(urls.templates(spark.createDataFrame(rows, "host string, path string, n long, blocked long, allowed long"), settings)))
    assert sizes[1] - sizes[0] == sizes[2] - sizes[1] == sizes[3] - sizes[2] <= 4 and sizes[4] == sizes[3]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    from oracle import compare, connect

    sf_dir = "/root/testdata/sf0.01"
    assert compare(spark, connect(sf_dir), name, queries.QUERIES[name], queries.ORACLES[name], sf_dir) is None


def test_edited_digests(spark):
    rows = queries.QUERIES["op3_document_fingerprints"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    for r in rows:
        half = len(texts[r.doc_id]) // 2
        changed = texts[r.doc_id][: len(texts[r.doc_id]) - half] + texts[after[r.doc_id]][:half]
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert len(r.fingerprint) % 16 == 0

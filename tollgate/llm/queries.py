"""The registered queries of this subpackage, over whole tables, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from math import log

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import fim, langid, licenses, mixing, negatives, packing, pages, quality, repeats, simhash, sketches, tokens, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PACKING_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
COUNTING_TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = "mix"


def query(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1: packing ------------------------------------------------------------------------------


@query()
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.packed_documents(table(spark, sf_dir, "documents"), PACKING_TOKENIZER, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


# --- 2: language -----------------------------------------------------------------------------


@query()
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.classify(docs, model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


# --- 3: fingerprints -------------------------------------------------------------------------


@query()
def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketches.edited(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        sketches.digest(F.col("sketch")).alias("fingerprint"), sketches.digest(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


# --- 4: quality ------------------------------------------------------------------------------

SQL_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i
  FROM (SELECT r, regexp_extract_all(t, '{SQL_WORD}') AS ws FROM d)),
runs AS (SELECT r, i, word, CASE WHEN lead(i, 4) OVER s IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER s,
    lead(word, 2) OVER s, lead(word, 3) OVER s, lead(word, 4) OVER s) END AS five
  FROM w WINDOW s AS (PARTITION BY r ORDER BY i)),
again AS (SELECT *, five IS NOT NULL AND count(*) OVER (PARTITION BY r, five) > 1 AS twice FROM runs),
cover AS (SELECT r, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM again),
by_word AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words FROM cover GROUP BY r),
by_line AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{SQL_WORD}') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    length(regexp_replace(t, '[^\p{{L}}\p{{M}}]+', '', 'g')) AS n_letters,
    length(regexp_replace(t, '\P{{Lu}}+', '', 'g')) AS n_capitals,
    length(t) - length(replace(t, '!', '')) AS n_exclamations
  FROM d LEFT JOIN by_word USING (r) LEFT JOIN by_line USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT ({" OR ".join(f"({rule})" for rule in quality.RULES.values())}) AS kept
FROM m"""


@query(QUALITY_SQL)
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.ledger(table(spark, sf_dir, "documents"))
    base, kept = ~quality.passes(quality.BASE), quality.passes(quality.STRICT)
    return ledger.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), kept.alias("kept"),
    )


# --- 5: licenses -----------------------------------------------------------------------------


def license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    every = licenses.numbered(licenses.TEMPLATES, licenses.TEXTS)
    values = ", ".join(f"({quoted(license)}, {k}, {for_lines}, {quoted(t)}, {n})" for k, (license, for_lines, words) in enumerate(every) for t, n in words.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, concat_ws('/', coalesce(source, 'none'), doc_id // 1000, doc_id) AS path,
    concat_ws('/', coalesce(source, 'none'), doc_id // 1000) AS dir, coalesce(source, 'none') AS top, coalesce(text, '') AS t FROM documents),
cut AS (SELECT r, string_split(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS all_lines FROM d),
lines AS (SELECT r, unnest(all_lines) AS line_text, generate_subscripts(all_lines, 1) - 1 AS line FROM cut),
words AS (SELECT r, line, trim(unnest(regexp_split_to_array(lower(line_text), '\s+')), {quoted(licenses.EDGES)}) AS term FROM lines),
tf AS (SELECT r, line, term, count(*) AS n FROM words WHERE term <> '' GROUP BY ALL),
notices(license, k, for_lines, term, n) AS (VALUES {values}),
total AS (SELECT count(*) AS n FROM (SELECT DISTINCT r, line FROM tf)),
df AS (SELECT term, count(*) AS n FROM tf GROUP BY term),
weight AS (SELECT v.term, ln((1 + total.n)::DOUBLE / greatest(coalesce(df.n, 0), 1)) + 1 AS w
  FROM (SELECT DISTINCT term FROM notices) v CROSS JOIN total LEFT JOIN df ON df.term = v.term),
vec AS (SELECT k, license, for_lines, notices.term, notices.n * w AS x FROM notices JOIN weight ON weight.term = notices.term),
unit AS (SELECT k, license, for_lines, term, x / sqrt(sum(x * x) OVER (PARTITION BY k)) AS x FROM vec),
-- lines, blocks of neighbouring lines that are all comments or all none, whole texts
worded AS (SELECT r, line, regexp_matches(line_text, {quoted(licenses.COMMENT)}) AS is_comment FROM lines SEMI JOIN tf USING (r, line)),
breaks AS (SELECT *, (coalesce(lag(line) OVER o = line - 1 AND lag(is_comment) OVER o = is_comment, false))::INT AS goes_on
  FROM worded WINDOW o AS (PARTITION BY r ORDER BY line)),
block AS (SELECT r, line, sum(1 - goes_on) OVER (PARTITION BY r ORDER BY line) AS b FROM breaks),
span AS (SELECT r, line, min(line) OVER (PARTITION BY r, b) AS head, count(*) OVER (PARTITION BY r, b) AS n_lines,
  min(line) OVER (PARTITION BY r) AS top, count(*) OVER (PARTITION BY r) AS n_all FROM block),
part AS (SELECT r, 'line' AS kind, line AS head, line FROM span UNION ALL
  SELECT r, 'block', head, line FROM span WHERE n_lines > 1 AND n_lines < n_all UNION ALL SELECT r, 'text', top, line FROM span),
utf AS (SELECT part.r, kind, head AS line, term, sum(n) AS n FROM part JOIN tf ON tf.r = part.r AND tf.line = part.line GROUP BY ALL),
sized AS (SELECT r, kind, line, utf.term, utf.n * (ln((1 + total.n)::DOUBLE / df.n) + 1) AS x, utf.n FROM utf CROSS JOIN total JOIN df ON df.term = utf.term),
norm AS (SELECT r, kind, line, sqrt(sum(x * x)) AS len, sum(n) AS n_terms FROM sized GROUP BY ALL),
dots AS (SELECT s.r, s.kind, s.line, u.k, u.license, sum(s.x * u.x) AS dot FROM sized s JOIN unit u ON u.term = s.term AND (u.for_lines OR s.kind <> 'line') GROUP BY ALL),
cos AS (SELECT r, kind, line, k, license, round(dot / len, 12) AS cosine, n_terms FROM dots JOIN norm USING (r, kind, line)),
best AS (SELECT * FROM cos WHERE cosine >= {licenses.THRESHOLD} QUALIFY row_number() OVER (PARTITION BY r, kind, line ORDER BY cosine DESC, k) = 1),
size AS (SELECT r, n_terms AS n FROM norm WHERE kind = 'text'),
mass AS (SELECT r, bool_or(whole) AS whole FROM (SELECT best.r, 2 * sum(n_terms) > any_value(size.n) AS whole FROM best JOIN size ON size.r = best.r GROUP BY best.r, kind) GROUP BY r),
own AS (SELECT best.r, license, cosine, line, whole FROM best JOIN mass ON mass.r = best.r
  QUALIFY row_number() OVER (PARTITION BY best.r ORDER BY cosine DESC, line, kind DESC) = 1),
holder AS (SELECT dir, license, cosine FROM own JOIN d ON d.r = own.r WHERE whole QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1)
SELECT doc_id, d.path, coalesce(own.license, h1.license, h2.license, h3.license) AS license, own.line::INT AS license_line,
  coalesce(whole, false) AS is_license_file,
  CASE WHEN own.r IS NOT NULL THEN 'own' WHEN coalesce(h1.license, h2.license, h3.license) IS NOT NULL THEN 'inherited' END AS license_source,
  round(coalesce(own.cosine, h1.cosine, h2.cosine, h3.cosine), 6) AS cosine
FROM d LEFT JOIN own ON own.r = d.r LEFT JOIN holder h1 ON h1.dir = d.dir LEFT JOIN holder h2 ON h2.dir = d.top LEFT JOIN holder h3 ON h3.dir = ''"""


@query(license_sql())
def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then the id's thousands, then the id."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.col("doc_id").cast("string"))
    found = licenses.licenses(docs.select("doc_id", path.alias("path"), "text"))
    return found.select("doc_id", "path", "license", "license_line", "is_license_file", "license_source", F.round("cosine", 6).alias("cosine"))


# --- 6: near-duplicates ----------------------------------------------------------------------


@query()
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


# --- 7: pages --------------------------------------------------------------------------------


@query()
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


# --- 8: token counts -------------------------------------------------------------------------


@query()
def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), COUNTING_TOKENIZER, limit=4096)


# --- 9: mixing -------------------------------------------------------------------------------

MIXING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}')) AS size FROM documents),
k AS (SELECT *, coalesce('=' || source, '') AS key, md5(coalesce(doc_id::VARCHAR, '')) AS digest,
    greatest(length(bin(size)) - 7, 0) AS shift FROM d),
s AS (SELECT key, sum(size)::DOUBLE AS total, row_number() OVER (ORDER BY key = '', key) - 1 AS place FROM k GROUP BY key),
w AS (SELECT *, [{", ".join(map(str, WEIGHTS))}][place % {len(WEIGHTS)} + 1]::DOUBLE AS weight, {MOST} * total AS cap FROM s),
-- share out by weight, cap, share out again what is left
fill AS (
  SELECT 0 AS step, {SHARE} * sum(total) / sum(weight) AS unit, []::VARCHAR[] AS capped FROM w
  UNION ALL
  SELECT step + 1,
    (SELECT ({SHARE} * sum(total) - coalesce(sum(cap) FILTER (cap < f.unit * weight), 0)) / sum(weight) FILTER (cap >= f.unit * weight) FROM w),
    (SELECT list(key) FILTER (cap < f.unit * weight) FROM w)
  FROM fill f WHERE step < 1000 AND (SELECT count(*) FROM w WHERE cap < f.unit * weight) > coalesce(len(capped), 0)),
goal AS (SELECT key, total, least(cap, (SELECT arg_max(unit, step) FROM fill) * weight) AS target,
    ('0x' || substr(md5('{SEED}' || key), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS start FROM w),
r AS (SELECT k.*, row_number() OVER (PARTITION BY key ORDER BY shift * 128 + (size >> shift), digest, doc_id, size) AS place FROM k),
e AS (SELECT r.*, total, target, start, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate FROM r JOIN goal USING (key))
SELECT doc_id, size, total::BIGINT AS source_size, target,
  (size * (floor(place * rate + start) - floor((place - 1) * rate + start)))::BIGINT AS taken
FROM e"""


@query(MIXING_SQL)
def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED)
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_size") * F.col("_copies")).alias("taken"),
    )


# --- 10: URLs --------------------------------------------------------------------------------

RULES = [
    urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"),
]


def url_sql(rules: list[urls.Rule], tree: urls.TreeSettings = urls.TreeSettings()) -> str:
    """The verdicts with one step a level; ``levels`` of them, whatever the paths' depth."""
    fits = [(r, f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')") for r in sorted(rules, key=lambda r: -len(r.text()))]
    name = " ".join(f"WHEN {test} THEN '{r.text()}'" for r, test in fits)
    given = " ".join(f"WHEN {test} THEN '{r.verdict}'" for r, test in fits)
    steps, ending = [], r"'(\.[A-Za-z]{1,5})$'"
    for k in range(1, tree.levels + 1):
        steps.append(f"""
s{k} AS (SELECT *, segments[{k}] AS segment FROM l{k - 1}),
c{k} AS (SELECT host, template, segment, sum(n) AS pages FROM s{k} WHERE segment IS NOT NULL GROUP BY ALL),
w{k} AS (SELECT host, template, true AS wide FROM c{k} GROUP BY ALL HAVING count(*) >= {tree.distinct} AND sum(pages) < {tree.support} * count(*)),
v{k} AS (SELECT s.*, wide IS NOT NULL OR regexp_matches(regexp_replace(segment, {ending}, ''), '[0-9]') OR length(segment) > 40 AS varies
  FROM s{k} s LEFT JOIN w{k} USING (host, template)),
p{k} AS (SELECT *, CASE WHEN segment IS NULL THEN '' WHEN varies THEN '/*' || regexp_extract(segment, {ending}, 1) ELSE '/' || segment END AS part FROM v{k}),
l{k} AS (SELECT host, path, n, blocked, allowed, segments, template || part AS template,
  CASE WHEN segment IS NOT NULL AND NOT varies THEN template || '/*' ELSE branch || part END AS branch FROM p{k}),""")
    rates = [f"abs({c} / n::DOUBLE - all_{c} / all_n::DOUBLE) <= {(log(2 / tree.alpha) / 2) ** 0.5!r}::DOUBLE * (1 / sqrt(n) + 1 / sqrt(all_n))" for c in ("blocked", "allowed")]
    return rf"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT *, CASE {name} END AS rule, CASE {given} END AS given FROM u),
l0 AS (SELECT host, path, count(*) AS n, count(*) FILTER (given = 'block') AS blocked, count(*) FILTER (given = 'allow') AS allowed,
    list_filter(string_split(path, '/'), lambda s: s <> '') AS segments, '' AS template, '' AS branch FROM r GROUP BY host, path),
{"".join(steps)}
e AS (SELECT *, CASE WHEN len(segments) > {tree.levels} THEN '/**' ELSE '' END || CASE WHEN regexp_matches(path, './$') THEN '/' ELSE '' END AS tail FROM l{tree.levels}),
t AS (SELECT host, path, n, blocked, allowed, template || tail AS template, branch || tail AS branch FROM e),
f AS (SELECT host, branch, template, sum(n) AS n, sum(blocked) AS blocked, sum(allowed) AS allowed FROM t GROUP BY ALL),
g AS (SELECT *, CASE WHEN 2 * blocked > n THEN 'block' WHEN 2 * allowed > n THEN 'allow' ELSE '' END AS side FROM f),
h AS (SELECT *, sum(n) OVER b AS all_n, sum(blocked) OVER b AS all_blocked, sum(allowed) OVER b AS all_allowed FROM g
  WINDOW b AS (PARTITION BY host, branch, side)),
i AS (SELECT host, template, n, blocked, allowed, CASE WHEN {" AND ".join(rates)} THEN branch ELSE template END AS merged,
  CASE WHEN {" AND ".join(rates)} THEN side ELSE template END AS side FROM h),
j AS (SELECT host, merged, side, (sum(blocked) + {tree.prior}) / (sum(blocked) + sum(allowed) + 2 * {tree.prior})::DOUBLE AS purity FROM i GROUP BY ALL)
SELECT page_id, r.host, r.path, rule, coalesce(given, CASE WHEN purity >= {tree.reject} THEN 'block' ELSE 'allow' END) AS verdict, i.merged AS template
FROM r JOIN t ON t.host = r.host AND t.path = r.path JOIN i ON i.host = t.host AND i.template = t.template
JOIN j ON j.host = i.host AND j.merged = i.merged AND j.side = i.side"""


@query(url_sql(RULES))
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "template")


# --- 11: hard negatives ----------------------------------------------------------------------

NEGATIVES_SQL = """
WITH r AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
s AS (SELECT a.r, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT r, anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER w)::INT AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.r = p.r AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.r, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 5"""


@query(NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(moved, F.col("vec_id") % 100 == 0, negatives.Settings(positives=5, negatives=5, per_hundred=80, scale=256))


# --- 12: fill-in-the-middle ------------------------------------------------------------------

FIM_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS k1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS k2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
      WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
c AS (SELECT *, array_to_string(u[1:least(k1, k2)], '') AS p, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS m,
    array_to_string(u[greatest(k1, k2) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM c"""


@query(FIM_SQL)
def op12_fill_in_the_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = fim.Settings(seed=7, cut_percent=100, spm_percent=50)
    made = fim.transform(table(spark, sf_dir, "documents"), settings)
    digest = lambda text: F.sha2(F.encode(text, "UTF-8"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(fim.restored(F.col("output"), F.col("form"), settings)).alias("restored_sha256"),
    )


# --- 13: repeated passages -------------------------------------------------------------------


@query()
def op13_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = repeats.without_repeats(table(spark, sf_dir, "documents"), length=50)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


# --- the pipeline ----------------------------------------------------------------------------


@query()
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)

"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the ``K`` smallest of the different 64-bit hashes of a text's shingles of five words, in
order. Sketches of parts merge into the sketch of the whole, and from two sketches resemblance and
containment can be estimated; texts of up to ``K`` different shingles are compared exactly. All of
it is column arithmetic.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import bind, free_prefix, words

K = 128
SHINGLE = 5


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash of each run of ``size`` words; of all the words if there are fewer; none without words."""
    def of_words(h: Column) -> Column:
        count = F.size(h) - (size - 1)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(size)]))
        return F.when(count > 0, runs).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return bind(F.transform(words(text), lambda w: F.xxhash64(w)), of_words)


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, size: int = SHINGLE) -> Column:
    """The sketch of a text, an ``array<bigint>``; empty for a text without words, or null."""
    return bottom(shingle_hashes(text, size), k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of what two sketches' texts have together."""
    return bottom(F.concat(a, b), k)


def merge_groups(sketches: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """``key``, ``sketch``: one sketch for each group of sketches, of any number.

    Hashes are made different before the shuffle, and each task passes on the smallest ``k`` of a
    key only. Null sketches are empty; null keys are a group.
    """
    hashes = sketches.select(key, F.explode_outer(sketch_col).alias("_hash")).distinct()
    first = Window.partitionBy(key).orderBy(F.col("_hash").asc_nulls_last())
    few = hashes.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= k)
    return few.groupBy(key).agg(F.sort_array(F.collect_list("_hash")).alias("sketch"))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """How many different shingles the sketch's text has: exact below ``k``, else estimated from the k-th smallest hash."""
    share = (F.element_at(sketch, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of common shingles among all of both texts, 0 to 1; 1 if neither has any."""
    return bind(F.struct(a.alias("a"), b.alias("b")), lambda s: bind(
        merged(s.a, s.b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(F.array_intersect(s.a, s.b), union)) / F.size(union))))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of the first text's shingles that the second has, 0 to 1; 1 if it has none."""
    both = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(both / distinct_shingles(a, k), F.lit(1.0)))


def digest(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", tie: str = "_tie", derive=lambda df: df) -> DataFrame:
    """``derive(docs)`` with ``next_<column>``: the value in the row after, by descending ``id_col``; after the last comes the first.

    Null ids are last; equal ids follow ``tie`` downwards. The rows are dealt out by id ranges
    between approximate quantiles, and each range gets a copy of the first row of the range below,
    so that no window spans the table and each row is shuffled once. ``derive`` adds columns before
    the shuffle; it is given as a function so that the search for those first rows does without.
    """
    spark = docs.sparkSession
    # More ranges than partitions, so that partitions get about as many rows each.
    parts = 4 * max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    marks = [i / parts for i in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx(id_col, marks, 20 * parts)).first()[0] or []))
    run = max(1, isqrt(len(cuts)))
    runs = [cuts[i : i + run] for i in range(0, len(cuts), run)]
    if runs:
        literal = lambda values: F.array(*[F.lit(v) for v in values])
        below = lambda all: F.size(F.filter(all, lambda c: c <= F.col(id_col)))
        place = bind(below(literal([r[0] for r in runs])), lambda at: F.when(at == 0, F.lit(0)).otherwise(
            (at - 1) * run + below(F.element_at(F.array(*[literal(r) for r in runs]), at))))
        place = F.coalesce(place, F.lit(0))
    else:
        place = F.lit(0)
    at = free_prefix(docs)
    part, extra, key = f"{at}part", f"{at}extra", f"{at}key"
    rows = docs.withColumn(part, place.cast("int"))
    order = F.struct(F.col(id_col).alias("id"), F.col(tie).alias("tie"))
    heads = rows.groupBy(part).agg(F.max(order).alias(key)).collect()  # one row a range: no more than shuffle partitions
    if not heads:
        none = derive(docs).where("false")
        return none.withColumns({f"next_{c}": F.col(c) for c in columns})
    heads.sort(key=lambda row: -row[0])
    follows = [(heads[k][0], heads[(k + 1) % len(heads)][1].id, heads[(k + 1) % len(heads)][1].tie) for k in range(len(heads))]
    kinds = docs.schema
    schema = f"{at}for int, {at}id {kinds[id_col].dataType.simpleString()}, {at}tie {kinds[tie].dataType.simpleString()}"
    wanted = F.broadcast(spark.createDataFrame(follows, schema))
    met = rows.join(wanted, rows[id_col].eqNullSafe(wanted[f"{at}id"]) & rows[tie].eqNullSafe(wanted[f"{at}tie"]))
    copies = met.withColumn(part, F.col(f"{at}for")).dropDuplicates([part]).select(*rows.columns, F.lit(1).alias(extra))
    window = Window.partitionBy(part).orderBy(extra, F.col(id_col).desc_nulls_last(), F.col(tie).desc())
    both = derive(rows.withColumn(extra, F.lit(0))).unionByName(derive(copies))
    led = both.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns})
    return led.where(F.col(extra) == 0).drop(part, extra)


def fingerprints(docs: DataFrame, k: int = K, text_col: str = "text") -> DataFrame:
    """``doc_id``, ``text`` (empty if null), ``sketch``, ``n_shingles`` (estimated, different ones) of each row of ``docs``.

    Equal texts have equal sketches. Whole texts are used, of any length; repeated rows and null
    doc_ids are kept, other columns ignored, and an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("sketch", sketch(F.col("text"), k))
    return rows.withColumn("n_shingles", distinct_shingles(F.col("sketch"), k))


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Each row's fingerprint against that of its next row and of its edited text.

    Columns doc_id, n_chars, edited, sketch, edited_sketch, near_edited, near_next. The edited text
    has the last half of the code points (rounded down) replaced by as many from the beginning of
    the next text, or all of it. With one row, the next row is the row itself.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    led = with_next(rows, ["text", "sketch"], derive=lambda df: df.withColumn("sketch", sketch(F.col("text"), k)))
    led = led.withColumn("n_chars", F.char_length("text").cast("bigint"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    text = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    led = led.select("doc_id", "n_chars", text.alias("edited"), "sketch", resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
    led = led.withColumn("edited_sketch", sketch(F.col("edited"), k))
    return led.withColumn("near_edited", resemblance(F.col("sketch"), F.col("edited_sketch"), k))

"""Mix sources to target weights by systematic sampling.

Within a source each document has an expected number of copies, here the same for all: the
source's target over its size. Along a fixed order of the source's documents these numbers are
summed up, one offset between 0 and 1 drawn for the source is added, and a document is emitted
once for each integer that the sum passes at it. The order is by size (in classes that differ by
a sixty-fourth at most) and then by a hash of the doc_id, so that what is emitted follows the
target closely: only neighbours in size stand in for each other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import WORD, free_prefix, held, ranked

SALT_DIGITS = 3  # hexadecimal: a size class of a source is cut into 4096 pieces


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _class(size: Column) -> Column:
    """A number that rises with the size; sizes up to 127 have their own, larger ones share it if their seven leading bits agree."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return shift * 128 + F.call_function("shiftright", size, shift)


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """``source_key``, ``source_size``, ``target`` for each row (``source_key``, ``source_size``, in order of ``place``) of ``sizes``.

    The ``weights`` repeat along ``place``. The targets add up to ``share`` of all sizes; none is
    above ``most`` times its source's size, and what that takes away is shared out by weight again
    until no target is above. One row a source: this table is small next to the documents, and its
    windows run over all of it.
    """
    given = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy("place")) - 1
    rows = sizes.withColumn("_w", F.element_at(given, (place % len(weights) + 1).cast("int")))
    rows = rows.withColumns({"_cap": most * F.col("source_size"), "_total": share * F.sum("source_size").over(everything)})
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_ratio", "place")
    # If all sources before this one are capped, what is left for a unit of weight.
    left = F.col("_total") - F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("_unit", left / F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # The first source that need not be capped sets the unit; from there on it only falls.
    unit = F.max(F.when(F.col("_unit") <= F.col("_ratio"), F.col("_unit"))).over(everything)
    target = F.least("_cap", F.coalesce(unit * F.col("_w"), F.col("_cap")))
    return rows.select("source_key", "source_size", target.alias("target"))


def offset(source_key: Column, seed: str) -> Column:
    """The source's random offset, from 0 to below 1; the same in every run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), source_key)), 1, 8), 16, 10).cast("double") / 2.0**32


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: str = "mix", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_size`` (words), ``_source_size``, ``_target`` (of the row's source) and ``_copies``, the times to emit the row.

    Columns doc_id, source and the text are needed; all columns are kept (those named like the
    added ones are replaced). Sources are weighed in order of their names' code points, a null
    source last. A null or empty text has size 0 and may have copies of nothing. Rows with a null
    doc_id come first among rows of their size class; rows that repeat a doc_id each count. Without
    rows, or without words at all, nothing is emitted. No row has more than ``most`` copies,
    rounded up.

    Rows are shuffled once, by source, size class and piece of the hash, which cuts a source of any
    share of the rows; ranks are put together from the counts of the pieces.
    """
    docs = docs.drop("_size", "_source_size", "_target", "_copies")
    at = free_prefix(docs) + "mix_"
    key, size_class, salt, digest, rank = (at + x for x in ("key", "class", "salt", "digest", "rank"))
    rows = docs.withColumn("_size", word_count(F.col(text_col))).withColumns({
        key: F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")),
        size_class: _class(F.col("_size")),
        digest: F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))),
    }).withColumn(salt, F.substring(digest, 1, SALT_DIGITS))
    spread = [size_class, salt]
    counts = held(rows.groupBy(key, *spread).agg(F.count(F.lit(1)).alias("n"), F.sum("_size").alias("words")))
    sizes = counts.groupBy(F.col(key).alias("source_key")).agg(F.sum("words").alias("source_size"))
    place = F.struct(F.col("source_key") == "", F.col("source_key"))  # the null source last
    targets = source_targets(sizes.withColumn("place", place), weights, share, most)
    targets = targets.select(F.col("source_key").alias(key), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    start = offset(F.col(key), seed)
    passed = lambda upto: F.floor(upto * rate + start)
    placed = ranked(rows, key, spread, [digest, "doc_id", "_size"], counts, rank)
    return (
        placed.join(targets, key)
        .withColumn("_copies", (passed(F.col(rank)) - passed(F.col(rank) - 1)).cast("int"))
        .drop(key, digest, rank, *spread)
    )


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as ``mix`` says, with its own columns."""
    mixed = mix(docs.select("doc_id", "source", "text", F.struct("*").alias("doc")), **options).where("_copies > 0")
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("doc.*")

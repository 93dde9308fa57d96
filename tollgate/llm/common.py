"""What several operators share: the definition of a word, checkpoints, ranks that survive hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tollgate.session import let_workers_import, use_checkpoints

# The six characters that separate words.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even if ``body`` names it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text in order; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK + "+"), lambda w: w != "")


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with workers that can import this package."""
    let_workers_import(df.sparkSession)
    return df.mapInArrow(run, schema)


def held(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the session's shared checkpoint folder, without lineage."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def is_letter_free(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\p{L}"), F.lit(True))


def ranked(df: DataFrame, group: str, spread: Sequence[str], order: Sequence[Column | str], counts: DataFrame, name: str) -> DataFrame:
    """Add to each row its rank from 1 within ``group``, in order of ``spread`` and then ``order``.

    No group is ever sorted as a whole: rows are numbered within (``group``, ``spread``), and what
    comes before adds up from ``counts``, one row for each of these with the column ``n``. With two
    ``spread`` columns the first is summed on its own, so that neither sum is long.
    """
    keys, known = [group, *spread], f"{name}_before"
    first, rest = spread[0], list(spread[1:])
    before = lambda window: F.coalesce(F.sum("n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "n")
    if rest:
        coarse = counts.groupBy(group, first).agg(F.sum("n").alias("n"))
        coarse = coarse.select(group, first, before(Window.partitionBy(group).orderBy(first)).alias("_coarse"))
        fine = before(Window.partitionBy(group, first).orderBy(*rest))
        offsets = offsets.withColumn("_fine", fine).join(coarse, [group, first]).select(*keys, (F.col("_fine") + F.col("_coarse")).alias(known))
    else:
        offsets = offsets.select(*keys, before(Window.partitionBy(group).orderBy(first)).alias(known))
    numbered = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return numbered.join(offsets, keys).withColumn(name, F.col(name) + F.col(known)).drop(known)


def free_prefix(df: DataFrame) -> str:
    """Underscores with which no column of ``df`` begins: helper columns so named don't clash."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix

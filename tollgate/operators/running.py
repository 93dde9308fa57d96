"""Running aggregates per key that stay parallel when one key holds a large share of the rows.

A plain window puts every row of a key into one task. Here keys whose row count is out of
proportion are first found by a map-side-combined count, and their rows are cut into
consecutive pieces along the order. Each piece is windowed on its own; what earlier pieces
contribute is one row per piece, small enough to broadcast:

    result(row) = running value inside the piece  (+ or max)  running value of earlier pieces

The cut points only decide which task a row goes to. Any cut gives the same result, so the
approximate quantiles used for cutting do not make the results approximate.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = "_piece"

# A group below this many rows is never worth cutting.
SMALL_GROUP_ROWS = 20_000
# The tie of a cut point that lies before all rows of its value.
FIRST = -(2**63)
# At most this many pieces in total (twice that counting rounding): bounds what is broadcast.
MAX_PIECES = 16_384


@dataclass(frozen=True)
class Split:
    """Keys to group by and, for oversized keys, where their rows are cut along the order.

    ``large`` holds the rows of the oversized keys, ``finer`` a split of those rows by more keys.
    """

    keys: tuple[str, ...]
    cuts: DataFrame | None = None
    large: DataFrame | None = None
    finer: Split | None = None

    def place(self, df: DataFrame, at: Column) -> DataFrame:
        """Add the piece number of each row; null for keys that are not cut.

        ``at`` is what the cut points were chosen of: a number, or a struct of ``at`` and ``tie``.
        """
        if self.cuts is None:
            return df
        run = F.size(F.filter("_heads", lambda head: head <= at))
        inner = F.size(F.filter(F.element_at("_runs", F.greatest(run, F.lit(1))), lambda cut: cut <= at))
        piece = F.when(
            F.col("_heads").isNotNull(),
            F.when(run == 0, 0).otherwise((run - 1) * F.size(F.element_at("_runs", 1)) + inner),
        )
        return (
            df.join(F.broadcast(self.cuts), list(self.keys), "left")
            .withColumn(PIECE, piece)
            .drop("_heads", "_runs")
        )


def find_split(
    df: DataFrame, keys: Sequence[str], order: str, group_rows: int | None = None, tie: str | None = None
) -> Split:
    """Count rows per key and choose cut points of the numeric ``order`` for oversized keys.

    ``group_rows`` is the size above which a key is cut; by default a quarter of a shuffle
    partition's fair share, never below ``SMALL_GROUP_ROWS`` unless given. Rows of a key that share
    one value of ``order`` stay together, unless ``tie`` names the number that orders them: then
    crowded values are cut by it too, and cut points are structs of both, ``at`` and ``tie``.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    total, largest = sizes.agg(F.sum("_rows"), F.max("_rows")).first()
    if not total:
        return Split(tuple(keys))
    if group_rows is None:
        shares = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        group_rows = max(SMALL_GROUP_ROWS, total // shares)
    group_rows = max(group_rows, total // MAX_PIECES, 1)
    if largest <= group_rows:
        return Split(tuple(keys))

    # At most total / group_rows <= MAX_PIECES keys can be larger than group_rows. Held as rows, so that
    # all keys are counted only once more, and what follows reads only the rows of these.
    large = sizes.where(F.col("_rows") > group_rows)
    large = df.sparkSession.createDataFrame(large.collect(), large.schema)
    cuts = {tuple(row[k] for k in keys): [(at, FIRST) for at in row["_cuts"]]
            for row in _cut_points(df, large, keys, order, largest, group_rows).collect()}
    if tie is not None:
        of_large = df.join(F.broadcast(large.select(*keys)), list(keys), "left_semi")
        crowds = of_large.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > group_rows)
        fullest = crowds.agg(F.max("_rows")).first()[0]
        if fullest:
            for row in _cut_points(df, crowds, [*keys, order], tie, fullest, group_rows).collect():
                cuts[tuple(row[k] for k in keys)] += [(row[order], value) for value in row["_cuts"]]
    kind = df.schema[order].dataType.simpleString()
    point = kind if tie is None else f"struct<at:{kind},tie:bigint>"
    rows = []
    for key, points in cuts.items():
        points = sorted(set(points)) if tie is not None else sorted({at for at, _ in points})
        run = max(1, isqrt(len(points)))
        runs = [points[k : k + run] for k in range(0, len(points), run)]
        rows.append((*key, [r[0] for r in runs], runs))
    fields = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*fields, f"_heads array<{point}>", f"_runs array<array<{point}>>"])
    # Bounded by MAX_PIECES, see above. Held as rows so that every use sees the same cuts.
    cuts = df.sparkSession.createDataFrame(rows, schema)
    return Split(tuple(keys), cuts, df.join(F.broadcast(cuts.select(*keys)), list(keys), "left_semi"))


def _cut_points(df: DataFrame, large: DataFrame, keys: Sequence[str], order: str, largest: int, group_rows: int) -> DataFrame:
    """``keys``, ``_cuts``: for each of the ``large`` groups, approximate quantiles that leave pieces of about ``group_rows``."""
    grid = ceil(largest / group_rows)
    marks = [i / grid for i in range(1, grid)] or [0.5]
    quantiles = (
        df.join(F.broadcast(large), list(keys))
        .groupBy(*keys)
        .agg(
            F.first("_rows").alias("_rows"),
            F.percentile_approx(order, marks, F.lit(10 * grid)).alias("_marks"),
        )
    )
    # A group with fewer rows than the largest one takes only every so many of the grid's marks.
    pieces = F.ceil(F.col("_rows") / group_rows).cast("int")
    chosen = F.transform(
        F.sequence(F.lit(1), F.greatest(pieces - 1, F.lit(1))),
        lambda i: F.element_at("_marks", F.greatest(F.lit(1), (i * grid / pieces).cast("int"))),
    )
    return quantiles.select(*keys, F.array_distinct(F.filter(chosen, lambda c: c.isNotNull())).alias("_cuts"))


@dataclass(frozen=True)
class Running:
    """One running aggregate: ``kind`` is ``sum`` or ``max``; ``inclusive`` counts the row itself."""

    kind: str
    value: Column
    inclusive: bool = True

    def aggregate(self, value: Column) -> Column:
        return F.sum(value) if self.kind == "sum" else F.max(value)

    def combine(self, inner: Column, earlier: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(inner, F.lit(0)) + F.coalesce(earlier, F.lit(0))
        return F.greatest(inner, earlier)


def running(
    df: DataFrame,
    split: Split,
    order: Sequence[Column | str],
    aggregates: dict[str, Running],
    at: Column | None = None,
    totals_of: DataFrame | None = None,
) -> DataFrame:
    """Add running aggregates over the rows of each key in ``order``.

    A running sum over no rows is 0, a running max over no rows is null. ``at`` is the order
    value by which rows are put into pieces; a frame that already carries pieces keeps them.

    The totals of the pieces are a second pass over the rows. ``totals_of`` names an equal but
    cheaper table of the oversized keys' rows for it, so that the other keys, and what was
    computed for ``df`` before, do not run twice.
    """
    keys = list(split.keys)
    if split.cuts is None:
        window = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({
            name: _over(a, window) if a.kind == "max" else F.coalesce(_over(a, window), F.lit(0))
            for name, a in aggregates.items()
        })

    placed = df if PIECE in df.columns else split.place(df, at)
    earlier_pieces = (
        Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = placed if totals_of is None else split.place(totals_of, at)
    carried = (
        counted.where(F.col(PIECE).isNotNull())
        .groupBy(*keys, PIECE)
        .agg(*[a.aggregate(a.value).alias(f"_carry_{name}") for name, a in aggregates.items()])
        .withColumns({
            f"_carry_{name}": a.aggregate(F.col(f"_carry_{name}")).over(earlier_pieces)
            for name, a in aggregates.items()
        })
    )
    window = Window.partitionBy(*keys, PIECE).orderBy(*order)
    inside = placed.withColumns({name: _over(a, window) for name, a in aggregates.items()})
    # One row per piece, at most 2 * MAX_PIECES.
    return (
        inside.join(F.broadcast(carried), [*keys, PIECE], "left")
        .withColumns({
            name: a.combine(F.col(name), F.col(f"_carry_{name}")) for name, a in aggregates.items()
        })
        .drop(*[f"_carry_{name}" for name in aggregates])
    )


def _over(aggregate: Running, window) -> Column:
    last = Window.currentRow if aggregate.inclusive else -1
    return aggregate.aggregate(aggregate.value).over(
        window.rowsBetween(Window.unboundedPreceding, last)
    )

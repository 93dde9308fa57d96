"""Hard negatives: for an anchor and each of its positives, the best rows of other labels that score just below.

Scores are integer inner products of quantised vectors. All rows are scored against all anchors, in
tiles of an anchor block and a row block, one matrix product each; a tile passes on per anchor only
what can matter, never its pairs. Two passes over the tiles:

1. the best rows of the anchor's own label; the first few over all tiles are its positives;
2. with the positives known, for each of them the tile's best rows of other labels in its window.

What the second pass gives goes through a secondary sort: each pair is packed into one key (anchor,
descending score, positives first, id), big-endian, so that bytes sort as the numbers do. Rows are
dealt by anchor and sorted by key within partitions, ``repartitionAndSortWithinPartitions`` in its
DataFrame form. One iterator reads a partition: a positive opens its window, a negative goes to every
open window it falls into, and a window closes when it is full. It holds a handful of windows, never
an anchor's rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tollgate.llm.common import held, in_arrow

ROWS = 4096  # of a row block
ANCHORS = 1024  # of an anchor block
PART_BLOCKS = 8  # row blocks that one task goes through
SIGN = np.uint64(1 << 63)

KEY = np.dtype([("anchor_id", ">u8"), ("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("id", ">u8")])
POSITIVE, NEGATIVE = 0, 1
FOUND = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


@dataclass(frozen=True)
class Settings:
    """``per_hundred`` of a positive's score is the least that a negative of it may have."""

    positives: int = 5
    negatives: int = 5
    per_hundred: int = 80
    scale: int = 256


# --- numbers ---------------------------------------------------------------------------------


def quantised(vectors: list, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of all components as doubles, a row each; short vectors are filled up with zeros."""
    out = np.zeros((len(vectors), width))
    for k, vector in enumerate(vectors):
        out[k, : len(vector)] = vector
    return np.floor(out * scale)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``, which hold integers; too large ones are an error."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if largest < 2.0**53:  # doubles add up such integers without rounding
        return (a @ b.T).astype(np.int64)
    if largest < 2.0**56:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("a hundred times a score may not fit 64 bits")


def vectors_of(data: bytes, rows: int, width: int) -> np.ndarray:
    """The vectors of a block, stored in four or eight bytes a component."""
    return np.frombuffer(data, np.float32 if len(data) == 4 * rows * width else np.float64).reshape(rows, width).astype(np.float64)


def packed(anchor_ids, anchors, found, kinds, ids) -> np.ndarray:
    """One key a pair; keys sort by anchor, descending score, kind and id."""
    out = np.empty(len(anchors), KEY)
    out["anchor_id"] = np.asarray(anchor_ids, np.int64).view(np.uint64) ^ SIGN
    out["anchor"] = anchors
    out["down"] = ~(np.asarray(found, np.int64).view(np.uint64) ^ SIGN)
    out["kind"] = kinds
    out["id"] = np.asarray(ids, np.int64).view(np.uint64) ^ SIGN
    return out


def unpacked(keys: np.ndarray) -> tuple[np.ndarray, ...]:
    signed = lambda u: (u.astype(np.uint64) ^ SIGN).view(np.int64)
    return signed(keys["anchor_id"]), keys["anchor"].astype(np.int64), signed(~keys["down"].astype(np.uint64)), keys["kind"], signed(keys["id"])


def first_in_order(found: np.ndarray, ids: np.ndarray, among: np.ndarray, most: int) -> np.ndarray:
    """The places of the first ``most`` of ``among``, by descending score, ties by id."""
    if len(among) > most:
        least = np.partition(found[among], len(among) - most)[len(among) - most]
        among = among[found[among] >= least]  # with all that tie with the last
    return among[np.lexsort((ids[among], -found[among]))[:most]]


# --- blocks and tiles ------------------------------------------------------------------------


def _blocks(rows: DataFrame, name: str, width: int, settings: Settings, windows: bool) -> DataFrame:
    """The rows of each block (column ``name``) packed into one: ids, labels, vectors, and the windows' upper ends."""
    def run(batches):
        block, parts = None, []

        def flush():
            got = pa.Table.from_batches(parts)
            vectors = quantised([v.as_py() for v in got["embedding"]], settings.scale, width)
            tops = np.full((got.num_rows, settings.positives), np.iinfo(np.int64).min)
            if windows:
                for k, found in enumerate(got["tops"].to_pylist()):
                    tops[k, : len(found)] = found
            if np.abs(vectors).max(initial=0) < 2.0**24:  # exact in four bytes
                vectors = vectors.astype(np.float32)
            binary = [got[c].to_numpy().astype(np.int64).tobytes() for c in ("_row", "vec_id", "label")]
            values = [block, *binary, vectors.tobytes(), tops.tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int64(), *[pa.binary()] * 5])], [name, "_rows", "ids", "labels", "vectors", "tops"])

        for batch in batches:
            numbers = batch.column(0).to_numpy()
            starts = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else []
            for a, b in zip(starts, [*starts[1:], len(numbers)]):
                if parts and numbers[a] != block:
                    yield flush()
                    parts = []
                block = int(numbers[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield flush()

    columns = [name, "_row", "vec_id", "label", "embedding", *(["tops"] if windows else [])]
    dealt = rows.select(*columns).repartition(name).sortWithinPartitions(name)
    return in_arrow(dealt, run, f"{name} bigint, _rows binary, ids binary, labels binary, vectors binary, tops binary")


def _tiles(anchors: DataFrame, rows: DataFrame, n_anchor_blocks: int, n_parts: int) -> DataFrame:
    """Each row block beside each anchor block: row blocks go to all anchor blocks, anchor blocks to all parts of the rows."""
    to_anchors = rows.withColumns({"_part": F.pmod("_block", F.lit(n_parts)), "_anchors": F.explode(F.sequence(F.lit(0), F.lit(n_anchor_blocks - 1)).cast("array<bigint>"))})
    to_parts = anchors.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1)).cast("array<bigint>")))
    renamed = to_parts.select("_anchors", "_part", *[F.col(c).alias(f"a_{c}") for c in ("_rows", "ids", "labels", "vectors", "tops")])
    joined = to_anchors.join(renamed, ["_anchors", "_part"])
    return joined.select(*[c for side in ("a_", "") for c in (f"{side}_rows", f"{side}ids", f"{side}labels", f"{side}vectors", f"{side}tops")])


def _scored(tiles: DataFrame, width: int, settings: Settings, negatives: bool) -> DataFrame:
    """``anchor``, ``key``: of each tile and anchor the best rows of its label, or those of other labels that its windows may take."""
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield from tile(*(batch.column(c)[k].as_py() for c in range(9)))

    def tile(a_rows, a_ids, a_labels, a_vectors, tops, b_rows, b_ids, b_labels, b_vectors):
        long = lambda data: np.frombuffer(data, np.int64)
        a_rows, a_ids, a_labels, b_rows, b_ids, b_labels = map(long, (a_rows, a_ids, a_labels, b_rows, b_ids, b_labels))
        tops = long(tops).reshape(len(a_rows), -1)
        found = scores(vectors_of(a_vectors, len(a_rows), width), vectors_of(b_vectors, len(b_rows), width))
        same = a_labels[:, None] == b_labels[None, :]
        anchors, places = [], []
        for k in range(len(a_rows)):
            if not negatives:
                among = np.flatnonzero(same[k] & (b_rows != a_rows[k]))
                best = first_in_order(found[k], b_ids, among, settings.positives)
            else:
                others, wanted = np.flatnonzero(~same[k]), []
                high = found[k][others]
                for top in set(tops[k].tolist()) - {np.iinfo(np.int64).min}:
                    fits = others[(100 * high <= 100 * top) & (100 * high >= settings.per_hundred * top)]
                    wanted.append(first_in_order(found[k], b_ids, fits, settings.negatives))
                best = np.unique(np.concatenate(wanted)) if wanted else np.empty(0, np.int64)
            anchors.append(np.full(len(best), k))
            places.append(best)
        anchors, places = np.concatenate(anchors), np.concatenate(places)
        kind = NEGATIVE if negatives else POSITIVE
        keys = packed(a_ids[anchors], a_rows[anchors], found[anchors, places], kind, b_ids[places])
        yield _keyed(keys)

    return in_arrow(tiles.drop("tops"), run, "anchor bigint, key binary")


def _keyed(keys: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * KEY.itemsize
    column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(keys.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(keys["anchor"].astype(np.int64)), column], ["anchor", "key"])


def _sorted_keys(pairs: DataFrame) -> DataFrame:
    return pairs.repartition("anchor").sortWithinPartitions("key").select("key")


def _read(batch: pa.RecordBatch):
    return zip(*(c.tolist() for c in unpacked(np.frombuffer(b"".join(batch.column(0).to_pylist()), KEY))))


# --- the operator ----------------------------------------------------------------------------


def _first_positives(pairs: DataFrame, settings: Settings) -> DataFrame:
    """The first pairs of each anchor out of those of all tiles: ``anchor``, ``score``, ``key``."""
    def run(batches):
        anchor, taken = None, 0
        for batch in batches:
            keep, found = [], []
            for k, (_, row, score, _, _) in enumerate(_read(batch)):
                anchor, taken = row, taken + 1 if row == anchor else 1
                if taken <= settings.positives:
                    keep.append(k)
                    found.append((row, score))
            keys = batch.column(0).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), keys], ["anchor", "score", "key"])

    return in_arrow(_sorted_keys(pairs), run, "anchor bigint, score bigint, key binary")


class _Open:
    """The window of one positive."""

    __slots__ = ("id", "score", "taken")

    def __init__(self, positive: int, score: int):
        self.id, self.score, self.taken = positive, score, 0


def _mined(pairs: DataFrame, settings: Settings) -> DataFrame:
    """Negatives by the windows that are open when they come by."""
    def run(batches):
        anchor, windows = None, []
        for batch in batches:
            out = []
            for anchor_id, row, score, kind, other in _read(batch):
                if row != anchor:
                    anchor, windows = row, []
                if kind == POSITIVE:
                    windows.append(_Open(other, score))
                    continue
                windows = [w for w in windows if w.taken < settings.negatives and settings.per_hundred * w.score <= 100 * score]
                for w in windows:  # all have a score of at least this one's: they came before
                    w.taken += 1
                    out.append((anchor_id, w.id, w.taken, other, w.score, score))
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int32() if k == 2 else pa.int64()) for k, c in enumerate(columns)],
                ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return in_arrow(_sorted_keys(pairs), run, FOUND)


def hard_negatives(rows: DataFrame, anchors, settings: Settings = Settings()) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    ``rows`` has ``vec_id``, ``label`` (integers) and ``embedding``; ``anchors`` is a condition on
    these that names the anchors. Rows with a null id or label, a null vector, or a null, NaN or
    infinite component take no part. Vectors of different length are compared as if filled up with
    zeros. Of rows that repeat an id each is a row of its own: one may be the other's positive, and
    each is an anchor if its id is. An anchor without positives, or a positive without negatives in
    its window, has no rows; positives below zero never have any. An empty table gives no rows. A
    score beyond 56 bits fails the job. Other columns are ignored.
    """
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    valid = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    slim = valid.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "embedding", anchors.alias("_anchor"))
    known = held(slim.withColumn("_row", F.monotonically_increasing_id()))
    n, n_anchors, width = known.agg(F.count(F.lit(1)), F.count_if("_anchor"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    if not n or not n_anchors:
        return rows.sparkSession.createDataFrame([], FOUND)
    width = max(width, 1)
    n_blocks, n_anchor_blocks = ceil(n / ROWS), ceil(n_anchors / ANCHORS)
    n_parts = ceil(n_blocks / PART_BLOCKS)
    deal = lambda blocks: F.pmod(F.xxhash64("_row"), F.lit(blocks))  # noqa: E731  blocks of about equal size

    row_blocks = held(_blocks(known.withColumn("_block", deal(n_blocks)), "_block", width, settings, windows=False))
    chosen = known.where("_anchor").withColumn("_anchors", deal(n_anchor_blocks))
    own = _scored(_tiles(_blocks(chosen, "_anchors", width, settings, windows=False), row_blocks, n_anchor_blocks, n_parts), width, settings, negatives=False)
    positives = held(_first_positives(own, settings))

    tops = positives.groupBy("anchor").agg(F.collect_list("score").alias("tops")).withColumnRenamed("anchor", "_row")  # a few each
    with_windows = chosen.join(tops, "_row")
    others = _scored(_tiles(_blocks(with_windows, "_anchors", width, settings, windows=True), row_blocks, n_anchor_blocks, n_parts), width, settings, negatives=True)
    return _mined(others.union(positives.select("anchor", "key")), settings)

"""Fill-in-the-middle: a text's lines are cut at two drawn places and reordered around sentinels.

Where a text may be cut is a set of offsets, the ends of its lines, kept as a Roaring bitmap keeps
integers: by their upper bits in containers of 65,536 values, each as a sorted array, a bitmap or
runs, whichever is smallest, with the containers' cumulative cardinalities beside them. "The end of
the k-th line" is a select: a search of the container in the cumulative cardinalities, then a select
inside it. Texts are read a block at a time, so the set is all that is held besides the text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import in_arrow

BLOCK_BYTES = 1 << 20
OUT_BYTES = 16 << 20
LOW_BITS = 16
LINE_END = 10


# --- containers: 65,536 values each ----------------------------------------------------------


class ArrayContainer:
    """The values themselves, sorted; two bytes each."""

    def __init__(self, values: np.ndarray):
        self.values = values.astype(np.uint16)

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 2 * len(values)

    def select(self, k: int) -> int:
        return int(self.values[k])


class BitmapContainer:
    """One bit a value, with the cumulative cardinality of its 1,024 words."""

    def __init__(self, values: np.ndarray):
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[values] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.upto = np.cumsum(np.bitwise_count(self.words), dtype=np.int32)

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return (1 << LOW_BITS) // 8

    def select(self, k: int) -> int:
        at = int(np.searchsorted(self.upto, k, side="right"))
        word = int(self.words[at])
        for _ in range(k - (int(self.upto[at - 1]) if at else 0)):
            word &= word - 1  # drops the lowest bit
        return at * 64 + (word & -word).bit_length() - 1


class RunContainer:
    """First values and cumulative lengths of runs of neighbouring values; four bytes a run."""

    def __init__(self, values: np.ndarray):
        first = np.concatenate(([True], np.diff(values) != 1))
        self.firsts = values[first].astype(np.uint16)
        self.before = np.flatnonzero(first)  # the values in the runs before

    @staticmethod
    def size(values: np.ndarray, runs: int) -> int:
        return 4 * runs

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.firsts[run]) + k - int(self.before[run])


KINDS = (ArrayContainer, RunContainer, BitmapContainer)  # of equal sizes the first is taken


def container(values: np.ndarray):
    """The smallest container of sorted values below 65,536."""
    runs = 1 + int(np.count_nonzero(np.diff(values) != 1))
    return min(KINDS, key=lambda kind: kind.size(values, runs))(values)


class Boundaries:
    """A set of offsets, added in ascending order, with ``select``."""

    def __init__(self, pieces: Iterable[np.ndarray] = ()):
        self.keys: list[int] = []
        self.containers: list = []
        self.upto: list[int] = []  # cumulative cardinalities
        self._key, self._open = None, []
        for piece in pieces:
            self._add(piece)
        self._close()
        self._searched = np.array(self.upto, np.int64)

    def _add(self, offsets: np.ndarray) -> None:
        if not len(offsets):
            return
        high = offsets >> LOW_BITS
        starts = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1])))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(offsets)]):
            if int(high[a]) != self._key:
                self._close()
                self._key = int(high[a])
            self._open.append(offsets[a:b] & ((1 << LOW_BITS) - 1))

    def _close(self) -> None:
        if self._open:
            values = np.concatenate(self._open)
            self.keys.append(self._key)
            self.containers.append(container(values))
            self.upto.append(len(self) + len(values))
            self._open = []

    def __len__(self) -> int:
        return self.upto[-1] if self.upto else 0

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 1; of 0 it is 0, the start of the text."""
        if not 0 <= k <= len(self):
            raise IndexError(k)
        if k == 0:
            return 0
        at = int(np.searchsorted(self._searched, k - 1, side="right"))
        local = k - 1 - (self.upto[at - 1] if at else 0)
        return (self.keys[at] << LOW_BITS) + self.containers[at].select(local)


def line_ends(text: str) -> Iterator[np.ndarray]:
    """The offsets, in code points, at which the lines of a text end, a block at a time."""
    data = np.frombuffer(text.encode(), np.uint8)
    ascii_only, before = text.isascii(), 0
    for at in range(0, len(data), BLOCK_BYTES):
        block = data[at : at + BLOCK_BYTES]
        ends = np.flatnonzero(block == LINE_END).astype(np.int64) + 1
        if ascii_only:
            yield ends + at
        else:
            points = np.cumsum((block & 0xC0) != 0x80)  # bytes that begin a code point
            yield points[ends - 1] + before
            before += int(points[-1])
    if text and not text.endswith("\n"):
        yield np.array([len(text)], np.int64)


# --- the transformation ----------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Sentinels, the seed of all draws, and the percentages of texts cut, and of those in suffix-first order."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: int = 7
    cut_percent: int = 100
    spm_percent: int = 50


def draws(id_col: Column, settings: Settings) -> list[Column]:
    """Four numbers below 2^32 that depend on seed and id only; a null id counts as an empty one."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    digest = F.sha2(F.encode(name, "UTF-8"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def transform(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n`` (lines), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars``, ``output`` of each row.

    The prefix ends after the smaller of two drawn numbers of lines (0 to n), the middle after the
    larger. Empty and null texts, and texts that hold a sentinel, are plain: the output is the text
    and both lengths are null. Whole texts of any length are cut; a cut never falls inside a line.
    Repeated rows give equal rows, rows without an id all the same draws; other columns are ignored
    and may have any names; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    marks = (settings.prefix, settings.suffix, settings.middle)

    def cut(text: str, h1: int, h2: int, h3: int, h4: int) -> tuple:
        bounds = Boundaries(line_ends(text))
        n = len(bounds)
        if not text or any(m in text for m in marks) or h3 % 100 >= settings.cut_percent:
            return n, "plain", None, None, text
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = bounds.select(low), bounds.select(high)
        p, s, m = marks
        if h4 % 100 < settings.spm_percent:
            return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
        return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"

    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [None, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            ids, texts, *numbers = batch.columns
            numbers = [c.to_pylist() for c in numbers]
            at, size, rows = 0, 0, []
            for k in range(batch.num_rows):
                rows.append(cut(texts[k].as_py() or "", *(c[k] for c in numbers)))
                size += len(rows[-1][-1])
                if size >= OUT_BYTES or k + 1 == batch.num_rows:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows), kinds[1:])]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(rows)), *columns], names)
                    at, size, rows = k + 1, 0, []

    drawn = [h.alias(f"h{k}") for k, h in enumerate(draws(F.col(id_col), settings))]
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *drawn)
    return in_arrow(slim, run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, settings: Settings = Settings()) -> Column:
    """The text that ``transform`` made an output from, by the sentinels alone.

    A text in psm or spm form holds no sentinel, and cutting one cannot make any, so the first of
    each that is found is the one that was put there.
    """
    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(len(first) + 1))
        one = F.substring_index(rest, second, 1)
        rest = F.substr(rest, F.char_length(one) + len(second) + 1)
        two = F.substring_index(rest, settings.middle, 1)
        return one, two, F.substr(rest, F.char_length(two) + len(settings.middle) + 1)

    prefix, suffix, middle = between(settings.prefix, settings.suffix)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = between(settings.suffix, settings.prefix)
    spm = F.concat(prefix, middle, suffix)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)

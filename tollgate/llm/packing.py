"""Best-fit packing of tokenised documents into sequences of bounded length, by large-item matching.

Lengths are whole numbers up to the capacity, so the number of pieces of each length says all that
packing needs: at most ``capacity`` counts, whatever the size of the corpus. The driver works out
from them where the k-th piece of a length goes, many equal sequences in one step. The pieces
themselves are numbered within their length on the executors and look up their place.

Pieces of over a third of the capacity are matched first: from the longest down, each with the
longest other large piece that still fits, so a sequence holds at most two. Shorter pieces follow,
longest first, each into the sequence with the smallest gap that takes it.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left, insort
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import held, in_arrow, ranked

CAPACITY = 2048
SALTS = 4096
TEXTS = 256  # texts tokenised in one step

# Fixed value: how byte-level BPE vocabularies divide text before merging.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


# --- tokens ----------------------------------------------------------------------------------


def byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    """Ids of a tokenizers file of byte-level BPE, worked out by the faster tiktoken from the same vocabulary.

    Both merge the pair of least rank first; here a pair's rank is the id of what it makes, which
    must rise with the file's list of merges (this is checked). Special tokens in a text get their
    ids, as tokenizers does by default. A text that tiktoken refuses goes to tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        special = {t["content"]: t["id"] for t in setup["added_tokens"]}
        vocabulary = {token: id for token, id in setup["model"]["vocab"].items() if token not in special}
        made = [vocabulary["".join(pair if isinstance(pair, list) else pair.split(" "))] for pair in setup["model"]["merges"]]
        odd = [t for t in setup["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if setup["normalizer"] or setup["pre_tokenizer"] != byte_level or made != sorted(made) or odd:
            raise ValueError("not a plain byte-level tokenizer")
        bytes_of = {character: byte for byte, character in byte_characters().items()}
        ranks = {bytes(bytes_of[c] for c in token): id for token, id in vocabulary.items()}
        self.fast = tiktoken.Encoding("file", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        try:
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        except BaseException as problem:  # its regular expressions give up on extreme texts
            if isinstance(problem, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    @cached_property
    def tokenizer(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``piece`` (from 0), ``start``, ``length``, ``ids`` (binary, 4 bytes an id): each text's ids and ``end_id`` after them.

    Only what is longer than ``capacity`` is cut, into pieces of ``capacity``, of which the first
    may be shorter. ``tokenizer`` is the path of a byte-level BPE file, the same on all executors.
    A null or empty text is the ``end_id`` alone. Repeated rows and null doc_ids are kept; other
    columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.slice(at, TEXTS)
                rows = []
                for k, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.ids(text) + end
                    total = len(ids) // 4
                    first = total if total <= capacity else total % capacity or capacity
                    bounds = [0, *range(first, total + 1, capacity)]
                    rows += [(k, n, a, b - a, ids[4 * a : 4 * b]) for n, (a, b) in enumerate(zip(bounds, bounds[1:]))]
                own, number, start, length, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(own)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"],
                )

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(slim, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


# --- the plan --------------------------------------------------------------------------------


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where pieces go, from the number of pieces of each length: rows (length, first rank, number, first sequence, offset).

    The pieces of the length that have the ranks first .. first + number - 1 go to as many
    sequences in a row, at the offset.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    if any(not 0 < length <= capacity for length in left):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    used = dict.fromkeys(left, 0)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: list[int] = []  # in order; spans[gap]: (first sequence, number)
    spans: dict[int, list[tuple[int, int]]] = {}
    opened = 0

    def put(length: int, number: int, sequence: int, offset: int) -> None:
        out.append((length, used[length], number, sequence, offset))
        used[length] += number
        left[length] -= number

    def keep(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in spans:
                insort(gaps, gap)
                spans[gap] = []
            spans[gap].append((sequence, number))

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        at = bisect_left(large, min(length, capacity - length) + 1) - 1
        while left[length]:
            while at >= 0 and (not left[large[at]] or large[at] == length and left[length] < 2):
                at -= 1
            if at < 0:
                number, gap = left[length], capacity - length
                put(length, number, opened, 0)
            elif (other := large[at]) == length:
                number, gap = left[length] // 2, capacity - 2 * length
                put(length, number, opened, 0)
                put(length, number, opened, length)
            else:
                number, gap = min(left[length], left[other]), capacity - length - other
                put(length, number, opened, 0)
                put(other, number, opened, length)
            keep(gap, opened, number)
            opened += number

    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                number = left[length] // each
                for k in range(each if number else 0):
                    put(length, number, opened, k * length)
                keep(capacity - each * length, opened, number)
                opened += number
                if rest := left[length]:
                    for k in range(rest):
                        put(length, 1, opened, k * length)
                    keep(capacity - rest * length, opened, 1)
                    opened += 1
                break
            gap = gaps[at]
            first, number = spans[gap].pop()
            if not spans[gap]:
                del spans[gap], gaps[at]
            taken = min(number, left[length])
            put(length, taken, first, capacity - gap)
            keep(gap - length, first, taken)
            keep(gap, first + taken, number - taken)
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (any rows with a whole ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    In a sequence the offsets have no gaps, from 0. Pieces of a length are interchangeable; which
    of them goes where follows a hash of the ``order`` columns, then these. ``pieces`` is read
    twice: give a stored table. An empty table gives no rows; a length that is null or out of range
    is an error.
    """
    rows = pieces.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
    counts = rows.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n"))
    lengths = {row.length: row.n for row in counts.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 2).collect()}
    if None in lengths:
        raise ValueError("a length is null")
    where = pieces.sparkSession.sparkContext.broadcast(plan(lengths, capacity))
    schema = rows.drop("_salt").schema.add("sequence_id", "long").add("offset", "long")
    numbered = ranked(rows, "length", ["_salt"], [*order], counts, "_rank").select(*pieces.columns, "_rank")

    def run(batches):
        steps = where.value
        span = int(steps[:, 1].max()) + 1 if len(steps) else 1
        span = max(span, 1)
        heads = steps[:, 0] * span + steps[:, 1]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "_rank"))
            rank = rank - 1
            at = np.searchsorted(heads, length * span + np.minimum(rank, span - 1), side="right") - 1
            own = steps[at]
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])], schema.names)

    return in_arrow(numbered, run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``length``, ``ids``: the packed pieces' ids put together; no more than the capacity in each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda all, part: F.concat(all, part.ids))
    total = F.aggregate("parts", F.lit(0).cast("bigint"), lambda all, part: all + part.length)
    return rows.select("sequence_id", total.alias("length"), joined.alias("ids"))


def packed_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """The digest of packing ``docs``: where each piece goes and the CRC-32 of its ids, without the ids."""
    coded = pieces(docs, tokenizer, capacity)
    return pack(held(coded.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))), capacity)

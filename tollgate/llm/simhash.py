"""SimHash near-duplicates by Golay-code fuzzy hashing.

A text's fingerprint has a bit set if it is set in over half the XXH64 values of the text's word
shingles. Two fingerprints of 64 bits that differ in at most two are linked.

Finding the links: a fingerprint is cut into three segments of 22, 21 and 21 bits, each a word of
the binary Golay code of length 23 (zeros in front). The code is perfect: every word of 23 bits is
within three bits of exactly one codeword. A segment's keys are the codewords of the segment and of
its 23 neighbours at one bit, one or six different codewords. Two segments that differ in at most
two bits have a common neighbour (or are neighbours, or equal) and so share a key. Two flipped bits
leave one of three segments untouched, and no segment has more than two errors. So linked
fingerprints agree in (an untouched segment, a key of the segment after it) for one of three
choices: 3 to 18 keys for each fingerprint, of up to 34 bits.

Verification does not compare pairs, as near copies may fill one key: each fingerprint that shares
a key gives out the 65 words within one bit of it. Two fingerprints are within two bits if and only
if they give out a common word, and at most 65 fingerprints can give out the same word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import free_prefix, held, in_arrow
from tollgate.llm.components import components

SEED = 42
BITS = 64
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift and width of each
GENERATOR = 0b110001110101  # of the Golay code: x^11+x^10+x^6+x^5+x^4+x^2+1
BLOCK_BYTES = 1 << 20


# --- fingerprints ----------------------------------------------------------------------------


def _word_blocks(text: bytes, carry: int) -> Iterator[list[bytes]]:
    """The words of a text, some at a time; each block but the first begins with the last ``carry`` words before it."""
    kept: list[bytes] = []
    at = 0
    while at < len(text):
        end = at + BLOCK_BYTES
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        kept += text[at:end].lower().split()  # bytes know only ASCII: A-Z, and the six blanks
        yield kept
        kept = kept[-carry:] if carry else []
        at = end


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """XXH64 of each run of ``size`` words joined by one space."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    ends = (starts + lengths)[size - 1 :].tolist()
    starts = starts[: len(ends)].tolist()
    pieces = map(joined.__getitem__, map(slice, starts, ends))
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(SEED)), np.uint64, len(ends))


def fingerprint(text: bytes | None, size: int) -> int:
    """The signed 64-bit fingerprint of one text."""
    ones, total, seen = np.zeros(BITS, np.int64), 0, 0
    block: list[bytes] = []
    for block in _word_blocks(text or b"", size - 1):
        hashes = shingle_hashes(block, size)
        total += len(hashes)
        seen = max(seen, len(block))
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    if not total and seen:  # fewer words than a shingle has: the whole sequence
        total = 1
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(block), SEED)], "<u8")
        ones = np.unpackbits(whole.view(np.uint8), bitorder="little").astype(np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``fingerprint`` (bigint) of each row of ``docs``; a text without words, or null, has fingerprint 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            values = (fingerprint(texts[i].as_py(), shingle) for i in range(len(texts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.int64())], ["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return in_arrow(slim, run, f"doc_id {kind}, fingerprint bigint")


# --- Golay keys ------------------------------------------------------------------------------


def _remainders() -> np.ndarray:
    """The remainder, modulo the generator, of each 12-bit word shifted by eleven places."""
    out = np.zeros(1 << 12, np.int64)
    for word in range(1 << 12):
        rest = word << 11
        for bit in range(22, 10, -1):
            if rest >> bit & 1:
                rest ^= GENERATOR << (bit - 11)
        out[word] = rest
    return out


def _errors(remainders: np.ndarray) -> np.ndarray:
    """By syndrome, the one error of at most three bits that has it."""
    out = np.zeros(1 << 11, np.int64)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            error = sum(1 << b for b in bits)
            out[remainders[error >> 11] ^ (error & 0x7FF)] = error
    return out


REMAINDERS = _remainders()
ERRORS = _errors(REMAINDERS)


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[REMAINDERS[words >> 11] ^ (words & 0x7FF)]) >> 11


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices near each 23-bit word, 24 a row in order, and which of them are not repeats."""
    flips = np.concatenate(([0], 1 << np.arange(23)))
    near = np.sort(decode(words[:, None] ^ flips[None, :]), axis=1)
    fresh = np.ones(near.shape, bool)
    fresh[:, 1:] = near[:, 1:] != near[:, :-1]
    return near, fresh


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of the fingerprints, as the fingerprint's position and the key."""
    cut = [(prints.astype(np.uint64) >> np.uint64(s)).astype(np.int64) & ((1 << w) - 1) for s, w in SEGMENTS]
    rows, keys = [], []
    for k, same in enumerate(cut):
        near, fresh = segment_keys(cut[(k + 1) % 3])
        row, _ = np.nonzero(fresh)
        rows.append(row)
        keys.append(k << 34 | same[row] << 12 | near[fresh])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(column), 4096):
                part = column[at : at + 4096]
                rows, keys = golay_keys(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(part[rows], pa.int64())], ["key", "fingerprint"])

    return in_arrow(prints.select("fingerprint"), run, "key bigint, fingerprint bigint")


# --- links and groups ------------------------------------------------------------------------


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``a``, ``b`` between different fingerprints (column ``fingerprint``, each once) that connect all within ``max_bits`` of each other.

    Every two fingerprints within ``max_bits`` are linked, or both are linked to a third that is
    within ``max_bits`` of each. ``max_bits`` is at most 2, for which the keys are complete.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits is 0, 1 or 2")
    if max_bits == 0:
        return prints.select(F.col("fingerprint").alias("a"), F.col("fingerprint").alias("b")).where("false")
    keyed = _keyed(prints)
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    candidates = held(keyed.join(shared, "key", "left_semi").select("fingerprint").distinct())
    flipped = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.col("fingerprint").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i)))
    if max_bits == 1:
        there = candidates.select(F.col("fingerprint").alias("b"))
        near = candidates.select(F.col("fingerprint").alias("a"), F.explode(flipped).alias("b"))
        return near.join(there, "b").select("a", "b").where("a > b")
    around = candidates.select("fingerprint", F.explode(F.concat(F.array("fingerprint"), flipped)).alias("word"))
    met = around.groupBy("word").agg(F.collect_list("fingerprint").alias("all")).where("size(all) > 1")  # at most 65
    met = met.select(F.array_min("all").alias("b"), F.explode("all").alias("a"))
    return met.where("a <> b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """``doc_id``, ``fingerprint``, ``component_id``: the smallest doc_id that links of at most ``max_bits`` bits lead to.

    One row for each row of ``docs`` (columns doc_id, text; others are ignored). Equal fingerprints
    are always linked; they are first reduced to one, so copies cost nothing further. Texts without
    words and null texts have fingerprint 0 and are linked like others. Rows with a null doc_id are
    kept and never give a component its id (unless it has no other); repeated rows are repeated in
    the result; an empty table gives no rows. Whole texts are hashed, one block of words at a time.
    """
    prints = held(fingerprints(docs, shingle))
    firsts = held(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    roots = components(links(firsts.select("fingerprint"), max_bits)).withColumnRenamed("node", "fingerprint")
    rooted = firsts.join(roots, "fingerprint", "left").select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return (
        prints.join(rooted.join(least, "root").select("fingerprint", "component_id"), "fingerprint")
        .select("doc_id", "fingerprint", "component_id")
    )


def one_of_each(docs: DataFrame, shingle: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` without all but one of each group of near-duplicates.

    The row with the smallest doc_id stays, rows without one come last, and of rows that share a
    doc_id the one with the least hash of its text; of rows that are the same in both any one.
    Rows that share a doc_id and are not near-duplicates all stay.
    """
    at = free_prefix(docs)
    # None of the key's columns is null, so that one shuffle serves the join and what follows it.
    blank = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = {"unnamed": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", blank), "hash": F.xxhash64("text")}
    named = docs.select(F.struct(*[c.alias(name) for name, c in key.items()]).alias("doc_id"), "text")
    first = near_duplicates(named, shingle, max_bits).where("doc_id = component_id")
    kept = first.select(*[F.col(f"doc_id.{name}").alias(f"{at}{name}") for name in key]).distinct()
    keys = [f"{at}{name}" for name in key]
    keyed = docs.withColumns(dict(zip(keys, key.values())))
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).drop(*keys)

"""Language identification by cross-parsing.

For each language a suffix automaton is built over a bounded sample of labelled text. A document is
parsed against each automaton into phrases, each the longest piece of the rest of the document that
occurs in the sample. The fewer phrases, the closer the language: n phrases of a text of length m
estimate the cross entropy as n * log2(sample + 256) / m, as each phrase is one of the sample's places
or, where not even its first byte is in the sample, one of 256 bytes. So a short sample, against which
phrases are short too, gets nothing for pointing into little. The language with the smallest estimate wins.

Texts are compared as lower-case letters, with one space for anything between, in UTF-8. Parsing
is done in steps for many pieces of text at once: the automata are tables from state and byte to
the next state. A phrase also ends every ``PIECE`` bytes, alike for all languages.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tollgate.llm.common import held, in_arrow, is_letter_free

SAMPLE_TEXTS = 96  # about so many texts of a language
TEXT_CHARS = 1000  # of each
SAMPLE_BYTES = 32_000  # of a language
TABLE_BYTES = 256_000_000  # of all automata together; more languages get smaller samples
PIECE = 512
BLOCK_BYTES = 4 << 20
UNKNOWN = "und"
ENOUGH = 20  # labelled texts to learn from how near a language's texts are
FAR = 8  # times the spread; texts in two languages of the test tables are at up to 4.3, gibberish and Greek at 14 and more


def letters(text: Column) -> Column:
    """What is parsed: lower-case letters and marks, with a space for each run of other characters."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")


# --- training --------------------------------------------------------------------------------


def transitions(sample: bytes) -> list[dict[int, int]]:
    """The suffix automaton of ``sample``: for each state, from byte to state. State 0 is the empty string's."""
    goes: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for byte in sample:
        new = len(goes)
        goes.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and byte not in goes[state]:
            goes[state][byte] = new
            state = link[state]
        if state >= 0:
            target = goes[state][byte]
            if longest[target] == longest[state] + 1:
                link[new] = target
            else:
                copy = len(goes)
                goes.append(dict(goes[target]))
                longest.append(longest[state] + 1)
                link.append(link[target])
                while state >= 0 and goes[state].get(byte) == target:
                    goes[state][byte] = copy
                    state = link[state]
                link[target] = link[new] = copy
        last = new
    return goes


@dataclass(frozen=True)
class Model:
    """The automata as one table of 32-bit steps.

    ``symbols`` maps bytes to columns (0: in no sample). A step is the place of the next state's
    row; the top bit is set if a phrase begins with this byte, and the row is then the one that the
    byte leads to from the start. Each automaton's last row, at ``roots``, is where a text begins
    and where a byte leads that is not in the sample: the next byte always begins a phrase.
    """

    languages: tuple[str, ...]
    symbols: np.ndarray
    table: np.ndarray
    roots: np.ndarray
    bits: np.ndarray  # of a phrase: log2 of each sample's length and the 256 bytes


ENDS = np.uint32(1 << 31)


def build(samples: dict[str, bytes]) -> Model:
    """A model of languages from their sample texts (as ``letters`` gives them, in UTF-8)."""
    languages = tuple(sorted(samples))
    alphabet = sorted(set().union(*samples.values())) if samples else []
    symbols = np.zeros(256, np.uint8)
    width = len(alphabet) + 1
    if width > 256:
        raise ValueError("more than 255 bytes in use")
    symbols[alphabet] = np.arange(1, width)
    tables, roots, start = [], [], 0
    for language in languages:
        goes = transitions(samples[language])
        rows = np.full((len(goes) + 1, width), -1, np.int64)
        for state, edges in enumerate(goes):
            for byte, target in edges.items():
                rows[state, symbols[byte]] = start + target * width
        nowhere = start + len(goes) * width
        first = np.where(rows[0] < 0, nowhere, rows[0])
        steps = np.where(rows < 0, first | int(ENDS), rows).astype(np.uint32)
        tables.append(steps.ravel())
        roots.append(nowhere)
        start += steps.size
    sizes = np.array([256 + len(samples[x]) for x in languages], float)
    return Model(languages, symbols, np.concatenate(tables) if tables else np.zeros(0, np.uint32), np.array(roots, np.uint32), np.log2(sizes))


def sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``lang``, ``part``: a bounded sample of the labelled texts, the same in every run.

    About ``texts`` different texts of each language, those whose XXH64 is smallest, and the
    first ``TEXT_CHARS`` characters of each; null labels and texts without letters are left out.
    The share to take comes from the number of different texts, so copies don't crowd it.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.where("lang IS NOT NULL").where(~is_letter_free(F.col("text")))
    rows = rows.withColumn("draw", F.pmod(F.xxhash64("text"), F.lit(1 << 40)))
    kinds = rows.groupBy("lang").agg(F.approx_count_distinct("draw").alias("kinds")).collect()  # one row a language
    if not kinds:
        return rows.select("lang", F.lit(1).alias("place"), F.col("text").alias("part")).where("false")
    limit = F.create_map(*[F.lit(x) for row in kinds for x in (row.lang, int(min(1.0, 2 * texts / max(row.kinds, 1)) * (1 << 40)))])
    few = rows.where(F.col("draw") <= F.element_at(limit, F.col("lang")))
    few = few.groupBy("lang", "draw").agg(F.min(F.substring("text", 1, TEXT_CHARS)).alias("text"))
    few = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw"))).where(F.col("place") <= texts)
    return few.select("lang", "place", letters(F.col("text")).alias("part"))


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from ``labelled`` texts. What reaches the driver is the bounded sample."""
    parts: dict[str, list[str]] = {}
    for row in sample(labelled, text_col, lang_col).orderBy("lang", "place").toLocalIterator():
        parts.setdefault(row.lang, []).append(row.part)
    # A table row for each state, up to two for each byte of the sample, of at most 256 steps.
    size = min(SAMPLE_BYTES, TABLE_BYTES // (2 * 4 * 80 * max(1, len(parts))))
    joined = {lang: " ".join(found).encode()[:size] for lang, found in parts.items()}
    return build(joined)


# --- parsing ---------------------------------------------------------------------------------


def phrases(model: Model, text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The number of phrases of each text (bytes ``offsets[k]`` to ``offsets[k + 1]``) by language."""
    lengths = np.diff(offsets)
    pieces = (lengths + PIECE - 1) // PIECE
    owner = np.repeat(np.arange(len(lengths)), pieces)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[owner] + within * PIECE
    sizes = np.minimum(PIECE, offsets[owner + 1] - starts)
    order = np.argsort(-sizes, kind="stable")
    owner, starts, sizes = owner[order], starts[order], sizes[order]
    symbols = model.symbols[text]
    active = np.searchsorted(-sizes, -np.arange(PIECE), side="left")  # pieces longer than the step
    out = np.zeros((len(lengths), len(model.languages)), np.int64)
    for k, root in enumerate(model.roots):
        state = np.full(len(owner), root, np.uint32)
        count = np.zeros(len(owner), np.int32)
        for step in range(int(sizes[0]) if len(sizes) else 0):
            n = active[step]
            seen = model.table[state[:n] + symbols[starts[:n] + step]]
            count[:n] += seen >> np.uint32(31)
            state[:n] = seen & ~ENDS
        np.add.at(out[:, k], owner, count)
    return out


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``entropy``, ``size`` and the ``keep`` columns of each row of ``docs``.

    ``score`` is how far the best language is ahead: one less its estimate over the second's, 0 for
    a tie (the first language in order wins) and 1 if there is no other. A null text, a text
    without letters, or any text if the model has no language, is ``und`` with score 0. ``entropy`` is
    the best language's estimate in bits a byte, null for ``und``, ``size`` the bytes parsed. Of a text
    of any length all is parsed; memory is bounded by an Arrow batch. Repeated rows and null
    doc_ids are kept; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            data = batch.column(1)
            offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
            text = np.frombuffer(data.buffers()[2] or b"", np.uint8)
            found = np.zeros((len(data), len(model.languages)), np.int64)
            at = 0
            while at < len(data):
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1)
                found[at:end] = phrases(model, text[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
                at = end
            languages, scores = decide(model, found)
            none = ~batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            languages = np.where(none, UNKNOWN, languages)
            scores = np.where(none, 0.0, scores)
            least = (found * model.bits).min(1, initial=np.inf) / np.maximum(np.diff(offsets), 1)
            entropy = pa.array(least, mask=none | (languages == UNKNOWN))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(languages.tolist(), pa.string()), pa.array(scores), entropy, pa.array(np.diff(offsets)), *[batch.column(k) for k in range(3, batch.num_columns)]], ["doc_id", "lang_pred", "score", "entropy", "size", *keep])

    slim = docs.select(F.col(id_col).alias("doc_id"), letters(F.col(text_col)).cast("binary").alias("_letters"), (~is_letter_free(F.col(text_col))).alias("_any"), *keep)
    schema = T.StructType().add("doc_id", kind).add("lang_pred", "string").add("score", "double").add("entropy", "double").add("size", "long")
    for c in keep:
        schema = schema.add(c, docs.schema[c].dataType)
    return in_arrow(slim, run, schema)


def decide(model: Model, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language with the fewest normalised phrases, and how far it is ahead."""
    if not model.languages:
        return np.full(len(found), UNKNOWN), np.zeros(len(found))
    cost = found * model.bits
    best = cost.argmin(1)
    if len(model.languages) == 1:
        return np.array(model.languages)[best], np.ones(len(found))
    two = np.partition(cost, 1, axis=1)[:, :2]
    return np.array(model.languages, dtype=object)[best], 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)


@dataclass(frozen=True)
class Limits:
    """By language the middle entropy and the lead that three quarters have, and the spread of all: as it is, and times the root of the text's bytes."""

    middle: dict[str, float]
    lead: dict[str, float]
    spread: float
    short: float

    def _of(self, values: dict[str, float], language: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), language) if values else F.lit(None).cast("double")

    def near(self, language: Column, entropy: Column, size: Column) -> Column:
        """Whether a text is not much farther from the language than its texts are; true if that can't be told."""
        bound = self._of(self.middle, language) + FAR * F.greatest(F.lit(self.spread), F.lit(self.short) / F.sqrt(size))
        return F.coalesce(entropy <= bound, F.lit(True))

    def sure(self, language: Column, score: Column) -> Column:
        """Whether the language is as far ahead as for three quarters of its texts."""
        return F.coalesce(score >= self._of(self.lead, language), F.lit(False))


def limits(labelled: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> Limits:
    """What is usual for ``labelled`` texts that ``model`` has not seen and gives their label.

    The spread is the 99th percentile of what the entropies are above their language's median; short
    texts spread more. A language with fewer than ``ENOUGH`` texts has the median of all, if these are enough.
    """
    texts = labelled.where(F.col(lang_col).isNotNull()).select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    found = held(classify(texts, model, keep=("lang",)).where("lang = lang_pred AND entropy IS NOT NULL").select("lang", "entropy", "score", "size"))
    half = [F.percentile_approx(c, q, 1000).alias(c) for c, q in (("entropy", 0.5), ("score", 0.25))]
    whole = found.agg(F.count(F.lit(1)).alias("n"), *half).first()
    if whole.n < ENOUGH:
        return Limits({}, {}, 0.0, 0.0)
    rows = [r for r in found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *half).collect()]  # one row a language
    middle = {x: whole.entropy for x in model.languages} | {r.lang: r.entropy for r in rows if r.n >= ENOUGH}
    above = F.col("entropy") - F.element_at(F.create_map(*[F.lit(x) for pair in middle.items() for x in pair]), F.col("lang"))
    high = found.agg(F.percentile_approx(above, 0.99, 1000).alias("spread"), F.percentile_approx(above * F.sqrt("size"), 0.99, 1000).alias("short")).first()
    return Limits(middle, {r.lang: r.score for r in rows if r.n >= ENOUGH}, high.spread, high.short)


def held_out(id_col: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    """Whether a row is left out of training: CRC-32 of its id's digits, modulo ``folds``, is ``fold``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))

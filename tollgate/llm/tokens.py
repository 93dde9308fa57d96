"""Token counts of whole texts: batch encoding in Arrow functions that return lengths only.

Texts are gathered into batches of about equal bytes. A long text is first cut where its tokens
cannot reach across: at a space after a character that is neither a space nor the tokenizer's
space mark. The vocabulary has no piece in which the mark follows another character (this is
checked; with such a vocabulary nothing is cut), and the part after the cut gets the mark back as
the prefix that the tokenizer puts before every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tollgate.llm.common import in_arrow

MARK = "▁"
PART_CHARS = 32_768
BATCH_CHARS = 262_144


def parts(text: str, longest: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``longest`` characters, whose tokens add up to the text's."""
    start = 0
    while len(text) - start > longest:
        cut = text.find(" ", start + longest)
        while cut >= 0 and text[cut - 1] in (" ", MARK):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 == len(text):
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:] if start else text


class Counter:
    """Counts tokens with a sentencepiece model or a tokenizers file, as the path's ending says."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            processor = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = map(processor.id_to_piece, range(processor.get_piece_size()))
            self.cuts = not any(MARK in piece.lstrip(MARK) for piece in pieces) and len(processor.encode("a   a")) > len(processor.encode("a a"))
            self.encode = lambda texts: map(len, processor.encode(texts, num_threads=1))
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.cuts = False
            self.encode = lambda texts: (len(e.ids) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False))

    def counts(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        batch: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            for owner, n in zip(owners, self.encode(batch)):
                out[owner] += n
            batch.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for part in (parts(text) if self.cuts else [text]) if text else []:
                batch.append(part)
                owners.append(k)
                size += len(part)
                if size >= BATCH_CHARS:
                    flush()
                    size = 0
        flush()
        return out


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` of each row of ``docs``.

    Null and empty texts have 0 of both. Whole texts count, without begin, end or added special
    tokens, truncation or padding. Repeated rows and null doc_ids are kept, other columns ignored;
    an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        counter = Counter(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                counts = counter.counts(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = in_arrow(slim, run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

"""From raw documents to packed training sequences: filter, identify, de-duplicate, mix, pack."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tollgate.llm import langid, mixing, packing, quality, simhash
from tollgate.llm.common import is_letter_free
from tollgate.llm.queries import PACKING_TOKENIZER
from tollgate.session import remove_folder, shared_folder


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass all rules.

    Null and empty texts have too few words and go; very long ones are measured whole. Repeated rows
    and rows without an id are judged like others, each by its own text. All columns are kept, whatever
    their names; an empty table stays empty.
    """
    ledger = quality.ledger(docs.select("text", F.struct("*").alias("doc")))
    return ledger.where(quality.passes(quality.STRICT)).select("doc.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose text is in a language that the labels name; a missing label is filled in.

    A document is rejected if no language can be told: it has no text or no letters, or its entropy
    is far above that of labelled texts of the nearest language, learned from a third of them that
    another model has not seen. A label that differs from a sure prediction gives way to it. If
    nothing is labelled, all texts with letters stay as they are.
    """
    model = langid.train(docs)
    if not model.languages:
        return docs.where(~is_letter_free(F.col("text")))
    apart = langid.held_out("text")  # copies together
    limits = langid.limits(docs.where(apart), langid.train(docs.where(~apart)))
    found = langid.classify(docs.select("doc_id", "text", F.struct("*").alias("doc")), model, keep=("doc",))
    found = found.where(F.col("lang_pred") != langid.UNKNOWN).where(limits.near(F.col("lang_pred"), F.col("entropy"), F.col("size")))
    lang = F.when(limits.sure(F.col("lang_pred"), F.col("score")), F.col("lang_pred")).otherwise(F.coalesce("doc.lang", "lang_pred")).alias("lang")
    return found.select(*[lang if c == "lang" else F.col("doc")[c].alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id, rows without one last.

    Rows that share a doc_id but not their text are different documents; of rows that are the same in
    both one stays. Null texts and texts without words are near-duplicates of each other. All columns
    are kept, whatever their names; an empty table stays empty.
    """
    return simhash.one_of_each(docs, shingle=3, max_bits=2)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in rows of their own.

    Sizes are whole texts' words; documents without words take no part of the mix and stay or go like
    others of their source. A null source is a source. Ties are ordered by a hash of the id, so reruns
    agree. All columns are kept, whatever their names; an empty table stays empty.
    """
    return mixing.emitted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix and their places in training sequences.

    Each row is a document of its own, repeated ones too, with or without an id; null and empty texts
    are the end token alone. Only documents longer than a sequence are cut. An empty table gives no rows.
    """
    return packing.packed_documents(docs, PACKING_TOKENIZER)


STAGES = [
    ("quality rules", quality_rules),
    ("language ID", language_id),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, tokens and cross-parsing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed sequences made from ``documents``.

    What each stage but the last returns is stored in the shared folder, until the stage after it is
    stored; the last of these tables stays, as the result is read from it.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
        remove_folder(spark, f"{folder}/{number - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)

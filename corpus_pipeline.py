"""The corpus pipeline: language ID, near-dedup, PII, mixing and BPE, each stage over all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import bpe, langid, mixing, neardup, pii
from corpuscope.llm.shared import drop_stored, stored, stored_count


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`lang` becomes the predicted language, also where it was null; documents without a language go.

    Those are null texts and texts without a letter. The model learns from the training fold's labels. Null and repeated ids
    are kept, and so are columns named like a prediction.
    """
    free = lambda name: name if name not in docs.columns else free(f"{name}_")
    lang, score = free("lang_pred"), free("score")
    model = langid.train(docs.where(langid.in_training(F.col("doc_id"))))
    found = langid.identify(docs, model, lang_out=lang, score_out=score).where(F.col(lang) != langid.UND)
    return found.withColumn("lang", F.col(lang)).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (shingles of five words, similarity 0.8 or more) one document stays.

    Rows that repeat an id with another text are judged by their text; rows without an id all stay.
    """
    return neardup.deduplicated(docs, shingle=5, percent=80)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in the texts, and n_chars follows; null texts stay null."""
    return pii.mask_pii(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language, source and ids of the texts, and proof that they decode to the same bytes; null text counts as empty."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, keep=("doc_id", "lang", "source"), outputs=("n_tokens", "ids", "ids_sha256", "decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("near_dedup", near_dedup_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: String kernels, LSH and the tokenizer can't be expressed in SQL; a test compares run() with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again; what earlier stages stored is deleted then.

    An empty table gives an empty result.
    """
    docs, began = spark.read.parquet(f"{sf_dir}/documents.parquet"), stored_count()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_stored(spark, began, but=docs)
    return STAGES[-1][1](spark, docs, sf_dir)

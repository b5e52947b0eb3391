"""The corpus pipeline: documents are filtered by language, deduplicated, masked, mixed and encoded.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the
last return the columns of ``documents``.  Stages are joined by Parquet tables,
so a lost executor costs work of one stage only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, langid, mixing, pii, simhash
from larkspur.llm.common import Scratch, gathered, read_table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no text, or no letter in it) go."""
    return langid.identify(docs).where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates the document with the smallest id stays.

    Rows that share an id are compared by their texts, so none is lost that is
    linked to nothing that stays; a group without any id keeps one row.
    """
    return simhash.unique_documents(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in every text is replaced by a mask of its kind; ``n_chars`` follows the text."""
    masked = pii.mask_pii(pii.find_pii(docs, Scratch(spark, "pipeline-pii")))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by the chances that bring the domains to their target weights; from 0.8 on they stay, and the others make up for it."""
    rated = mixing.mixing_rates(docs, read_table(spark, sf_dir, "labels"), scratch=Scratch(spark, "pipeline-mix"), sure=0.8)
    return mixing.sampled(rated).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the text they decode to."""
    done = bpe.bpe_decode(bpe.bpe_encode(docs))
    return done.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("encode", encode),
]

#: No SQL: suffix automata, XXH64 and BPE have none; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of ``sf_dir``.

    A stage's own tables go when its result is written, and its input with
    them, so the shared folder holds little more than one copy of the documents.
    """
    scratch = Scratch(spark, "pipeline")
    docs, before = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with gathered() as used:
            docs = scratch.keep(stage(spark, docs, sf_dir))
        for s in used:
            s.remove()
        if before is not None:
            scratch.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

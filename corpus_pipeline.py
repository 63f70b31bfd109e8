"""A corpus pipeline of five stages over `documents`, each an operator of sparkloom.llm.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns the columns of `documents`, but for
the last, which returns the packing. Stages handle nulls, ties, repeated rows and empty tables as their operators do; extra columns go.

1. Language ID: documents without a letter, or of no language that the model knows well enough (score below MIN_SCORE), go. A missing
   lang is filled in.
2. N-gram Jaccard join: of each component the document with the smallest id stays, once; rows that share an id but not the text are
   documents of their own. Rows without an id take part and stay only if no document of their component has one.
3. PII: spans become <EMAIL>, <IP>, <CARD> and <PHONE>; n_chars follows.
4. Mixing: every document is used at most once, by its rate; rates of 0.8 and more always stay.
5. Packing: token pieces and their places in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import jaccard_join, language_id, mixing, packing, pii
from sparkloom.llm._common import stored, table
from sparkloom.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    found = language_id.identify(docs, language_id.train(docs.where(~language_id.held_out())))
    kept = found.where((F.col("language.lang") != language_id.UND) & (F.col("language.score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "language.lang")).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.without_near_copies(docs.select(COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(pii.find_pii(docs.select(COLUMNS), out="_spans"), spans="_spans")
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed, _ = mixing.mix(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return mixing.sampled(mixed).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packing_report(docs, tokenizer_path())


STAGES = [
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The stages learn models and solve for rates; SQL can't express them. tests/llm/test_pipeline.py holds the result against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

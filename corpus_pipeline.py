"""Corpus preparation: from ``documents`` to packed training sequences.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame. All but the last return the columns of documents and work
on whatever their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveworks.llm import queries
from sieveworks.llm.line_dedup import dedup_lines
from sieveworks.llm.near_dup import keep_one
from sieveworks.llm.pii import pseudonymise
from sieveworks.llm.scratch import materialise
from sieveworks.llm.toxicity import fit, reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably toxic go; the model learns from all labels of the documents at hand."""
    return reject_toxic(docs, fit(docs, queries.table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs are cut; a document that they make up wholly goes. n_chars follows."""
    cut = dedup_lines(docs)
    count = F.when(F.col("lines_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where("lines_removed = 0 or lines_removed < lines_before").withColumn("n_chars", count).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to pseudonyms; n_chars follows the text."""
    out = pseudonymise(docs, queries.PII_KEY)
    count = F.when(F.col("n_pseudonyms") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", count).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences along the curve, with their ids."""
    return queries.packed(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("pii", pii), ("packing", packing)]

#: The classifier and the tokenizer are beyond SQL; tests hold the stages against plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs

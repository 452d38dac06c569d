"""A corpus pipeline: classifier, quality rules, line dedup, near-duplicate documents, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder and
reads them again as the next one's docs.  All stages but the last return the columns of documents.

Null texts count as empty: the rules reject them.  Rows with a null doc_id are judged like others but no line or document is
removed as their copy.  Rows equal in doc_id and text are judged alike in every stage; rows that share only the doc_id are
documents each.  Other columns, whatever their names, are carried along; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import curve_packing, line_dedup, ngram_join, quality_classifier, quality_rules
from tidegraph.llm.common import read, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_accepted(docs, read(spark, sf_dir, "labels"))


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose source is rejected, go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier line go, and documents of which nothing is left."""
    return line_dedup.drop_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays."""
    return ngram_join.keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 4096 tokens."""
    import public_tokenizers

    return curve_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_classifier", classify), ("quality_rules", rules), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("hilbert_packing", packing)]

#: Trained weights and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir), name)
    return docs

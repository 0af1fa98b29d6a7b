"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing.

Each stage is ``(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelworks.llm import neardup, packing, repetition, toxicity
from panelworks.llm.common import materialise
from panelworks.llm.queries import TOXIC, vocabulary_file

#: No SQL says the same: the rules need rolling hashes and the filter a trained model.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the repetition rules; those without text or with few words do not.

    Rows are judged each by itself: repeated and null ids and further columns stay as they are.
    """
    return repetition.keep(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity limit, the model trained on the labelled ones among them.

    Null and empty texts get the score of no features; all columns stay as they are, whatever
    their names.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    to = "toxicity_score_"
    while to in docs.columns:
        to += "_"
    return toxicity.score(docs, model, to=to).where(f"{to} < {TOXIC}").select(docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one of the least doc_id, of each group of near-duplicates.

    Documents without words or without a doc_id are in no group and stay; rows that share a
    doc_id are one document.
    """
    return neardup.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces in sequences of at most 4096 tokens; every row is packed by itself."""
    return packing.pack(docs, vocabulary_file("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("toxicity", clean), ("near-duplicates", distinct), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage{i}")
    return docs

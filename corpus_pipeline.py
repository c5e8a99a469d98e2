"""A corpus from raw documents to packed sequences: five stages of the operators in glossarium.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossarium.llm import classifier, line_dedup, packing, quality_rules, simhash
from glossarium.llm.common import materialise, table
from glossarium.llm.queries import held_out


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and both distances keep."""
    return quality_rules.rate_documents(docs, keep=True).where("kept").select(*docs.columns)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that look like those labelled good; learnt from labelled rows of the raw documents, the held-out third apart."""
    labels = table(spark, sf_dir, "labels").where(~held_out())
    scored = classifier.score_documents(docs, labels, examples=table(spark, sf_dir, "documents"), keep=True)
    return scored.where("predicted = 1").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat earlier ones; n_chars is that of the text left."""
    cut = line_dedup.dedup_lines(docs).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, by shingles of five words and a similarity of about 0.8 or more.

    SimHash fingerprints meet by the generalised pigeonhole; exact shingle sets
    verify them and complete what lies beyond their radius. Null and empty texts
    are near-duplicates of each other; of repeated rows one stays.
    """
    return simhash.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, as pieces in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("best_fit_packing", packing_stage),
]

#: Nearest neighbours in a latent space, SimHash and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each but the last written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs

"""The corpus pipeline: rules, exact and near duplicates, repeated passages, packing.

Each stage works on all that the one before it kept, as written to Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossvec.llm import best_fit_packing, exact_dedup, minhash_dedup, quality_rules, suffix_dedup
from glossvec.llm.common import tables, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their label model keep."""
    return quality_rules.judge(docs).where("kept").select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Texts stay where they lie; only the ids that go are sent."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets that share four fifths."""
    return minhash_dedup.deduplicate(docs, width=5)


#: Bytes of a repeated passage: 51 words of four letters with their blanks, as a passage of over 50 words has. And bytes of a trigger;
#: shorter ones are met more often by chance, longer ones make more phrases.
PASSAGE, TRIGGER = 256, 64


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE bytes or more that are met elsewhere.

    n_chars is counted anew; texts that are all repeats become empty and stay.
    """
    return suffix_dedup.drop_repeats(docs, PASSAGE, TRIGGER).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("exact_dedup", exact),
    ("minhash_near_dedup", near),
    ("suffix_array_dedup", repeats),
    ("best_fit_packing", packing),
]

#: Suffix order and tokenisation have no SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

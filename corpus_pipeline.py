"""A corpus pipeline: quality, exact and near duplicates, benchmark passages, packing.

Every stage works on all rows that its predecessor kept and, but for the last, returns the
columns of ``documents``. SQL cannot express the trained classifier, so there is no oracle;
the stages are tested against plain versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import exact_dedup, packing, quality, simhash, winnow
from paperloom.llm.common import removed, written
from paperloom.llm.tokens import vocabulary

#: A document stays when the classifier gives it at least this probability of label 1.
THRESHOLD = 0.7


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "__loom_score"
    while name in docs.columns:
        name += "_"
    return quality.score(docs, model, name=name).filter(F.col(name) >= THRESHOLD).select(*docs.columns)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keep the row with the largest id."""
    return exact_dedup.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked at a similarity of 0.8 over five-word shingles keep the smallest id."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a whole benchmark window, and those of which one word in twenty lies in shorter items."""
    return winnow.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), any_window=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact_duplicates),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        last, docs = docs, written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        removed(last)  # a stage's table goes when the next one's is written
    return STAGES[-1][1](spark, docs, sf_dir)

"""A corpus from raw documents to packed sequences: quality, near-duplicates, repeats, benchmarks, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. ``sf_dir`` is only used
for the small tables beside the documents: labels and benchmark items.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.llm import decontaminate, jaccard_join, packing, quality, suffix_dedup
from trekframe.storage import materialize


def keep_good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more. It learns from labelled rows of the stage's input."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = "_".join(["score", *docs.columns])  # a name that no column has
    return quality.score_quality(docs, model, score).where(F.col(score) >= 0.5).select(*docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more over five-word n-grams."""
    return jaccard_join.drop_near_duplicates(docs, threshold=0.8, k=5)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that repeat 100 bytes standing earlier in the corpus."""
    return suffix_dedup.drop_repeats(docs, min_bytes=100)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, not even lightly edited."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept texts' tokens in sequences of at most 2,048."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), max_tokens=2048)


STAGES = [
    ("quality", keep_good_documents),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeats", cut_repeats),
    ("benchmark", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: A classifier trained by coordinate descent and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs

"""Five stages from raw documents to a training mixture; each is written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ranksmith.llm import stages
from ranksmith.llm.storage import materialize

#: (name, function); a function takes (spark, docs, sf_dir) and returns the documents that it keeps.
STAGES = [
    ("language_id", stages.language),
    ("simhash_dedup", stages.near_duplicates),
    ("substring_dedup", stages.repeated_passages),
    ("decontamination", stages.contamination),
    ("mixture", stages.mixture),
]

#: The stages train a classifier, walk graphs and hash windows, which SQL cannot express; tests/llm/test_pipeline.py holds
#: their result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), name)
    return docs

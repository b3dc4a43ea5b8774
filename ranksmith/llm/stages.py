"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents that it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranksmith.llm.decontaminate import decontaminate
from ranksmith.llm.language_id import keep_known_languages
from ranksmith.llm.language_id import train as train_languages
from ranksmith.llm.mixture import mix_sources
from ranksmith.llm.near_copies import drop_near_copies
from ranksmith.llm.substring_dedup import remove_repeats


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the texts as they are now."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (4): documents in no known language go."""
    return keep_known_languages(docs, train_languages(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-dedup (5): of documents connected by a five-word Jaccard similarity of at least 0.8, one stays."""
    return drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup (7): words covered by repeated windows go; a document that loses all of its words goes with them."""
    kept = remove_repeats(docs)
    return _recounted(kept.filter("text is null or text <> ''"))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (3): hit spans are cut, and documents that are mostly benchmark text go."""
    return _recounted(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources (9): Poisson replication to tempered source shares, in one global shuffle."""
    return mix_sources(docs)

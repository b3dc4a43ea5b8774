"""Reading corpora and writing results: Parquet, JSON documents and the tables of a sparse index."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ranksmith.operators.ingest import unflatten
from ranksmith.operators.sparse_index import IndexParameters, SparseIndex


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """JSON documents, one on a line, with a declared schema (none is inferred)."""
    return spark.read.schema(schema).json(path)


def bulk_documents(spark: SparkSession, lines: Iterable[str], schema: T.StructType) -> DataFrame:
    """Documents of a bulk request: action lines (``index`` or ``create``) each followed by a source line. Dotted keys nest."""
    rows, action = [], None
    for line in filter(str.strip, lines):
        x = json.loads(line)
        if action is None:
            (kind, meta), *_ = x.items()
            if kind not in ("index", "create"):
                raise ValueError(f"unsupported bulk action {kind!r}")
            action = meta
        else:
            rows.append({"doc_id": action.get("_id"), **unflatten(x)})
            action = None
    return spark.createDataFrame(rows, schema)


def write_result(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).parquet(path)


def write_index(index: SparseIndex, path: str, buckets: int = 64) -> None:
    """The index's tables, sorted by token within files so that a token's rows are pruned by row-group statistics."""
    for name in ("vectors", "clustered", "summary"):
        df = getattr(index, name)
        df.repartition(buckets, "token").sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, parameters: IndexParameters = IndexParameters()) -> SparseIndex:
    return SparseIndex(*[spark.read.parquet(f"{path}/{name}") for name in ("vectors", "clustered", "summary")], parameters)

"""Registration helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranksmith.sources.tables import read_table


class Tables:
    """The tables of a folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return read_table(self.spark, self.folder, name)

    def query_vector(self, vec_id: int = 0) -> list[float]:
        """One vector, as the query side of a search."""
        rows = self.embeddings.filter(f"vec_id = {vec_id}").select("embedding").take(1)
        return list(rows[0][0]) if rows else [0.0]


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, build: Callable[[Tables], DataFrame], sql: str | None = None) -> None:
        self.queries[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            self.sql[name] = sql

"""Shaping of ranked results: sorting, paging, collapsing, thresholds and rescoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.operators.retrieval import DIGITS

#: (column, descending)
Sort = Sequence[tuple[str, bool]]
BY_SCORE: Sort = (("score", True),)


def order(sort: Sort) -> list[Column]:
    """Sort columns, nulls last, ties by id."""
    return [F.desc_nulls_last(c) if down else F.asc_nulls_last(c) for c, down in sort] + [F.asc("doc_id")]


def check_sort(sort: Sort, track_scores: bool = False, min_score: float | None = None) -> None:
    fields = [c for c, _ in sort]
    if "score" in fields and len(fields) > 1:
        raise ValueError("a sort by score takes no other field")
    if track_scores:
        raise ValueError("scores are not tracked with a sort")
    if min_score is not None and "score" not in fields:
        raise ValueError("min_score does not go with a sort by field")


def page(rows: DataFrame, size: int = 10, from_: int = 0, sort: Sort = BY_SCORE) -> DataFrame:
    """``size`` rows after the first ``from_`` in order."""
    if size < 0 or from_ < 0:
        raise ValueError("size and from must not be negative")
    ordered = rows.orderBy(*order(sort))
    return ordered.offset(from_).limit(size) if from_ else ordered.limit(size)


def sort_lists(ranked_by: DataFrame, sort: Sort, depth: int) -> DataFrame:
    """Candidates of each sub-query by the sort fields, one row for each document: ``sub_query, doc_id, ...`` to distinct documents."""
    w = Window.partitionBy("sub_query").orderBy(*order(sort))
    rows = ranked_by.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") <= depth).drop("_place", "sub_query")
    return rows.dropDuplicates(["doc_id"])


def search_after(rows: DataFrame, sort: Sort, values: Sequence, doc_id=None) -> DataFrame:
    """Rows strictly after the given sort values; rows with equal values follow if their id is greater than ``doc_id``."""
    if len(values) != len(sort):
        raise ValueError(f"search_after has {len(values)} values but sort has {len(sort)}")
    tie = F.lit(False) if doc_id is None else F.col("doc_id") > F.lit(doc_id)
    after = tie
    for (column, down), value in reversed(list(zip(sort, values))):
        c, v = F.col(column), F.lit(value)
        beyond = (c < v) | c.isNull() if down else (c > v) | c.isNull()
        after = beyond | ((c == v) & after)
    return rows.filter(after)


def collapse(rows: DataFrame, group: str, sort: Sort = BY_SCORE) -> DataFrame:
    """The best row of each group; rows without a group value are a group together."""
    w = Window.partitionBy(group).orderBy(*order(sort))
    return rows.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def collapse_hits(rows: DataFrame, group: str, size: int, sort: Sort = BY_SCORE) -> DataFrame:
    """The ``size`` best rows of each group with their place."""
    w = Window.partitionBy(group).orderBy(*order(sort))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= size)


def at_least(rows: DataFrame, min_score: float) -> DataFrame:
    if math.isnan(min_score) or math.isinf(min_score):
        raise ValueError("min_score must be finite")
    return rows.filter(F.col("score") >= min_score)


def rescore(rows: DataFrame, second: DataFrame, window: int, query_weight: float = 1.0, rescore_weight: float = 1.0) -> DataFrame:
    """Add a second query's weighted score to the ``window`` best rows; the others keep theirs below them in order."""
    if window <= 0:
        raise ValueError("the rescore window must be positive")
    head = rows.orderBy(*order(BY_SCORE)).limit(window).select("doc_id", F.lit(True).alias("_head"))
    scored = second.select("doc_id", F.col("score").alias("_second"))
    out = rows.join(head, "doc_id", "left").join(scored, "doc_id", "left")
    new = F.col("score") * query_weight + F.coalesce(F.when(F.col("_head"), F.col("_second")), F.lit(0.0)) * rescore_weight
    return out.withColumn("score", F.round(F.when(F.col("_head"), new).otherwise(F.col("score")), DIGITS)).drop("_head", "_second")

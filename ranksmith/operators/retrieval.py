"""Retrieval: a corpus and a query to ``doc_id, score`` rows. Scores are rounded to ``DIGITS`` places, so that equal
scores tie the same way in every plan; ties go by id."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.functions import sparse, text, vectors
from ranksmith.functions.binding import once

DIGITS = 6
K1, B = 1.2, 0.75


def _scored(corpus: DataFrame, doc_id: str, score: Column) -> DataFrame:
    return corpus.select(F.col(doc_id).alias("doc_id"), F.round(score, DIGITS).alias("score"))


def top(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows: a bounded heap in each task, then one of the heaps' rows."""
    if k <= 0:
        raise ValueError("k must be positive")
    return scored.orderBy(F.desc("score"), "doc_id").limit(k)


def knn(corpus: DataFrame, query: Sequence[float] | Column, k: int | None = None, max_distance: float | None = None, min_score: float | None = None, filter: Column | None = None, space: str = "l2", doc_id: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """Exact nearest neighbours, or all vectors within a distance or above a score. The filter goes before the distance.

    At most one of ``k``, ``max_distance`` and ``min_score`` may be given; none means the ten nearest."""
    if sum(x is not None for x in (k, max_distance, min_score)) > 1:
        raise ValueError("only one of k, max_distance and min_score may be given")
    rows = (corpus if filter is None else corpus.filter(filter)).filter(F.col(vector).isNotNull())
    q = query if isinstance(query, Column) else vectors.literal(query)
    if max_distance is not None:
        rows = rows.filter(F.round(vectors.distance(F.col(vector), q, space), DIGITS) <= max_distance)
    out = _scored(rows, doc_id, vectors.score(F.col(vector), q, space))
    if min_score is not None:
        return out.filter(F.col("score") >= min_score)
    return out if max_distance is not None else top(out, k or 10)


def sparse_match(corpus: DataFrame, query: Mapping[str, float] | Column, vector: str = "tokens", doc_id: str = "doc_id", boost: float = 1.0) -> DataFrame:
    """Documents that share a token with the query, scored by the dot product."""
    q = query if isinstance(query, Column) else sparse.literal(query)
    score = F.round(sparse.dot(q, F.col(vector)) * boost, DIGITS)
    return corpus.select(F.col(doc_id).alias("doc_id"), once(score).alias("score")).filter("score > 0")


def analyzed_query(text_query: str, weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Query tokens from an analyzer: each distinct token with its given weight, or one; weights of at most zero drop out."""
    import re

    found = dict.fromkeys(re.findall(text.WORD, text_query.lower()))
    out = {t: float((weights or {}).get(t, 1.0)) for t in found}
    return {t: w for t, w in out.items() if w > 0}


def match(corpus: DataFrame, query: str, field: str = "text", doc_id: str = "doc_id", k1: float = K1, b: float = B, operator: str = "or", filter: Column | None = None) -> DataFrame:
    """BM25 over the tokens of a text column. Statistics cover the whole corpus, the filter only narrows the result.

    Only counts of the query's own terms leave a document, so there is no shuffle of postings: a scan makes the statistics
    (one row), a second one scores."""
    terms = list(analyzed_query(query))
    if not terms:
        return corpus.select(F.col(doc_id).alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    words = text.tokens(F.col(field))

    def times(term: str) -> Column:
        return F.size(F.filter("_w", lambda x: x == F.lit(term))).cast("double")

    counts = [times(t).alias(f"_t{i}") for i, t in enumerate(terms)]

    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(F.col(doc_id).alias("doc_id"), words.alias("_w")).select("doc_id", F.size("_w").cast("double").alias("_dl"), *counts)

    stats = counted(corpus).agg(F.count("*").cast("double").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_t{i}") > 0).cast("double")).alias(f"_df{i}") for i in range(len(terms))])
    rows = counted(corpus if filter is None else corpus.filter(filter)).join(F.broadcast(stats))  # stats is one row
    parts = []
    for i in range(len(terms)):
        tf, df = F.col(f"_t{i}"), F.col(f"_df{i}")
        idf = F.log(1 + (F.col("_n") - df + 0.5) / (df + 0.5))
        parts.append(idf * tf / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avg"))))
    hits = [F.col(f"_t{i}") > 0 for i in range(len(terms))]
    keep = hits[0]
    for h in hits[1:]:
        keep = (keep | h) if operator == "or" else (keep & h)
    score = parts[0]
    for p in parts[1:]:
        score = score + p
    return _scored(rows.filter(keep), "doc_id", score)


def constant(corpus: DataFrame, condition: Column, boost: float = 1.0, doc_id: str = "doc_id") -> DataFrame:
    """Documents that meet a condition (term, range, exists), each with the same score."""
    return _scored(corpus.filter(condition), doc_id, F.lit(float(boost)))


def boolean(must: Sequence[DataFrame] = (), should: Sequence[DataFrame] = (), must_not: Sequence[DataFrame] = (), filter: Sequence[DataFrame] = (), minimum: int | None = None) -> DataFrame:
    """Clauses by id: all of ``must`` and ``filter``, none of ``must_not``, at least ``minimum`` of ``should`` (one where nothing
    else is required); the score sums the scoring clauses. One aggregation by id does all clauses."""
    minimum = (0 if must or filter else 1) if minimum is None else minimum
    kinds = [("must", must), ("should", should), ("not", must_not), ("filter", filter)]
    tagged = [d.select("doc_id", F.lit(kind).alias("kind"), F.lit(i).alias("clause"), (F.col("score") if kind in ("must", "should") else F.lit(0.0)).alias("score")) for kind, many in kinds for i, d in enumerate(many)]
    if not must and not should and not filter:
        raise ValueError("a bool query needs a must, should or filter clause")
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    number = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("clause")))
    out = rows.groupBy("doc_id").agg(F.sum("score").alias("score"), *[number(kind).alias(f"n_{kind}") for kind, _ in kinds])
    out = out.filter((F.col("n_must") == len(must)) & (F.col("n_filter") == len(filter)) & (F.col("n_not") == 0) & (F.col("n_should") >= minimum))
    return out.select("doc_id", F.round("score", DIGITS).alias("score"))


def nested_max(children: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The best child's score of each parent."""
    return children.groupBy(F.col(doc_id).alias("doc_id")).agg(F.max("score").alias("score"))


def inner_hits(children: DataFrame, size: int = 3, from_: int = 0) -> DataFrame:
    """The best children (``child``, ``score``) of each parent with their place from 1."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "child")
    return children.withColumn("place", F.row_number().over(order)).filter((F.col("place") > from_) & (F.col("place") <= from_ + size))

"""Fusion of ranked lists: ``sub_query, doc_id, score`` rows are normalized within each sub-query and combined by document.

Statistics come from the candidate lists, not from the corpus. All functions take optional ``keys`` (for example a query
id) in front, so many queries are fused in one plan: one shuffle by (keys, sub-query) and one by (keys, document)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.operators.retrieval import DIGITS

MAX_SUB_QUERIES = 5
MIN_SCORE = 0.001
#: Where the running maximum of scores starts.
TINY = 1.401298464324817e-45
RANK_CONSTANT = 60
NORMALIZATIONS, COMBINATIONS = ("min_max", "l2", "z_score", "rrf"), ("arithmetic_mean", "geometric_mean", "harmonic_mean", "rrf")
BOUND_MODES = ("apply", "clip", "ignore")


def check_techniques(normalization: str, combination: str) -> None:
    if normalization not in NORMALIZATIONS:
        raise ValueError(f"unknown normalization {normalization!r}")
    if combination not in COMBINATIONS:
        raise ValueError(f"unknown combination {combination!r}")
    if normalization == "z_score" and combination != "arithmetic_mean":
        raise ValueError("z_score goes with arithmetic_mean only")


def check_weights(weights: Sequence[float] | None, n: int) -> list[float]:
    if weights is None or not len(weights):
        return [1.0] * n
    if len(weights) != n:
        raise ValueError(f"{len(weights)} weights for {n} sub-queries")
    if any(not 0 <= w <= 1 for w in weights) or abs(sum(weights) - 1) > 0.01:
        raise ValueError("weights must be between 0 and 1 and sum to 1")
    return [float(w) for w in weights]


def rank_lists(lists: Sequence[DataFrame], depth: int, keys: Sequence[str] = ()) -> DataFrame:
    """The union of sub-query results as ``keys, sub_query, doc_id, score, place``, each cut to its ``depth`` best positive scores."""
    if not 1 <= len(lists) <= MAX_SUB_QUERIES:
        raise ValueError(f"a hybrid query has 1 to {MAX_SUB_QUERIES} sub-queries")
    if depth < 1:
        raise ValueError("the depth must be at least 1")
    rows = None
    for i, scored in enumerate(lists):
        part = scored.filter("score > 0").select(*keys, F.lit(i).alias("sub_query"), "doc_id", F.col("score").cast("double").alias("score"))
        rows = part if rows is None else rows.unionByName(part)
    order = Window.partitionBy(*keys, "sub_query").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= depth)


def _per_sub(values: Sequence, default) -> Column:
    out = F.lit(default)
    for i, v in enumerate(values):
        out = F.when(F.col("sub_query") == i, v).otherwise(out)
    return out


def check_bounds(bounds: Sequence[dict] | None, key: str, n: int | None = None) -> None:
    if bounds is None:
        return
    if len(bounds) > MAX_SUB_QUERIES or n is not None and len(bounds) != n:
        raise ValueError("one bound for each sub-query, at most five")
    for x in bounds:
        if not isinstance(x, dict) or set(x) - {"mode", key}:
            raise ValueError(f"a bound is a map of mode and {key}")
        if x.get("mode", "apply") not in BOUND_MODES:
            raise ValueError(f"bound mode must be one of {BOUND_MODES}")
        if not -10000 <= x.get(key, 0) <= 10000:
            raise ValueError("a bound must be between -10000 and 10000")


def min_max(ranked: DataFrame, lower: Sequence[dict] | None = None, upper: Sequence[dict] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Scores to ``(s - min) / (max - min)``; exactly zero becomes 0.001, and lists of one value become 1.

    Bounds of a sub-query move its minimum or maximum: ``apply`` uses the bound where it lies outside the list's own range
    on the far side of the score, ``clip`` cuts scores off at the bound, ``ignore`` leaves all as it is."""
    check_bounds(lower, "min_score")
    check_bounds(upper, "max_score")
    w = Window.partitionBy(*keys, "sub_query")
    rows = ranked.withColumn("_min", F.min("score").over(w)).withColumn("_max", F.greatest(F.max("score").over(w), F.lit(TINY)))
    s, low, high = F.col("score"), F.col("_min"), F.col("_max")
    floor, least, most = [], low, high
    if lower:
        mode = _per_sub([F.lit(x.get("mode", "apply")) for x in lower], "ignore")
        bound = _per_sub([F.lit(float(x.get("min_score", 0.0))) for x in lower], 0.0)
        least = F.when(mode == "apply", F.when((high > bound) & (s > bound), bound).otherwise(low)).when(mode == "clip", F.when(high < bound, low).otherwise(bound)).otherwise(low)
        floor.append(((mode == "clip") & (s < least), F.lit(MIN_SCORE)))
    if upper:
        mode = _per_sub([F.lit(x.get("mode", "apply")) for x in upper], "ignore")
        bound = _per_sub([F.lit(float(x.get("max_score", 1.0))) for x in upper], 1.0)
        most = F.when(mode == "apply", F.when((low < bound) & (s < bound), bound).otherwise(high)).when(mode == "clip", F.when(low > bound, high).otherwise(bound)).otherwise(high)
        floor.append(((mode == "clip") & (s > most), F.lit(1.0)))
    plain = (s - least) / (most - least)
    out = F.when((low == high) & (high == s), F.lit(1.0))
    for condition, value in floor:
        out = out.when(condition, value)
    out = out.when(least == most, F.lit(1.0)).when(s == least, F.lit(MIN_SCORE)).otherwise(plain)
    return rows.withColumn("normalized", out).drop("_min", "_max")


def l2(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    size = F.sqrt(F.sum(F.col("score") * F.col("score")).over(Window.partitionBy(*keys, "sub_query")))
    return ranked.withColumn("normalized", F.when(size == 0, F.lit(0.0)).otherwise(F.col("score") / size))


def z_score(ranked: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Standard scores (sample deviation). A score at the mean becomes the list's maximum, no deviation its minimum, and what
    is not positive 0.001."""
    w = Window.partitionBy(*keys, "sub_query")
    mean, dev = F.avg("score").over(w), F.coalesce(F.stddev_samp("score").over(w), F.lit(0.0))
    z = (F.col("score") - mean) / dev
    out = F.when(F.abs(F.col("score") - mean) < 1e-9, F.max("score").over(w)).when(dev == 0, F.min("score").over(w)).when(z <= 0, F.lit(MIN_SCORE)).otherwise(z)
    return ranked.withColumn("normalized", out)


def reciprocal_rank(ranked: DataFrame, rank_constant: int = RANK_CONSTANT) -> DataFrame:
    if not 1 <= rank_constant <= 10000:
        raise ValueError("rank_constant must be between 1 and 10000")
    return ranked.withColumn("normalized", F.round(1 / (F.lit(float(rank_constant)) + F.col("place")), 10))


def normalize(ranked: DataFrame, technique: str = "min_max", keys: Sequence[str] = (), **parameters) -> DataFrame:
    """``ranked`` with the column ``normalized``."""
    if technique == "min_max":
        if set(parameters) - {"lower_bounds", "upper_bounds"}:
            raise ValueError("min_max takes lower_bounds and upper_bounds")
        return min_max(ranked, parameters.get("lower_bounds"), parameters.get("upper_bounds"), keys)
    if technique == "rrf":
        if set(parameters) - {"rank_constant"}:
            raise ValueError("rrf takes rank_constant")
        return reciprocal_rank(ranked, **parameters)
    if technique not in NORMALIZATIONS or parameters:
        raise ValueError(f"unknown normalization or parameters: {technique} {sorted(parameters)}")
    return (l2 if technique == "l2" else z_score)(ranked, keys)


def pivot(normalized: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """A row for each document with ``s0 .. s{n-1}``; a sub-query that missed it counts 0."""
    each = [F.coalesce(F.max(F.when(F.col("sub_query") == i, F.col("normalized"))), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    return normalized.groupBy(*keys, "doc_id").agg(*each)


def combined(technique: str, n: int, weights: Sequence[float] | None = None) -> Column:
    """The combined score of the columns ``s0 .. s{n-1}``."""
    if technique not in COMBINATIONS:
        raise ValueError(f"unknown combination {technique!r}")
    pairs = list(zip([F.col(f"s{i}") for i in range(n)], check_weights(weights, n)))

    def total(parts: list[Column]) -> Column:
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    at = (lambda s: s >= 0) if technique in ("arithmetic_mean", "rrf") else (lambda s: s > 0)
    each = {"arithmetic_mean": lambda s, w: s * w, "rrf": lambda s, w: s * w, "geometric_mean": lambda s, w: F.log(s) * w, "harmonic_mean": lambda s, w: F.lit(w) / s}[technique]
    value = total([F.when(at(s), each(s, w)).otherwise(0.0) for s, w in pairs])
    if technique == "rrf":
        return value
    weight = total([F.when(at(s), F.lit(w)).otherwise(0.0) for s, w in pairs])
    ratio = {"arithmetic_mean": lambda: value / weight, "geometric_mean": lambda: F.exp(value / weight), "harmonic_mean": lambda: weight / value}[technique]()
    empty = value if technique == "harmonic_mean" else weight
    return F.when(empty == 0, F.lit(0.0)).otherwise(ratio)


def combine(normalized: DataFrame, n: int, technique: str = "arithmetic_mean", weights: Sequence[float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, doc_id, score`` of every document that some sub-query found."""
    return pivot(normalized, n, keys).select(*keys, "doc_id", F.round(combined(technique, n, weights), DIGITS).alias("score"))


def fuse(lists: Sequence[DataFrame], depth: int, normalization: str = "min_max", combination: str = "arithmetic_mean", weights: Sequence[float] | None = None, keys: Sequence[str] = (), **parameters) -> DataFrame:
    """Rank, normalize and combine sub-query results."""
    check_techniques(normalization, combination)
    for key, name in (("lower_bounds", "min_score"), ("upper_bounds", "max_score")):
        check_bounds(parameters.get(key), name, len(lists))
    return combine(normalize(rank_lists(lists, depth, keys), normalization, keys, **parameters), len(lists), combination, weights, keys)


def explain(lists: Sequence[DataFrame], depth: int, normalization: str = "min_max", combination: str = "arithmetic_mean", weights: Sequence[float] | None = None, **parameters) -> DataFrame:
    """``doc_id, score, explanation``: the combination, and for each sub-query that found the document its normalized and raw score."""
    check_techniques(normalization, combination)
    n = len(lists)
    rows = normalize(rank_lists(lists, depth), normalization, **parameters)
    raw = [F.max(F.when(F.col("sub_query") == i, F.col("score"))).alias(f"r{i}") for i in range(n)]
    each = [F.coalesce(F.max(F.when(F.col("sub_query") == i, F.col("normalized"))), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    out = rows.groupBy("doc_id").agg(*raw, *each).withColumn("score", F.round(combined(combination, n, weights), DIGITS))
    of = "" if not weights else f", weights [{', '.join(str(float(w)) for w in weights)}]"

    def text(value: Column) -> Column:
        return F.round(value, DIGITS).cast("decimal(20,6)").cast("string")

    parts = [F.when(F.col(f"s{i}") > 0, F.concat(F.lit("["), text(F.col(f"s{i}")), F.lit(f" {normalization} normalization of: sub-query {i} score "), text(F.col(f"r{i}")), F.lit("]"))) for i in range(n)]
    return out.select("doc_id", "score", F.concat(text(F.col("score")), F.lit(f" {combination}{of} combination of: "), F.concat_ws(", ", *parts)).alias("explanation"))

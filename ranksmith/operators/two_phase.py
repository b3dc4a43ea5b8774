"""Two-phase sparse scoring: all documents by the query's heavy tokens, the light ones only within a window of the best."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import sparse
from ranksmith.operators.retrieval import DIGITS, sparse_match, top

DEFAULTS = {"enabled": True, "prune_type": "max_ratio", "prune_ratio": 0.4, "expansion_rate": 5.0, "max_window_size": 10000}


def split_query(tokens: Mapping[str, float], prune_type: str, ratio: float) -> tuple[dict[str, float], dict[str, float]]:
    """Heavy and light query tokens by a prune rule, on the driver."""
    sparse.check_prune(prune_type, ratio)
    if prune_type == "none" or not tokens:
        return dict(tokens), {}
    ordered = sorted(tokens.items(), key=lambda x: (-x[1], x[0]))
    total, run, keep = sum(tokens.values()), 0.0, []
    for i, (t, w) in enumerate(ordered):
        run += w
        fine = {"top_k": i < ratio, "max_ratio": w >= ratio * ordered[0][1], "abs_value": w >= ratio, "alpha_mass": run <= total * ratio + 1e-9}[prune_type]
        if fine:
            keep.append(t)
    return {t: tokens[t] for t in keep}, {t: w for t, w in tokens.items() if t not in keep}


def check_parameters(size: int, expansion_rate: float, max_window_size: int) -> int:
    """The window of the second phase."""
    if expansion_rate < 1:
        raise ValueError("expansion_rate must be at least 1")
    if max_window_size < 50:
        raise ValueError("max_window_size must be at least 50")
    window = int(size * expansion_rate)
    if window > max_window_size:
        raise ValueError(f"the window {window} is above max_window_size {max_window_size}")
    return window


def two_phase(corpus: DataFrame, tokens: Mapping[str, float], size: int = 10, vector: str = "tokens", doc_id: str = "doc_id", prune_type: str = "max_ratio", prune_ratio: float = 0.4, expansion_rate: float = 5.0, max_window_size: int = 10000, weight: float = 1.0) -> DataFrame:
    """``doc_id, score`` of the window's documents: heavy score plus ``weight`` times the light one. The window's rows, a bounded
    number, are all that the second phase reads."""
    window = check_parameters(size, expansion_rate, max_window_size)
    heavy, light = split_query(tokens, prune_type, prune_ratio)
    if not light:
        return top(sparse_match(corpus, heavy, vector, doc_id), window)
    first = top(sparse_match(corpus, heavy, vector, doc_id), window).withColumnRenamed("score", "_heavy")
    rows = corpus.select(F.col(doc_id).alias("doc_id"), F.col(vector).alias("_v")).join(F.broadcast(first), "doc_id")  # at most max_window_size rows
    return rows.select("doc_id", F.round(F.col("_heavy") + sparse.dot(sparse.literal(light), F.col("_v")) * weight, DIGITS).alias("score"))


def applies(sort: list | None, targets_ann: bool = False) -> bool:
    """Whether a request is rewritten at all: only for results by descending score, and not for a sparse-index field."""
    if targets_ann:
        raise ValueError("two-phase scoring does not go with a sparse index field")
    return not sort or list(sort) in ([("score", True)], ["score"])

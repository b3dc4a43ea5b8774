"""Sparse vectors as maps of token to weight: scoring, pruning, folding and quantization as map expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranksmith.functions.binding import let

PRUNE_TYPES = ("none", "top_k", "max_ratio", "alpha_mass", "abs_value")
CEILING_INGEST, CEILING_SEARCH, MAX_BYTE = 3.0, 16.0, 255
TOKEN_SPACE = 32768


def literal(tokens: Mapping[str, float]) -> Column:
    """Query tokens as a constant map of doubles."""
    if not tokens:
        return F.create_map().cast("map<string,double>")
    return F.create_map(*[x for k, v in sorted(tokens.items()) for x in (F.lit(k), F.lit(float(v)))])


def term_frequencies(tokens: Column) -> Column:
    """A deterministic encoder: each distinct token of an array, with ``1 + ln(count)`` as weight.

    Equal tokens are neighbours in the sorted array, so run lengths count them in linear time."""

    def runs(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))

    def weights(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s) + 1))
        lengths = F.zip_with(starts, F.slice(ends, F.lit(1), F.size(starts)), lambda a, b: 1 + F.log((b - a).cast("double")))
        return F.map_from_arrays(F.transform(starts, lambda i: F.element_at(s, i)), lengths)

    return let(F.sort_array(tokens), lambda s: let(runs(s), lambda starts: weights(s, starts)))


def dot(query: Column, document: Column) -> Column:
    """Sum over the query's tokens of both weights' product; tokens that the document lacks add nothing."""
    return F.aggregate(F.map_entries(query), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(document, e["key"]).cast("double"), F.lit(0.0)))


def check_prune(prune_type: str, ratio: float | None) -> None:
    """Reject what no pruning accepts: an unknown type, a missing ratio or one outside its range."""
    if prune_type not in PRUNE_TYPES:
        raise ValueError(f"unknown prune type {prune_type!r}; known: {', '.join(PRUNE_TYPES)}")
    if prune_type == "none":
        if ratio is not None:
            raise ValueError("no ratio goes with prune type none")
        return
    if ratio is None:
        raise ValueError(f"prune type {prune_type} needs a ratio")
    if prune_type == "top_k" and (ratio <= 0 or ratio != int(ratio)):
        raise ValueError("top_k needs a positive whole number")
    if prune_type in ("max_ratio", "alpha_mass") and not 0 <= ratio < 1:
        raise ValueError(f"{prune_type} needs a ratio in [0, 1)")
    if prune_type == "abs_value" and ratio < 0:
        raise ValueError("abs_value needs a threshold of at least 0")


def _ordered(m: Column) -> Column:
    """Entries by weight, largest first; equal weights by token."""

    def order(a: Column, b: Column) -> Column:
        by_weight = F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
        return by_weight.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)

    return F.array_sort(F.map_entries(m), order)


def _parts(m: Column, prune_type: str, ratio: float | None) -> tuple[Column, Column]:
    """The tokens that pruning keeps and those that it takes out, each in one pass over the entries."""
    check_prune(prune_type, ratio)
    if prune_type == "none":
        return m, F.map_filter(m, lambda k, v: F.lit(False))
    if prune_type in ("abs_value", "max_ratio"):
        least = F.lit(ratio) if prune_type == "abs_value" else F.array_max(F.map_values(m)) * ratio
        return let(least, lambda x: F.map_filter(m, lambda _, v: v >= x)), let(least, lambda x: F.map_filter(m, lambda _, v: ~F.coalesce(v >= x, F.lit(False))))
    if prune_type == "top_k":
        return F.map_from_entries(F.slice(_ordered(m), 1, int(ratio))), let(_ordered(m), lambda o: F.map_from_entries(F.slice(o, F.lit(int(ratio) + 1), F.size(o))))
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0).alias("n"))

    def number(ordered: Column, budget: Column) -> Column:
        # Prefixes whose mass stays within the budget; rounding of the running sum gets a small allowance.
        return F.aggregate(ordered, start, lambda s, e: F.struct((s["run"] + e["value"]).alias("run"), F.when(s["run"] + e["value"] <= budget, s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])

    budget = F.aggregate(F.map_values(m), F.lit(0.0), lambda s, x: s + x) * ratio + 1e-9

    def cut(piece) -> Column:
        return let(budget, lambda most: let(_ordered(m), lambda o: let(number(o, most), lambda n: F.map_from_entries(piece(o, n)))))

    return cut(lambda o, n: F.slice(o, F.lit(1), n)), cut(lambda o, n: F.slice(o, n + 1, F.size(o)))


def prune(m: Column, prune_type: str, ratio: float | None = None) -> Column:
    """The tokens that pruning keeps. Equal weights at the cut of ``top_k`` go by token."""
    return _parts(m, prune_type, ratio)[0]


def split(m: Column, prune_type: str, ratio: float | None = None) -> tuple[Column, Column]:
    """The pruned map and the tokens that pruning took out."""
    return _parts(m, prune_type, ratio)


def quantize(weight: Column, ceiling: float = CEILING_INGEST) -> Column:
    """A weight as 0 to 255, half up, clamped to the ceiling."""
    clamped = F.greatest(F.lit(0.0), F.least(weight.cast("double"), F.lit(ceiling)))
    return F.floor(clamped * MAX_BYTE / F.lit(ceiling) + 0.5).cast("int")


def fold(token: Column) -> Column:
    """Token ids folded to 15 bits."""
    return F.pmod(token, F.lit(TOKEN_SPACE)).cast("int")


def rescale(product: Column, boost: float = 1.0, ingest: float = CEILING_INGEST, search: float = CEILING_SEARCH) -> Column:
    """A product of quantized weights on the scale of the weights."""
    return product * F.lit(boost * ingest * search / MAX_BYTE / MAX_BYTE)

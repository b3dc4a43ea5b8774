"""Statistics of configured pipelines, of stored indexes and of events, in one nested listing."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame

from ranksmith.streaming import stats as events

# Names of the statistics.
INFO_STATS = (
    "processors.ingest.text_embedding_processors_in_pipelines",
    "processors.ingest.skip_existing_processors",
    "processors.ingest.text_chunking_processors",
    "processors.ingest.text_chunking_delimiter_processors",
    "processors.ingest.text_chunking_fixed_token_length_processors",
    "processors.ingest.text_chunking_fixed_char_length_processors",
    "processors.ingest.text_image_embedding_processors",
    "processors.ingest.sparse_encoding_processors",
    "processors.search.hybrid.normalization_processors",
    "processors.search.hybrid.norm_l2_processors",
    "processors.search.hybrid.norm_minmax_processors",
    "processors.search.hybrid.norm_zscore_processors",
    "processors.search.hybrid.comb_arithmetic_processors",
    "processors.search.hybrid.comb_geometric_processors",
    "processors.search.hybrid.comb_harmonic_processors",
    "processors.search.hybrid.rank_based_normalization_processors",
    "processors.search.hybrid.comb_rrf_processors",
    "processors.search.neural_query_enricher_processors",
    "processors.search.neural_sparse_two_phase_processors",
    "processors.search.rerank_by_field_processors",
    "processors.search.rerank_ml_processors",
    "processors.search.agentic.agentic_query_translator_processors",
    "processors.search.agentic.agentic_context_processors",
)
_SHORT = {path.rpartition(".")[2]: path for path in INFO_STATS}
_TECHNIQUES = {"min_max": "norm_minmax", "l2": "norm_l2", "z_score": "norm_zscore", "arithmetic_mean": "comb_arithmetic", "geometric_mean": "comb_geometric", "harmonic_mean": "comb_harmonic"}
PARAMETERS = {"flat_stat_paths", "include_metadata", "include_info", "include_metric"}


class StatsDisabled(PermissionError):
    """Statistics are switched off."""


def info_stats(ingest_pipelines: Mapping[str, Mapping] | None = None, search_pipelines: Mapping[str, Mapping] | None = None) -> dict[str, int]:
    """How many processors of each kind and technique the pipelines have, by full name."""
    counts = dict.fromkeys(INFO_STATS, 0)

    def one(short: str, when: bool = True) -> None:
        if when:
            counts[_SHORT[short]] += 1

    for pipeline in (ingest_pipelines or {}).values():
        for processor in pipeline.get("processors", []):
            (name, s), *_ = processor.items()
            one("skip_existing_processors", bool(s.get("skip_existing")))
            if name == "text_chunking":
                one("text_chunking_processors")
                one(f"text_chunking_{next(iter(s.get('algorithm') or {'fixed_token_length': {}}))}_processors")
            elif name == "text_embedding":
                one("text_embedding_processors_in_pipelines")
            elif f"{name}_processors" in _SHORT:
                one(f"{name}_processors")
    for pipeline in (search_pipelines or {}).values():
        for key in ("request_processors", "phase_results_processors", "response_processors"):
            for processor in pipeline.get(key, []):
                (name, s), *_ = processor.items()
                if name == "normalization-processor":
                    one("normalization_processors")
                    one(f"{_TECHNIQUES[s.get('normalization', {}).get('technique', 'min_max')]}_processors")
                    one(f"{_TECHNIQUES[s.get('combination', {}).get('technique', 'arithmetic_mean')]}_processors")
                elif name == "score-ranker-processor":
                    one("rank_based_normalization_processors")
                    one("comb_rrf_processors")
                elif name == "rerank":
                    one("rerank_by_field_processors", "by_field" in s)
                    one("rerank_ml_processors", "ml" in s)
                else:
                    short = f"{name.removesuffix('_processor')}_processors"
                    one(short, short in _SHORT)
    return counts


def metric_stats(indices: Mapping[str, object]) -> dict[str, float]:
    """Kilobytes that the cached tables of sparse indexes take, as the optimizer knows their sizes; tables that are not cached take none."""

    def cached(df: DataFrame) -> float:
        return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) / 1024 if df.is_cached else 0.0

    forward = sum(cached(x.vectors) for x in indices.values())
    posting = sum(cached(x.clustered) + cached(x.summary) for x in indices.values())
    return {"memory.sparse.sparse_memory_usage": forward + posting, "memory.sparse.forward_index_usage": forward, "memory.sparse.clustered_posting_usage": posting}


def warm_up(indices: Mapping[str, object], names: list[str] | None = None) -> None:
    """Cache the tables of sparse indexes; what does not fit in memory goes to disk."""
    for name in names or indices:
        for df in (indices[name].vectors, indices[name].clustered, indices[name].summary):
            df.persist().count()


def clear_cache(indices: Mapping[str, object], names: list[str] | None = None) -> None:
    for name in names or indices:
        for df in (indices[name].vectors, indices[name].clustered, indices[name].summary):
            df.unpersist()


def _nested(flat: Mapping[str, object]) -> dict:
    out: dict = {}
    for path, value in flat.items():
        *parents, last = path.split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def listing(
    stats: list[str] | None = None,
    ingest_pipelines: Mapping[str, Mapping] | None = None,
    search_pipelines: Mapping[str, Mapping] | None = None,
    indices: Mapping[str, object] | None = None,
    event_table: DataFrame | None = None,
    now=None,
    enabled: bool = True,
    **parameters: bool,
) -> dict:
    """``{"info": ..., "all_nodes": ...}``: the named statistics, or all. ``flat_stat_paths`` gives full names as keys, ``include_metadata`` a map
    with the kind of each value, and ``include_info`` and ``include_metric`` leave groups out. Events come from a table of ``event_type, ts``."""
    if not enabled:
        raise StatsDisabled("statistics are disabled")
    if unknown := set(parameters) - PARAMETERS:
        raise ValueError(f"unknown parameters {sorted(unknown)}")
    if bad := [s for s in stats or [] if not re.fullmatch(r"[A-Za-z0-9_-]+", s)]:
        raise ValueError(f"bad names {bad}")
    info, nodes = {}, {}
    if parameters.get("include_info", True):
        info = {k: (v, "info_counter") for k, v in info_stats(ingest_pipelines, search_pipelines).items()}
    if parameters.get("include_metric", True):
        nodes |= {k: (round(v, 2), "memory") for k, v in metric_stats(indices or {}).items()}
    if event_table is not None:
        for x in events.snapshot(event_table, now).collect():  # a row for each event name
            nodes[f"events.{x['name']}"] = ({"value": x["total"], "trailing_interval_value": x["trailing"], "minutes_since_last_event": x["minutes_since_last_event"]}, "timestamped_event_counter")
    known = {path.rpartition(".")[2] for path in (*info, *nodes)}
    if missing := [s for s in stats or [] if s not in known]:
        raise ValueError(f"unknown statistics {missing}")

    def shown(group: dict) -> dict:
        chosen = {k: v for k, v in group.items() if not stats or k.rpartition(".")[2] in stats}
        values = {k: ({**(v if isinstance(v, dict) else {"value": v}), "stat_type": kind} if parameters.get("include_metadata") else v if not isinstance(v, dict) else v["value"]) for k, (v, kind) in chosen.items()}
        return values if parameters.get("flat_stat_paths") else _nested(values)

    return {"info": shown(info), "all_nodes": shown(nodes)}

"""The query language: nested maps with one clause each, checked before anything is planned."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping

from ranksmith.operators.fusion import MAX_SUB_QUERIES

COMPOUND = ("bool", "dis_max", "function_score", "constant_score", "boosting", "script_score", "nested")
CLAUSES = ("match_all", "match", "multi_match", "term", "terms", "range", "exists", "bool", "nested", "constant_score", "knn", "neural", "neural_knn", "neural_sparse", "hybrid", "agentic")
MAX_AGENTIC_CHARS, MAX_AGENTIC_FIELDS, MAX_TRANSLATED_CHARS = 1000, 25, 10_000
_KEYS = {
    "hybrid": {"queries", "filter", "pagination_depth", "boost", "_name"},
    "neural": {"query_text", "query_image", "model_id", "k", "max_distance", "min_score", "filter", "expand_nested_docs", "method_parameters", "rescore", "boost", "_name", "query_tokens", "semantic_field_search_analyzer"},
    "neural_sparse": {"query_text", "model_id", "query_tokens", "analyzer", "max_token_score", "method_parameters", "boost", "_name"},
    "agentic": {"query_text", "query_fields", "memory_id"},
}
# An exact search has no use for ``rescore`` and the ``method_parameters`` of a vector index, all children of a document count with
# or without ``expand_nested_docs``, and ``max_token_score`` is deprecated: they are accepted and change nothing.
_ANN_KEYS = {"top_n", "k", "heap_factor", "filter"}


class QueryError(ValueError):
    """A request that the language does not allow."""


def clause(query: Mapping) -> tuple[str, dict]:
    """The kind and body of a query."""
    if not isinstance(query, Mapping) or len(query) != 1:
        raise QueryError("a query is a map with one clause")
    (kind, body), *_ = query.items()
    if kind not in CLAUSES:
        raise QueryError(f"unknown query [{kind}]")
    if not isinstance(body, Mapping):
        raise QueryError(f"[{kind}] needs a map")
    return kind, dict(body)


def as_list(value) -> list:
    return [] if value is None else list(value) if isinstance(value, (list, tuple)) else [value]


def field_body(kind: str, body: Mapping) -> tuple[str, dict]:
    """The single field of a clause and its settings."""
    if len(body) != 1:
        raise QueryError(f"[{kind}] takes one field")
    (name, settings), *_ = body.items()
    return name, dict(settings) if isinstance(settings, Mapping) else {"value": settings}


def _known(kind: str, settings: Mapping) -> None:
    for key in settings:
        if key not in _KEYS[kind]:
            raise QueryError(f"[{kind}] does not support [{key}]")


def validate(query: Mapping, top: bool = True, inside_hybrid: bool = False) -> None:
    """Raise QueryError for what the language does not allow."""
    kind, body = clause(query)
    if kind == "hybrid":
        _hybrid(body, top, inside_hybrid)
    elif kind == "agentic":
        if not top:
            raise QueryError("[agentic] must be the top-level query")
        _agentic(body)
    elif kind == "neural":
        _neural(*field_body(kind, body))
    elif kind == "neural_sparse":
        _neural_sparse(*field_body(kind, body))
    for child in children(query):
        if kind in COMPOUND and clause(child)[0] == "hybrid" and not (kind == "bool" and top and child in as_list(body.get("must"))):
            raise QueryError(f"a hybrid query stands at the top and not inside [{kind}]")
        if kind != "hybrid":
            validate(child, kind == "bool" and top and clause(child)[0] == "hybrid", inside_hybrid)


def _hybrid(body: Mapping, top: bool, inside: bool) -> None:
    if inside:
        raise QueryError("a hybrid query cannot hold another one")
    if not top:
        raise QueryError("a hybrid query stands at the top")
    _known("hybrid", body)
    queries = body.get("queries")
    if not isinstance(queries, (list, tuple)) or not queries:
        raise QueryError("[hybrid] needs at least one query")
    if len(queries) > MAX_SUB_QUERIES:
        raise QueryError(f"[hybrid] takes at most {MAX_SUB_QUERIES} queries")
    if body.get("boost", 1.0) != 1.0:
        raise QueryError("[hybrid] does not support boost")
    if "filter" in body and not isinstance(body["filter"], Mapping):
        raise QueryError("the filter of [hybrid] is a single query")
    depth = body.get("pagination_depth")
    if depth is not None and (not isinstance(depth, int) or depth < 1):
        raise QueryError("pagination_depth must be at least 1")
    for q in queries:
        validate(q, top=False, inside_hybrid=True)


def _neural(name: str, settings: Mapping) -> None:
    _known("neural", settings)
    if not any(settings.get(k) for k in ("query_text", "query_image", "query_tokens")):
        raise QueryError(f"[neural] on {name} needs query_text, query_image or query_tokens")
    if sum(settings.get(k) is not None for k in ("k", "max_distance", "min_score")) > 1:
        raise QueryError("only one of k, max_distance and min_score may be given")
    if settings.get("k") is not None and settings["k"] <= 0:
        raise QueryError("k must be positive")


def _neural_sparse(name: str, settings: Mapping) -> None:
    _known("neural_sparse", settings)
    if not settings.get("query_text") and not settings.get("query_tokens"):
        raise QueryError(f"[neural_sparse] on {name} needs query_text or query_tokens")
    if settings.get("query_text") == "":
        raise QueryError("query_text must not be empty")
    if settings.get("model_id") and settings.get("analyzer"):
        raise QueryError("only one of model_id and analyzer may be given")
    for token, weight in (settings.get("query_tokens") or {}).items():
        if not isinstance(weight, (int, float)) or not weight > 0:
            raise QueryError(f"the weight of token {token!r} must be positive")
    ann = settings.get("method_parameters")
    if ann is not None:
        if set(ann) - _ANN_KEYS:
            raise QueryError(f"unknown method parameters {sorted(set(ann) - _ANN_KEYS)}")
        for key in ("top_n", "k", "heap_factor"):
            if key in ann and not ann[key] > 0:
                raise QueryError(f"{key} must be positive")


def _agentic(body: Mapping) -> None:
    _known("agentic", body)
    text = body.get("query_text")
    if not text or len(text) > MAX_AGENTIC_CHARS:
        raise QueryError(f"[agentic] needs query_text of at most {MAX_AGENTIC_CHARS} characters")
    if len(as_list(body.get("query_fields"))) > MAX_AGENTIC_FIELDS:
        raise QueryError(f"[agentic] takes at most {MAX_AGENTIC_FIELDS} query_fields")


def cleaned_agentic_text(text: str) -> str:
    """Query text without what reads like instructions to the agent's runtime."""
    text = re.sub(r"(?i)\b(system|instruction|command|prompt)\s*:", "", text)
    return re.sub(r"(?i)\b(execute|run|eval|exec)\s*\(", "", text).strip()


def children(query: Mapping) -> Iterator[dict]:
    """Queries directly inside a query."""
    kind, body = clause(query)
    if kind == "bool":
        for key in ("must", "should", "must_not", "filter"):
            yield from as_list(body.get(key))
    elif kind == "hybrid":
        yield from body.get("queries", [])
        yield from as_list(body.get("filter"))
    elif kind == "nested":
        yield body["query"]
    elif kind == "constant_score":
        yield body["filter"]


def walk(query: Mapping) -> Iterator[tuple[str, dict]]:
    """Every clause of a query, itself first."""
    yield clause(query)
    for child in children(query):
        yield from walk(child)


def rewrite(query: Mapping, change: Callable[[str, dict], dict]) -> dict:
    """The query with ``change(kind, body)`` applied to every clause, innermost first."""
    kind, body = clause(query)
    if kind in ("bool", "hybrid", "nested", "constant_score"):
        body = {k: [rewrite(q, change) for q in v] if isinstance(v, (list, tuple)) and v and isinstance(v[0], Mapping) else rewrite(v, change) if isinstance(v, Mapping) and k in ("must", "should", "must_not", "filter", "query") else v for k, v in body.items()}
    return {kind: change(kind, body)}


def add_filter(query: Mapping, condition: Mapping) -> dict:
    """A hybrid query with one more filter in every sub-query."""
    kind, body = clause(query)
    if kind != "hybrid":
        return {"bool": {"must": [query], "filter": [condition]}}
    return {"hybrid": {**body, "queries": [{"bool": {"must": [q], "filter": [condition]}} for q in body["queries"]]}}


def check_request(request: Mapping) -> None:
    """Rules for the parts of a request together."""
    kind, body = clause(request.get("query", {"match_all": {}}))
    validate(request.get("query", {"match_all": {}}))
    size, start = request.get("size", 10), request.get("from", 0)
    if size < 0 or start < 0:
        raise QueryError("size and from must not be negative")
    if request.get("search_type") == "dfs_query_then_fetch" and kind == "hybrid":
        raise QueryError("hybrid queries do not run with a DFS phase")
    if request.get("scroll") and kind == "hybrid":
        raise QueryError("hybrid queries cannot be scrolled")
    minimum = request.get("min_score")
    if minimum is not None and (math.isnan(minimum) or math.isinf(minimum)):
        raise QueryError("min_score must be finite")
    if kind != "hybrid":
        return
    if start > 0 and body.get("pagination_depth") is None:
        raise QueryError("pagination_depth is needed when from is above 0")
    sort = as_list(request.get("sort"))
    names = [next(iter(s)) if isinstance(s, Mapping) else s for s in sort]
    if "_score" in names and len(names) > 1:
        raise QueryError("_score goes with no other sort field")
    if sort and request.get("track_scores"):
        raise QueryError("track_scores does not go with a sort")
    if sort and names != ["_score"] and minimum is not None:
        raise QueryError("min_score does not go with a sort by field")
    if sort and request.get("rescore"):
        raise QueryError("rescore does not go with a sort")
    after = request.get("search_after")
    if after is not None and len(after) != len(sort):
        raise QueryError("search_after has another length than sort")

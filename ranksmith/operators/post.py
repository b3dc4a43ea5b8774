"""Post-processing of hits: reranking, highlighting and diversification."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import text as T
from ranksmith.functions.binding import let

MAX_RERANK_FIELDS = 50
RERANK_TYPES = ("by_field", "ml")
MAX_BATCH_SIZE = 100


def rerank_by_field(hits: DataFrame, target: str, keep_previous: bool = False, remove_target: bool = False, previous: str = "previous_score") -> DataFrame:
    """A numeric field (dotted path) becomes the score; the old order breaks ties."""
    old = F.col("score")
    out = hits.withColumn("_old", old).withColumn("score", F.col(target).cast("double"))
    if keep_previous:
        out = out.withColumn(previous, F.col("_old"))
    out = out.orderBy(F.desc_nulls_last("score"), F.desc("_old"), "doc_id").drop("_old")
    if not remove_target:
        return out
    *path, last = target.split(".")
    return out.drop(target) if not path else out.withColumn(path[0], F.col(path[0]).dropFields(".".join([*path[1:], last])))


def context_text(fields: Sequence[str], list_fields: Sequence[str] = ()) -> Column:
    """Document text of several fields; list values are joined by spaces, missing ones are empty."""
    if not fields or len(fields) > MAX_RERANK_FIELDS:
        raise ValueError(f"1 to {MAX_RERANK_FIELDS} document fields are needed")
    return F.concat_ws(" ", *[F.coalesce(F.concat_ws(" ", F.col(f)) if f in list_fields else F.col(f).cast("string"), F.lit("")) for f in fields])


def overlap_score(query: str, document: Column) -> Column:
    """A deterministic scorer: the share of the query's distinct tokens that the document has."""
    import re

    wanted = sorted(set(re.findall(T.WORD, query.lower())))
    have = F.array_intersect(T.tokens(document), F.array(*[F.lit(t) for t in wanted]))
    return F.size(have) / F.lit(float(max(1, len(wanted))))


def rerank(hits: DataFrame, query: str, fields: Sequence[str], scorer: Callable[[str, Column], Column] = overlap_score) -> DataFrame:
    """Scores (query, document text) pairs anew; ``scorer`` is a column function or wraps a model's pandas UDF."""
    out = hits.withColumn("_old", F.col("score")).withColumn("score", F.round(scorer(query, context_text(fields)), 6))
    return out.orderBy(F.desc("score"), F.desc("_old"), "doc_id").drop("_old")


def rerank_config(config: dict) -> tuple[str, dict]:
    """The single rerank type of a configuration and its settings."""
    found = [t for t in RERANK_TYPES if t in config]
    if len(found) != 1:
        raise ValueError("a rerank processor has exactly one type")
    settings = config[found[0]]
    if found[0] == "by_field" and not settings.get("target_field"):
        raise ValueError("by_field needs target_field")
    return found[0], settings


def rerank_query(context: dict, query: dict | None = None) -> str:
    """The query text of a request: given, or found by a path in the query; exactly one of both."""
    given, path = context.get("query_text"), context.get("query_text_path")
    if (given is None) == (path is None):
        raise ValueError("exactly one of query_text and query_text_path is needed")
    if given is not None:
        return given
    at = query
    for p in path.split("."):
        if not isinstance(at, dict) or p not in at:
            raise ValueError(f"{path} is not in the query")
        at = at[p]
    if not isinstance(at, str):
        raise ValueError(f"{path} is no text")
    return at


def term_spans(text: Column, terms: Sequence[str]) -> Column:
    """A deterministic highlighter: spans of the given lower-case words, not overlapping."""
    import re

    pattern = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(t) for t in terms) + r")(?![A-Za-z0-9])"
    # Split at matches: running lengths of the pieces between give the offsets.
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def walk(g: Column, f: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            begin = s["at"] + F.length(F.element_at(g, i))
            end = begin + F.length(F.element_at(f, i))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("out"))

        places = F.when(F.size(f) > 0, F.sequence(F.lit(1), F.size(f))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, add, lambda s: s["out"])

    return let(gaps, lambda g: let(found, lambda f: walk(g, f)))


def highlight(text: Column, spans: Column, pre: str = "<em>", post: str = "</em>", encoder: str = "default", no_match_size: int = 0) -> Column:
    """Tagged text; without spans the first ``no_match_size`` characters, or null if that is 0."""
    if encoder not in ("default", "html"):
        raise ValueError("encoder must be default or html")
    head = F.substring(text, 1, no_match_size)
    head = T.escape_html(head) if encoder == "html" else head
    none = head if no_match_size > 0 else F.lit(None).cast("string")
    return F.when(F.size(spans) > 0, T.apply_tags(text, spans, pre, post, encoder == "html")).otherwise(none)


def highlight_terms(text: Column, terms: Sequence[str], pre: str = "<em>", post: str = "</em>", encoder: str = "default", no_match_size: int = 0) -> Column:
    """``highlight`` of the spans of ``term_spans``, without making the spans: one replacement, or pieces that are escaped and joined."""
    import re

    if encoder not in ("default", "html"):
        raise ValueError("encoder must be default or html")
    if not terms:
        return highlight(text, F.array().cast("array<struct<start:int,end:int>>"), pre, post, encoder, no_match_size)
    pattern = r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(re.escape(t) for t in terms) + r")(?![A-Za-z0-9])"
    found = F.regexp_like(text, F.lit(pattern))
    none = highlight(text, F.array().cast("array<struct<start:int,end:int>>"), pre, post, encoder, no_match_size)
    if encoder == "default":
        tagged = F.regexp_replace(text, pattern, f"{_replacement(pre)}$0{_replacement(post)}")
    else:
        inside = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), 1), lambda x: F.concat(F.lit(pre), T.escape_html(x), F.lit(post)))
        between = F.transform(F.split(text, pattern, -1), T.escape_html)
        tagged = F.array_join(F.flatten(F.zip_with(between, inside, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    return F.when(found, tagged).otherwise(none)


def _replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", "\\$")


def query_texts(query: dict) -> list[str]:
    """The texts that a query's clauses ask for, in order and without repeats; ``must_not`` does not count."""
    (kind, body), *rest = query.items()
    if rest:
        raise ValueError("a query has one clause")
    if kind in ("match", "term", "neural", "neural_sparse"):
        (_, value), *_ = body.items()
        value = value if not isinstance(value, dict) else value.get("query_text", value.get("query", value.get("value")))
        return [str(value)] if value is not None else []
    if kind == "bool":
        parts = [q for k in ("must", "should", "filter") for q in (body.get(k) if isinstance(body.get(k), list) else [body[k]] if body.get(k) else [])]
    elif kind == "hybrid":
        parts = body.get("queries", [])
    elif kind == "nested":
        parts = [body["query"]]
    elif kind == "neural_knn":
        return [body["original_query_text"]] if body.get("original_query_text") else []
    else:
        parts = []
    return list(dict.fromkeys(t for q in parts for t in query_texts(q)))


def mmr(hits: DataFrame, size: int, diversity: float = 0.5, key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """Greedy maximal marginal relevance among the candidates of each key: ``(1 - d) * score - d * max cosine to those taken``.

    The candidates of a key are a bounded window of hits (cut them before), never the corpus."""
    if not 0 <= diversity <= 1:
        raise ValueError("diversity must be between 0 and 1")
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields}

    def greedy(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["score", "doc_id"], ascending=[False, True]).reset_index(drop=True)
        v = np.array([np.asarray(x, float) for x in rows["vec"]])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        nearest, left, taken = np.zeros(len(v)), list(range(len(v))), []
        while left and len(taken) < size:
            value = [(1 - diversity) * rows["score"][i] - diversity * nearest[i] for i in left]
            best = left.pop(int(np.argmax(np.round(value, 9))))
            taken.append(best)
            nearest = np.maximum(nearest, v @ v[best]) if len(taken) > 1 else v @ v[best]
        out = rows.loc[taken, [key, "doc_id", "score"]].copy()
        out["place"] = range(1, len(taken) + 1)
        return out

    return hits.select(key, "doc_id", "score", F.col(vector).alias("vec")).groupBy(key).applyInPandas(greedy, f"{key} {kinds[key]}, doc_id {kinds['doc_id']}, score {kinds['score']}, place int")

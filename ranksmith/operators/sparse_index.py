"""An approximate index of sparse vectors: pruned postings in clusters with summaries, as three tables.

Build: the heaviest documents of each token (``n_postings``), dealt to clusters around deterministic centres, each with a
summary of the largest weights of its members. Search: the query's heaviest tokens name clusters, the best clusters by
summary give candidates, and candidates are scored exactly on quantized vectors. All steps are joins and windows by
token, so the index grows and splits with the corpus; the query side is a handful of literals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranksmith.functions import sparse
from ranksmith.operators.retrieval import DIGITS, top

SUMMARY_RATIO, CLUSTER_RATIO, MIN_CLUSTERED, MIN_POSTINGS, POSTING_RATIO = 0.4, 0.1, 10, 160, 0.0005
APPROXIMATE_THRESHOLD = 1_000_000


@dataclass(frozen=True)
class IndexParameters:
    """Build and quantization settings; ``n_postings`` of None follows the corpus size."""

    n_postings: int | None = None
    cluster_ratio: float = CLUSTER_RATIO
    summary_prune_ratio: float = SUMMARY_RATIO
    approximate_threshold: int = APPROXIMATE_THRESHOLD
    quantization_ceiling_ingest: float = sparse.CEILING_INGEST
    quantization_ceiling_search: float = sparse.CEILING_SEARCH

    def __post_init__(self):
        if self.n_postings is not None and self.n_postings <= 0:
            raise ValueError("n_postings must be positive")
        if not 0 < self.summary_prune_ratio <= 1:
            raise ValueError("summary_prune_ratio must be in (0, 1]")
        if not 0 < self.cluster_ratio < 1:
            raise ValueError("cluster_ratio must be in (0, 1)")
        if self.approximate_threshold < 0:
            raise ValueError("approximate_threshold must not be negative")
        if self.quantization_ceiling_ingest <= 0 or self.quantization_ceiling_search <= 0:
            raise ValueError("quantization ceilings must be positive")

    def postings(self, documents: int) -> int:
        return self.n_postings or max(int(documents * POSTING_RATIO), MIN_POSTINGS)


def fold_tokens(vectors: DataFrame) -> DataFrame:
    """``doc_id, token, weight`` with token ids folded; of tokens that meet, the largest weight stays."""
    return vectors.select("doc_id", sparse.fold(F.col("token")).alias("token"), "weight").groupBy("doc_id", "token").agg(F.max("weight").alias("weight"))


def quantized(vectors: DataFrame, ceiling: float = sparse.CEILING_INGEST) -> DataFrame:
    return vectors.select("doc_id", "token", sparse.quantize(F.col("weight"), ceiling).alias("weight"))


def postings(vectors: DataFrame, n: int) -> DataFrame:
    """The ``n`` heaviest documents of each token, with their place."""
    order = Window.partitionBy("token").orderBy(F.desc("weight"), "doc_id")
    return vectors.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def clusters(posted: DataFrame, vectors: DataFrame, cluster_ratio: float = CLUSTER_RATIO) -> DataFrame:
    """``token, cluster, doc_id, weight, must_visit``: each posting's document joins the centre with the largest dot product.

    Centres are the documents with the smallest hashes, ``ceil(n * ratio)`` of a token's ``n``. A posting list is cut to
    ``n_postings`` documents before, so the pairs of centres and members within a token are bounded."""
    size = Window.partitionBy("token")
    rows = posted.withColumn("n", F.count("*").over(size)).withColumn("_h", F.row_number().over(size.orderBy(F.xxhash64("doc_id", "token"), "doc_id")))
    small = rows.filter(F.col("n") < MIN_CLUSTERED).select("token", F.lit(0).alias("cluster"), "doc_id", "weight", F.lit(True).alias("must_visit"))
    large = rows.filter(F.col("n") >= MIN_CLUSTERED)
    centres = large.filter(F.col("_h") <= F.greatest(F.ceil(F.col("n") * cluster_ratio), F.lit(1))).select("token", (F.col("_h") - 1).cast("int").alias("cluster"), F.col("doc_id").alias("centre"))
    maps = vectors.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("token", F.col("weight").cast("double")))).alias("v"))
    members = large.select("token", "doc_id", "weight").join(maps, "doc_id")
    centres = centres.join(maps.select(F.col("doc_id").alias("centre"), F.col("v").alias("cv")), "centre")
    paired = members.join(centres, "token").select("token", "doc_id", "weight", "cluster", F.round(sparse.dot(F.col("v"), F.col("cv")), DIGITS).alias("near"))
    best = paired.groupBy("token", "doc_id", "weight").agg(F.max(F.struct("near", (-F.col("cluster")).alias("c"))).alias("best"))
    return small.unionByName(best.select("token", (-F.col("best.c")).cast("int").alias("cluster"), "doc_id", "weight", F.lit(False).alias("must_visit")))


def summaries(clustered: DataFrame, vectors: DataFrame, ratio: float = SUMMARY_RATIO) -> DataFrame:
    """``token, cluster, must_visit, summary_token, weight``: each cluster's largest weight by token, heaviest first, up to and
    including the entry that passes ``floor(total * ratio)``."""
    members = clustered.select("token", "cluster", "must_visit", "doc_id").join(vectors.select("doc_id", F.col("token").alias("summary_token"), F.col("weight").alias("w")), "doc_id")
    most = members.groupBy("token", "cluster", "must_visit", "summary_token").agg(F.max("w").alias("weight"))
    every = Window.partitionBy("token", "cluster")
    running = every.orderBy(F.desc("weight"), "summary_token").rowsBetween(Window.unboundedPreceding, 0)
    rows = most.withColumn("_total", F.sum("weight").over(every)).withColumn("_run", F.sum("weight").over(running))
    return rows.filter(F.col("_run") - F.col("weight") <= F.floor(F.col("_total") * ratio)).drop("_total", "_run")


@dataclass(frozen=True)
class SparseIndex:
    vectors: DataFrame
    clustered: DataFrame
    summary: DataFrame
    parameters: IndexParameters
    documents: int | None = None


def build(vectors: DataFrame, parameters: IndexParameters = IndexParameters(), documents: int | None = None) -> SparseIndex:
    """``vectors``: ``doc_id, token, weight`` with raw weights. ``documents``: the corpus size, counted if not given."""
    folded = quantized(fold_tokens(vectors), parameters.quantization_ceiling_ingest)
    documents = vectors.select("doc_id").distinct().count() if documents is None else documents
    clustered = clusters(postings(folded, parameters.postings(documents)), folded, parameters.cluster_ratio)
    return SparseIndex(folded, clustered, summaries(clustered, folded, parameters.summary_prune_ratio), parameters, documents)


def merge(indices: Sequence[SparseIndex], parameters: IndexParameters | None = None) -> SparseIndex:
    """One index of several with separate documents: their quantized vectors are kept, postings and clusters are made anew."""
    p = parameters or indices[0].parameters
    if any(x.parameters.quantization_ceiling_ingest != p.quantization_ceiling_ingest for x in indices):
        raise ValueError("indexes of different ceilings cannot be merged")
    vectors = indices[0].vectors
    for x in indices[1:]:
        vectors = vectors.unionByName(x.vectors)
    known = [x.documents for x in indices]
    documents = vectors.select("doc_id").distinct().count() if None in known else sum(known)
    clustered = clusters(postings(vectors, p.postings(documents)), vectors, p.cluster_ratio)
    return SparseIndex(vectors, clustered, summaries(clustered, vectors, p.summary_prune_ratio), p, documents)


def search_nested(index: SparseIndex, parents: DataFrame, tokens: Mapping[int, float], k: int = 10, children: int = 100, **more) -> DataFrame:
    """The ``k`` best parents by their best child. The index holds children; ``parents`` maps their ``doc_id`` to ``parent``.
    The search collects ``children`` of them."""
    found = search(index, tokens, max(k, children), **more).select("doc_id", "score").join(parents, "doc_id")
    return top(found.groupBy(F.col("parent").alias("doc_id")).agg(F.max("score").alias("score")), k)


def query_tokens(tokens: Mapping[int, float], parameters: IndexParameters, top_n: int | None = None) -> dict[int, int]:
    """Folded, quantized query tokens; only the ``top_n`` heaviest (ties by token)."""
    folded: dict[int, float] = {}
    for t, w in tokens.items():
        folded[int(t) % sparse.TOKEN_SPACE] = max(w, folded.get(int(t) % sparse.TOKEN_SPACE, 0.0))
    ceiling = parameters.quantization_ceiling_search
    kept = sorted(folded.items(), key=lambda x: (-x[1], x[0]))[:top_n]
    return {t: int(min(max(w, 0.0), ceiling) * sparse.MAX_BYTE / ceiling + 0.5) for t, w in kept}


def _weights(token: Column, query: Mapping[int, int]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in query.items() for x in pair]), token)


def exact(vectors: DataFrame, query: Mapping[int, int], parameters: IndexParameters, boost: float = 1.0) -> DataFrame:
    """Every document that shares a token with the query, by the rescaled product of quantized weights."""
    hits = vectors.filter(F.col("token").isin(*query)) if query else vectors.limit(0)
    product = hits.groupBy("doc_id").agg(F.sum(F.col("weight").cast("long") * _weights(F.col("token"), query).cast("long")).alias("product")) if query else hits.select("doc_id", F.lit(0).cast("long").alias("product"))
    scale = sparse.rescale(F.col("product"), boost, parameters.quantization_ceiling_ingest, parameters.quantization_ceiling_search)
    return product.filter("product > 0").select("doc_id", "product", F.round(scale, DIGITS).alias("score"))


def search(index: SparseIndex, tokens: Mapping[int, float], k: int = 10, top_n: int = 10, heap_factor: float = 1.0, filter: DataFrame | None = None, boost: float = 1.0, documents: int | None = None) -> DataFrame:
    """Approximate top ``k``. With a filter of at most ``k`` ids the filtered documents are scored exactly; with a larger one the
    approximate result is intersected with it and may be short. Small corpora (below the threshold) are scored exactly too.

    A first pass over the best clusters gives the ``k``-th best score; clusters whose summary times ``heap_factor`` cannot reach it
    are skipped in the second."""
    if k <= 0 or top_n <= 0 or heap_factor <= 0:
        raise ValueError("k, top_n and heap_factor must be positive")
    p = index.parameters
    if filter is not None and filter.limit(k + 1).count() <= k:
        return top(exact(index.vectors.join(filter, "doc_id", "left_semi"), query_tokens(tokens, p), p, boost), k)
    if documents is not None and documents < p.approximate_threshold:
        scored = exact(index.vectors, query_tokens(tokens, p), p, boost)
        return top(scored if filter is None else scored.join(filter, "doc_id", "left_semi"), k)
    query = query_tokens(tokens, p, top_n)
    own = index.summary.filter(F.col("token").isin(*query))
    scored = own.groupBy("token", "cluster", "must_visit").agg(F.sum(F.col("weight").cast("long") * F.coalesce(_weights(F.col("summary_token"), query), F.lit(0)).cast("long")).alias("bound"))
    best = scored.orderBy(F.desc("bound"), "token", "cluster").limit(k)
    lists = index.clustered.filter(F.col("token").isin(*query)).select("token", "cluster", "doc_id")

    def candidates(chosen: DataFrame) -> DataFrame:
        return lists.join(chosen.select("token", "cluster"), ["token", "cluster"], "left_semi").select("doc_id").distinct()

    first = exact(index.vectors.join(candidates(best), "doc_id", "left_semi"), query, p, boost)
    floor = top(first, k).agg(F.when(F.count("*") == k, F.min("product")).otherwise(0).alias("floor"))  # one row
    worth = scored.join(F.broadcast(floor)).filter(F.col("must_visit") | (F.col("bound") * heap_factor >= F.col("floor")))
    found = exact(index.vectors.join(candidates(worth), "doc_id", "left_semi"), query, p, boost)
    return top(found if filter is None else found.join(filter, "doc_id", "left_semi"), k)


def explain(index: SparseIndex, tokens: Mapping[int, float], doc_ids: list | DataFrame, boost: float = 1.0) -> DataFrame:
    """For each named document (ids, or a table with ``doc_id``): the product, the rescaled score and the contribution of each shared token."""
    p = index.parameters
    query = query_tokens(tokens, p)
    hits = index.vectors.filter(F.col("token").isin(*query))
    hits = hits.join(doc_ids, "doc_id", "left_semi") if isinstance(doc_ids, DataFrame) else hits.filter(F.col("doc_id").isin(*doc_ids))
    each = F.struct("token", F.col("weight").cast("long").alias("document_weight"), _weights(F.col("token"), query).cast("long").alias("query_weight"))
    rows = hits.groupBy("doc_id").agg(F.array_sort(F.collect_list(each)).alias("tokens"))
    product = F.aggregate("tokens", F.lit(0).cast("long"), lambda s, t: s + t["document_weight"] * t["query_weight"])
    text = F.array_join(F.transform("tokens", lambda t: F.concat(t["token"].cast("string"), F.lit(": "), t["query_weight"].cast("string"), F.lit(" x "), t["document_weight"].cast("string"))), ", ")
    return rows.select("doc_id", product.alias("product"), F.round(sparse.rescale(product, boost, p.quantization_ceiling_ingest, p.quantization_ceiling_search), DIGITS).alias("score"), text.alias("explanation"))

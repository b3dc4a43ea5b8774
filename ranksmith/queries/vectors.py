"""Dense and sparse vector operators over ``embeddings`` and ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.functions import sparse, text, vectors
from ranksmith.functions.binding import once
from ranksmith.operators import retrieval, sparse_index
from ranksmith.plans.engine import Engine
from ranksmith.queries.registry import Registry, Tables

R = Registry()
QUERY = {"the": 1.5, "of": 0.9, "pathetic": 2.0, "and": 0.4, "idiot": 1.1, "to": 0.2}

_PAIR = """with q as (select embedding::double[] as qv from embeddings where vec_id = 0),
p as (select vec_id as doc_id, label, embedding::double[] as e, qv from embeddings, q)"""
_L2 = "list_reduce(list_transform(range(1, len(e) + 1), lambda i: (e[i] - qv[i]) * (e[i] - qv[i])), lambda a, b: a + b)"
_COS = "list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv)))"


def _knn(t: Tables, **more) -> DataFrame:
    return retrieval.knn(t.embeddings, t.query_vector(), doc_id="vec_id", **more)


def _spaces(t: Tables) -> DataFrame:
    q = vectors.literal(t.query_vector())
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), *[F.round(vectors.score(F.col("embedding"), q, s), 6).alias(s) for s in ("l1", "linf", "hamming")])


R.add("knn_topk", lambda t: _knn(t, k=25), f"{_PAIR} select doc_id, round(1 / (1 + sqrt({_L2}) ** 2), 6) as score from p order by score desc, doc_id limit 25")
R.add("knn_l2", lambda t: _knn(t, min_score=0.0, space="l2"), f"{_PAIR} select doc_id, round(1 / (1 + sqrt({_L2}) ** 2), 6) as score from p")
R.add("knn_cosine", lambda t: _knn(t, min_score=-1.0, space="cosinesimil"), f"{_PAIR} select doc_id, round((1 + {_COS}) / 2, 6) as score from p")
R.add("knn_ip", lambda t: _knn(t, min_score=-1.0, space="innerproduct"), f"{_PAIR}, d as (select doc_id, list_dot_product(e, qv) as ip from p) select doc_id, round(case when ip >= 0 then ip + 1 else 1 / (1 - ip) end, 6) as score from d")
R.add("knn_radial", lambda t: _knn(t, max_distance=1.25), f"{_PAIR}, d as (select doc_id, sqrt({_L2}) as x from p) select doc_id, round(1 / (1 + x ** 2), 6) as score from d where round(x, 6) <= 1.25")
R.add("knn_min_score", lambda t: _knn(t, min_score=0.6, space="cosinesimil"), f"{_PAIR}, d as (select doc_id, round((1 + {_COS}) / 2, 6) as score from p) select * from d where score >= 0.6")
R.add("knn_filtered", lambda t: _knn(t, k=15, filter=F.col("label") == 3), f"{_PAIR} select doc_id, round(1 / (1 + sqrt({_L2}) ** 2), 6) as score from p where label = 3 order by score desc, doc_id limit 15")
R.add(
    "knn_spaces",
    _spaces,
    f"""{_PAIR}, d as (select doc_id, list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - qv[i])) as d from p)
select doc_id, round(1 / (1 + list_reduce(d, lambda a, b: a + b)), 6) as l1, round(1 / (1 + list_max(d)), 6) as linf, round(1.0::double / (1 + len(list_filter(d, lambda x: x <> 0))), 6) as hamming from d""",
)


def encoded(t: Tables) -> DataFrame:
    """Documents with token weights ``1 + ln(count)``."""
    return t.documents.select("doc_id", once(sparse.term_frequencies(text.tokens(F.col("text")))).alias("tokens"))


def asked(t: Tables, terms) -> DataFrame:
    """The same, with the tokens of a query only: what the query does not ask for is not encoded."""
    return t.documents.select("doc_id", sparse.term_frequencies(text.tokens_among(F.col("text"), terms)).alias("tokens"))


def entries(t: Tables) -> DataFrame:
    """The same as ``doc_id, token, weight``."""
    words = t.documents.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "token").agg((1 + F.log(F.count("*").cast("double"))).alias("weight"))


def numbered(t: Tables) -> DataFrame:
    """``doc_id, token id, weight``: the token id is the CRC of the token."""
    return entries(t).select("doc_id", F.crc32("token").alias("token"), "weight")


_ENTRIES = """words as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as token from documents),
ent as (select doc_id, token, 1 + ln(count(*)::double) as weight from words group by doc_id, token)"""
_QUERY = "qt as (select * from (values " + ", ".join(f"('{k}', {v}::double)" for k, v in QUERY.items()) + ") v(token, qw))"

R.add("sparse_encode_tf", lambda t: encoded(t).select("doc_id", F.explode("tokens").alias("token", "weight")).withColumn("weight", F.round("weight", 6)), f"with {_ENTRIES} select doc_id, token, round(weight, 6) as weight from ent")
R.add("sparse_dot", lambda t: retrieval.sparse_match(asked(t, QUERY), QUERY), f"with {_ENTRIES}, {_QUERY} select doc_id, round(sum(weight * qw), 6) as score from ent join qt using (token) group by doc_id")
_ANALYZED = retrieval.analyzed_query("The PATHETIC, the idiot of", {"of": 0.5})
R.add(
    "sparse_analyzer",
    lambda t: retrieval.sparse_match(asked(t, _ANALYZED), _ANALYZED),
    f"with {_ENTRIES}, qt(token, qw) as (values ('the', 1.0::double), ('pathetic', 1.0), ('idiot', 1.0), ('of', 0.5)) select doc_id, round(sum(weight * qw), 6) as score from ent join qt using (token) group by doc_id",
)
def _two_phase(t: Tables) -> DataFrame:
    request = {"query": {"neural_sparse": {"tokens": {"query_tokens": QUERY, "boost": 1.5}}}, "size": 20, "_source": []}
    return Engine(asked(t, QUERY)).search(request, {"request_processors": [{"neural_sparse_two_phase_processor": {}}]})


R.add(
    "sparse_two_phase",
    _two_phase,
    f"""with {_ENTRIES}, {_QUERY},
one as (select doc_id, round(sum(weight * qw) * 1.5, 6) as score from ent join qt using (token) where qw >= 0.4 * 2.0 group by doc_id order by score desc, doc_id limit 100),
low as (select doc_id, round(sum(weight * qw) * 1.5, 6) as extra from ent join qt using (token) where qw < 0.4 * 2.0 group by doc_id)
select doc_id, round(score + coalesce(extra, 0), 6) as score from one left join low using (doc_id) order by score desc, doc_id limit 20""",
)


def _pruned(kind: str, ratio: float):
    def build(t: Tables) -> DataFrame:
        pruned = encoded(t).select("doc_id", once(sparse.prune(F.col("tokens"), kind, ratio)).alias("tokens"))
        return pruned.select("doc_id", F.explode("tokens").alias("token", "weight")).withColumn("weight", F.round("weight", 6))

    return build


_OVER = "over (partition by doc_id order by round(weight, 9) desc, token rows between unbounded preceding and current row)"
_KEPT = {
    ("top_k", 5): "row_number() over (partition by doc_id order by round(weight, 9) desc, token) <= 5",
    ("max_ratio", 0.6): "weight >= max(weight) over (partition by doc_id) * 0.6",
    ("abs_value", 1.5): "weight >= 1.5",
    ("alpha_mass", 0.4): f"sum(weight) {_OVER} <= sum(weight) over (partition by doc_id) * 0.4 + 1e-9",
}
for (_kind, _ratio), _condition in _KEPT.items():
    R.add(f"prune_{_kind}", _pruned(_kind, _ratio), f"with {_ENTRIES} select doc_id, token, round(weight, 6) as weight from ent {'where' if _kind == 'abs_value' else 'qualify'} {_condition}")


def _split(t: Tables) -> DataFrame:
    high, low = sparse.split(F.col("tokens"), "max_ratio", 0.6)
    parts = encoded(t).select("doc_id", F.explode_outer(F.create_map(F.lit("h"), high, F.lit("l"), low)).alias("part", "tokens"))
    return parts.select("doc_id", "part", F.explode("tokens").alias("token", "weight")).withColumn("weight", F.round("weight", 6))


R.add("prune_split", _split, f"with {_ENTRIES} select doc_id, case when weight >= max(weight) over (partition by doc_id) * 0.6 then 'h' else 'l' end as part, token, round(weight, 6) as weight from ent")
R.add("quantize", lambda t: t.events.select("event_id", sparse.quantize(F.col("value") / 10).alias("w")), "select event_id, floor(greatest(0, least(value / 10, 3.0)) * 255 / 3.0 + 0.5)::int as w from events")

# CRC-32 has no SQL twin in DuckDB; tokens of parts stand in for token ids.
_PART_ENTRIES = "part_ent as (select l_orderkey as doc_id, l_partkey * 977 as token, l_quantity / 16.0 as weight from lineitem)"


def _part_vectors(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 977).alias("token"), (F.col("l_quantity") / 16.0).alias("weight"))


_FOLDED = f"{_PART_ENTRIES}, folded as (select doc_id, (token % 32768)::int as token, max(weight) as weight from part_ent group by all), quant as (select doc_id, token, floor(greatest(0, least(weight, 3.0)) * 255 / 3.0 + 0.5)::int as weight from folded)"
_PART_QUERY = {int(k) * 977: 1.0 + k / 8.0 for k in range(40)}
R.add("sparse_fold", lambda t: sparse_index.fold_tokens(_part_vectors(t)), f"with {_FOLDED} select * from folded")


def _dot(t: Tables) -> DataFrame:
    p = sparse_index.IndexParameters()
    return sparse_index.exact(sparse_index.quantized(sparse_index.fold_tokens(_part_vectors(t))), sparse_index.query_tokens(_PART_QUERY, p), p)


_PART_Q = ", ".join(f"({k % 32768}, {int(min(v, 16.0) * 255 / 16.0 + 0.5)})" for k, v in _PART_QUERY.items())
_DOT = f"with {_FOLDED}, qt(token, qw) as (values {_PART_Q}), prod as (select doc_id, sum(weight::bigint * qw)::bigint as product from quant join qt using (token) group by doc_id)"
R.add("sparse_dot_quantized", _dot, f"{_DOT} select doc_id, product, round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score from prod where product > 0")
R.add(
    "seismic_postings",
    lambda t: sparse_index.postings(sparse_index.quantized(sparse_index.fold_tokens(_part_vectors(t))), 12).select("token", "doc_id", "weight", "place"),
    f"with {_FOLDED} select token, doc_id, weight, row_number() over (partition by token order by weight desc, doc_id)::int as place from quant qualify place <= 12",
)
_PARAMETERS = sparse_index.IndexParameters(n_postings=200)


def _index(t: Tables) -> sparse_index.SparseIndex:
    return sparse_index.build(_part_vectors(t), _PARAMETERS)


def _clusters(t: Tables) -> DataFrame:
    return _index(t).clustered


def _given_clusters(t: Tables) -> tuple[DataFrame, DataFrame]:
    """A clustering that SQL can also make: four clusters by order number."""
    folded = sparse_index.quantized(sparse_index.fold_tokens(_part_vectors(t)))
    return folded.select("token", (F.col("doc_id") % 4).cast("int").alias("cluster"), "doc_id", "weight", F.lit(False).alias("must_visit")), folded


R.add("seismic_clusters", _clusters)
R.add(
    "seismic_summary",
    lambda t: sparse_index.summaries(*_given_clusters(t)).select("token", "cluster", "summary_token", "weight"),
    f"""with {_FOLDED}, mem as (select a.token, (a.doc_id % 4)::int as cluster, b.token as summary_token, max(b.weight) as weight from quant a join quant b using (doc_id) group by all)
select token, cluster, summary_token, weight from mem
qualify sum(weight) over (partition by token, cluster order by weight desc, summary_token rows between unbounded preceding and current row) - weight <= floor(sum(weight) over (partition by token, cluster) * 0.4)""",
)
R.add("sparse_ann", lambda t: sparse_index.search(_index(t), _PART_QUERY, k=10, top_n=40))
R.add(
    "sparse_ann_exact",
    lambda t: sparse_index.search(_index(t), _PART_QUERY, k=10, documents=1000),
    f"{_DOT} select doc_id, product, round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score from prod where product > 0 order by score desc, doc_id limit 10",
)
R.add("sparse_ann_filtered", lambda t: sparse_index.search(_index(t), _PART_QUERY, k=10, top_n=40, filter=t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc_id"))))
R.add(
    "sparse_ann_filtered_exact",
    lambda t: sparse_index.search(_index(t), _PART_QUERY, k=50, filter=t.orders.filter("o_custkey = 7").select(F.col("o_orderkey").alias("doc_id"))),
    f"{_DOT} select doc_id, product, round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score from prod where product > 0 and doc_id in (select o_orderkey from orders where o_custkey = 7) order by score desc, doc_id limit 50",
)


def _explained(t: Tables) -> DataFrame:
    index = _index(t)
    return sparse_index.explain(index, _PART_QUERY, sparse_index.search(index, _PART_QUERY, k=10, documents=1000).select("doc_id"))


R.add(
    "sparse_explain",
    _explained,
    f"""{_DOT}, best as (select doc_id from prod where product > 0 order by round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) desc, doc_id limit 10)
select doc_id, sum(weight::bigint * qw)::bigint as product, round(sum(weight::bigint * qw)::bigint * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score,
  string_agg(token || ': ' || qw || ' x ' || weight, ', ' order by token) as explanation
from quant join qt using (token) join best using (doc_id) group by doc_id""",
)
R.add(
    "sparse_merge",
    lambda t: sparse_index.search(sparse_index.merge([sparse_index.build(_part_vectors(t).join(t.orders.filter(F.col("o_orderstatus") == x), F.col("doc_id") == F.col("o_orderkey"), "left_semi"), _PARAMETERS) for x in "FOP"]), _PART_QUERY, k=10, documents=1000),
    f"{_DOT} select doc_id, product, round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score from prod where product > 0 and doc_id in (select o_orderkey from orders) order by score desc, doc_id limit 10",
)


def _by_customer(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("parent"))


R.add(
    "sparse_nested",
    lambda t: sparse_index.search_nested(_index(t), _by_customer(t), _PART_QUERY, k=10, children=200, documents=1000),
    f"""{_DOT}, best as (select doc_id, round(product * (1.0::double * 3.0 * 16.0 / 255 / 255), 6) as score from prod where product > 0 order by score desc, doc_id limit 200)
select o_custkey as doc_id, max(score) as score from best join orders on o_orderkey = best.doc_id group by 1 order by score desc, doc_id limit 10""",
)

QUERIES, ORACLE_SQL = R.queries, R.sql

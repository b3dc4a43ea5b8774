"""Hybrid retrieval over ``documents`` and ``embeddings`` (ids are shared): fusion and shaping of the result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.operators import fusion, retrieval, shaping
from ranksmith.plans.engine import Engine
from ranksmith.queries.registry import Registry, Tables

TERMS = ("the", "of", "pathetic")
DEPTH = 50
R = Registry()


def lists(t: Tables, filter=None, text_filter=None) -> list[DataFrame]:
    near = retrieval.knn(t.embeddings, t.query_vector(), k=DEPTH, space="cosinesimil", doc_id="vec_id", filter=filter)
    return [near, retrieval.match(t.documents, " ".join(TERMS), filter=text_filter)]


def lexical_sql(terms=TERMS, where="true", name="lex") -> str:
    each = ", ".join(f"len(list_filter(w, lambda x: x = '{x}'))::double as t{i}" for i, x in enumerate(terms))
    stats = ", ".join(f"sum((t{i} > 0)::int)::double as f{i}" for i in range(len(terms)))
    score = " + ".join(f"ln(1 + (n - f{i} + 0.5) / (f{i} + 0.5)) * t{i} / (t{i} + 1.2 * (1 - 0.75 + 0.75 * dl / a))" for i in range(len(terms)))
    some = " or ".join(f"t{i} > 0" for i in range(len(terms)))
    return f"""
{name}_w as (select *, regexp_extract_all(lower(text), '[a-z0-9]+') as w from documents),
{name}_t as (select doc_id, lang, source, len(w)::double as dl, {each} from {name}_w),
{name}_s as (select count(*)::double as n, avg(dl) as a, {stats} from {name}_t),
{name} as (select doc_id, round({score}, 6) as score from {name}_t, {name}_s where ({some}) and {where})"""


def similar_sql(where="true") -> str:
    return f"""
q as (select embedding::double[] as qv from embeddings where vec_id = 0),
sim as (
  select vec_id as doc_id, round((1 + list_dot_product(e, qv) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qv, qv)))) / 2, 6) as score
  from (select vec_id, label, embedding::double[] as e from embeddings), q where {where} order by score desc, doc_id limit {DEPTH})"""


def ranked_sql(depth=DEPTH, lex_where="true", sim_where="true") -> str:
    return f"""with {lexical_sql(where=lex_where)}, {similar_sql(sim_where)},
both_lists as (select 0 as sub_query, * from sim union all select 1, * from lex),
ranked as (
  select *, row_number() over (partition by sub_query order by score desc, doc_id) as place from both_lists where score > 0
  qualify place <= {depth})"""


NORMED = {
    "min_max": "case when mn = mx then 1.0 when score = mn then 0.001 else (score - mn) / (mx - mn) end",
    "l2": "case when l2 = 0 then 0.0 else score / l2 end",
    "z_score": "case when abs(score - av) < 1e-9 then mx when sd = 0 then mn when (score - av) / sd <= 0 then 0.001 else (score - av) / sd end",
    "rrf": "round(1 / (60.0::double + place), 10)",
}
STATS = """stats as (
  select *, min(score) over s as mn, max(score) over s as mx, sqrt(sum(score * score) over s) as l2, avg(score) over s as av, coalesce(stddev_samp(score) over s, 0) as sd
  from ranked window s as (partition by sub_query))"""


def normed_sql(technique: str, **where) -> str:
    return f"{ranked_sql(**where)}, {STATS}, normed as (select sub_query, doc_id, score, ({NORMED[technique]})::double as v from stats)"


def pivoted_sql(technique: str = "min_max", **where) -> str:
    return f"""{normed_sql(technique, **where)},
piv as (select doc_id, coalesce(max(v) filter (sub_query = 0), 0.0) as s0, coalesce(max(v) filter (sub_query = 1), 0.0) as s1 from normed group by doc_id)"""


def combined_sql(how: str, w0: float = 1.0, w1: float = 1.0) -> str:
    return {
        "arithmetic_mean": f"(s0 * {w0} + s1 * {w1}) / ({w0} + {w1})",
        "geometric_mean": f"exp((case when s0 > 0 then ln(s0) * {w0} else 0.0 end + case when s1 > 0 then ln(s1) * {w1} else 0.0 end) / (case when s0 > 0 then {w0} else 0.0 end + case when s1 > 0 then {w1} else 0.0 end))",
        "harmonic_mean": f"(case when s0 > 0 then {w0} else 0.0 end + case when s1 > 0 then {w1} else 0.0 end) / (case when s0 > 0 then {w0} / s0 else 0.0 end + case when s1 > 0 then {w1} / s1 else 0.0 end)",
        "rrf": f"s0 * {w0} + s1 * {w1}",
    }[how]


def fused_sql(how: str = "arithmetic_mean", technique: str = "min_max", w0: float = 1.0, w1: float = 1.0, **where) -> str:
    return f"{pivoted_sql(technique, **where)}, fused as (select doc_id, round(({combined_sql(how, w0, w1)})::double, 6) as score from piv)"


def fused(t: Tables, **more) -> DataFrame:
    return fusion.fuse(lists(t), DEPTH, **more)


def search(t: Tables, pipeline: dict | None = None, depth: int = DEPTH, filter: dict | None = None, **request) -> DataFrame:
    """The two sub-queries as one request to the engine, over documents with the vectors that some of them have."""
    corpus = t.documents.join(t.embeddings.select(F.col("vec_id").alias("doc_id"), "label", "embedding"), "doc_id", "left")
    near = {"knn": {"embedding": {"vector": t.query_vector(), "k": DEPTH}}}
    hybrid = {"queries": [near, {"match": {"text": " ".join(TERMS)}}], "pagination_depth": depth, **({"filter": filter} if filter else {})}
    return Engine(corpus, space="cosinesimil").search({"query": {"hybrid": hybrid}, **request}, pipeline)


def with_fields(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id")


# Retrieval into one list for each sub-query.
R.add("hybrid_topk", lambda t: fusion.rank_lists(lists(t), DEPTH), f"{ranked_sql()} select sub_query, doc_id, score, place::int as place from ranked")
_EN = "doc_id in (select doc_id from documents where lang = 'en')"
#: The engine knows vectors of documents only.
_KNOWN = "vec_id in (select doc_id from documents)"
R.add(
    "hybrid_filter",
    lambda t: search(t, filter={"term": {"lang": "en"}}, size=100, _source=["lang"]),
    f"{fused_sql(lex_where=_EN, sim_where=_EN.replace('doc_id in', 'vec_id in'))} select doc_id, score, lang from fused join documents using (doc_id) order by score desc, doc_id limit 100",
)
R.add(
    "hybrid_dls",
    lambda t: fusion.rank_lists(lists(t, F.col("label").isin(1, 2, 3), F.col("lang").isin("en", "fr")), DEPTH),
    ranked_sql(lex_where="lang in ('en', 'fr')", sim_where="label in (1, 2, 3)") + " select sub_query, doc_id, score, place::int as place from ranked",
)
R.add("hybrid_pagination", lambda t: shaping.page(fusion.fuse(lists(t), 30), 10, 5), f"{fused_sql(depth=30)} select * from fused order by score desc, doc_id limit 10 offset 5")
R.add(
    "hybrid_bool_wrapped",
    lambda t: retrieval.boolean(should=lists(t), filter=[retrieval.constant(t.documents, F.col("lang") == "en")], minimum=1),
    f"with {lexical_sql()}, {similar_sql()} select doc_id, round(sum(score), 6) as score from (select * from sim union all select * from lex) join documents using (doc_id) where lang = 'en' group by doc_id",
)

# Normalization and combination.
for _technique in ("min_max", "l2", "z_score", "rrf"):
    R.add(
        f"norm_{_technique}",
        lambda t, n=_technique: fusion.normalize(fusion.rank_lists(lists(t), DEPTH), n).select("sub_query", "doc_id", F.round("normalized", 6).alias("normalized")),
        f"{normed_sql(_technique)} select sub_query, doc_id, round(v, 6) as normalized from normed",
    )
_LOWER = [{"mode": "apply", "min_score": 0.55}, {"mode": "clip", "min_score": 0.02}]
_UPPER = [{"mode": "clip", "max_score": 0.6}, {"mode": "apply", "max_score": 0.04}]
R.add(
    "norm_min_max_lower",
    lambda t: fusion.normalize(fusion.rank_lists(lists(t), DEPTH), "min_max", lower_bounds=_LOWER).select("sub_query", "doc_id", F.round("normalized", 6).alias("normalized")),
    f"""{ranked_sql()}, {STATS},
e as (select *, case sub_query when 0 then case when mx > 0.55 and score > 0.55 then 0.55 else mn end else case when mx < 0.02 then mn else 0.02 end end as lo from stats)
select sub_query, doc_id, round((case when mn = mx then 1.0 when sub_query = 1 and score < lo then 0.001 when lo = mx then 1.0 when score = lo then 0.001 else (score - lo) / (mx - lo) end)::double, 6) as normalized from e""",
)
R.add(
    "norm_min_max_upper",
    lambda t: fusion.normalize(fusion.rank_lists(lists(t), DEPTH), "min_max", upper_bounds=_UPPER).select("sub_query", "doc_id", F.round("normalized", 6).alias("normalized")),
    f"""{ranked_sql()}, {STATS},
e as (select *, case sub_query when 0 then case when mn > 0.6 then mx else 0.6 end else case when mn < 0.04 and score < 0.04 then 0.04 else mx end end as hi from stats)
select sub_query, doc_id, round((case when mn = mx then 1.0 when sub_query = 0 and score > hi then 1.0 when mn = hi then 1.0 when score = mn then 0.001 else (score - mn) / (hi - mn) end)::double, 6) as normalized from e""",
)
R.add(
    "combine_pivot",
    lambda t: fusion.pivot(fusion.normalize(fusion.rank_lists(lists(t), DEPTH)), 2).select("doc_id", F.round("s0", 6).alias("s0"), F.round("s1", 6).alias("s1")),
    f"{pivoted_sql()} select doc_id, round(s0, 6) as s0, round(s1, 6) as s1 from piv",
)
for _how, _short in (("arithmetic_mean", "arithmetic"), ("geometric_mean", "geometric"), ("harmonic_mean", "harmonic")):
    R.add(f"comb_{_short}", lambda t, h=_how: fused(t, combination=h), f"{fused_sql(_how)} select * from fused")
    R.add(f"comb_{_short}_weighted", lambda t, h=_how: fused(t, combination=h, weights=[0.7, 0.3]), f"{fused_sql(_how, w0=0.7, w1=0.3)} select * from fused")
R.add("rrf_fusion", lambda t: fused(t, normalization="rrf", combination="rrf"), f"{fused_sql('rrf', 'rrf')} select * from fused")
R.add("z_score_fusion", lambda t: fused(t, normalization="z_score"), f"{fused_sql(technique='z_score')} select * from fused")
R.add("l2_fusion", lambda t: fused(t, normalization="l2"), f"{fused_sql(technique='l2')} select * from fused")

# Shaping.
R.add("hybrid_min_score", lambda t: shaping.at_least(fused(t), 0.3), f"{fused_sql()} select * from fused where score >= 0.3")
R.add("hybrid_sort_score", lambda t: shaping.page(fused(t), 20), f"{fused_sql()} select * from fused order by score desc, doc_id limit 20")
_FIELDS = "lex_and_sim as (select sub_query, doc_id, source, n_chars from both_lists join documents using (doc_id) where score > 0)"


def _sorted_sql(order: str, after: str = "true", limit: int = 30) -> str:
    return f"""{ranked_sql(sim_where=_KNOWN)}, {_FIELDS},
s as (select *, row_number() over (partition by sub_query order by {order}, doc_id) as p from lex_and_sim where {after} qualify p <= 30)
select distinct doc_id, null::double as score, source, n_chars from s order by {order}, doc_id limit {limit}"""


R.add("hybrid_sort_field", lambda t: search(t, depth=30, size=30, sort=[{"n_chars": "desc"}], _source=["source", "n_chars"]), _sorted_sql("n_chars desc nulls last"))
R.add(
    "hybrid_sort_multi",
    lambda t: search(t, depth=30, size=30, sort=["source", {"n_chars": {"order": "desc"}}], _source=["source", "n_chars"]),
    _sorted_sql("source nulls last, n_chars desc nulls last"),
)
R.add(
    "hybrid_search_after",
    lambda t: search(t, depth=30, sort=[{"n_chars": "desc"}], search_after=[1000], _source=["source", "n_chars"]),
    _sorted_sql("n_chars desc nulls last", "(n_chars < 1000 or n_chars is null)", 10),
)
R.add(
    "hybrid_search_after_score",
    lambda t: shaping.page(shaping.search_after(fused(t), shaping.BY_SCORE, [0.5], 10), 10),
    f"{fused_sql()} select * from fused where score < 0.5 or (score = 0.5 and doc_id > 10) order by score desc, doc_id limit 10",
)
R.add(
    "hybrid_collapse",
    lambda t: search(t, size=DEPTH, collapse={"field": "source"}, _source=["source"]),
    f"{fused_sql(sim_where=_KNOWN)} select doc_id, source, score from fused join documents using (doc_id) qualify row_number() over (partition by source order by score desc, doc_id) = 1",
)
R.add(
    "hybrid_post_filter",
    lambda t: search(t, size=100, post_filter={"term": {"lang": "en"}}, _source=["lang"]),
    fused_sql(lex_where=_EN, sim_where=_KNOWN).replace("sim as (", "near as (").replace("both_lists as (", f"sim as (select * from near where {_EN}), both_lists as (")
    + " select doc_id, lang, score from fused join documents using (doc_id) order by score desc, doc_id limit 100",
)
R.add(
    "rescore_window",
    lambda t: shaping.rescore(fused(t), retrieval.match(t.documents, "pathetic"), 20, 0.7, 1.2),
    f"""{fused_sql()}, {lexical_sql(("pathetic",), name="second")},
h as (select *, row_number() over (order by score desc, doc_id) as p from fused)
select h.doc_id, round(case when p <= 20 then h.score * 0.7 + coalesce(s.score, 0) * 1.2 else h.score end, 6) as score from h left join second s using (doc_id)""",
)
R.add(
    "inner_hits",
    lambda t: retrieval.inner_hits(_turns(t), 2).select("doc_id", "child", "score", "place"),
    """select conv_id as doc_id, turn::int as child, score, place::int as place from (
  select conv_id, turn, n as score, row_number() over (partition by conv_id order by n desc, turn) as place
  from (select conv_id, turn, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::double as n from conversations) where n > 0) where place <= 2""",
)
R.add(
    "nested_max",
    lambda t: retrieval.nested_max(_turns(t)),
    "select conv_id as doc_id, max(n) as score from (select conv_id, len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'))::double as n from conversations) where n > 0 group by conv_id",
)


def _turns(t: Tables) -> DataFrame:
    from ranksmith.functions import text

    words = F.size(text.tokens(F.col("text"))).cast("double")
    return t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("child"), words.alias("score")).filter("score > 0")


def _explained_sql() -> str:
    fixed = "printf('%.6f', round({}, 6))"
    part = "case when s{0} > 0 then '[' || " + fixed.format("s{0}") + " || ' min_max normalization of: sub-query {0} score ' || " + fixed.format("r{0}") + " || ']' end"
    return f"""{pivoted_sql()}, raw as (select doc_id, max(score) filter (sub_query = 0) as r0, max(score) filter (sub_query = 1) as r1 from normed group by doc_id),
x as (select *, round((({combined_sql('arithmetic_mean')}))::double, 6) as score from piv join raw using (doc_id))
select doc_id, score, {fixed.format('score')} || ' arithmetic_mean combination of: ' || concat_ws(', ', {part.format(0)}, {part.format(1)}) as explanation from x"""


R.add("hybrid_explain", lambda t: fusion.explain(lists(t), DEPTH), _explained_sql())

# Clauses on their own.
R.add("bm25_match", lambda t: retrieval.match(t.documents, " ".join(TERMS)), f"with {lexical_sql()} select * from lex")
R.add(
    "bool_query",
    lambda t: retrieval.boolean(
        must=[retrieval.constant(t.orders, F.col("o_orderstatus") == "F", 1.0, "o_orderkey")],
        should=[retrieval.constant(t.orders, F.col("o_totalprice") >= 200000, 2.0, "o_orderkey"), retrieval.constant(t.orders, F.col("o_orderpriority") == "1-URGENT", 0.5, "o_orderkey")],
        must_not=[retrieval.constant(t.orders, F.col("o_orderpriority") == "5-LOW", 1.0, "o_orderkey")],
        filter=[retrieval.constant(t.orders, F.col("o_totalprice") > 1000, 1.0, "o_orderkey")],
    ),
    """select o_orderkey as doc_id, (1.0 + case when o_totalprice >= 200000 then 2.0 else 0 end + case when o_orderpriority = '1-URGENT' then 0.5 else 0 end)::double as score
from orders where o_orderstatus = 'F' and not coalesce(o_orderpriority = '5-LOW', false) and o_totalprice > 1000""",
)

QUERIES, ORACLE_SQL = R.queries, R.sql

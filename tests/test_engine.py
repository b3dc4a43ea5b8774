import pytest
from pyspark.sql import functions as F

from ranksmith.functions import sparse, text
from ranksmith.operators import aggregations as A
from ranksmith.operators import ingest, models, post, sparse_index
from ranksmith.plans import dsl
from ranksmith.plans.engine import Engine, fusion_settings

DOCS = [
    (1, "Hello world", [1.0, 0.0], 130, "workable"),
    (2, "Hi to this place", [0.0, 1.0], 100, None),
    (3, "We would like to welcome everyone to this place", [0.6, 0.8], 200, "angry"),
    (4, "Hello, I'm glad to see you", [0.8, 0.6], 25, "likeable"),
    (5, "People keep telling me orange", [-1.0, 0.0], 30, "entire"),
    (6, "Nothing", [0.0, -1.0], 350, "entire"),
]
EVERY = {"match_all": {}}


def both(**groups):
    return {"bool": groups}


def between(**limits):
    return {"range": {"price": limits}}


def words(text_, name="body"):
    return {"match": {name: text_}}


def hybrid(*queries, **more):
    return {"hybrid": {"queries": list(queries), **more}}


TWO = hybrid(words("hello place"), {"knn": {"vec": {"vector": [1.0, 0.0], "k": 3}}})


@pytest.fixture(scope="module")
def engine(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, body string, vec array<float>, price int, keyword string")
    df = df.withColumn("tokens", sparse.term_frequencies(text.tokens(F.col("body")))).repartition(3).cache()
    registry = models.ModelRegistry()
    registry.register("unit", models.Model("unit", "dense", function=lambda texts: [[1.0, 0.0] for _ in texts]))
    registry.register("terms", models.Model("terms", "sparse", function=lambda texts: [{w: 1.0 for w in t.lower().split()} for t in texts]))
    registry.register("length", models.Model("length", "score", function=lambda pairs: [float(len(d)) for _, d in pairs]))
    return Engine(df, registry, agent=lambda q, b: {"query": words(q), "size": 2})


def ids(df):
    return [r.doc_id for r in df.collect()]


def test_hybrid_request_and_pipelines(engine):
    assert ids(engine.search({"query": TWO}))[0] in (1, 4)
    by_rank = {"phase_results_processors": [{"score-ranker-processor": {"combination": {"technique": "rrf", "rank_constant": 10}}}]}
    hits = engine.search({"query": TWO}, by_rank).collect()
    assert max(r.score for r in hits) <= 2 / 11 + 1e-9 and {r.doc_id for r in hits} == {1, 2, 3, 4}
    weighted = {"phase_results_processors": [{"normalization-processor": {"normalization": {"technique": "l2"}, "combination": {"technique": "harmonic_mean", "parameters": {"weights": [0.3, 0.7]}}}}]}
    assert len(ids(engine.search({"query": TWO}, weighted))) == 4
    assert all(r.score >= 0.4 for r in engine.search({"query": TWO, "min_score": 0.4}).collect())
    explained = engine.hits({"query": TWO, "explain": True}).collect()
    assert all("arithmetic_mean combination of:" in r.explanation for r in explained)


def test_filters_sorts_pages_and_collapse(engine):
    filtered = hybrid(*TWO["hybrid"]["queries"], filter=between(gte=100))
    assert set(ids(engine.search({"query": filtered}))) <= {1, 2, 3, 6}
    assert ids(engine.search({"query": TWO, "sort": [{"price": "desc"}]})) == [3, 1, 2, 4]
    assert ids(engine.search({"query": TWO, "sort": [{"price": {"order": "asc"}}], "search_after": [100]})) == [1, 3]
    paged = hybrid(*TWO["hybrid"]["queries"], pagination_depth=10)
    everything = ids(engine.search({"query": paged}))
    assert ids(engine.search({"query": paged, "from": 1, "size": 2})) == everything[1:3]
    all_docs = hybrid(EVERY)
    assert len(ids(engine.search({"query": all_docs, "collapse": {"field": "keyword"}}))) == 5
    assert ids(engine.search({"query": all_docs, "post_filter": {"term": {"keyword": "entire"}}})) == [5, 6]
    assert engine.search({"query": TWO, "_source": ["price"]}).columns == ["doc_id", "score", "price"]


def test_other_clauses(engine):
    assert ids(engine.search({"query": both(must=[words("hello")], must_not=[{"term": {"price": 25}}])})) == [1]
    assert set(ids(engine.search({"query": both(should=[{"term": {"price": 25}}, {"exists": {"field": "keyword"}}], filter=[between(lt=100)])}))) == {4, 5}
    assert ids(engine.search({"query": {"multi_match": {"query": "orange angry", "fields": ["body", "keyword"]}}})) != []
    assert set(ids(engine.search({"query": {"terms": {"price": [25, 30]}}}))) == {4, 5}
    assert ids(engine.search({"query": {"constant_score": {"filter": {"term": {"price": 30}}}}})) == [5]
    wrapped = both(must=[hybrid({"term": {"price": {"value": 25, "boost": 2.0}}}, EVERY)], filter=[between(lte=100)])
    assert {r.doc_id: r.score for r in engine.search({"query": wrapped}).collect()} == {4: 3.0, 2: 1.0, 5: 1.0}


def test_neural_clauses_and_enricher(engine):
    near = {"neural": {"vec": {"query_text": "x", "model_id": "unit", "k": 2}}}
    assert ids(engine.search({"query": near})) == [1, 4]
    assert ids(engine.search({"query": {"neural": {"vec": {"query_text": "x", "model_id": "unit", "max_distance": 0.7}}}})) == [1, 4]
    enricher = {"request_processors": [{"neural_query_enricher": {"default_model_id": "none", "neural_field_default_id": {"vec": "unit", "tokens": "terms"}}}]}
    assert ids(engine.search({"query": hybrid({"neural": {"vec": {"query_text": "x", "k": 1}}}, {"neural_sparse": {"tokens": {"query_text": "orange"}}})}, enricher)) == [1, 5]
    with pytest.raises(ValueError):
        engine.search({"query": {"neural": {"vec": {"query_text": "x"}}}}, {"request_processors": [{"neural_query_enricher": {}}]})
    assert ids(engine.search({"query": {"neural_sparse": {"tokens": {"query_tokens": {"hello": 2.0, "world": 1.0}}}}})) == [1, 4]
    assert ids(engine.search({"query": {"neural_sparse": {"tokens": {"query_text": "Orange people"}}}})) == [5]
    assert ids(engine.search({"query": {"neural_knn": {"vec": {"vector": [0.0, 1.0], "k": 1, "original_query_text": "up"}}}})) == [2]


def test_two_phase_agent_and_responses(engine):
    two = {"request_processors": [{"neural_sparse_two_phase_processor": {}}]}
    q = {"neural_sparse": {"tokens": {"query_tokens": {"hello": 2.0, "to": 0.5}}}}
    got = {r.doc_id: r.score for r in engine.search({"query": q}, two).collect()}
    assert got == {1: 2.0, 4: 2.5}  # documents with only light tokens are not found
    assert set(ids(engine.search({"query": q, "sort": [{"price": "asc"}]}, two))) == {1, 2, 3, 4}  # a sort by field turns it off
    agent = {"request_processors": [{"agentic_query_translator": {}}]}
    asked = {"agentic": {"query_text": "hello"}}
    assert set(ids(engine.search({"query": asked}, agent))) == {1, 4}
    with pytest.raises(ValueError):
        engine.search({"query": asked})
    with pytest.raises(ValueError):
        engine.search({"query": asked, "sort": ["price"]}, agent)
    rerank = {"response_processors": [{"rerank": {"by_field": {"target_field": "price", "keep_previous_score": True, "remove_target_field": True}}}]}
    out = engine.search({"query": TWO}, rerank)
    assert ids(out) == [3, 1, 2, 4] and "price" not in out.columns and "previous_score" in out.columns
    ml = {"response_processors": [{"rerank": {"ml": {"model_id": "length"}, "context": {"document_fields": ["body"]}}}]}
    assert ids(engine.search({"query": TWO, "ext": {"rerank": {"query_context": {"query_text": "q"}}}}, ml))[0] == 3
    marked = {"response_processors": [{"semantic_highlighter": {"fields": ["body"], "no_match_size": 3}}]}
    found = {r.doc_id: r.body_highlight for r in engine.search({"query": TWO}, marked).collect()}
    assert found[1] == "<em>Hello</em> world" and found[2] == "Hi to this <em>place</em>"


BAD = [
    {"query": hybrid()},
    {"query": hybrid(*[EVERY] * 6)},
    {"query": hybrid(EVERY, boost=2.0)},
    {"query": hybrid(EVERY, x=1)},
    {"query": hybrid(EVERY, filter=[{"match_all": {}}])},
    {"query": hybrid(EVERY, pagination_depth=0)},
    {"query": hybrid(TWO)},
    {"query": {"constant_score": {"filter": TWO}}},
    {"query": both(should=[TWO])},
    {"query": TWO, "from": 1},
    {"query": TWO, "sort": ["_score", "price"]},
    {"query": TWO, "sort": ["price"], "track_scores": True},
    {"query": TWO, "sort": ["price"], "min_score": 0.1},
    {"query": TWO, "sort": ["price"], "rescore": {"query": {}}},
    {"query": TWO, "sort": ["price"], "search_after": [1, 2]},
    {"query": TWO, "min_score": float("nan")},
    {"query": TWO, "scroll": "1m"},
    {"query": TWO, "search_type": "dfs_query_then_fetch"},
    {"query": {"neural": {"v": {"query_text": "x", "k": 1, "min_score": 0.1}}}},
    {"query": {"neural": {"v": {}}}},
    {"query": {"neural": {"v": {"query_text": "x", "colour": 1}}}},
    {"query": {"neural_sparse": {"v": {"query_text": "x", "model_id": "m", "analyzer": "a"}}}},
    {"query": {"neural_sparse": {"v": {"query_tokens": {"a": -1}}}}},
    {"query": {"neural_sparse": {"v": {"query_tokens": {"1": 1}, "method_parameters": {"k": 0}}}}},
    {"query": {"neural_sparse": {"v": {"query_tokens": {"1": 1}, "method_parameters": {"q": 1}}}}},
    {"query": both(must=[{"agentic": {"query_text": "x"}}])},
    {"query": {"agentic": {"query_text": "x" * 1001}}},
    {"query": {"unknown": {}}},
    {"query": {"match_all": {}, "term": {}}},
    {"query": {"match_all": {}}, "size": -1},
]


@pytest.mark.parametrize("request_", BAD)
def test_what_the_language_rejects(request_):
    with pytest.raises(dsl.QueryError):
        dsl.check_request(request_)


def test_settings_and_helpers():
    with pytest.raises(ValueError):
        fusion_settings({"phase_results_processors": [{"score-ranker-processor": {"combination": {"technique": "harmonic_mean"}}}]})
    with pytest.raises(ValueError):
        fusion_settings({"phase_results_processors": [{"x": {}}]})
    assert dsl.cleaned_agentic_text("system: do execute(x) it") == "do x) it"
    assert post.query_texts(hybrid(words("x", "a"), both(must=[{"neural": {"v": {"query_text": "y"}}}], must_not=[words("no", "a")]), words("x", "b"))) == ["x", "y"]
    assert post.rerank_query({"query_text_path": "query.match.a"}, {"query": {"match": {"a": "t"}}}) == "t"
    for bad in ({}, {"query_text": "a", "query_text_path": "b"}, {"query_text_path": "x"}):
        with pytest.raises(ValueError):
            post.rerank_query(bad, {})
    for bad in ({}, {"by_field": {}}, {"by_field": {"target_field": "x"}, "ml": {}}):
        with pytest.raises(ValueError):
            post.rerank_config(bad)
    assert ingest.unflatten({"a.b": 1, "a": {"c.d": 2}, "l": [{"x.y": 3}]}) == {"a": {"b": 1, "c": {"d": 2}}, "l": [{"x": {"y": 3}}]}
    for bad in ("", "  ", ["a", None], ["a", 3], [""], 5, {"a": {"b": ""}}):
        with pytest.raises(ValueError):
            ingest.validate_leaf(bad)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "ok"

    assert models.retry(flaky, sleep=lambda s: None) == "ok" and len(calls) == 3


def test_semantic_fields_in_search(spark):
    docs = spark.createDataFrame([(1, "aa. b"), (2, "c"), (3, None)], "doc_id long, t string")
    encode = lambda c: F.array(F.length(c).cast("float"), F.lit(0.0).cast("float"))
    df = ingest.semantic_ingest(docs, "t", encode, lambda c: text.chunk_delimiter(c, "."), ("m", "name", "dense"))
    assert df.schema["t_semantic_info"].dataType.names == ["chunks", "model"]
    rows = {r.doc_id: r.t_semantic_info for r in df.collect()}
    assert [c.text for c in rows[1].chunks] == ["aa.", " b"] and rows[3] is None
    registry = models.ModelRegistry()
    registry.register("m", models.Model("m", "dense", function=lambda x: [[3.0, 0.0] for _ in x]))
    assert ids(Engine(df, registry).search({"query": {"neural": {"t": {"query_text": "q", "model_id": "m", "k": 1}}}})) == [1]
    whole = ingest.semantic_ingest(docs, "t", lambda c: F.create_map(c, F.lit(1.0)), model=("m", "name", "sparse"))
    assert ids(Engine(whole).search({"query": {"neural": {"t": {"query_tokens": {"c": 1.0}}}}})) == [2]
    schema = ingest.expand_semantic_schema(docs.schema, {"t": {"chunking": True}, "u": {"model_type": "sparse", "semantic_info_field_name": "ui"}})
    assert schema["t_semantic_info"].dataType == df.schema["t_semantic_info"].dataType or schema["ui"].dataType.names == ["embedding", "model"]
    with pytest.raises(ValueError):
        ingest.expand_semantic_schema(docs.schema, {"t": {"sparse_encoding_config": {}}})


def test_lists_and_reuse_of_embeddings(spark):
    registry = models.ModelRegistry()
    registry.register("m", models.Model("m", "dense", function=lambda texts: [[float(len(t))] for t in texts]))
    df = spark.createDataFrame([(1, "ab", ["x", "yyy"]), (2, " ", []), (3, None, None)], "doc_id long, t string, l array<string>")
    out = {r.doc_id: r for r in ingest.text_embedding(df, registry, "m", {"t": "v", "l": "lv"}).collect()}
    assert out[1].v == [2.0] and [x.knn for x in out[1].lv] == [[1.0], [3.0]] and out[2].v is None and out[3].lv is None


def test_sparse_index_recall_and_tables(spark, tmp_path):
    import random

    from ranksmith.sources import tables

    rng = random.Random(5)
    rows = [(d, t, rng.uniform(0.1, 3.0)) for d in range(400) for t in rng.sample(range(80), 12)]
    vectors = spark.createDataFrame(rows, "doc_id long, token long, weight double")
    p = sparse_index.IndexParameters(n_postings=300, cluster_ratio=0.2)
    tables.write_index(sparse_index.build(vectors, p), str(tmp_path / "ix"), buckets=3)
    index = tables.read_index(spark, str(tmp_path / "ix"), p)
    recall = 0
    for q in range(4):
        tokens = {t: rng.uniform(0.5, 5) for t in rng.sample(range(80), 8)}
        want = ids(sparse_index.top(sparse_index.exact(index.vectors, sparse_index.query_tokens(tokens, p), p), 10))
        recall += len(set(want) & set(ids(sparse_index.search(index, tokens, heap_factor=1.5)))) / 40
    assert recall >= 0.9
    few = spark.createDataFrame([(d, 1000, d / 10) for d in range(1, 9)] + [(d, 2000, d / 10) for d in range(1, 9)], "doc_id long, token long, weight double")
    assert ids(sparse_index.search(sparse_index.build(few, documents=8), {1000: 0.1, 2000: 0.2}, k=3)) == [8, 7, 6]
    for bad in ({"n_postings": 0}, {"cluster_ratio": 1}, {"summary_prune_ratio": 0}, {"quantization_ceiling_search": 0}, {"approximate_threshold": -1}):
        with pytest.raises(ValueError):
            sparse_index.IndexParameters(**bad)


def test_mmr_prefers_what_differs(spark):
    rows = [(0, 1, 1.0, [1.0, 0.0]), (0, 2, 0.99, [1.0, 0.01]), (0, 3, 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id int, doc_id long, score double, embedding array<double>")
    assert [r.doc_id for r in post.mmr(df, 2, 0.5).orderBy("place").collect()] == [1, 3]
    assert [r.doc_id for r in post.mmr(df, 2, 0.0).orderBy("place").collect()] == [1, 2]


def test_aggregations_of_matches(engine):
    rows = engine.matched({"query": hybrid(words("hello place"), {"term": {"keyword": "entire"}})})
    assert rows.count() == 6
    assert {r.bucket: r.doc_count for r in A.terms(rows, "keyword").collect()}["entire"] == 2
    assert {r.bucket: r.doc_count for r in A.histogram(rows, "price", 100).collect()} == {0.0: 2, 100.0: 2, 200.0: 1, 300.0: 1}


def test_bulk_documents(spark):
    from ranksmith.sources import tables

    lines = ['{"index": {"_id": "7"}}', '{"a.b": 1, "t": "x"}', "", '{"create": {"_id": "8"}}', '{"t": "y"}']
    got = {r.doc_id: (r.a, r.t) for r in tables.bulk_documents(spark, lines, "doc_id string, a struct<b:int>, t string").collect()}
    assert got["7"][0].b == 1 and got["8"] == (None, "y")
    with pytest.raises(ValueError):
        tables.bulk_documents(spark, ['{"delete": {}}'], "doc_id string")


def test_trailing_stream(spark, tmp_path):
    from datetime import datetime

    from ranksmith.streaming import stats

    rows = [(datetime(2024, 1, 1, 0, m, s), "a") for m, s in ((0, 10), (1, 0), (7, 0))]
    spark.createDataFrame(rows, "ts timestamp, event_type string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    query = stats.trailing_stream(stream).writeStream.outputMode("complete").format("memory").queryName("trailing").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.minute.minute, r.n) for r in spark.sql("select * from trailing where name = 'a'").collect()}
    assert (2, 2) in got and (5, 2) in got and (12, 1) in got


@pytest.fixture(scope="module")
def forty(spark):
    """The better a document scores, the lower its price."""
    rows = [(i, " ".join(["word"] * (40 - i) + ["pad"] * i), i, "even" if i % 2 else "odd", [("word " * (i % 3), i), ("pad", -i)]) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, body string, price int, kind string, parts array<struct<t:string, n:int>>")
    return Engine(df.withColumn("tokens", sparse.term_frequencies(text.tokens(F.col("body")))).cache())


def test_candidates_are_cut_in_the_order_of_the_sort(forty):
    q = hybrid(words("word"))
    assert ids(forty.search({"query": q, "size": 3})) == [0, 1, 2]
    assert ids(forty.search({"query": q, "size": 3, "sort": [{"price": "desc"}]})) == [39, 38, 37]
    assert ids(forty.search({"query": q, "size": 3, "sort": [{"price": "asc"}], "search_after": [20]})) == [21, 22, 23]
    assert ids(forty.search({"query": q, "size": 3, "sort": ["kind", {"price": "desc"}], "search_after": ["even", 3]})) == [1, 38, 36]
    assert {r.score for r in forty.search({"query": q, "size": 3, "sort": ["price"]}).collect()} == {None}
    assert ids(forty.search({"query": q, "size": 3, "post_filter": {"term": {"kind": "even"}}})) == [1, 3, 5]
    assert ids(forty.search({"query": q, "size": 3, "sort": [{"price": "desc"}], "post_filter": {"term": {"kind": "odd"}}})) == [38, 36, 34]
    assert ids(forty.search({"query": q, "size": 3, "sort": [{"price": "desc"}], "collapse": {"field": "kind"}})) == [39, 38]
    assert forty.matched({"query": q, "post_filter": {"term": {"kind": "odd"}}}).count() == 40


def test_filters_leave_word_statistics_alone(forty):
    alone = {r.doc_id: r.score for r in forty.search({"query": words("pad"), "size": 50}).collect()}
    for query in (both(must=[words("pad")], filter=[{"term": {"kind": "even"}}]), {"bool": {"must": [{"bool": {"should": [words("pad")], "filter": [{"range": {"price": {"lt": 7}}}]}}]}}):
        found = {r.doc_id: r.score for r in forty.search({"query": query, "size": 50}).collect()}
        assert found and all(s == pytest.approx(alone.get(i, 0.0)) for i, s in found.items())


def test_alias_filters_hold_in_every_request(forty):
    alias = Engine(forty.corpus, alias_filter={"term": {"kind": "even"}})
    q, scores = hybrid(words("word"), words("pad")), {r.doc_id: r.score for r in forty.search({"query": words("pad"), "size": 50}).collect()}
    assert set(ids(alias.search({"query": q, "size": 50}))) == set(range(1, 40, 2))
    found = {r.doc_id: r.score for r in alias.search({"query": words("pad"), "size": 50}).collect()}
    assert set(found) == set(range(1, 40, 2)) and all(s == pytest.approx(scores[i]) for i, s in found.items())
    assert ids(alias.search({"query": q, "size": 2, "sort": [{"price": "desc"}]})) == [39, 37] and alias.matched({"query": q}).count() == 20


def test_two_phases_with_boosts(forty):
    tokens = {"word": 2.0, "pad": 0.5}
    two = {"request_processors": [{"neural_sparse_two_phase_processor": {}}]}
    plain = {r.doc_id: r.score for r in forty.search({"query": {"neural_sparse": {"tokens": {"query_tokens": tokens}}}, "size": 40}).collect()}
    boosted = forty.search({"query": {"neural_sparse": {"tokens": {"query_tokens": tokens, "boost": 3.0}}}, "size": 10}, two).collect()
    assert len(boosted) == 10 and all(r.score == pytest.approx(3 * plain[r.doc_id], abs=1e-4) for r in boosted)
    inside = {"bool": {"should": [{"neural_sparse": {"tokens": {"query_tokens": tokens}}}, {"term": {"kind": {"value": "even", "boost": 0.25}}}]}}
    small = {"request_processors": [{"neural_sparse_two_phase_processor": {"two_phase_parameter": {"expansion_rate": 1.0, "max_window_size": 50}}}]}
    got = {r.doc_id: r.score for r in forty.search({"query": inside, "size": 40}, small).collect()}
    assert len(got) == 40 and all(s == pytest.approx(plain[i] + (0.25 if i % 2 else 0), abs=1e-4) for i, s in got.items())
    five = forty.hits(forty.prepared({"query": inside, "size": 5}, small)).collect()
    assert len(five) == 40  # what lies outside of the window keeps its first score
    assert sum(r.score == pytest.approx(plain[r.doc_id] + (0.25 if r.doc_id % 2 else 0), abs=1e-4) and r.doc_id > 0 for r in five) <= 6


def test_small_sparse_indexes_are_searched_exactly(spark):
    rows = [(d, 7, 1.0 + d / 50) for d in range(40)]
    vectors = spark.createDataFrame(rows, "doc_id long, token long, weight double")
    index = sparse_index.build(vectors, sparse_index.IndexParameters(n_postings=3))
    corpus = vectors.select("doc_id").withColumn("tokens", F.create_map(F.lit("7"), F.lit(1.0))).withColumn("even", F.col("doc_id") % 2 == 0)
    query = {"neural_sparse": {"tokens": {"query_tokens": {"7": 1.0}, "method_parameters": {"k": 20}}}}
    found = Engine(corpus, indices={"tokens": index}).search({"query": query, "size": 20})
    assert ids(found) == list(range(39, 19, -1))  # postings hold three documents
    approximate = sparse_index.build(vectors, sparse_index.IndexParameters(n_postings=3, approximate_threshold=10))
    assert len(ids(Engine(corpus, indices={"tokens": approximate}).search({"query": query, "size": 20}))) == 3
    filtered = Engine(corpus, indices={"tokens": index}).search({"query": both(must=[query], filter=[{"term": {"even": True}}]), "size": 3})
    assert ids(filtered) == [38, 36, 34]


def test_inner_hits_and_highlight_targets(forty):
    nested = {"nested": {"path": "parts", "query": words("word", "parts.t"), "inner_hits": {"name": "best", "size": 1, "highlight": {"fields": {"parts.t": {"type": "semantic"}}}}}}
    rows = forty.search({"query": nested, "size": 4}).collect()
    best = {r.doc_id: r.inner_hits_best for r in rows}
    assert len(best) == 4 and all(len(x) == 1 and x[0].child == 0 and x[0].n == i and x[0].t_highlight.startswith("<em>word</em>") for i, x in best.items())
    highlight = {"options": {"no_match_size": 2}, "pre_tags": ["["], "post_tags": ["]"], "fields": {"body": {"type": "semantic"}, "kind": {"type": "plain"}}}
    one = forty.search({"query": hybrid(words("pad")), "size": 1, "sort": [{"price": "asc"}], "highlight": highlight}).first()
    assert one.body_highlight.startswith("word word") and one.body_highlight.endswith("[pad]") and "kind_highlight" not in one
    other = forty.search({"query": hybrid(words("word")), "size": 1, "highlight": {**highlight, "highlight_query": words("nothing")}}).first()
    assert other.body_highlight == "wo"
    forty.models.register("spans", models.Model("spans", "spans", function=lambda pairs: [[(0, 4)] if c.startswith("word") else [] for _, c in pairs]))
    by_model = {"fields": {"body": {"type": "semantic", "options": {"model_id": "spans", "batch_inference": True, "max_inference_batch_size": 2}}}}
    assert all(r.body_highlight.startswith("<em>word</em>") for r in forty.search({"query": hybrid(words("word")), "size": 3, "highlight": by_model}).collect())


def test_response_processors_for_explanations_and_agents(engine):
    explained = {"response_processors": [{"hybrid_score_explanation": {}}]}
    assert "explanation" not in engine.search({"query": TWO, "explain": True}).columns
    assert all("combination of:" in r.explanation for r in engine.search({"query": TWO, "explain": True}, explained).collect())
    agent = Engine(engine.corpus, agent=lambda q, b: {"query": words(q), "size": 2, "agent_steps": "looked it up", "memory_id": "m1"})
    pipeline = {"request_processors": [{"agentic_query_translator": {}}], "response_processors": [{"agentic_context": {"agent_steps_summary": True, "dsl_query": True}}]}
    row = agent.search({"query": {"agentic": {"query_text": "hello"}}}, pipeline).first()
    assert (row.ext_agent_steps, row.ext_memory_id, row.ext_dsl_query) == ("looked it up", "m1", '{"match": {"body": "hello"}}')
    assert "ext_dsl_query" not in agent.search({"query": {"agentic": {"query_text": "hello"}}}, {**pipeline, "response_processors": [{"agentic_context": {}}]}).columns


def test_highlighting_terms_as_their_spans(spark):
    texts = ["The cat & the dog, <the>", "none", "THE", None, "the$the \\1 the_x", "dog the"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for encoder in ("default", "html"):
        both_ways = df.select(post.highlight_terms(F.col("t"), ("the", "dog"), "<$b>", "\\1", encoder, 3).alias("a"), post.highlight(F.col("t"), post.term_spans(F.col("t"), ("the", "dog")), "<$b>", "\\1", encoder, 3).alias("b"))
        assert all(r.a == r.b for r in both_ways.collect())


def test_sparse_recall_where_posting_lists_are_cut(spark):
    """Lists of about 750 documents are cut to 160, and a query has the default ten tokens and heap factor."""
    import random

    rng = random.Random(5)
    rows = [(d, t, min(3.0, rng.expovariate(2.0))) for d in range(3000) for t in rng.sample(range(100), 25)]
    index = sparse_index.build(spark.createDataFrame(rows, "doc_id long, token long, weight double"), sparse_index.IndexParameters(n_postings=160))
    for table in (index.vectors, index.clustered, index.summary):
        table.persist().count()
    p, recall = index.parameters, 0
    for _ in range(5):
        tokens = {t: rng.expovariate(0.5) for t in rng.sample(range(100), 12)}
        want = set(ids(sparse_index.top(sparse_index.exact(index.vectors, sparse_index.query_tokens(tokens, p), p), 10)))
        recall += len(want & set(ids(sparse_index.search(index, tokens, k=10)))) / 50
    assert recall >= 0.9

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import text
from ranksmith.operators import models, sparse_index
from ranksmith.plans import ingest_pipeline as P
from ranksmith.plans import stats


def registry():
    out = models.ModelRegistry()
    out.register("length", models.Model("length", "dense", function=lambda texts: [[float(len(t))] for t in texts]))
    out.register("terms", models.Model("terms", "sparse", function=lambda texts: [{w: float(len(w)) for w in t.split()} for t in texts]))
    return out


def chunk(**more):
    return {"text_chunking": {"algorithm": {"delimiter": {"delimiter": "."}}, **more}}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "a.b.c", ["x.y", "z"], ("n.m", [("p.q",), (None,)])), (2, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, t string, l array<string>, o struct<s:string, many:array<struct<u:string>>>")


def test_field_maps_reach_lists_and_nested_fields(docs):
    made = P.run(docs, {"processors": [chunk(field_map={"t": "tc", "l": "lc", "o": {"s": "sc"}, "o.many": {"u": "uc"}})]})
    one, two = made.orderBy("doc_id").collect()
    assert one.tc == ["a.", "b.", "c"] and one.lc == ["x.", "y", "z"] and one.o.sc == ["n.", "m"]
    assert [x.uc for x in one.o.many][0] == ["p.", "q"] and two.o is None and made.columns == ["doc_id", "t", "l", "o", "tc", "lc"]
    assert P.run(docs, {"processors": [chunk(field_map={"none": "x"}, ignore_missing=True)]}).columns == docs.columns


def test_a_list_shares_its_limit(spark):
    df = spark.createDataFrame([(["a.b.c.d", "e.f", "g"],)], "l array<string>")
    for limit, want in ((-1, 7), (4, 4), (3, 3), (2, 3)):
        got = df.select(text.chunk_texts(F.col("l"), "delimiter", delimiter=".", max_chunk_limit=limit).alias("c")).first().c
        assert len(got) == want and "".join(got) == "a.b.c.de.fg"
    assert df.select(text.chunk_texts(F.col("l"), "delimiter", delimiter=".", max_chunk_limit=4).alias("c")).first().c == ["a.", "b.c.d", "e.f", "g"]


def test_embedding_and_encoding_by_configuration(docs):
    made = P.run(
        docs,
        {
            "processors": [
                {"text_embedding": {"model_id": "length", "field_map": {"t": "v", "l": "lv", "o.s": "sv"}, "batch_size": 1}},
                {"sparse_encoding": {"model_id": "terms", "field_map": {"t": "w"}, "prune_type": "top_k", "prune_ratio": 1}},
                {"text_image_embedding": {"model_id": "length", "embedding": "iv", "field_map": {"text": "t"}}},
            ]
        },
        registry(),
    )
    one, two = made.orderBy("doc_id").collect()
    assert one.v == [5.0] and [x.knn for x in one.lv] == [[3.0], [1.0]] and one.o.sv == [3.0] and one.w == {"a.b.c": 5.0} and one.iv == [2.0]  # a pair of text and image
    assert two.v is None and two.lv is None


def test_unchanged_documents_keep_their_embeddings(spark):
    pipeline = {"processors": [{"text_embedding": {"model_id": "length", "field_map": {"t": "v"}, "skip_existing": True}}]}
    old = spark.createDataFrame([(1, "same", [-1.0]), (2, "before", [-1.0]), (4, None, None)], "doc_id long, t string, v array<float>")
    new = spark.createDataFrame([(1, "same"), (2, "after it"), (3, "new"), (4, None)], "doc_id long, t string")
    got = {r.doc_id: r.v for r in P.reindex(new, old, pipeline, registry()).collect()}
    assert got == {1: [-1.0], 2: [8.0], 3: [3.0], 4: None}


BAD = [
    [{"x": {}}],
    [{"text_chunking": {"field_map": {}}}],
    [chunk(field_map={"t": "c"}, colour=1)],
    [chunk(field_map={"missing": "c"})],
    [chunk(field_map={"doc_id": "c"})],
    [chunk(field_map={"t": {"u": "c"}})],
    [{"text_chunking": {"algorithm": {"delimiter": {}, "fixed_char_length": {}}, "field_map": {"t": "c"}}}],
    [{"text_embedding": {"model_id": "length", "field_map": {"o.many": {"u": "v"}}}}],
    [{"sparse_encoding": {"model_id": "terms", "field_map": {"l": "v"}}}],
    [{"text_image_embedding": {"model_id": "length", "field_map": {"sound": "t"}, "embedding": "v"}}],
]


@pytest.mark.parametrize("processors", BAD)
def test_what_pipelines_reject(docs, processors):
    with pytest.raises(ValueError):
        P.run(docs, {"processors": processors}, registry())


def test_statistics(spark):
    ingest = {"p": {"processors": [chunk(field_map={"t": "c"}), {"text_embedding": {"skip_existing": True}}, {"text_chunking": {}}]}}
    search = {
        "a": {"request_processors": [{"neural_query_enricher": {}}, {"neural_sparse_two_phase_processor": {}}], "phase_results_processors": [{"normalization-processor": {"normalization": {"technique": "l2"}}}]},
        "b": {"phase_results_processors": [{"score-ranker-processor": {}}], "response_processors": [{"rerank": {"by_field": {}}}, {"agentic_context": {}}]},
    }
    events = spark.createDataFrame([("seen", "2024-01-01 10:00:30"), ("seen", "2024-01-01 10:03:10")], "event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stats.listing(ingest_pipelines=ingest, search_pipelines=search, event_table=events, now="2024-01-01 10:04:00", flat_stat_paths=True)
    counts = {k.rpartition(".")[2]: v for k, v in got["info"].items() if v}
    assert counts == {
        "text_chunking_processors": 2, "text_chunking_delimiter_processors": 1, "text_chunking_fixed_token_length_processors": 1, "text_embedding_processors_in_pipelines": 1, "skip_existing_processors": 1,
        "neural_query_enricher_processors": 1, "neural_sparse_two_phase_processors": 1, "normalization_processors": 1, "norm_l2_processors": 1, "comb_arithmetic_processors": 1,
        "rank_based_normalization_processors": 1, "comb_rrf_processors": 1, "rerank_by_field_processors": 1, "agentic_context_processors": 1,
    }
    assert got["all_nodes"]["events.seen"] == 2
    meta = stats.listing(["seen"], event_table=events, now="2024-01-01 10:04:00", include_metadata=True)
    assert meta["all_nodes"]["events"]["seen"] == {"value": 2, "trailing_interval_value": 2, "minutes_since_last_event": 0, "stat_type": "timestamped_event_counter"} and meta["info"] == {}
    assert stats.listing(include_info=False)["info"] == {}
    for bad in ({"stats": ["no_such"]}, {"stats": ["a b"]}, {"colour": True}):
        with pytest.raises(ValueError):
            stats.listing(**bad)
    with pytest.raises(PermissionError):
        stats.listing(enabled=False)


def test_warm_up_and_merge_of_indexes(spark):
    rows = [(d, t, d / 10) for d in range(1, 9) for t in (1000, 2000)]
    parts = [spark.createDataFrame(rows[:8], "doc_id long, token long, weight double"), spark.createDataFrame(rows[8:], "doc_id long, token long, weight double")]
    merged = sparse_index.merge([sparse_index.build(p) for p in parts])
    assert merged.documents == 8
    assert [r.doc_id for r in sparse_index.search(merged, {1000: 0.1, 2000: 0.2}, k=3).collect()] == [8, 7, 6]
    parents = spark.createDataFrame([(d, d % 3) for d in range(1, 9)], "doc_id long, parent long")
    assert [r.doc_id for r in sparse_index.search_nested(merged, parents, {1000: 0.1, 2000: 0.2}, k=2).collect()] == [2, 1]
    stats.warm_up({"i": merged})
    assert stats.metric_stats({"i": merged})["memory.sparse.sparse_memory_usage"] > 0
    stats.clear_cache({"i": merged})
    assert stats.metric_stats({"i": merged})["memory.sparse.sparse_memory_usage"] == 0
    with pytest.raises(ValueError):
        sparse_index.merge([merged, sparse_index.build(parts[0], sparse_index.IndexParameters(quantization_ceiling_ingest=2.0))])

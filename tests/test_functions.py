import random
import re

import pytest
from pyspark.sql import functions as F

from ranksmith.functions import sparse, text, vectors
from ranksmith.operators import two_phase


def value(spark, column, *rows_and_schema):
    data, schema = rows_and_schema if rows_and_schema else ([(1,)], "x int")
    return spark.createDataFrame(data, schema).select(column.alias("v")).first().v


GAP = "\n" * 2
CHUNKS = [
    (text.chunk_delimiter, {"delimiter": "\n"}, "\n".join("abcd"), [x + "\n" for x in "abc"] + ["d"]),
    (text.chunk_delimiter, {"delimiter": GAP}, f"{GAP}a{GAP}\n", [GAP, f"a{GAP}", "\n"]),
    (text.chunk_delimiter, {"delimiter": "."}, "a.b.cc.d.", [x + "." for x in ("a", "b", "cc", "d")]),
    (text.chunk_delimiter, {"delimiter": ".", "limit": 2}, "a.b.cc.d.", ["a.", "b.cc.d."]),
    (text.chunk_delimiter, {"delimiter": "\n"}, "", []),
    (text.chunk_fixed_char, {"char_limit": 10, "overlap_rate": 0.5}, "abcdefghijklmnopqrstuvwxyz", ["abcdefghij", "fghijklmno", "klmnopqrst", "pqrstuvwxy", "uvwxyz"]),
    (text.chunk_fixed_char, {"char_limit": 10, "overlap_rate": 0.2}, "abcdefghijklmnopqrstuvwxyz", ["abcdefghij", "ijklmnopqr", "qrstuvwxyz"]),
    (text.chunk_fixed_char, {"char_limit": 10, "limit": 2}, "This is a test string for chunking with max limit.", ["This is a ", "test string for chunking with max limit."]),
    (text.chunk_fixed_char, {"char_limit": 10}, "", []),
    (text.chunk_fixed_token, {"token_limit": 2, "tokenizer": "whitespace"}, " one  two three\nfour five ", [" one  two ", "three\nfour ", "five "]),
    (text.chunk_fixed_token, {"token_limit": 3, "overlap_rate": 0.34, "tokenizer": "letter"}, "a-b c1d, e", ["a-b c1", "c1d, e"]),
    (text.chunk_fixed_token, {"token_limit": 2}, "This isn't 3.5, ok.", ["This isn't ", "3.5, ok."]),
    (text.chunk_fixed_token, {"token_limit": 2, "limit": 2, "tokenizer": "whitespace"}, "a b c d e f", ["a b ", "c d e f"]),
    (text.chunk_fixed_token, {"token_limit": 5}, "...", ["..."]),
]


@pytest.mark.parametrize("chunk,parameters,given,want", CHUNKS)
def test_chunkers(spark, chunk, parameters, given, want):
    assert value(spark, chunk(F.col("t"), **parameters), [(given,)], "t string") == want


def test_chunk_lists_cascades_and_what_is_rejected(spark):
    cascade = text.cascade(F.col("t"), text.chunker("delimiter", delimiter="."), text.chunker("fixed_char_length", char_limit=3))
    assert value(spark, cascade, [("abcd.e",)], "t string") == ["abc", "d.", "e"]
    assert value(spark, text.chunk_list(F.col("t"), text.chunker("delimiter", delimiter=".")), [(["a.b", "c"],)], "t array<string>") == ["a.", "b", "c"]
    for name, parameters in (("x", {}), ("delimiter", {"delimiter": ""}), ("fixed_char_length", {"char_limit": 0}), ("fixed_char_length", {"overlap_rate": 0.6}), ("fixed_token_length", {"tokenizer": "none"}), ("delimiter", {"max_chunk_limit": 0})):
        with pytest.raises(ValueError):
            text.chunker(name, **parameters)


def test_chunks_with_no_overlap_join_to_the_text(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab .\n,é", k=rng.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for chunk in (text.chunk_delimiter(F.col("t"), "."), text.chunk_fixed_char(F.col("t"), 7), *[text.chunk_fixed_token(F.col("t"), 3, tokenizer=k) for k in text.TOKENIZERS]):
        got = df.select("t", F.concat_ws("", chunk).alias("j"), F.array_contains(chunk, "").alias("empty")).collect()
        assert all(r.t == r.j and not r.empty for r in got)


PRUNED = [("top_k", 2, {"a": 5.0, "b": 3.0, "c": 4.0, "d": 1.0}, {"a", "c"}), ("max_ratio", 0.7, {"a": 10.0, "b": 8.0, "c": 5.0, "d": 2.0}, {"a", "b"}), ("abs_value", 3, {"a": 5.0, "b": 3.0, "c": 2.0, "d": 1.0}, {"a", "b"}), ("alpha_mass", 0.8, {"a": 10.0, "b": 6.0, "c": 3.0, "d": 1.0}, {"a", "b"}), ("none", None, {"a": 1.0}, {"a"})]


@pytest.mark.parametrize("kind,ratio,given,want", PRUNED)
def test_pruning_and_splitting(spark, kind, ratio, given, want):
    high, low = sparse.split(F.col("m"), kind, ratio)
    df = spark.createDataFrame([(given,), ({},)], "m map<string,double>")
    first, empty = df.select(high.alias("h"), low.alias("l")).collect()
    assert set(first.h) == want and set(first.l) == set(given) - want and empty.h == {} == empty.l
    heavy, light = two_phase.split_query(given, kind, ratio)
    assert set(heavy) == want and {**heavy, **light} == given


@pytest.mark.parametrize("kind,ratio", [("x", 1), ("top_k", 0), ("top_k", 1.5), ("max_ratio", 1.0), ("alpha_mass", -0.1), ("abs_value", -1), ("top_k", None), ("none", 1)])
def test_bad_pruning(kind, ratio):
    with pytest.raises(ValueError):
        sparse.check_prune(kind, ratio)


def test_quantize_fold_rescale_and_encoder(spark):
    got = spark.createDataFrame([(0.0,), (1.5,), (3.0,), (-1.0,), (4.0,)], "w double").select(sparse.quantize(F.col("w")).alias("q")).collect()
    assert [r.q for r in got] == [0, 128, 255, 0, 255]
    assert value(spark, sparse.fold(F.lit(32768 * 3 + 5))) == 5
    assert value(spark, sparse.rescale(F.lit(255 * 255))) == pytest.approx(48)
    m = value(spark, sparse.term_frequencies(text.tokens(F.lit("b a B c! a a"))))
    assert m == pytest.approx({"a": 1 + 1.0986123, "b": 1 + 0.6931472, "c": 1.0})
    assert value(spark, sparse.term_frequencies(text.tokens(F.lit(None).cast("string")))) == {}
    assert value(spark, sparse.dot(sparse.literal({"a": 2.0, "z": 1.0}), F.create_map(F.lit("a"), F.lit(1.5)))) == 3.0


def test_vector_spaces(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, -1.0])], "a array<float>, b array<double>")
    d = {s: df.select(vectors.distance(F.col("a"), F.col("b"), s).alias("d"), vectors.score(F.col("a"), F.col("b"), s).alias("s")).first() for s in vectors.SPACES}
    assert d["l2"].d == pytest.approx(13**0.5) and d["l2"].s == pytest.approx(1 / 14)
    assert d["l1"].d == 5 and d["linf"].d == 3 and d["hamming"].d == 2
    assert d["innerproduct"].s == pytest.approx(2.0) and d["cosinesimil"].s == pytest.approx((1 + 1 / 50**0.5) / 2)
    with pytest.raises(ValueError):
        vectors.score(F.col("a"), F.col("b"), "manhattan")


def test_tags_and_escapes(spark):
    spans = F.array(F.struct(F.lit(6).alias("start"), F.lit(9).alias("end")), F.struct(F.lit(0).alias("start"), F.lit(2).alias("end")))
    assert value(spark, text.apply_tags(F.lit("<a & b'c>"), spans)) == "<em><a</em> & b<em>'c></em>"
    assert value(spark, text.apply_tags(F.lit("<a & b'c>"), spans, escape=True)) == "<em>&lt;a</em> &amp; b<em>&#39;c&gt;</em>"
    assert value(spark, text.escape_html(F.lit("\"&amp;'"))) == "&quot;&amp;amp;&#39;"
    bad = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("end")), F.struct(F.lit(2).alias("start"), F.lit(4).alias("end")))
    with pytest.raises(Exception, match="highlight spans"):
        value(spark, text.apply_tags(F.col("t"), bad), [("abcdef",)], "t string")


def test_term_spans_match_a_regex(spark):
    from ranksmith.operators.post import highlight, term_spans

    t = "The end, the END of theend; the"
    got = value(spark, term_spans(F.col("t"), ("the", "end")), [(t,)], "t string")
    assert [(s.start, s.end) for s in got] == [m.span() for m in re.finditer(r"(?i)(?<![A-Za-z0-9])(?:the|end)(?![A-Za-z0-9])", t)]
    none = F.array().cast("array<struct<start:int,end:int>>")
    assert value(spark, highlight(F.lit("a<b"), none)) is None
    assert value(spark, highlight(F.lit("a<b"), none, encoder="html", no_match_size=2)) == "a&lt;"


def test_expensive_columns_are_computed_once(spark, tmp_path):
    """No plan of a sparse query tokenizes a text again for a filter or for a second part of the result."""
    from ranksmith.queries import vectors as queries

    spark.createDataFrame([(1, "the idiot of the to and"), (2, "pathetic"), (3, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name in ("sparse_encode_tf", "prune_top_k", "prune_max_ratio", "prune_alpha_mass", "prune_split", "sparse_dot", "sparse_two_phase"):
        plan = queries.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == 1, name


@pytest.mark.parametrize("kind, ratio", [("none", None), ("top_k", 2), ("max_ratio", 0.6), ("abs_value", 1.5), ("alpha_mass", 0.6)])
def test_split_is_prune_and_the_rest(spark, kind, ratio):
    for given in ({}, {"a": 3.0, "b": 1.5, "c": 2.0, "d": 1.5}, {"a": 1.0}):
        high, low = (value(spark, c) for c in sparse.split(sparse.literal(given), kind, ratio))
        assert high == value(spark, sparse.prune(sparse.literal(given), kind, ratio)) and {**high, **low} == given and not set(high) & set(low)

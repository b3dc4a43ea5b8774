import os
import random

import numpy as np
import pytest

from ranksmith.llm import token_counts as T

pytestmark = pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="no vocabulary file here")


def pieces(encoder, text):
    encoder.lengths([""])
    encoding = encoder._built[0]
    return [encoding.decode_single_token_bytes(i) for i in encoding.encode_ordinary(text)]


def brute(tokens, ends, rule):
    owner, at, counts, crossing = [], 0, [0.0] * len(ends), 0
    for i, e in enumerate(ends):
        owner += [i] * (e - at)
        at = e
    at = 0
    for t in tokens:
        own = owner[at : at + len(t)]
        at += len(t)
        crossing += own[0] != own[-1]
        if rule == "first":
            counts[own[0]] += 1
        elif rule == "most":
            counts[max(sorted(set(own)), key=lambda s: (own.count(s), -s))] += 1
        else:
            for s in own:
                counts[s] += 1 / len(own)
    return counts, crossing


def texts():
    rng = random.Random(1)
    parts = ["Hello", " world", "\n", "\n\n", "  ", "é", "日本語", "don't", "<|endoftext|>", "123", "\t", "...\n...", "\r\n"]
    return [None, "", "\n", "\n\n\n", "one line", "a" * 5000] + ["".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(80)]


@pytest.mark.parametrize("rule", T.RULES)
def test_lines_match_brute_force(spark, rule):
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").coalesce(1)
    encoder = T.Encoder(T.VOCABULARY)
    for (i, t, _), r in zip(rows, T.count_lines(df, rule=rule).collect()):
        lines = (t or "").split("\n")
        sizes = [len(x.encode()) + 1 for x in lines[:-1]] + ([len(lines[-1].encode())] if lines[-1] else [])
        tokens = pieces(encoder, t or "")
        counts, crossing = brute(tokens, np.cumsum(sizes).tolist(), rule)
        assert (r.doc_id, r.n_tokens, r.n_crossing) == (i, len(tokens), crossing)
        assert r.section_tokens == pytest.approx(counts) and sum(r.section_tokens) == pytest.approx(len(tokens))
        assert b"".join(tokens) == (t or "").encode()


@pytest.mark.parametrize("rule", T.RULES)
def test_fields_match_brute_force(spark, rule):
    t = texts()
    rows = [(i, a, b, c) for i, (a, b, c) in enumerate(zip(t, t[3:], t[7:]))]
    df = spark.createDataFrame(rows, "id long, a string, b string, `c.d` string").coalesce(1)
    encoder = T.Encoder(T.VOCABULARY)
    for (i, *parts), r in zip(rows, T.count_fields(df, ["a", "b", "c.d"], ("id",), rule, separator=" \n").collect()):
        parts = [(p or "") + (" \n" if k < 2 else "") for k, p in enumerate(parts)]
        counts, crossing = brute(pieces(encoder, "".join(parts)), np.cumsum([len(p.encode()) for p in parts]).tolist(), rule)
        assert (r.id, r.n_crossing) == (i, crossing) and r.section_tokens == pytest.approx(counts)


def test_empty_and_bad_rule(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert T.count_lines(df).count() == 0
    with pytest.raises(ValueError):
        T.count_lines(df, rule="last")


@pytest.mark.parametrize("space", [" ", "\n", "\u00a0", "\t "])
def test_long_white_space_is_encoded_as_before(space):
    encoder = T.Encoder(T.VOCABULARY)
    encoder.lengths([""])
    encoding, sizes = encoder._built[:2]
    for before, after in [("", ""), ("x", ""), ("", "y"), ("it's", "y 1"), ("x ", "!"), ("a", "\u00e9")]:
        text = before + space * T.LONG_SPACE + after
        assert encoder.lengths([text])[0].tolist() == sizes[encoding.encode_ordinary(text)].tolist()


def test_white_space_beyond_what_the_pattern_can_step_back_over():
    lengths = T.Encoder(T.VOCABULARY).lengths([" " * 1_500_000 + "x", "\n" * 1_500_000])
    assert [int(n.sum()) for n in lengths] == [1_500_001, 1_500_000]

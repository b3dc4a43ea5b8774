"""Texts of some megabytes, which are read in pieces, against the same in one go; and columns of odd names."""

import random

import numpy as np
import pytest
from test_decontaminate import brute
from test_simhash_dedup import slow_fingerprint

from ranksmith.llm import decontaminate, language_id, near_copies, simhash_dedup, toxicity


@pytest.fixture(scope="module")
def long():
    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in ("der", "the", "é", "Wort", "x") for b in range(900)]
    return " ".join(rng.choices(vocab, k=450_000))


def test_scores_and_means_add_up(long):
    raw = long.encode()
    assert len(raw) > 2 << 20
    at, rng = np.array([0, len(raw)]), np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=1 << 12), 0.1)
    sums, n = model._sums(raw, at)
    assert model.scores(raw, at) == pytest.approx(1 / (1 + np.exp(-(0.1 + sums / n))), rel=1e-9)
    texts = language_id.fit_text_model([b"der die das und nicht", b"the and of to in that"], ["de", "en"])
    whole, count = texts.means(raw + b" ", np.array([0, len(raw), len(raw) + 1]))
    parts, n = texts.means(raw, at)
    assert n[0] == count[0] and parts[0] == pytest.approx(whole[0], rel=1e-9)


def test_fingerprints_and_shingle_sets(long):
    assert simhash_dedup.fingerprint(long.encode()) == slow_fingerprint(long)
    import pyarrow as pa

    words = long.encode().lower().split()
    (got,) = near_copies.shingle_sets(pa.array([long]))
    assert len(got) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    a, b = near_copies.shingle_sets(pa.array([long, "one two"]))
    assert (a == got).all() and len(b) == 1


@pytest.mark.parametrize("shard_words", [200_000, 30])
def test_items_across_the_pieces(spark, long, shard_words):
    items = [(i, " ".join(f"item{i} und der x{j}" for j in range(6))) for i in range(4)]
    words = long.split()
    for at in range(500, len(words), 19_997):  # some at the cuts between pieces
        words[at:at] = items[at % 4][1].split()
    text = " ".join(words)
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.digests(docs, bench, shard_words=shard_words).collect()}
    n_hit = sum(24 for at in range(500, 450_000, 19_997))
    assert got[1][0] == len(words) and n_hit <= got[1][1] < n_hit + 40 and got[1][2] == 4
    assert got[2] == brute("short", items, 10)
    assert decontaminate.decontaminate(docs, bench, shard_words=shard_words).filter("doc_id = 1").first().text.count("item") == 0


def test_columns_of_odd_names(spark):
    rows = [(i, "the and of to in that " * 3, "en", "s", 1, 2, (3,)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `x.y` int, `a b` int, st struct<`p.q`: int>")
    kept = language_id.keep_known_languages(docs, language_id.train(docs))
    assert kept.columns == docs.columns and kept.count() == 4
    for out in (near_copies.drop_near_copies(docs), simhash_dedup.drop_near_duplicates(docs)):
        assert [tuple(r) for r in out.collect()] == [rows[0][:-1] + ((3,),)]
    assert decontaminate.decontaminate(docs, docs.selectExpr("doc_id as item_id", "'none of it' as text")).columns == docs.columns

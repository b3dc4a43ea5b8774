import random
import zlib

import numpy as np
import pytest

from ranksmith.llm.toxicity import Model, features, fit, padded, toxicity

BAD = ["idiot", "worthless", "scum"]


def make(n, seed=1):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("aeiounrst", k=rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(10, 80))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2 + len(w) // 20):
                w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def slow_grams(text, lo, hi):
    out = []
    for w in bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b >= 128 else 32 for b in text.encode()).split(b" "):
        w = b" " + w + b" "
        out += [w[i : i + n] for n in range(lo, hi + 1) for i in range(len(w) - n + 1)] if w.strip() else []
    return sorted(out)


@pytest.mark.parametrize("text", ["", "a", "ab cd", "Hello,  wörld 12!", "  x  yz   ", "é"])
def test_features_are_the_grams_of_words(text):
    raw, at = padded(text.encode(), np.array([0, len(text.encode())]))
    got = sorted(raw[i : i + n] for n, (first, _) in zip(range(3, 7), features(raw, at)) for i in first.tolist())
    assert got == slow_grams(text, 3, 6)


def test_scores_match_a_slow_mean():
    rng = np.random.default_rng(0)
    model = Model(rng.normal(size=1 << 10), -0.3)
    texts = [b"", b"idiot moron", "Ünder scöre x".encode(), b"!!!"]
    at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = model.scores(b"".join(texts), at)
    for t, s in zip(texts, got):
        raw, p = padded(t, np.array([0, len(t)]))
        w = np.concatenate([model.weight[b] for _, b in features(raw, p, buckets=1 << 10)])
        assert s == pytest.approx(1 / (1 + np.exp(-(model.intercept + (w.mean() if len(w) else 0)))))


def test_held_out_accuracy_and_misspellings(spark):
    rows = make(1200)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, None, "x"), (5000, "", "x"), (5001, "what an idiiot and worthlesss skum you are", "x"), (5002, rows[0][1] * 300, "x")], "doc_id long, text string, score string").repartition(3)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9999, 1, 0), (3, 0, 7), (4, 0, None)], "doc_id long, quality int, toxic int")
    out = toxicity(docs, labels).collect()
    assert len(out) == 1204
    truth = {i: y for i, _, y in rows}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 150 and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.9
    by = {r.doc_id: r for r in out}
    assert by[5001].predicted == 1 and by[5002].predicted == 1
    assert by[None].score == by[5000].score and not by[None].held_out


def test_one_class_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity(docs, none).collect()} == {0.5}
    assert toxicity(docs.limit(0), none).count() == 0
    assert fit([b"x", b"y"], [1, 1], 0.75).scores(b"x", np.array([0, 1]))[0] == pytest.approx(0.75)

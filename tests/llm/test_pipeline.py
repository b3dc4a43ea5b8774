"""The pipeline against a plain Python version of every stage, on a small corpus."""

import random
from collections import Counter

import pytest
from test_decontaminate import brute as hits_of
from test_mixture import draw
from test_simhash_dedup import slow_components, slow_fingerprint

import corpus_pipeline
from ranksmith.llm import decontaminate as D

WORDS = {"en": "the and of to in that with house river green".split(), "de": "der die und nicht über schön straße haus fluß".split()}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    out = tmp_path_factory.mktemp("corpus")
    items = [" ".join(rng.choices("zeta eta theta iota kappa".split(), k=14)) for _ in range(3)]
    passage = " ".join(f"{rng.choice(WORDS['en'])}{i}" for i in range(50))
    rows = []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        words = [f"{w}{rng.randrange(40) or ''}" for w in rng.choices(WORDS[lang], k=rng.randint(20, 90))]
        if i % 10 == 0:
            words[5:5] = passage.split()
        if i % 10 == 5:
            words[8:8] = items[i % 3].split()
        rows.append((i, " ".join(words), lang, f"s{i % 4 % 3}"))
    rows += [(100 + i, rows[i][1], rows[i][2], rows[i][3]) for i in (1, 2)] + [(110, "--- 123", "en", "s0"), (111, None, "en", "s0"), (112, items[0], "en", "s1")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), docs, items


def slow(docs, items):
    docs = [d for d in docs if d[0] not in (110, 111)]  # no letters: no language
    fps = {d[0]: slow_fingerprint(d[1]) for d in docs}
    comp = slow_components(set(fps.values()), lambda a, b: bin(a ^ b).count("1") <= 2)
    first = {}
    for i, f in sorted(fps.items()):
        first.setdefault(comp[f], i)
    docs = [d for d in docs if d[0] in first.values()]
    windows = Counter(tuple(w[j : j + 35]) for d in docs for w in [d[1].split()] for j in range(len(w) - 34))
    after = []
    for i, t, lang, s, _ in docs:
        w = t.split()
        gone = {p for j in range(len(w) - 34) if windows[tuple(w[j : j + 35])] > 1 for p in range(j, j + 35)}
        t = " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t
        if t:
            after.append((i, t, lang, s))
    bench, clean = list(enumerate(items)), []
    automaton = D.Automaton([D.words_of(t) for t in items])
    for i, t, lang, s in after:
        n, hit, *_ = hits_of(t, bench, 10)
        if hit > 0.5 * n:
            continue
        found = D._merge(automaton.hits(D.words_of(t))[0])
        clean.append((i, D.cut_spans(t.encode(), [{"lo": a, "hi": b} for a, b in found], 10).decode(), lang, s))
    n = Counter(d[3] for d in clean)
    raw = sum(c**0.5 for c in n.values())
    return sorted((i, t, lang, s, len(t), k) for i, t, lang, s in clean for k in range(draw(i, n[s] ** 0.5 / raw * len(clean) / n[s])))


def test_pipeline_matches_plain_python(spark, folder):
    path, docs, items = folder
    got = corpus_pipeline.run(spark, path)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key"]
    rows = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.copy) for r in got.collect())
    want = slow(docs, items)
    assert rows == want and 20 < len(want) < 90


def test_every_stage_takes_empty_tables_and_returns_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), folder[0])
        assert out.count() == 0 and set(docs.columns) <= set(out.columns)

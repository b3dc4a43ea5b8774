import hashlib
import random
import re

import pytest

from ranksmith.llm.decontaminate import Automaton, decontaminate, digests, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(doc, items, k):
    d, hit, own = words(doc), set(), []
    for i, t in items:
        w = words(t)
        windows = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        at = [(j, len(x)) for x in windows for j in range(len(d) - len(x) + 1) if tuple(d[j : j + len(x)]) == x]
        hit |= {p for j, n in at for p in range(j, j + n)}
        if at:
            own.append("" if i is None else str(i))
    return len(d), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)


def tables(seed=4):
    rng = random.Random(seed)
    vocab = ["a", "B", "c", "é", "Ü1", "d e", "zz"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 9)))) for i in range(30)] + [(None, "B b B b b"), (5, None), (6, ""), (11, "c, é; zz")]
    docs = [None, "", " .,- ", "B"] + [rng.choice([" ", "-", ", "]).join(rng.choices(vocab + ["out"], k=rng.randint(1, 60))) for _ in range(80)]
    return [(i if i % 9 else None, t) for i, t in enumerate(docs)], items


@pytest.mark.parametrize("shard_words", [200_000, 25])
def test_matches_brute_force(spark, shard_words):
    docs, items = tables()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in digests(df, bench, window=5, shard_words=shard_words).collect()), key=str)
    assert got == sorted(((i, *brute(t, items, 5)) for i, t in docs), key=str)


def test_long_items_with_many_repeats():
    rng = random.Random(9)
    items = [" ".join(rng.choices("ab", k=60)) for _ in range(12)]
    automaton = Automaton([words_of(t) for t in items], 7)
    for _ in range(60):
        doc = " ".join(rng.choices("abx", weights=[6, 6, 1], k=80))
        found, own = automaton.hits(words_of(doc))
        n, hit, n_items, _, _ = brute(doc, list(enumerate(items)), 7)
        assert (len({p for a, b in found for p in range(a, b)}), len(own)) == (hit, n_items)


@pytest.mark.parametrize("shard_words", [200_000, 5])
def test_cutting_and_coverage(spark, shard_words):
    item = "one two three four five"
    rows = [(1, f"Kept here -- {item.upper()}! and after, every word stays; more", "x"), (2, item, "x"), (3, None, "x"), (4, "", "x"), (5, "clean text\n\tas it was", "x")]
    df = spark.createDataFrame(rows, "_row long, text string, spans string")
    bench = spark.createDataFrame([(1, item), (2, "something else in the other shard of items")], "item_id long, text string")
    got = {r._row: r.text for r in decontaminate(df, bench, window=4, min_span=4, shard_words=shard_words).collect()}
    assert got == {1: "Kept here -- ! and after, every word stays; more", 3: None, 4: "", 5: "clean text\n\tas it was"}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert tuple(digests(docs, none).first())[1:4] == (2, 0, 0)
    assert digests(docs.limit(0), none).count() == 0 and decontaminate(docs.limit(0), none).count() == 0


def test_whole_short_items_are_cut_from_longer_documents(spark):
    from ranksmith.llm.decontaminate import cut_spans

    long = " ".join(f"q{i}" for i in range(30))
    rows = [(1, f"a b {long} k Short, item! c d " + "z " * 60), (2, f"short thing {'y ' * 9}"), (3, "p " * 9 + "solo p"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard_words in (200_000, 12):
        items = spark.createDataFrame([(1, long), (2, "short item"), (3, "solo")], "item_id long, text string")
        got = {r.doc_id: r.text for r in decontaminate(docs, items, shard_words=shard_words).collect()}
        assert got == {1: "a b  k ! c d " + "z " * 60, 2: rows[1][1], 3: "p " * 9 + " p", 4: None}
    assert cut_spans(b"a b c d e", [{"lo": 1, "hi": 4}], 4, 3) == b"a b c d e"

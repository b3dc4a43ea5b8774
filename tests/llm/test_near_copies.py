import random

import pytest
from test_simhash_dedup import slow_components, slow_fingerprint

from ranksmith.llm import near_copies as N
from ranksmith.llm import stages


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(x, y):
    return x == y or 9 * len(x & y) >= 4 * (len(x) + len(y)) > 0


def edited(rng, words, n):
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"x{rng.randrange(10**6)}"
    return words


def corpus():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    passage = rng.choices(base, k=40)
    texts = [None, "", " \n", "One", "one", "A b c", "a B c d", "a b c d e", "A B C D E"]
    for i in range(25):
        words = rng.choices(base, k=rng.randint(6, 200))
        texts += [" ".join(words), " ".join(edited(rng, words, max(1, len(words) // 60))).upper(), " ".join(edited(rng, words, len(words) // 30))]
    long = rng.choices(base, k=150)
    texts += [" ".join(edited(rng, long, rng.randint(0, 5))) for _ in range(90)]  # a bucket of over SMALL_CELL
    texts += [" ".join(passage + rng.choices(base, k=rng.randint(1, 30))) for _ in range(90)]
    chain = rng.choices(base, k=100)
    for _ in range(8):
        chain = edited(rng, chain, 2)
        texts.append(" ".join(chain))
    for n in (33, 66, 130):  # sizes whose parities have different lengths
        words = rng.choices(base, k=n)
        texts += [" ".join(words), " ".join(words + ["y"] * (n // 10)), " ".join(words + ["z"] * n)]
    texts += texts[10:14]
    rows = [(i if i % 11 else None, t, "x") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("frequent,cell", [(8, 512), (10**9, 6)])
def test_the_stage_matches_brute_force(spark, monkeypatch, frequent, cell):
    monkeypatch.setattr(N, "FREQUENT", frequent)
    monkeypatch.setattr(N, "CELL", cell)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string").repartition(3).cache()
    docs.count()
    sets = [shingles(t) for _, t, _ in rows]
    comp = slow_components(range(len(rows)), lambda a, b: alike(sets[a], sets[b]))
    least, size = {}, {}
    for k, (i, _, _) in enumerate(rows):
        size[comp[k]] = size.get(comp[k], 0) + 1
        if i is not None:
            least[comp[k]] = min(i, least.get(comp[k], i))
    kept = stages.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = [r.doc_id for r in kept.collect()]
    assert len(got) == len(size)
    assert sorted(i for i in got if i is not None) == sorted(least.values())


def test_the_stage_finds_copies_beyond_two_bits(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(120)]
    near = next(w for w in (edited(rng, words, 2) for _ in range(99)) if bin(slow_fingerprint(" ".join(w)) ^ slow_fingerprint(" ".join(words))).count("1") > 2)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near))], "doc_id long, text string")
    assert [r.doc_id for r in stages.near_duplicates(spark, docs, "").collect()] == [1]


def test_cells_pair_all_that_are_apart():
    """Every pair of different components meets in some cell, with its main component dealt over several cells."""
    import numpy as np
    import pyarrow as pa

    root = [0] * 9 + [1, 1, 2, 3]
    cells = 3
    rows = []
    for part in range(cells):
        for i, r in enumerate(root):
            main, own = r == 0, i % cells
            if not main or own == part:
                rows.append({"cell": part, "_row": i, "n": 1, "shared": 1, "place": 0, "root": r, "main": main, "home": own == part, "odd": bytes(8 * N.PARITY_WORDS)})
    got = [p for batch in N._unconnected(iter(pa.RecordBatch.from_pylist(rows).slice(k, 5) for k in range(0, len(rows), 5))) for p in zip(*(batch.column(c).to_pylist() for c in "ab"))]
    assert sorted(got) == [(a, b) for a in range(13) for b in range(a + 1, 13) if root[a] != root[b]]
    assert 9 * np.bitwise_count(np.frombuffer(N.parities(np.arange(5, dtype=np.uint64)), np.uint64)).sum() == 45


def far_first():
    """A group of near copies whose first ones are alike to half of the others only."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    return [" ".join(edited(rng, base, n)) for n in [5] * 6 + [2, 4] * 40], 1


def quoted():
    """A group of near copies that a longer text quotes as a whole; what else is in it is more frequent."""
    rng = random.Random(6)
    base, more = [f"w{i}" for i in range(100)], [f"x{i}" for i in range(100)]
    others = [" ".join(more + [f"y{k}-{i}" for i in range(100)]) for k in range(80)]
    return [" ".join(base + more), *others, *(" ".join(edited(rng, base, 1)) for _ in range(70))], 82


@pytest.mark.parametrize("corpus", [far_first, quoted])
def test_a_group_takes_no_square_of_comparisons(spark, monkeypatch, corpus):
    compared, open_pairs = [], N._open_pairs

    def counted(*given):
        pairs = open_pairs(*given).cache()
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(N, "_open_pairs", counted)
    texts, components = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert N.drop_near_copies(docs).count() == components
    assert compared[0] <= 10 * len(texts)


def test_empty(spark):
    assert N.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0

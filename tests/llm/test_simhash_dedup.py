import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from ranksmith.llm import simhash_dedup as S
from ranksmith.llm.components import connected_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hs = [xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_documents_match_brute_force(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(120)]
    texts = [None, "", " \n", "One", "one", "A b", "É x y z"] + [" ".join(rng.choices(base, k=rng.randint(1, 9))) for _ in range(30)]
    long = rng.choices(base, k=300)
    for _ in range(12):
        near = list(long)
        near[rng.randrange(300)] = "zz"
        texts.append(" ".join(near).upper())
    texts += [" ".join(long)] * 3
    rows = [(i if i % 9 else None, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3).cache()
    docs.count()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in S.digests(docs).collect()]
    fps = [slow_fingerprint(t) for _, t, _ in rows]
    comp = slow_components(set(fps), lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, _, _), f in zip(rows, fps):
        if i is not None:
            least[comp[f]] = min(i, least.get(comp[f], i))
    want = [(i, f"{f:016x}", least.get(comp[f])) for (i, _, _), f in zip(rows, fps)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = S.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(comp.values()))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} == set(least.values())


@pytest.mark.parametrize("big", [2, 4096])
def test_links_of_dense_fingerprints(spark, big):
    rng = random.Random(big)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1, 1 << 63, 1 << 60, 1 << 59}
    for f in list(fps):
        for _ in range(6):
            f ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            fps.add(f)
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = S.fingerprint_links(df, big=big).collect()
    mask = (1 << 64) - 1
    assert all(bin((r.a ^ r.b) & mask).count("1") > 0 for r in links)
    want = slow_components(signed, lambda a, b: bin((a ^ b) & mask).count("1") <= 2)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long"), "a", "b").collect()}
    assert {n: got.get(n, n) for n in signed} == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.digests(docs).count() == 0 and S.drop_near_duplicates(docs).count() == 0


def test_components_of_paths_and_rings(spark):
    rng = random.Random(5)
    order = list(range(200))
    rng.shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(120)] + [(500, 500), (600, 601), (601, 600), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "x long, y long"), "x", "y").collect()}
    want = {n: min(order[:121]) for n in order[:121]} | {600: 600, 601: 600}
    assert got == want

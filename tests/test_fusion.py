import math
import random

import pytest

from ranksmith.operators import fusion as N
from ranksmith.operators import shaping

LISTS = {0: {2: 0.5, 4: 0.2}, 1: {3: 0.9, 4: 0.7, 2: 0.1}}
GOLDEN = {
    "min_max": {(0, 2): 1.0, (0, 4): 0.001, (1, 3): 1.0, (1, 4): 0.75, (1, 2): 0.001},
    "l2": {(0, 2): 0.928477, (0, 4): 0.371391, (1, 3): 0.786334, (1, 4): 0.611593, (1, 2): 0.08737},
    "z_score": {(0, 2): 0.707107, (0, 4): 0.001, (1, 3): 0.800641, (1, 4): 0.320256, (1, 2): 0.001},
    "rrf": {(0, 2): 0.0163934426, (0, 4): 0.0161290323, (1, 3): 0.0163934426, (1, 4): 0.0161290323, (1, 2): 0.0158730159},
}


def frames(spark, lists):
    return [spark.createDataFrame(list(d.items()), "doc_id long, score double") for _, d in sorted(lists.items())]


@pytest.mark.parametrize("technique", GOLDEN)
def test_normalization(spark, technique):
    ranked = N.rank_lists(frames(spark, LISTS), 10)
    got = {(r.sub_query, r.doc_id): r.normalized for r in N.normalize(ranked, technique).collect()}
    assert got == pytest.approx(GOLDEN[technique], abs=1e-6)


def test_single_result_and_negative_scores(spark):
    one = N.rank_lists(frames(spark, {0: {1: 7.5}, 1: {1: -2.0, 2: 0.0}}), 10)
    assert {r.normalized for r in N.normalize(one).collect()} == {1.0}
    assert N.normalize(one, "z_score").first().normalized == 7.5
    assert one.count() == 1  # scores of zero or less are never collected


@pytest.mark.parametrize(
    "bounds,want",
    [
        ({"lower_bounds": [{"mode": "apply", "min_score": 0.1}]}, {1: 1.0, 2: 0.4 / 0.9, 3: 0.001}),
        ({"lower_bounds": [{"mode": "clip", "min_score": 0.3}]}, {1: 1.0, 2: 0.2 / 0.7, 3: 0.001}),
        ({"lower_bounds": [{"mode": "ignore", "min_score": 0.3}]}, {1: 1.0, 2: 0.45 / 0.95, 3: 0.001}),
        ({"upper_bounds": [{"mode": "clip", "max_score": 0.5}]}, {1: 1.0, 2: 1.0, 3: 0.001}),
        ({"upper_bounds": [{"mode": "apply", "max_score": 0.7}]}, {1: 1.0, 2: 0.45 / 0.65, 3: 0.001}),
    ],
)
def test_bounds(spark, bounds, want):
    ranked = N.rank_lists(frames(spark, {0: {1: 1.0, 2: 0.5, 3: 0.05}}), 10)
    assert {r.doc_id: r.normalized for r in N.normalize(ranked, "min_max", **bounds).collect()} == pytest.approx(want, abs=1e-6)


COMBINED = [
    ("arithmetic_mean", (1.0, 0.0, 0.6), 0.69),
    ("geometric_mean", (1.0, 0.5, 0.3), 0.5567),
    ("geometric_mean", (1.0, 0.0, 0.6), 0.7863),
    ("harmonic_mean", (1.0, 0.5, 0.3), 0.48),
    ("harmonic_mean", (1.0, 0.0, 0.6), 0.7611),
    ("rrf", (1.0, 0.0, 0.6), 0.69),
]


@pytest.mark.parametrize("technique,scores,want", COMBINED)
def test_combination(spark, technique, scores, want):
    df = spark.createDataFrame([scores], "s0 double, s1 double, s2 double")
    assert df.select(N.combined(technique, 3, [0.45, 0.15, 0.4]).alias("x")).first().x == pytest.approx(want, abs=1e-4)
    zeros = spark.createDataFrame([(0.0, 0.0)], "s0 double, s1 double")
    assert zeros.select(N.combined(technique, 2).alias("x")).first().x == 0.0


def test_random_lists_against_a_plain_version_and_any_partitioning(spark):
    rng = random.Random(1)
    lists = {i: {d: rng.uniform(0.01, 9) for d in rng.sample(range(60), 30)} for i in range(3)}
    want = {}
    for d in {d for x in lists.values() for d in x}:
        total = 0.0
        for x in lists.values():
            kept = dict(sorted(x.items(), key=lambda p: (-p[1], p[0]))[:20])
            lo, hi = min(kept.values()), max(kept.values())
            total += max((kept[d] - lo) / (hi - lo), 0.001) if d in kept else 0
            want.setdefault(d, [False])
            want[d][0] |= d in kept
        want[d].append(round(total / 3, 6))
    want = {d: v for d, (seen, v) in want.items() if seen}
    for parts in (1, 5):
        got = {r.doc_id: r.score for r in N.fuse([f.repartition(parts) for f in frames(spark, lists)], 20).collect()}
        assert got == pytest.approx(want, abs=2e-6)


def test_many_queries_in_one_plan(spark):
    a = spark.createDataFrame([(q, d, float(q + d)) for q in (1, 2) for d in (1, 2, 3)], "query_id int, doc_id long, score double")
    got = N.fuse([a, a], 10, keys=["query_id"])
    assert {(r.query_id, r.doc_id): r.score for r in got.collect()} == pytest.approx({(q, d): {1: 0.001, 2: 0.5, 3: 1.0}[d] for q in (1, 2) for d in (1, 2, 3)})


def test_what_is_rejected(spark):
    lists = frames(spark, LISTS)
    for bad in (
        lambda: N.rank_lists(lists * 3, 10),
        lambda: N.rank_lists([], 10),
        lambda: N.rank_lists(lists, 0),
        lambda: N.fuse(lists, 10, weights=[0.5]),
        lambda: N.fuse(lists, 10, weights=[0.9, 0.3]),
        lambda: N.fuse(lists, 10, weights=[1.5, -0.5]),
        lambda: N.fuse(lists, 10, "z_score", "geometric_mean"),
        lambda: N.fuse(lists, 10, "max"),
        lambda: N.fuse(lists, 10, "rrf", "rrf", rank_constant=0),
        lambda: N.fuse(lists, 10, lower_bounds=[{"mode": "apply"}]),
        lambda: N.fuse(lists, 10, lower_bounds=[{"mode": "x"}, {}]),
        lambda: N.fuse(lists, 10, lower_bounds=[{"min_score": 10001}, {}]),
        lambda: N.normalize(N.rank_lists(lists, 10), "l2", x=1),
        lambda: shaping.at_least(lists[0], math.nan),
        lambda: shaping.search_after(lists[0], shaping.BY_SCORE, []),
        lambda: shaping.check_sort([("score", True), ("name", False)]),
        lambda: shaping.page(lists[0], -1),
    ):
        with pytest.raises(ValueError):
            bad()


STOCK = [("Dunes part 2", 25, "Drama"), ("Dunes part 1", 22, "Drama"), ("Mission Impossible 1", 256, "Action"), ("Mission Impossible 2", 25, "Action"), ("The Terminal", 20, "Drama"), ("Avengers", 20, "Sci-fi")]


def stock(spark):
    return spark.createDataFrame([(i, *r, 0.1 * i) for i, r in enumerate(STOCK)] + [(6, "none", None, None, 0.9)], "doc_id long, name string, stock int, category string, score double")


def test_sorting_paging_and_search_after(spark):
    sort = [("stock", True), ("name", False)]
    names = [r.name for r in shaping.page(stock(spark), 10, 0, sort).collect()]
    assert names == ["Mission Impossible 1", "Dunes part 2", "Mission Impossible 2", "Dunes part 1", "Avengers", "The Terminal", "none"]
    after = shaping.search_after(stock(spark), sort, [25, "Dunes part 2"])
    assert [r.name for r in shaping.page(after, 10, 0, sort).collect()] == names[2:]
    assert [r.name for r in shaping.page(stock(spark), 2, 3, sort).collect()] == names[3:5]
    tie = shaping.search_after(stock(spark), [("stock", False)], [20], doc_id=4)
    assert [r.doc_id for r in shaping.page(tie, 10, 0, [("stock", False)]).collect()] == [5, 1, 0, 3, 2, 6]


def test_collapse_and_rescore(spark):
    best = {r.category: r.doc_id for r in shaping.collapse(stock(spark), "category").collect()}
    assert best == {"Drama": 4, "Action": 3, "Sci-fi": 5, None: 6}
    assert shaping.collapse_hits(stock(spark), "category", 2).count() == 6
    second = spark.createDataFrame([(5, 2.0), (0, 9.0)], "doc_id long, score double")
    got = {r.doc_id: r.score for r in shaping.rescore(stock(spark), second, 2, 1.0, 0.5).collect()}
    assert got[5] == 1.5 and got[0] == 0.0 and got[6] == 0.9

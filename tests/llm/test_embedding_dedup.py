import math

import numpy as np
import pytest

from ranksmith.llm import embedding_dedup as E


def rows_of(seed=0, n=220, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = []
    for i in range(n):
        v = centres[i % 12] * rng.uniform(0.5, 2) + rng.normal(scale=0.35, size=dim)
        rows.append((i, [float(x) for x in v], int(i % 3)))
    rows += [(1000 + i, rows[5][1], rows[5][2]) for i in range(9)]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None, 0), (2001, [], 0), (2002, [0.0] * dim, 0), (2003, [nan] * dim, 0), (2004, [inf] * dim, 0), (2005, [None] * dim, 0), (2006, rows[0][1], None), (2007, rows[0][1][:3], 0), (None, rows[5][1], rows[5][2]), (None, rows[4][1], 7)]
    return rows


def brute(rows, threshold):
    def usable(r):
        return r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1])

    def linked(a, b):
        if not (usable(a) and usable(b)) or a[2] != b[2] or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold - 1e-12

    n = len(rows)
    near = [[j for j in range(n) if j != i and linked(rows[i], rows[j])] for i in range(n)]
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        todo, comp = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in comp:
                    comp.add(j)
                    todo.append(j)
        seen |= comp
        least = min((rows[j][0] for j in comp if rows[j][0] is not None), default=None)
        for j in comp:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return out


@pytest.mark.parametrize("cell,block", [(2000, 2048), (9, 8), (5, 1000), (1000, 7)])
def test_matches_brute_force(spark, cell, block):
    rows = rows_of()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, row string").repartition(3)
    got = sorted((tuple(r) for r in E.near_duplicates(df, cell=cell, block=block).collect()), key=str)
    assert got == sorted(brute(rows, 0.93), key=str)


def test_replication_never_misses_a_neighbour():
    rng = np.random.default_rng(3)
    for r in (0.1, 0.374, 0.9):
        u = E.unit(rng.normal(size=(400, 4)))
        p = u[:15]
        d = E.distances(u, p)
        home = d.argmin(axis=1)
        cover = np.array([d[home == j, j].max(initial=0) for j in range(15)])
        home, where = E.visits(d, E.distances(p, p), cover, r)
        near = E.distances(u, u) <= r
        for i, j in np.argwhere(near):
            assert where[i, home[j]]
        assert r > 0.5 or not where.all()


def test_floats_and_empty(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [2.0, 0.1], 1), (3, [0.0, 1.0], 1)], "vec_id long, embedding array<float>, label int")
    got = sorted(tuple(r) for r in E.near_duplicates(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_tiles_of_a_block_unite():
    rng = np.random.default_rng(5)
    u = E.unit(rng.normal(size=(40, 3)))
    ids, weights = np.arange(40) * 7, rng.integers(1, 5, 40)
    whole, parts = (E.block_links(u, u, ids, ids, weights, 0.9, tile) for tile in ((1000, 1000), (3, 4)))
    assert (whole[0] == parts[0]).all() and sorted(whole[1]) == sorted(parts[1]) and len(whole[1]) > 5

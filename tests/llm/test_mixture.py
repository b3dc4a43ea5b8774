import hashlib
import math

import pytest

from ranksmith.llm.mixture import mix_sources, rates


def draw(key, rate, seed=17):
    u = int(hashlib.md5(f"{seed}|{'' if key is None else key}".encode()).hexdigest()[:13], 16) / 2**52
    p = c = math.exp(-rate)
    k = 0
    while c <= u and k < rate + 10 * math.sqrt(rate) + 16:
        k += 1
        p *= rate / k
        c += p
    return k


def docs(spark, n=600):
    rows = [(i if i % 50 else None, f"t{i}", "hot" if i % 3 else (None if i % 2 else f"s{i % 5}"), "x") for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, copy string").repartition(4)


@pytest.mark.parametrize("targets", [None, {"hot": 0.2, "s0": 0.5, None: 0.3}])
def test_every_draw_and_shares(spark, targets):
    rows, df = docs(spark)
    n = {}
    for r in rows:
        n[r[2]] = n.get(r[2], 0) + 1
    raw = {s: (c**0.5 if targets is None else targets.get(s, 0)) for s, c in n.items()}
    rate = {s: raw[s] / sum(raw.values()) * len(rows) / n[s] for s in n}
    got = sorted(((r.doc_id, r.text, r.copy) for r in mix_sources(df, targets=targets).collect()), key=str)
    want = sorted(((i, t, k) for i, t, s, _ in rows for k in range(draw(i, rate[s]))), key=str)
    assert got == want
    assert {r.source: pytest.approx(r.rate) for r in rates(df, targets=targets).collect()} == rate


def test_draws_do_not_depend_on_partitions_and_are_shuffled(spark):
    _, df = docs(spark)
    a, b = (sorted(map(str, mix_sources(df.repartition(p)).collect())) for p in (1, 7))
    assert a == b
    keys = [r.shuffle_key for r in mix_sources(df).coalesce(1).collect()]
    assert len(set(keys)) > 0.5 * len(keys)


def test_empty_and_bad_weights(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(df).count() == 0
    with pytest.raises(ValueError):
        rates(df, targets={"a": -1})


def test_rates_beyond_one_table(spark):
    def summed(key, rate):
        parts = max(1, math.ceil(rate / 700))
        return sum(draw(key if k == 0 else f"part|{k}|{'' if key is None else key}", rate / parts) for k in range(parts))

    rows = [(i if i else None, "rare" if i < 2 else "less" if i < 5 else "hot") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = {}
    for r in mix_sources(df, targets={"rare": 0.9, "less": 0.08, "hot": 0.02}).groupBy("doc_id", "source").count().collect():
        got[r.doc_id, r.source] = r["count"]
    rate = {"rare": 900.0, "less": 160 / 3, "hot": 40 / 1995}
    assert got == {(i, s): n for i, s in rows if (n := summed(i, rate[s]))}
    few = mix_sources(df, targets={"rare": 0.5, "hot": 0.5}).groupBy("source").count().collect()
    assert abs({r.source: r["count"] for r in few}["rare"] - 1000) < 5 * 1000**0.5
    one = spark.createDataFrame([(i, "one" if i == 0 else "hot") for i in range(20000)], "doc_id long, source string")
    n = mix_sources(one, targets={"one": 1.0}).count()
    assert abs(n - 20000) < 5 * 20000**0.5

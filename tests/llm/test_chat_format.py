import itertools
import random

import pytest

from ranksmith.llm import chat_format as C


def brute_cost(roles):
    """The cheapest repair, by trying every choice for every turn."""
    best = None
    legal = {("start", "system"), ("start", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")}
    names = ("system", "user", "assistant")

    def relabel(raw, to):
        return 0 if raw == to else C.COSTS["relabel_unknown" if raw == "unknown" else "relabel"]

    def go(i, state, cost):
        nonlocal best
        if i == len(roles):
            cost += {"start": 0, "assistant": 0, "user": 4, "system": 8}[state]
            best = cost if best is None else min(best, cost)
            return
        for to in names:
            if state == to:
                go(i + 1, to, cost + C.COSTS["merge"] + relabel(roles[i], to))
            if (state, to) in legal:
                go(i + 1, to, cost + relabel(roles[i], to))
            for u in names:
                if (state, u) in legal and (u, to) in legal:
                    go(i + 1, to, cost + C.COSTS["insert"] + relabel(roles[i], to))

    go(0, "start", 0)
    return best


def cost_of(actions, roles):
    total = 0
    for a, raw in zip(actions, roles):
        for x in a.split("+"):
            total += {"keep": 0, "merge": C.COSTS["merge"], "relabel": C.COSTS["relabel_unknown" if raw == "unknown" else "relabel"]}.get(x, C.COSTS["insert"])
    return total


@pytest.mark.parametrize("chunk", [2, 512])
def test_least_cost_and_legal_rendering(spark, chunk):
    rng = random.Random(chunk)
    rows = []
    kinds = ["user", "assistant", "system", " Human ", "gpt", "tool", None]
    convs = [list(x) for n in (1, 2) for x in itertools.product(kinds, repeat=n)] + [rng.choices(kinds, k=rng.randint(3, 7)) for _ in range(40)]
    for c, roles in enumerate(convs):
        rows += [(c if c else None, t, r, rng.choice([None, "", f"text {t}", "a <|end|> b"]), "x") for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, place string").repartition(5)
    out = {}
    for r in C.repair(df, chunk=chunk).collect():
        out.setdefault(r.conv_id or 0, []).append(r)
    assert sum(map(len, out.values())) == len(rows)
    for c, roles in enumerate(convs):
        got = sorted(out[c], key=lambda r: r.place)
        assert [r.turn for r in got] == list(range(len(roles))) == [r.place for r in got]
        raw = [C.role_of(r) for r in roles]
        assert cost_of([r.action for r in got], raw) == brute_cost(raw)
        whole = "".join(r.rendered for r in got)
        heads = [part.split("|>")[0] for part in whole.split("<|")[1:]]
        assert heads[1::2] == ["end"] * (len(heads) // 2) and whole.endswith("<|end|>\n")
        names = heads[::2]
        names = names[1:] if names[0] == "system" else names
        assert names and names == ["user", "assistant"] * (len(names) // 2)


def test_long_conversation_in_pieces_is_one_repair(spark):
    rng = random.Random(3)
    roles = rng.choices(["user", "assistant", "system", "x"], k=900)
    rows = [("hot", t, r, "t") for t, r in enumerate(roles)]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string").repartition(4)
    one, many = (sorted(tuple(r) for r in C.repair(df, chunk=k).collect()) for k in (10_000, 7))
    raw = [C.role_of(r) for r in roles]
    by_place = lambda x: [r[4] for r in sorted(x, key=lambda r: r[2])]
    assert cost_of(by_place(one), raw) == cost_of(by_place(many), raw)


def test_null_turns_ties_repeats_and_empty(spark):
    rows = [(1, None, "assistant", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 3, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = sorted(C.repair(df).collect(), key=lambda r: r.place)
    assert "".join(r.rendered for r in got) == "<|user|>\na\na<|end|>\n<|assistant|>\nb\nz<|end|>\n"
    assert [r.action for r in got] == ["keep", "merge", "keep", "merge"]
    assert C.repair(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [2, 512])
def test_crowded_pieces_are_dealt_out_and_repaired_alike(spark, group):
    rng = random.Random(group)
    rows = [(None, None, "user", "same")] * 300 + [(None, None, rng.choice(["user", "assistant", None]), f"t{i % 40}") for i in range(200)]
    rows += [(1, 5, rng.choice(["user", "assistant", "tool"]), f"u{i % 30}") for i in range(200)]
    rows += [(2, t, rng.choice(["user", "assistant", "system"]), None if t == 3 else f"v{t}") for t in range(60)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(5)
    got = {}
    for r in C.repair(df, chunk=4, group=group, max_piece=50).collect():
        got.setdefault(r.conv_id, []).append(r)
    whole = {}
    for r in C.repair(df).collect():
        whole.setdefault(r.conv_id, []).append(r)
    key = lambda r: (r[1] is None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv in (None, 1, 2):
        own = sorted((r for r in rows if r[0] == conv), key=key)
        raw = [C.role_of(r[2]) for r in own]
        parts, all_at_once = (sorted(x[conv], key=lambda r: r.place) for x in (got, whole))
        assert [r.place for r in parts] == list(range(len(own))) and [r.turn for r in parts] == [r[1] for r in own]
        assert cost_of([r.action for r in parts], raw) == cost_of([r.action for r in all_at_once], raw)
        for r, (_, _, _, text) in zip(parts, own):
            assert (text or "") in r.rendered
        heads = [part.split("|>")[0] for part in "".join(r.rendered for r in parts).split("<|")[1:]]
        names = heads[::2][1:] if heads[0] == "system" else heads[::2]
        assert heads[1::2] == ["end"] * (len(heads) // 2) and names == ["user", "assistant"] * (len(names) // 2)


def test_power_composes():
    for role, (step, _) in C.MOVES.items():
        total = step
        for n in range(1, 9):
            assert (C.power(step, n) == total).all(), (role, n)
            total = C.compose(total, step)

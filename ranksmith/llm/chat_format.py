"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the
assistant. Each turn of the input is merged into the turn before it, or starts a turn; either way its role may be
relabelled, and an empty turn may be inserted before it and after the last turn. The automaton of legal turns has four
states (nothing yet, and the role of the last turn); dynamic programming over it finds the repair of least total cost
(``COSTS``; of equal ones the earlier state in ``STATES`` wins, from the end backwards, ends of pieces first).

A conversation of any length is repaired in pieces of ``CHUNK`` turn numbers: costs of a piece are a 4 x 4 matrix in the
(min, +) semiring, these compose to groups of ``GROUP`` pieces and then along the conversation, and with its entry and exit
states fixed each group, then each piece, is decoded on its own. So a conversation that holds a third of all rows is
spread over tasks. A piece of more than ``MAX_PIECE`` rows (null or tied turn numbers) or ``MAX_PIECE_CHARS`` is dealt out by ranges of its order;
there repeated rows travel as one row with a count, cut into runs, so not even one row repeated everywhere is one task's.

Order: turn number, null ones last; ties by role, then text (null first), so repeated rows are neighbours and usually
merge. A null conversation id is one conversation. Roles are trimmed and lower-cased, with the aliases in ``ALIASES``;
null and unknown roles cost less to relabel. Null texts are empty. Template markers inside texts are broken by a space,
so no text can end its turn. Output: a row for each input row, with ``place`` in its conversation, the repaired ``role``,
the ``action`` and ``rendered``, its part of the rendered conversation: the parts in order of place, joined by nothing, are
the whole, which is never one value in memory. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.storage import materialize, small_batches

STATES = ("start", "system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant"}
COSTS = {"merge": 2, "relabel": 3, "relabel_unknown": 1, "insert": 4}
CHUNK = 512
GROUP = 512
MAX_PIECE = 1 << 16
MAX_PIECE_CHARS = 1 << 25
OPEN, CLOSE = "<|{}|>\n", "<|end|>\n"
_LEGAL = {(0, 1), (0, 2), (1, 2), (2, 3), (3, 2)}
_FAR = 1 << 40


def _moves() -> dict[str, tuple[np.ndarray, list]]:
    """For each role of an input turn: the cost from state to state, and how (inserted role or none, merged)."""
    out = {}
    for raw in ("system", "user", "assistant", "unknown"):
        cost, how = np.full((4, 4), _FAR, np.int64), [[None] * 4 for _ in range(4)]
        for s in range(4):
            for t in range(1, 4):
                relabel = 0 if raw == STATES[t] else COSTS["relabel_unknown" if raw == "unknown" else "relabel"]
                ways = [(relabel, (None, False))] if (s, t) in _LEGAL else []
                ways += [(relabel + COSTS["merge"], (None, True))] if s == t else []
                ways += [(relabel + COSTS["insert"], (u, False)) for u in range(1, 4) if (s, u) in _LEGAL and (u, t) in _LEGAL]
                if ways:
                    cost[s, t], how[s][t] = min(ways, key=lambda w: w[0])
        out[raw] = (cost, how)
    return out


MOVES = _moves()
#: Cost of ending in a state, and what is inserted there.
ENDING = [(0, ()), (2 * COSTS["insert"], (2, 3)), (COSTS["insert"], (3,)), (0, ())]


def role_of(raw: str | None) -> str:
    role = (raw or "").strip().lower()
    role = ALIASES.get(role, role)
    return role if role in STATES[1:] else "unknown"


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def power(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` composed with itself, ``n`` times in all."""
    out = None
    while n:
        out, n, a = (a if out is None else compose(out, a)) if n & 1 else out, n >> 1, compose(a, a) if n > 1 else a
    return out


def route(steps: list[np.ndarray], entry: int, leave: int | None = None) -> list[int]:
    """States after each step of the cheapest way from ``entry`` to ``leave``, or to the cheapest end."""
    costs = np.full(4, _FAR, np.int64)
    costs[entry] = 0
    back = []
    for step in steps:
        total = costs[:, None] + step
        back.append(total.argmin(axis=0))
        costs = np.minimum(total.min(axis=0), _FAR)
    states = [int((costs + np.array([c for c, _ in ENDING])).argmin()) if leave is None else leave]
    for b in reversed(back[1:]):
        states.append(int(b[states[-1]]))
    return states[::-1]


#: A group of pieces, and a piece: ``_part`` is -1, or the range of a piece that was dealt out.
_GROUP = ["conv_id", "_no_turn", "_group"]
_KEYS = ["conv_id", "_no_turn", "_group", "_chunk", "_part"]


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Rows with equal keys, which arrive next to each other."""
    now, rows = object(), []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if key != now:
                if rows:
                    yield rows
                now, rows = key, []
            rows.append(row)
    if rows:
        yield rows


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _same(conv: str, *keys: tuple[str, str]) -> Column:
    """A join on the conversation, null-safely, and on keys that are never null."""
    on = F.col("conv_id").eqNullSafe(F.col(conv))
    for a, b in keys:
        on = on & (F.col(a) == F.col(b))
    return on


def _dealt(rows: DataFrame, run: int, max_piece: int) -> DataFrame:
    """``rows`` with ``_part`` and ``_copies``: pieces of more than ``max_piece`` rows in ranges, their repeated rows in runs."""
    spark, key = rows.sparkSession, ["conv_id", "_no_turn", "_group", "_chunk"]
    sizes = rows.groupBy(*key).agg(F.count("*").alias("rows"), F.sum(F.length("text")).alias("chars"))
    large = sizes.filter((F.col("rows") > max_piece) | (F.col("chars") > MAX_PIECE_CHARS)).select(*[F.col(k).alias(f"l{i}") for i, k in enumerate(key)])
    large, _ = materialize(large, "large")
    plain = rows.withColumns({"_part": F.lit(-1), "_copies": F.lit(1).cast("long")})
    if large.isEmpty():
        return plain
    on = _same("l0", *[(k, f"l{i}") for i, k in enumerate(key) if i])
    counted = rows.join(large, on, "left_semi").groupBy(*rows.columns).agg(F.count("*").alias("n"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / run).cast("long"))).alias("i"))
    runs = runs.withColumn("_copies", F.least(F.lit(run).cast("long"), F.col("n") - F.col("i") * run))
    runs = runs.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, "turn", "role", "text", "i")
    runs, _ = materialize(runs.select(*rows.columns, F.spark_partition_id().alias("_part"), "_copies"), "runs")
    return plain.join(large, on, "left_anti").unionByName(runs)


def repair(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = CHUNK, group: int = GROUP, max_piece: int = MAX_PIECE) -> DataFrame:
    """``conv_id, turn, place, role, action, rendered`` of every row."""
    small_batches(turns.sparkSession)
    kind, number = turns.schema[conv_id].dataType.simpleString(), turns.schema[turn].dataType.simpleString()
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("_no_turn", F.col("turn").isNull()).withColumn("_chunk", F.coalesce(F.floor(F.col("turn") / chunk).cast("long"), F.lit(0).cast("long")))
    rows = _dealt(rows.withColumn("_group", F.floor(F.col("_chunk") / group).cast("long")), chunk, max_piece)

    group_types = f"conv_id {kind}, _no_turn boolean, _group long"
    key_types = f"{group_types}, _chunk long, _part int"
    probe = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn")).limit(0).toArrow().schema
    group_schema = [probe.field("conv_id"), pa.field("_no_turn", pa.bool_()), pa.field("_group", pa.int64())]
    key_schema = [*group_schema, pa.field("_chunk", pa.int64()), pa.field("_part", pa.int32())]

    def summary(keys: list[str], fields: list[pa.Field], step):
        """For each run of rows with equal ``keys``: its turns, and the costs of its steps together."""
        schema = pa.schema([*fields, pa.field("n", pa.int64()), pa.field("costs", pa.list_(pa.int64()))])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for run in _runs(batches, keys):
                total = step(run[0])
                for row in run[1:]:
                    total = compose(total, step(row))
                yield {**{k: run[0][k] for k in keys}, "n": sum(row["n"] for row in run), "costs": total.ravel().tolist()}

        return lambda batches: _batches(each(batches), schema)

    def costs_of(row: dict) -> np.ndarray:
        return np.array(row["costs"]).reshape(4, 4)

    def plan(within: list[str], keys: list[str], fields: list[pa.Field]):
        """For each row, a stretch of turns: its first place, entry and exit states, and whether it is the conversation's last.

        ``first, entry, leave, last`` of the rows' own group are given, or null where a group is a whole conversation."""
        schema = pa.schema([*fields, *[pa.field(c, pa.int64()) for c in ("first", "entry", "leave", "last")]])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for run in _runs(batches, within):
                entry, first, last = run[0].get("entry", 0), run[0].get("first", 0), run[0].get("last", 1)
                for i, (row, leave) in enumerate(zip(run, route([costs_of(r) for r in run], entry, run[0].get("leave")))):
                    yield {**{k: row[k] for k in keys}, "first": first, "entry": entry, "leave": leave, "last": int(last and i + 1 == len(run))}
                    first, entry = first + row["n"], leave

        return lambda batches: _batches(each(batches), schema)

    out_schema = pa.schema([probe.field("conv_id"), probe.field("turn"), pa.field("place", pa.int64()), pa.field("role", pa.string()), pa.field("action", pa.string()), pa.field("rendered", pa.string())])

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[dict]:
            for run in _runs(batches, _KEYS):
                run = [row for row in run for _ in range(row["_copies"])]
                roles, before = [role_of(r["role"]) for r in run], run[0]["entry"]
                for i, (row, raw, state) in enumerate(zip(run, roles, route([MOVES[r][0] for r in roles], before, run[0]["leave"]))):
                    inserted, merged = MOVES[raw][1][before][state]
                    actions = [f"insert_{STATES[inserted]}"] if inserted else []
                    actions += ["merge"] if merged else []
                    actions += ["relabel"] if raw != STATES[state] else []
                    body = (row["text"] or "").replace("<|", "< |")
                    if merged:
                        part = "\n" + body
                    else:
                        part = (CLOSE if before else "") + (OPEN.format(STATES[inserted]) + CLOSE if inserted else "") + OPEN.format(STATES[state]) + body
                    if row["last"] and i + 1 == len(run):
                        part += CLOSE + "".join(OPEN.format(STATES[x]) + CLOSE for x in ENDING[state][1])
                        actions += [f"end_{STATES[x]}" for x in ENDING[state][1]]
                    yield {"conv_id": row["conv_id"], "turn": row["turn"], "place": row["first"] + i, "role": STATES[state], "action": "+".join(actions) or "keep", "rendered": part}
                    before = state

        return _batches(each(), out_schema)

    places = "first long, entry long, leave long, last long"
    # Costs need no texts: turns of one number and role are alike.
    bare = rows.select(*_KEYS, "turn", "role", F.col("_copies").alias("n")).repartition(*_KEYS).sortWithinPartitions(*_KEYS, "turn", "role")
    pieces = bare.mapInArrow(summary(_KEYS, key_schema, lambda row: power(MOVES[role_of(row["role"])][0], row["n"])), f"{key_types}, n long, costs array<long>")
    pieces, _ = materialize(pieces, "pieces")
    groups = pieces.repartition(*_GROUP).sortWithinPartitions(*_KEYS).mapInArrow(summary(_GROUP, group_schema, costs_of), f"{group_types}, n long, costs array<long>")
    ways = groups.repartition("conv_id").sortWithinPartitions(*_GROUP).mapInArrow(plan(["conv_id"], _GROUP, group_schema), f"{group_types}, {places}")
    # A join's partitions may be split and groups and pieces must be whole: dealt by a hash, which the planner cannot leave out.
    ways = ways.withColumnsRenamed({"conv_id": "_c", "_no_turn": "_n", "_group": "_g"})
    inner = pieces.join(ways, _same("_c", ("_no_turn", "_n"), ("_group", "_g"))).drop("_c", "_n", "_g").repartition(F.xxhash64(*_GROUP)).sortWithinPartitions(*_KEYS)
    plans = inner.mapInArrow(plan(_GROUP, _KEYS, key_schema), f"{key_types}, {places}").withColumnsRenamed({k: f"_to{k}" for k in _KEYS})
    joined = rows.join(plans, _same("_toconv_id", *[(k, f"_to{k}") for k in _KEYS[1:]])).drop(*[f"_to{k}" for k in _KEYS])
    joined = joined.repartition(F.xxhash64(*_KEYS)).sortWithinPartitions(*_KEYS, "turn", "role", "text")
    return joined.mapInArrow(render, f"conv_id {kind}, turn {number}, place long, role string, action string, rendered string")

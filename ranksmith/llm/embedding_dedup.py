"""Near-duplicate embeddings by an exact metric range join over pivot cells.

Vectors of one label link if their cosine (double precision) is at least ``threshold``: unit vectors at Euclidean
distance ``r = sqrt(2 - 2 * threshold)`` or less. Exact copies meet first and travel as one vector with a count.

* *Pivots.* A label with more than ``CELL`` vectors gets pivots in proportion (vectors with the smallest hashed row numbers;
  at most ``MAX_PIVOTS`` in all, so they may be broadcast). A vector's home is the cell of its nearest pivot.
* *Boundary replication.* A vector ``v`` also visits each cell ``j`` that can own a vector within ``r`` of it. By the
  triangle inequality that needs ``d(v, p_j) <= d(v, p_home) + 2 r`` and ``d(v, p_j) <= R_j + r`` for the cell's covering
  radius ``R_j``; and the distance of ``v`` to the plane between both pivots must be at most ``r``. A margin covers rounding.
* *Cells* join on their own: each home vector meets all visitors of its home, so its links are counted there once. A cell
  is cut into blocks of at most ``BLOCK`` home and ``BLOCK`` visiting vectors, whose pairs are a matrix product; a block
  returns counts and a spanning star of each of its components, never its pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, or whose label is null, links
with nothing and is its own component; vectors of different lengths do not link; repeated rows are vectors of their own
(copies link, as their cosine is one); a null id is a component's id only if it has no other, and ``kept`` compares
null-safely. Empty tables give empty results. Columns may have any names. Rows are told apart by file and place.

In data without structure (independent directions in many dimensions) all distances to pivots are about equal; then no
bound excludes a cell and the join compares all blocks of a label. The result is exact there too, at quadratic cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.components import connected_components
from ranksmith.llm.storage import Rows, materialize, small_batches, wider

THRESHOLD = 0.93
CELL = 8000
MAX_PIVOTS = 2048
BLOCK = 8192
#: Vectors of a block whose products are made at once.
TILE = (1024, 4096)
_SLACK = 1e-7


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, without overflow."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """For each group of a batch: its name, rows, and unit vectors (a group's vectors have one length)."""
    names = np.array(batch.column("grp").to_pylist(), object)
    vectors = batch.column("vec")
    for name in dict.fromkeys(names.tolist()):
        rows = np.flatnonzero(names == name)
        flat = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield name, rows, unit(flat.reshape(len(rows), -1))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A digest of each usable vector's bytes, null for the others."""
    for batch in batches:
        out = []
        for x in batch.column("vec").to_numpy(zero_copy_only=False):
            x = None if x is None else np.asarray(x, np.float64)
            fine = x is not None and len(x) and np.isfinite(x).all() and x.any()
            out.append(hashlib.blake2b((x + 0.0).tobytes(), digest_size=16).digest() if fine else None)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "digest"])


def _home(pivots: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            for name, rows, u in _groups(batch):
                if name in pivots:
                    d = distances(u, pivots[name])
                    home[rows], far[rows] = d.argmin(axis=1), d.min(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("grp"), pa.array(home), pa.array(far)], ["grp", "cell", "far"])

    return run


def visits(d: np.ndarray, between: np.ndarray, cover: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and which cells it visits (its home included), from its distances to the pivots."""
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home][:, None]
    gap = between[home]
    plane = (d * d - own * own) <= 2 * gap * r + _SLACK
    out = (d <= own + 2 * r + _SLACK) & (d <= cover[None, :] + r + _SLACK) & plane
    out[np.arange(len(d)), home] = True
    return home, out


def _visit(pivots: dict[str, np.ndarray], cover: dict[str, np.ndarray], r: float):
    between = {k: distances(p, p) for k, p in pivots.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home, cells = np.zeros(batch.num_rows, np.int32), [[0]] * batch.num_rows
            for name, rows, u in _groups(batch):
                if name in pivots:
                    home[rows], where = visits(distances(u, pivots[name]), between[name], cover[name], r)
                    for i, w in zip(rows.tolist(), where):
                        cells[i] = np.flatnonzero(w).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], [*batch.schema.names, "home", "cells"])

    return run


def _tile_stars(linked: np.ndarray, own_ids: np.ndarray, other_ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """A star for each component of a matrix of links: its members and the least of them."""
    left = linked.any(axis=1)
    for start in np.flatnonzero(left).tolist():
        if not left[start]:
            continue
        a, b, front = np.zeros(len(own_ids), bool), np.zeros(len(other_ids), bool), np.array([start])
        a[start] = True
        while len(front):
            new = linked[front].any(axis=0) & ~b
            b |= new
            front = np.flatnonzero(linked[:, new].any(axis=1) & ~a)
            a[front] = True
        left &= ~a
        members = np.unique(np.concatenate((own_ids[a], other_ids[b])))
        yield from ((int(x), int(members[0])) for x in members[1:].tolist())


def block_links(owned: np.ndarray, others: np.ndarray, own_ids: np.ndarray, other_ids: np.ndarray, weights: np.ndarray, threshold: float, tile: tuple[int, int] = TILE) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each owned vector (summed weights of the others linked to it), and a star for each component of the block.

    Products are made tile by tile; the stars of the tiles are united here, so a block returns no more edges than it has vectors."""
    counts, parent = np.zeros(len(owned), weights.dtype), {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(owned), tile[0]):
        own = slice(i, i + tile[0])
        for j in range(0, len(others), tile[1]):
            other = slice(j, j + tile[1])
            linked = owned[own] @ others[other].T >= threshold
            linked &= own_ids[own, None] != other_ids[None, other]
            counts[own] += linked @ weights[other]
            for a, b in _tile_stars(linked, own_ids[own], other_ids[other]):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return counts, [(x, root) for x in list(parent) if (root := find(x)) != x]


_LINKS = "row long, links long, root long"


def _join(threshold: float):
    schema = pa.schema([("row", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids, weights = table.column("row").to_numpy(), table.column("n").to_numpy()
        u = unit(table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        own, other = (role & 1) > 0, (role & 2) > 0
        if not own.any() or not other.any():
            return schema.empty_table()
        counts, stars = block_links(u[own], u[other], ids[own], ids[other], weights[other], threshold)
        some = np.flatnonzero(counts)
        rows = ids[own][some].tolist() + [a for a, _ in stars]
        return pa.table([pa.array(rows, pa.int64()), pa.array(counts[some].tolist() + [0] * len(stars), pa.int64()), pa.array([None] * len(some) + [b for _, b in stars], pa.int64())], schema=schema)

    return run


def _pivots(vectors: DataFrame, wanted: dict[str, tuple[int, int]]) -> dict[str, np.ndarray]:
    """For each group of ``wanted`` (its size and number of pivots): the vectors with the smallest hashed rows.

    One pass keeps rows below a hash limit, about twice as many as wanted and 16 more; the driver takes the smallest. A
    group that is left with none (a chance of one in e**16) stays one cell, cut into blocks."""
    if not wanted:
        return {}
    limits = [(name, int(min(1.0, (2 * n + 16) / size) * (1 << 30))) for name, (size, n) in wanted.items()]
    limit = vectors.sparkSession.createDataFrame(limits, "g string, most long")  # at most MAX_PIVOTS rows
    hashed = vectors.withColumn("h", F.pmod(F.xxhash64("row"), F.lit(1 << 30)))
    found: dict[str, list] = {}
    for x in hashed.join(F.broadcast(limit), F.col("grp") == F.col("g")).filter("h < most").select("grp", "h", "row", "vec").collect():
        found.setdefault(x["grp"], []).append((x["h"], x["row"], x["vec"]))
    return {name: unit(np.array([v for _, _, v in sorted(rows, key=lambda r: r[:2])[: wanted[name][1]]])) for name, rows in found.items()}


def links(vectors: DataFrame, threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """For distinct usable vectors ``row, grp, vec, n``: ``row, links`` of those that link, and the edges ``a, b`` of a forest of links."""
    r = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    total = vectors.count()
    cell = max(cell, -(-total // MAX_PIVOTS))
    large = {x["grp"]: x["count"] for x in vectors.groupBy("grp").count().filter(F.col("count") > cell).collect()}  # at most MAX_PIVOTS groups
    pivots = _pivots(vectors, {name: (size, -(-size // cell)) for name, size in large.items()})
    homes = vectors.select("grp", "vec").mapInArrow(_home(pivots), "grp string, cell int, far double").filter(F.col("grp").isin(*pivots)) if pivots else None
    cover = {k: np.zeros(len(p)) for k, p in pivots.items()}
    if homes is not None:
        for x in homes.groupBy("grp", "cell").agg(F.max("far").alias("far")).collect():  # a row for each pivot
            cover[x["grp"]][x["cell"]] = x["far"]
    kind = vectors.schema["vec"].dataType.simpleString()
    placed, _ = materialize(vectors.select("row", "grp", "vec", "n").mapInArrow(_visit(pivots, cover, r), f"row long, grp string, vec {kind}, n long, home int, cells array<int>"), "visits")

    sizes = placed.select("grp", F.explode("cells").alias("cell"), "home").groupBy("grp", "cell").agg(F.sum((F.col("cell") == F.col("home")).cast("long")).alias("owned"), F.count("*").alias("all"))
    split = {(x["grp"], x["cell"]): (-(-x["owned"] // block), -(-x["all"] // block)) for x in sizes.filter(F.col("all") > block).collect()}  # only cells of large groups

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, out = [], ([], [], [], [])
            for at, (row, name, home, cells) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "grp", "home", "cells")))):
                mixed = (row * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 24
                for c in cells:
                    owners, others = split.get((name, c), (1, 1))
                    i, j = mixed % max(1, owners), (mixed // 7919) % others
                    for x in range(max(1, owners)):
                        for y in range(others):
                            role = (c == home and x == i) + 2 * (y == j)
                            if role:
                                take.append(at)
                                for column, v in zip(out, (c, x, y, role)):
                                    column.append(v)
            rows = batch.select(["row", "grp", "vec", "n"]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rows.columns, *[pa.array(x, pa.int32()) for x in out]], ["row", "grp", "vec", "n", "cell", "i", "j", "role"])

    dealt = placed.mapInArrow(deal, f"row long, grp string, vec {kind}, n long, cell int, i int, j int, role int")
    found, _ = materialize(dealt.groupBy("grp", "cell", "i", "j").applyInArrow(_join(threshold), _LINKS), "links")
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    return counts, found.filter("root is not null").select(F.col("row").alias("a"), F.col("root").alias("b"))


def near_duplicates(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, cell: int = CELL, block: int = BLOCK) -> DataFrame:
    """Per row: ``vec_id, n_links, component_id, kept``."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    small_batches(embeddings.sparkSession)
    rows = Rows(embeddings).select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("vec")).withColumnRenamed("_row", "row")
    rows = rows.mapInArrow(_digest, wider(rows.schema, digest="binary"))
    usable = rows.filter("digest is not null and label is not null").select("row", "vec_id", F.concat_ws("/", F.size("vec"), "label").alias("grp"), "digest", "vec")
    first = usable.groupBy("grp", "digest").agg(F.min("row").alias("row"), F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes, _ = materialize(first, "classes")
    distinct, _ = materialize(usable.select("row", "grp", "vec").join(classes.select("row", "n"), "row"), "vectors")
    counts, edges = links(distinct, threshold, cell, block)
    roots = connected_components(edges, "a", "b")
    classes = classes.join(roots.withColumnRenamed("node", "row"), "row", "left").join(counts, "row", "left")
    classes = classes.select("grp", "digest", "least", F.coalesce("root", "row").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    classes, _ = materialize(classes, "counted")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = classes.join(least, "root").select(F.col("grp").alias("_g"), F.col("digest").alias("_d"), "n_links", "component_id", F.lit(True).alias("found"))
    grp = F.when(F.col("label").isNotNull(), F.concat_ws("/", F.size("vec"), "label"))
    out = rows.select("vec_id", grp.alias("grp"), "digest").join(classes, (F.col("grp") == F.col("_g")) & (F.col("digest") == F.col("_d")), "left")
    component = F.when(F.col("found"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))

"""SimHash near-duplicates: fingerprints joined on a grid of per-segment bit counts.

Fingerprint: ASCII-lower-cased words (runs of anything but the six ASCII spaces), three-word shingles with
repeats, joined by one space (fewer words: the whole sequence), XXH64 with seed 42; a bit is set if it is set in
over half the hashes. No words give fingerprint zero, which links like any other.

Links: the 64 bits are 16 segments of four; the vector of their bit counts is the grid point of a fingerprint.
The Manhattan distance of two such points is a lower bound of the Hamming distance, so fingerprints that differ in
at most two bits have points at distance two or less, and these share a lattice point at distance at most one
from both. Each *distinct* fingerprint is therefore filed under its own point and its 32 neighbours; in each cell
fingerprints are verified exactly. Exact copies meet before the join and count once. A task keeps only a spanning
forest of the links that it verifies, so a group of near copies gives about as many rows as it has members.

A cell with more than ``BIG_CELL`` fingerprints is verified through thirds of the bits (two differing bits leave
one third equal), which finds the same links without comparing all of its pairs.

Defined results: null and empty texts have fingerprint zero; null ids are kept in the result and are a component's
id only if it has no other; rows are told apart by file and place, so repeated rows are documents of their own, and of
tied rows the first stays. Columns may have any names. Long texts are read in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ranksmith.llm.arrays import CHUNK_BYTES, segments, utf8
from ranksmith.llm.components import connected_components
from ranksmith.llm.storage import Rows, kept_columns, materialize, small_batches, unpacked, wider

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BIG_CELL = 4096
_THIRDS = [np.uint64(x) for x in (0x00000000001FFFFF, 0x000007FFFFE00000, 0xFFFFF80000000000)]


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the 64-bit hashes have each bit, the highest bit first."""
    total = np.zeros(64, np.int64)
    for part in np.array_split(hashes.astype(">u8"), len(hashes) // 65535 + 1):
        total += np.unpackbits(part.view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return total


def majority(counts: np.ndarray, n: int) -> int:
    """The fingerprint whose bits are set in over half of ``n`` hashes."""
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text; a long one is read in pieces."""
    counts, n, words = np.zeros(64, np.int64), 0, []
    for piece, _, repeated in segments(np.frombuffer(text, np.uint8), CHUNK_BYTES, shingle - 1):
        words = bytes(piece).lower().split()
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(shingle)])))
        if shingles:
            counts += ones(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles)))
            n += len(shingles)
    if not n:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return majority(counts, n)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = utf8(batch.column("_text"))
        raw, at = memoryview(data), offsets.tolist()
        out = np.fromiter((fingerprint(bytes(raw[a:b])) for a, b in zip(at, at[1:])), np.uint64, len(at) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(out.view(np.int64))], ["_row", "_id", "fp"])


def grid_points(fp: Column) -> Column:
    """The grid point of a fingerprint and its neighbours: a nibble of each holds a segment's bit count plus one."""

    def counted(half: Column) -> Column:
        twos = half.bitwiseAND(F.lit(0x55555555)) + F.shiftrightunsigned(half, 1).bitwiseAND(F.lit(0x55555555))
        return twos.bitwiseAND(F.lit(0x33333333)) + F.shiftrightunsigned(twos, 2).bitwiseAND(F.lit(0x33333333))

    # Nibbles hold 0 to 6, so the sign bit stays clear.
    high = F.shiftleft(counted(F.shiftrightunsigned(fp, 32)), 32)
    point = high + counted(fp.bitwiseAND(F.lit(0xFFFFFFFF))) + F.lit(0x1111111111111111)
    return F.array(point, *[point + F.lit(sign << (4 * i)) for i in range(16) for sign in (1, -1)])


def _pairs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of one key (keys are sorted) that differ in at most ``most`` bits."""
    left, right, idx, d = [], [], np.arange(len(keys) - 1), 1
    while len(idx):
        idx = idx[idx + d < len(keys)]
        idx = idx[keys[idx] == keys[idx + d]]
        x, y = fps[idx], fps[idx + d]
        close = (np.bitwise_count(x ^ y) <= most) & (x != y)
        left.append(x[close])
        right.append(y[close])
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (fps[:0], fps[:0])


def cell_links(keys: np.ndarray, fps: np.ndarray, most: int = MAX_BITS, big: int = BIG_CELL) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among the fingerprints of each cell; ``keys`` are sorted."""
    begins = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.concatenate((begins, [len(keys)])))
    small = np.repeat((sizes > 1) & (sizes <= big), sizes)
    found = [_pairs(keys[small], fps[small], most)]
    for at, n in zip(begins[sizes > big].tolist(), sizes[sizes > big].tolist()):
        cell = fps[at : at + n]
        for third in _THIRDS:
            order = np.argsort(cell & third, kind="stable")
            found.append(_pairs((cell & third)[order], cell[order], most))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _forest(most: int, big: int):
    """Links of each task's cells, kept as a spanning forest. Rows arrive sorted by key; one cell may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        def link(keys: np.ndarray, fps: np.ndarray) -> None:
            x, y = cell_links(keys, fps, most, big)
            if not len(x):
                return
            for a, b in np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0).tolist():
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)

        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column("key").to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)))
            whole = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0  # rows of the last key may go on
            if whole > 0:
                link(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            link(keys, fps)
        ends = [(x, find(x)) for x in list(parent)]
        ends = np.array([e for e in ends if e[0] != e[1]], np.uint64).reshape(-1, 2).view(np.int64)
        for i in range(0, max(1, len(ends)), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ends[i : i + 100_000, j])) for j in (0, 1)], ["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, most: int = MAX_BITS, big: int = BIG_CELL) -> DataFrame:
    """A forest (``a, b``) with the connectivity of all links among the distinct fingerprints ``fp``."""
    if not 0 <= most <= MAX_BITS:
        raise ValueError(f"the grid finds links of up to {MAX_BITS} bits")
    # Fingerprints are small and grow 33-fold here, so they are dealt to a number of tasks and not by their own size
    # (by a hash: dealing by the fingerprint itself is left out where they come from an aggregation by it).
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed = fps.repartition(n, F.xxhash64("fp")).select("fp", F.explode(grid_points(F.col("fp"))).alias("key")).repartition("key").sortWithinPartitions("key")
    return filed.mapInArrow(_forest(most, big), "a long, b long")


def near_duplicates(rows: DataFrame, most: int = MAX_BITS, big: int = BIG_CELL) -> DataFrame:
    """For rows of ``_row, _id, _text``: ``_row, doc_id, fp, component_id, kept`` (the row that stands for its component)."""
    small_batches(rows.sparkSession)
    marked, _ = materialize(rows.mapInArrow(_fingerprints, wider(rows.select("_row", "_id").schema, fp="long")), "fingerprints")
    least = F.min(F.struct(F.col("_id").isNull().alias("n"), "_id", "_row")).alias("first")
    nodes = marked.groupBy("fp").agg(least)
    roots = connected_components(fingerprint_links(nodes.select("fp"), most, big), "a", "b")
    nodes = nodes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    nodes, _ = materialize(nodes, "nodes")
    first = nodes.groupBy("root").agg(F.min("first").alias("first"))
    of = nodes.select("fp", "root").join(first, "root").select("fp", F.col("first._id").alias("component_id"), F.col("first._row").alias("_first"))
    return marked.join(of, "fp").select("_row", F.col("_id").alias("doc_id"), "fp", "component_id", (F.col("_row") == F.col("_first")).alias("kept"))


def _ids_and_texts(rows: Rows, doc_id: str, text: str) -> DataFrame:
    return rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))


def drop_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of ties the first."""
    rows = Rows(docs)
    gone, _ = materialize(near_duplicates(_ids_and_texts(rows, doc_id, text), most).filter("not kept").select("_row"), "gone")
    return rows.select(kept_columns(docs).alias("_doc")).join(gone, "_row", "left_anti").select(*unpacked(docs))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, fingerprint, component_id, kept``."""
    found = near_duplicates(_ids_and_texts(Rows(docs), doc_id, text))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "kept")

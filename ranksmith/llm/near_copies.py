"""Near copies of whole texts: every pair of five-word shingle sets with a Jaccard similarity of at least 0.8, without loss.

Shingles: ASCII-lower-cased words (runs of anything but the six ASCII spaces), five at a time, as a set of 64-bit
hashes; fewer words are one shingle as a whole. No words are the empty set, and empty sets are alike.

The SimHash join of ``simhash_dedup`` (fingerprints of these sets, at most two bits apart) gives the first candidates. By
itself it misses most pairs of similarity 0.8, whose fingerprints lie around ten bits apart, so the others are found by
an exact search among *distinct* sets:

1. *Order.* Shingles travel in packed blocks to buckets of their hash, where those of more than one document are
   counted. Only these, with their counts, go back to the block they came from. Shingles that a sample finds in many documents stay
   at home; they count as more frequent than all others.
2. *Prefixes.* Ordered by count, two sets of n and m shingles that are similar enough share one of their first
   ``n - ceil(0.8 n) + 1`` and ``m - ceil(0.8 m) + 1``. Shingles of one document only come first and meet nothing, so a
   document whose own text exceeds a fifth is not filed at all, whatever passages it shares with others.
3. *Pairs.* A bucket of documents that share a prefix shingle compares its members with the one of least text of its own, which
   is closest to the others of its group: each document with the one that it meets in most buckets, then with the others if they
   are not connected yet. In ``TURNS`` turns documents outside of the largest component of a bucket meet members of it that are drawn
   anew in each bucket, ``DRAWN`` at most, which connects groups that another text leads. All these are at most a few comparisons
   for each document and bucket. Only then are all pairs compared whose members are still in different components.
   Places and numbers of shared shingles rule out pairs without loss, and so do the parities of the sets in ``PARITY_WORDS * 64``
   classes, which differ in no more places than the sets have shingles of only one of them; the others are verified on whole sets.

A bucket whose members are in different components is dealt out in cells of ``CELL`` members of its largest component, so no task
holds more of a bucket than such a cell and the members outside of that component.

Defined results: rows are told apart by file and place; of a component the smallest id stays, of ties the first row, and a
null id only if there is no other. Long texts are read in pieces. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.arrays import CHUNK_BYTES, U64, chunks, lists, mix, segments, spans, utf8, word_hashes
from ranksmith.llm.components import connected_components
from ranksmith.llm.simhash_dedup import fingerprint_links, majority, ones
from ranksmith.llm.storage import Rows, drop, kept_columns, materialize, small_batches, unpacked, wider

SHINGLE = 5
SAMPLE_DOCS = 10_000
#: Shingles of so many documents of the sample stay at home; at most ``MOST_FREQUENT`` of them.
FREQUENT = 8
MOST_FREQUENT = 200_000
BLOCK_SHINGLES = 400_000
BUCKET_SHINGLES = 1 << 22
#: Bytes of a shingle's hash that travel, besides the bits that name its bucket.
TRAVEL_BYTES = 6
BROADCAST_ROWS = 200_000
SMALL_CELL = 64
CELL = 512
PARITY_WORDS = 16
#: Turns in which rows meet drawn members of other components, and how many of them each row meets in a turn.
TURNS = 2
DRAWN = 8
_TOKENS, _SIZES, _REPEATED = 0, 1, 2
_OFTEN = 1 << 31
_P = [U64(pow(0xD6E8FEB86659FD93, j, 1 << 64)) for j in range(SHINGLE)]


def _shingle_hashes(words: np.ndarray) -> np.ndarray:
    n = max(0, len(words) - SHINGLE + 1)
    every = np.zeros(n, U64)
    for j in range(SHINGLE):
        every += words[j : j + n] * _P[j]
    return mix(every)


def _lower(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().lower(), np.uint8)


def _long_shingles(data: np.ndarray) -> np.ndarray:
    """Those of one long text, read in pieces."""
    found = []
    for piece, _, _ in segments(data, CHUNK_BYTES, SHINGLE - 1):
        part = _lower(piece)
        starts, ends, _ = spans(part, np.array([0, len(part)]))
        found.append(np.unique(_shingle_hashes(word_hashes(part, starts, ends))) if len(starts) >= SHINGLE else np.zeros(0, U64))
    return np.unique(np.concatenate(found))


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, data = utf8(column)
    for lo, hi in chunks(offsets):
        part = data[offsets[lo] : offsets[hi]]
        if len(part) > 2 * CHUNK_BYTES and len(long := _long_shingles(part)):  # one row
            yield long
            continue
        part = _lower(part)
        starts, ends, first = spans(part, offsets[lo : hi + 1] - offsets[lo])
        words = word_hashes(part, starts, ends) if len(starts) else np.zeros(0, U64)
        every = _shingle_hashes(words)
        for a, b in zip(first.tolist(), first[1:].tolist()):
            if b - a >= SHINGLE:
                yield np.unique(every[a : b - SHINGLE + 1])
            elif b > a:
                short = np.array([int(np.sum(words[a:b] * np.array(_P[: b - a], U64), dtype=U64))], U64)
                yield mix(short + U64(b - a))
            else:
                yield words[:0]


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = list(shingle_sets(batch.column("_text")))
        flat = np.concatenate(each) if each else np.zeros(0, U64)
        yield pa.RecordBatch.from_arrays([batch.column("_row"), lists(pa.array(flat.view(np.int64)), np.array([len(v) for v in each], np.int64))], ["_row", "shingles"])


def parities(s: np.ndarray) -> bytes:
    """Whether the number of shingles is odd, in each class of their last bits."""
    odd = np.bincount((s & U64(64 * PARITY_WORDS - 1)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest, fingerprint and parities of each set."""
    for batch in batches:
        n, d1, d2, fp, odd = [], [], [], [], []
        for s in shingle_sets(batch.column("_text")):
            n.append(len(s))
            d1.append(np.sum(s, dtype=U64))
            d2.append(np.sum(mix(s ^ U64(0x5851F42D4C957F2D)), dtype=U64))
            fp.append(majority(ones(s), len(s)) if len(s) else 0)
            odd.append(parities(s))
        sums = [pa.array(np.array(d, U64).view(np.int64)) for d in (d1, d2, fp)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(n, pa.int64()), *sums, pa.array(odd, pa.binary())], ["_row", "_id", "n", "d1", "d2", "fp", "odd"])


_BLOCKS = "bucket int, base long, kind int, at binary, shingles binary, counts binary"


def _binary(values: np.ndarray, cuts: np.ndarray, width: int) -> pa.Array:
    """Runs of ``values`` that begin at ``cuts`` (one more entry, the end), as their first ``width`` bytes."""
    at = np.ascontiguousarray(cuts * width).astype(np.int32)
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)[:, :width]
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())])


def travel(bits: int) -> int:
    """Bytes that travel where ``bits`` name a bucket."""
    return min(TRAVEL_BYTES, (64 - bits) // 8)


def _blocks(bucket, base, kind: int, cuts, at, shingles, counts, wide: int = 8) -> pa.RecordBatch:
    """One row for each run: documents (distance from the block's first), shingles or sizes, and their counts."""
    n, cuts = len(cuts) - 1, np.asarray(cuts, np.int64)
    columns = [pa.array(np.broadcast_to(np.asarray(x), n).astype(t)) for x, t in ((bucket, np.int32), (base, np.int64), (kind, np.int32))]
    parts = [_binary(x.astype(t), cuts, w) for x, t, w in ((at, np.int32, 4), (shingles, U64, wide), (counts, np.uint32, 4 if kind != _TOKENS else 0))]
    return pa.RecordBatch.from_arrays([*columns, *parts], ["bucket", "base", "kind", "at", "shingles", "counts"])


def _cuts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    if not len(values):
        return np.zeros(1, np.int64)
    return np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [len(values)]))


def _deal(shared, bits: int):
    """Blocks of consecutive documents: their shingles by bucket, and their numbers of shingles and of frequent ones."""

    def block(rows: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        known, often = shared.value
        base, n = rows[0], np.array([len(s) for s in sets], np.int64)
        index, shingles = np.repeat(np.arange(len(n)), n), np.concatenate(sets)
        count = np.zeros(len(shingles), np.int64)
        if len(known):
            place = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
            count = np.where(known[place] == shingles, often[place], 0)
        frequent = np.bincount(index[count > 0], minlength=len(n))
        at, home = np.array(rows, np.int64) - base, -1 - int(mix(np.array([base], U64))[0] % U64(1 << bits))
        yield _blocks(home, base, _SIZES, [0, len(n)], at, n, frequent)
        # What travels of a hash decides which shingles count as one; a set in which two fall together holds that one twice.
        shingles = shingles >> U64(64 - bits - 8 * travel(bits))
        # Frequent shingles are in the prefix of only those sets of which they make four fifths.
        take = (count > 0) & (5 * frequent >= 4 * n)[index]
        if take.any():
            yield _blocks(home, base, _REPEATED, [0, int(take.sum())], at[index[take]], shingles[take], count[take] + _OFTEN)
        rest = count == 0
        bucket = (shingles[rest] >> U64(8 * travel(bits))).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        cuts, own = _cuts(bucket[order]), shingles[rest][order]
        if len(own):
            yield _blocks(bucket[order][cuts[:-1]], base, _TOKENS, cuts, at[index[rest]][order], own, np.zeros(len(own), np.uint32), travel(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, sets, size = [], [], 0
            for row, s in zip(batch.column("_row").to_pylist(), shingle_sets(batch.column("_text"))):
                if rows and (size + len(s) > BLOCK_SHINGLES or not 0 <= row - rows[0] < 1 << 31):
                    yield from block(rows, sets)
                    rows, sets, size = [], [], 0
                rows.append(row)
                sets.append(s)
                size += len(s)
            if rows:
                yield from block(rows, sets)

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one key after another; they arrive sorted by it."""
    rows = (row for batch in batches for row in batch.to_pylist())
    return ((k, list(of)) for k, of in groupby(rows, key=lambda row: row[key]))


def _joined(rows: list[dict], wide: int = 8) -> tuple[np.ndarray, ...]:
    """Row of the list, document, shingle and count of all entries."""
    at, raw, counts = (np.frombuffer(b"".join([x[c] for x in rows]), t) for c, t in (("at", np.int32), ("shingles", np.uint8), ("counts", np.uint32)))
    shingles = np.zeros((len(at), 8), np.uint8)
    shingles[:, :wide] = raw.reshape(len(at), wide)
    return np.repeat(np.arange(len(rows)), [len(x["at"]) // 4 for x in rows]), at, shingles.view(U64).ravel(), counts


def _repeated(bits: int):
    """Of each bucket the shingles of several documents, with their counts, by the block they came from."""
    schema = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("kind", pa.int32()), ("at", pa.binary()), ("shingles", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches, "bucket"):
            if bucket < 0:
                yield pa.RecordBatch.from_pylist(rows, schema)
                continue
            of, at, shingles, _ = _joined(rows, travel(bits))
            order = np.argsort(shingles, kind="stable")
            sizes = np.diff(_cuts(shingles[order]))
            count = np.repeat(sizes, sizes)
            order, count = order[count > 1], count[count > 1]
            back = np.argsort(order)
            order, count = order[back], count[back]
            if len(order):
                cuts = _cuts(of[order])
                base = np.array([x["base"] for x in rows], np.int64)[of[order][cuts[:-1]]]
                yield _blocks(bucket, base, _REPEATED, cuts, at[order], shingles[order] | U64(bucket << 8 * travel(bits)), np.minimum(count, _OFTEN - 1))

    return run


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix shingles that a document shares, with their place among those it shares; blocks arrive sorted."""
    for base, rows in _groups(batches, "base"):
        sizes = [x for x in rows if x["kind"] == _SIZES]
        _, docs, n, frequent = _joined(sizes)
        _, at, shingles, count = _joined([x for x in rows if x["kind"] == _REPEATED])
        n, index = n.astype(np.int64), np.searchsorted(docs, at)
        shared = np.bincount(index[count < _OFTEN], minlength=len(n)) + frequent
        wanted = np.where(n > 0, n - (4 * n + 4) // 5 + 1 - (n - shared), 0)
        order = np.lexsort((shingles, count, index))
        index, shingles = index[order], shingles[order]
        first = np.searchsorted(index, np.arange(len(n)))
        place = np.arange(len(index)) - first[index]
        kept = place < wanted[index]
        index = index[kept]
        columns = [shingles[kept].view(np.int64), base + docs[index].astype(np.int64), n[index], shared[index].astype(np.int64), place[kept]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "_row", "n", "shared", "place"])


def _frequent(rows: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of about ``SAMPLE_DOCS`` rows finds in at least ``FREQUENT`` of them, sorted, and how often."""
    every = max(1, -(-total // SAMPLE_DOCS))
    sample = rows.select("_row", "_text").filter(F.pmod(F.xxhash64("_row"), F.lit(every)) == 0).mapInArrow(_sets, "_row long, shingles array<long>")
    often = sample.select(F.explode("shingles").alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= FREQUENT)
    found = often.orderBy(F.desc("n"), "key").limit(MOST_FREQUENT).toPandas()
    known = found["key"].to_numpy(np.int64).view(U64)
    order = np.argsort(known)
    return known[order], found["n"].to_numpy(np.int64)[order]


def filed(rows: DataFrame, documents: int, shingles: int) -> DataFrame:
    """``key, _row, n, shared, place``: documents under the shared shingles of their prefixes."""
    bits = max(10, (max(1, shingles) // BUCKET_SHINGLES).bit_length())
    shared = rows.sparkSession.sparkContext.broadcast(_frequent(rows, documents))
    dealt = rows.select("_row", "_text").mapInArrow(_deal(shared, bits), _BLOCKS).repartition("bucket").sortWithinPartitions("bucket")
    back = dealt.mapInArrow(_repeated(bits), _BLOCKS).repartition("base").sortWithinPartitions("base")
    return back.mapInArrow(_prefixes, "key long, _row long, n long, shared long, place long")


def _may_link(n, shared, place, m, others, at):
    """Whether two sets that share a shingle, at these places among those that they share with any, can be similar enough."""
    least = F.least if isinstance(n, Column) else np.minimum
    return 9 * (least(place, at) + least(shared - place, others - at)) >= 4 * (n + m)


def _unconnected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a cell whose members are in different components. A pair outside of the main component counts where its first
    one is at home; rows arrive sorted by cell and row."""
    names = ["cell", "_row", "n", "shared", "place", "root", "main", "home", "odd"]

    def pairs(x: dict, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        fine = (x["root"][a] != x["root"][b]) & (x["main"][a] | x["main"][b] | x["home"][np.minimum(a, b)])
        fine &= _may_link(*(x[c][a] for c in ("n", "shared", "place")), *(x[c][b] for c in ("n", "shared", "place")))
        a, b = a[fine], b[fine]
        fine = 9 * np.bitwise_count(x["odd"][a] ^ x["odd"][b]).sum(axis=1, dtype=np.int64) <= x["n"][a] + x["n"][b]
        a, b = x["_row"][a[fine]], x["_row"][b[fine]]
        for lo in range(0, len(a), 50_000):
            part = a[lo : lo + 50_000], b[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(*part)), pa.array(np.maximum(*part))], ["a", "b"])

    def cells() -> Iterator[dict]:
        held: dict = {}
        for batch in batches:
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names if c != "odd"}
            now["odd"] = np.frombuffer(b"".join(batch.column("odd").to_pylist()), U64).reshape(-1, PARITY_WORDS)
            held = {c: np.concatenate((held[c], now[c])) for c in names} if held else now
            if len(held["cell"]) and held["cell"][0] != held["cell"][-1]:
                whole = int(np.searchsorted(held["cell"] == held["cell"][-1], True))
                yield {c: v[:whole] for c, v in held.items()}
                held = {c: v[whole:] for c, v in held.items()}
        if held:
            yield held

    for x in cells():
        cuts = _cuts(x["cell"])
        sizes = np.diff(cuts)
        index, d = np.flatnonzero(np.repeat(sizes <= SMALL_CELL, sizes)), 1
        while len(index):
            index = index[index + d < len(x["cell"])]
            index = index[x["cell"][index] == x["cell"][index + d]]
            yield from pairs(x, index, index + d)
            d += 1
        for at, size in zip(cuts[:-1][sizes > SMALL_CELL].tolist(), sizes[sizes > SMALL_CELL].tolist()):
            own = np.arange(at, at + size)
            order = np.concatenate((own[~x["main"][own]], own[x["main"][own]]))
            for i in range(int((~x["main"][own]).sum())):
                yield from pairs(x, np.full(size - i - 1, order[i]), order[i + 1 :])


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose whole sets have a similarity of at least 0.8, written."""
    pairs, pairs_path = materialize(pairs.distinct(), "pairs")
    ends = pairs.select(F.col("a").alias("_row")).unionByName(pairs.select(F.col("b").alias("_row"))).distinct()
    if pairs.count() <= BROADCAST_ROWS // 2:
        ends = F.broadcast(ends)
    sets, sets_path = materialize(texts.join(ends, "_row", "left_semi").mapInArrow(_sets, "_row long, shingles array<long>"), "sets")
    left, right = (sets.select(F.col("_row").alias(c), F.col("shingles").alias(f"s{c}")) for c in "ab")
    same = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(left, "a").join(right, "b").filter(9 * same >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b")
    links, _ = materialize(links, "links")
    drop(pairs.sparkSession, pairs_path)
    drop(pairs.sparkSession, sets_path)
    return links


def _rooted(rows: DataFrame, roots: DataFrame, name: str, root: str) -> DataFrame:
    """``rows`` with the component of the row in column ``name``."""
    of = roots.select(F.col("node").alias(name), F.col("root").alias("_found"))
    return rows.join(of, name, "left").withColumn(root, F.coalesce("_found", name)).drop("_found")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    return _rooted(_rooted(pairs, roots, "a", "_ra"), roots, "b", "_rb").filter("_ra <> _rb").select(*pairs.columns)


def _simhash_pairs(nodes: DataFrame) -> DataFrame:
    """Sets of one fingerprint, and of fingerprints that the SimHash join links: ``a, b``."""
    first, _ = materialize(nodes.groupBy("fp").agg(F.min("_row").alias("rep")), "fingerprints")
    equal = nodes.join(first, "fp").filter("_row <> rep").select(F.col("rep").alias("a"), F.col("_row").alias("b"))
    of = {c: first.select(F.col("fp").alias(f"f{c}"), F.col("rep").alias(c)) for c in "ab"}
    linked = fingerprint_links(first.select("fp")).toDF("fa", "fb").join(of["a"], "fa").join(of["b"], "fb")
    return equal.unionByName(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


_FILED = ("key", "_row", "n", "shared", "place")


def _like(other: str) -> Column:
    """Whether a filed row can be similar enough to the one in struct ``other``."""
    return _may_link(*(F.col(c) for c in _FILED[2:]), *(F.col(f"{other}.{c}") for c in _FILED[2:]))


def _mixed(found: DataFrame, roots: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """``found`` with components, and the buckets of several: their largest component, and one of its members, drawn anew for each bucket and turn."""
    rooted, _ = materialize(_rooted(found, roots, "_row", "root"), "rooted")
    drawn = F.min(F.struct(F.xxhash64("key", "_row", F.lit(turn)).alias("by"), *_FILED[1:])).alias("lead")
    each = rooted.groupBy("key", "root").agg(F.count("*").alias("c"), drawn)
    each = each.groupBy("key").agg(F.max(F.struct("c", "lead", "root")).alias("most"), F.count("*").alias("roots"))
    cells = F.ceil(F.col("most.c") / F.lit(CELL)).cast("int").alias("cells")
    return rooted, materialize(each.filter("roots > 1").select("key", F.col("most.root").alias("main_root"), F.col("most.lead").alias("lead"), cells), "mixed")[0]


def _drawn_pairs(rooted: DataFrame, mixed: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of each row outside of the largest component of its buckets with members of these, ``DRAWN`` at most."""
    meets = rooted.join(mixed, "key").filter((F.col("root") != F.col("main_root")) & _like("lead"))
    some = F.collect_set(F.struct(F.xxhash64("lead._row", "_row").alias("by"), F.col("lead._row").alias("a")))
    some = meets.groupBy("_row").agg(F.slice(F.sort_array(some), 1, DRAWN).alias("some")).select("_row", F.explode("some.a").alias("a"))
    return some.select(F.least("a", "_row").alias("a"), F.greatest("a", "_row").alias("b"))


def _open_pairs(found: DataFrame, roots: DataFrame, marked: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of any bucket whose members are in different components."""
    rooted, mixed = _mixed(found, roots, TURNS)
    own = F.pmod(F.xxhash64("_row"), F.col("cells")).cast("int")
    rows = rooted.join(mixed.drop("lead"), "key").join(marked.select("_row", "odd"), "_row").withColumn("main", F.col("root") == F.col("main_root")).withColumn("own", own)
    rows = rows.withColumn("part", F.explode(F.when(F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("cells") - 1))))
    rows = rows.select(F.xxhash64("key", "part").alias("cell"), "_row", "n", "shared", "place", "root", "main", (F.col("own") == F.col("part")).alias("home"), "odd")
    return rows.repartition("cell").sortWithinPartitions("cell", "_row").mapInArrow(_unconnected, "a long, b long")


def _components(found: DataFrame, nodes: DataFrame, marked: DataFrame, texts: DataFrame) -> DataFrame:
    """``node, root`` of the near copies among the filed sets."""
    lead = F.min(F.struct((F.col("n") - F.col("shared")).alias("own"), *_FILED[1:])).alias("lead")
    leads, _ = materialize(found.groupBy("key").agg(lead, F.count("*").alias("size")).filter("size > 1"), "leads")
    met = found.join(leads, "key").filter((F.col("_row") != F.col("lead._row")) & _like("lead")).groupBy(F.col("lead._row").alias("a"), F.col("_row").alias("b")).agg(F.count("*").alias("times"))
    met, _ = materialize(met, "met")
    best = met.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")

    links = _verified(best.unionByName(_simhash_pairs(nodes)), texts)
    roots, _ = materialize(connected_components(links, "a", "b"), "roots")
    wide = found.join(leads.filter("size > 2").select("key"), "key", "left_semi")
    pairs = _apart(met.select("a", "b"), roots)
    for turn in range(TURNS):
        rooted, mixed = _mixed(wide, roots, turn)
        drawn = _drawn_pairs(rooted, mixed)
        links = links.unionByName(_verified(drawn if turn else drawn.unionByName(pairs), texts))
        roots, _ = materialize(connected_components(links, "a", "b"), "roots")
        wide = rooted.join(mixed.select("key"), "key", "left_semi").select(*_FILED)
    links = links.unionByName(_verified(_open_pairs(wide, roots, marked), texts))
    return connected_components(links, "a", "b")


def near_copy_rows(rows: DataFrame) -> DataFrame:
    """Of rows of ``_row, _id, _text`` the ``_row`` of those that go: all but one of each component."""
    small_batches(rows.sparkSession)
    texts = rows.select("_row", "_text")
    marked, _ = materialize(rows.mapInArrow(_marks, wider(rows.select("_row", "_id").schema, n="long", d1="long", d2="long", fp="long", odd="binary")), "marks")
    # Equal sets meet by their digest before any join; one row of each stands for them.
    least = F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("first")
    nodes, _ = materialize(marked.groupBy("n", "d1", "d2").agg(least, F.min("fp").alias("fp")).select("first", F.col("first._row").alias("_row"), "fp"), "nodes")

    size = marked.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    found, _ = materialize(filed(rows, *size).join(nodes.select("_row"), "_row", "left_semi"), "filed")
    roots = _components(found, nodes, marked, texts)

    of = _rooted(nodes, roots, "_row", "root")
    keep = of.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first._row").alias("_row"))
    return marked.select("_row").join(keep, "_row", "left_anti")


def drop_near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest id, of ties the first."""
    rows = Rows(docs)
    gone, _ = materialize(near_copy_rows(rows.select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_text"))), "gone")
    return rows.select(kept_columns(docs).alias("_doc")).join(gone, "_row", "left_anti").select(*unpacked(docs))

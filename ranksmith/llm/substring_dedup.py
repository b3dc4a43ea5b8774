"""Exact removal of repeated word windows, by super-k-mer partitioning.

A window is ``k`` consecutive words of one document; words are maximal runs of anything but space, tab, line
feed, vertical tab, form feed and carriage return, unchanged. Every word covered by a window whose word
sequence also starts anywhere else (same document included) is removed.

1. *Minimisers.* One pass hashes the words and takes, for each window, the smallest hash among its ``m``-word
   grams. Consecutive windows with one minimiser form a super-k-mer (of at most ``MAX_WINDOWS`` windows). Only minimisers
   travel first: equal windows have equal minimisers, so a super-k-mer whose minimiser is picked at one position of the
   whole corpus holds no repeated window and its text never leaves its document.
2. *Buckets.* The other super-k-mers travel as one packed string each to the bucket of their minimiser. Equal
   strings are combined before the shuffle (a passage shared by a third of all documents is one row with a
   count), and in the bucket the windows are sorted and counted as bytes.
3. A minimiser that is picked at more than ``max_bucket`` positions has no bucket: the windows of its different strings are
   dealt out one by one and summed by a map-side combined aggregation. So a bucket never has more than ``k - m + 1``
   windows for each of ``max_bucket`` positions, and no minimiser, however popular, gathers in one task.

Defined results: null, empty and blank texts have no words; fewer than ``k`` words have no window. Rows are told
apart by file and place and not by any column, so null, repeated or tied ids and whole repeated rows are separate
documents (and the windows of repeated rows are repeats). Columns may have any names. A row's text is never cut:
long texts are read in pieces that share ``k - 1`` words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.llm.arrays import CHUNK_BYTES, U64, chunks, joined_words, lists, mix, segments, sliding_min, spans, utf8, word_bounds, word_hashes
from ranksmith.llm.storage import Rows, kept_columns, materialize, small_batches, unpacked, wider

WINDOW = 35
MINIMISER = 10
MAX_BUCKET = 2048
MAX_WINDOWS = 4096
#: Windows of more bytes are compared by their digest.
LONG_WINDOW = 4096
OUT_ROWS = 20_000
#: More positions than a text column of Arrow can hold words.
_POSITION = U64((1 << 31) - 1)
_STEP = U64(0xD6E8FEB86659FD93)


def super_kmers(data: np.ndarray, offsets: np.ndarray, k: int, m: int) -> tuple[np.ndarray, ...]:
    """For consecutive rows of text: words of each row, then row, first word, windows, minimiser and picked positions of each super-k-mer."""
    starts, ends, first = spans(data, offsets)
    n_words = np.diff(first)
    h = word_hashes(data, starts, ends)
    none = np.zeros(0, np.int64)
    if len(h) < k:
        return n_words, none, none, none, none, none
    gram = np.zeros(len(h) - m + 1, U64)
    for j in range(m):
        gram = gram * _STEP + h[j : j + len(gram)]
    gram = mix(gram)
    # The leftmost least gram of each window: the position breaks ties, and equal windows pick at equal offsets.
    picked = (sliding_min((gram & ~_POSITION) | np.arange(len(gram), dtype=U64), k - m + 1) & _POSITION).astype(np.int64)
    value = gram[picked]
    row_of = np.repeat(np.arange(len(n_words)), n_words)[: len(picked)]
    at = np.arange(len(picked))
    inside = at + k <= first[1:][row_of]
    new_run = np.concatenate(([True], (value[1:] != value[:-1]) | ~inside[:-1]))
    new_pick = new_run | np.concatenate(([True], picked[1:] != picked[:-1]))
    at, runs = at[inside], new_run[inside]
    begins = np.flatnonzero(runs)
    if not len(begins):
        return n_words, none, none, none, none, none
    windows = np.diff(np.concatenate((begins, [len(at)])))
    picks = np.add.reduceat(new_pick[inside].astype(np.int64), begins)
    at = at[begins]
    if windows.max() > MAX_WINDOWS:
        pieces = -(-windows // MAX_WINDOWS)
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at, picks = np.repeat(at, pieces) + place * MAX_WINDOWS, np.repeat(picks, pieces) * (place == 0)
        windows = np.minimum(np.repeat(windows, pieces) - place * MAX_WINDOWS, MAX_WINDOWS)
    row = row_of[at]
    return n_words, row, at - first[row], windows, value[at].view(np.int64), picks


def _long_super_kmers(data: np.ndarray, k: int, m: int) -> tuple[int, str, list[np.ndarray]]:
    """Words of one long text, the digest of all of them, and its super-k-mers, read in pieces."""
    found, n, sha = [], 0, hashlib.sha256()
    for piece, word, repeated in segments(data, CHUNK_BYTES, k - 1):
        own = bytes(piece).split()[repeated:]
        sha.update(b" " * (n > 0 and len(own) > 0) + b" ".join(own))
        n += len(own)
        _, _, first, windows, value, picks = super_kmers(piece, np.array([0, len(piece)]), k, m)
        found.append((first + word, windows, value, picks))
    return n, sha.hexdigest(), [np.concatenate(x) for x in zip(*found)]


def _scan(k: int, m: int):
    def out(batch: pa.RecordBatch, lo: int, hi: int, n_words, shas: list[str], sizes: np.ndarray, columns: list[np.ndarray]) -> pa.RecordBatch:
        first, windows, value, picks = columns
        runs = pa.StructArray.from_arrays([pa.array(value, pa.int64()), pa.array(first, pa.int32()), pa.array(windows, pa.int32()), pa.array(picks, pa.int32())], ["mh", "first", "windows", "picks"])
        kept = [c for c in batch.schema.names if c != "_text"]
        return pa.RecordBatch.from_arrays([*[batch.column(c)[lo:hi] for c in kept], pa.array(n_words, pa.int64()), pa.array(shas, pa.string()), lists(runs, sizes)], [*kept, "n_words", "sha", "runs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_offsets, all_data = utf8(batch.column("_text"))
            for lo, hi in chunks(all_offsets):
                offsets, data = all_offsets[lo : hi + 1] - all_offsets[lo], all_data[all_offsets[lo] : all_offsets[hi]]
                if len(data) > 2 * CHUNK_BYTES:  # one row
                    n, sha, columns = _long_super_kmers(data, k, m)
                    yield out(batch, lo, hi, [n], [sha], np.array([len(columns[0])]), columns)
                    continue
                n_words, row, *columns = super_kmers(data, offsets, k, m)
                raw = data.tobytes()
                shas = [hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield out(batch, lo, hi, n_words, shas, np.bincount(row, minlength=hi - lo), columns)

    return run


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Each text with the bounds of its words."""
    offsets, data = utf8(batch.column("_text"))
    for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
        yield (data[a:b].tobytes(), *word_bounds(data[a:b]))


_STRINGS = pa.schema([("mh", pa.int64()), ("hot", pa.bool_()), ("digest", pa.binary()), ("packed", pa.binary())])
_PLACES = pa.schema([("mh", pa.int64()), ("digest", pa.binary()), ("_row", pa.int64()), ("first", pa.int32())])


def _packed(k: int, with_text: bool):
    """A row for each flagged super-k-mer: bucket, 128-bit digest of the packed string, and either the string or where it stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for (raw, starts, ends), row, runs in zip(_texts(batch), batch.column("_row").to_pylist(), batch.column("runs").to_pylist()):
                for x in runs:
                    packed = joined_words(raw, starts, ends, x["first"], x["first"] + x["windows"] + k - 1)
                    own = {"mh": x["mh"], "digest": hashlib.blake2b(packed, digest_size=16).digest()}
                    out.append({**own, "hot": x["hot"], "packed": packed} if with_text else {**own, "_row": row, "first": x["first"]})
                    size += len(packed) if with_text else 0
                    if len(out) >= OUT_ROWS or size > 4 * CHUNK_BYTES:
                        yield pa.RecordBatch.from_pylist(out, _STRINGS if with_text else _PLACES)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, _STRINGS if with_text else _PLACES)

    return run


def windows_of(packed: bytes, k: int) -> Iterator[bytes]:
    """The windows of a packed string (words joined by one space), in order; long ones as a digest behind a line feed, which no window has."""
    at = [-1, *np.flatnonzero(np.frombuffer(packed, np.uint8) == 0x20).tolist(), len(packed)]
    for i in range(len(at) - k):
        window = packed[at[i] + 1 : at[i + k]]
        yield window if len(window) <= LONG_WINDOW else b"\n" + hashlib.sha256(window).digest()


def merged(hits: list[int], k: int) -> list[tuple[int, int]]:
    """Word ranges covered by windows that start at the sorted ``hits``."""
    out: list[tuple[int, int]] = []
    for i in hits:
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], i + k)
        else:
            out.append((i, i + k))
    return out


def _count_bucket(rows: list[tuple[bytes, bytes, int]], k: int) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """Sort all windows of one bucket; strings that hold repeated ones, with the word ranges those cover."""
    found = sorted((w, r, i) for r, (_, packed, _) in enumerate(rows) for i, w in enumerate(windows_of(packed, k)))
    hits: list[list[int]] = [[] for _ in rows]
    for _, same in groupby(found, key=lambda x: x[0]):
        same = list(same)
        if len(same) > 1 or rows[same[0][1]][2] > 1:
            for _, r, i in same:
                hits[r].append(i)
    for (digest, _, _), h in zip(rows, hits):
        if h:
            yield digest, merged(sorted(h), k)


_SPANS = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _count(k: int):
    """Counts the windows of each bucket; rows arrive sorted by bucket, and one bucket at a time is held."""

    def emit(mh: int, rows: list, out: tuple[list, list, list]) -> None:
        for digest, covered in _count_bucket(rows, k):
            out[0].append(mh)
            out[1].append(digest)
            out[2].append([{"lo": lo, "hi": hi} for lo, hi in covered])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = ([], [], [])
            for mh, digest, packed, n in zip(*(batch.column(c).to_pylist() for c in ("mh", "digest", "packed", "occurrences"))):
                if mh != now:
                    emit(now, rows, out)
                    now, rows = mh, []
                rows.append((digest, packed, n))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], _SPANS)], ["mh", "digest", "covered"])
        out = ([], [], [])
        emit(now, rows, out)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], _SPANS)], ["mh", "digest", "covered"])

    return run


_WINDOWS = pa.schema([("mh", pa.int64()), ("digest", pa.binary()), ("window", pa.binary()), ("lo", pa.int32()), ("n", pa.int64())])


def _single_windows(k: int):
    """A row for each window of a string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for mh, digest, packed, n in zip(*(batch.column(c).to_pylist() for c in ("mh", "digest", "packed", "occurrences"))):
                out += [{"mh": mh, "digest": digest, "window": hashlib.blake2b(w, digest_size=16).digest(), "lo": i, "n": n} for i, w in enumerate(windows_of(packed, k))]
                if len(out) >= OUT_ROWS:
                    yield pa.RecordBatch.from_pylist(out, _WINDOWS)
                    out = []
            yield pa.RecordBatch.from_pylist(out, _WINDOWS)

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, shas, texts = [], [], []
        for (raw, starts, ends), covered in zip(_texts(batch), batch.column("covered").to_pylist()):
            kept, at, gone = [], 0, 0
            for lo, hi in sorted((x["lo"], x["hi"]) for x in covered):
                if lo > at:
                    kept.append(joined_words(raw, starts, ends, at, lo))
                gone += max(0, hi - max(at, lo))
                at = max(at, hi)
            if at < len(starts):
                kept.append(joined_words(raw, starts, ends, at, len(starts)))
            text = b" ".join(kept)
            texts.append(text.decode("utf-8", "replace"))
            removed.append(gone)
            shas.append(hashlib.sha256(text).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(texts, pa.string())], ["_row", "n_removed", "kept_sha256", "kept_text"])


def repeated_windows(rows: DataFrame, k: int = WINDOW, m: int = MINIMISER, max_bucket: int = MAX_BUCKET) -> tuple[DataFrame, DataFrame]:
    """For ``rows`` of ``_row, _text`` and more: ``n_words`` and ``sha`` of every row (the digest of all its words joined by one
    space) with its other columns, and ``_row, n_removed, kept_sha256, kept_text`` of the rows that lose words."""
    if not 1 <= m <= k:
        raise ValueError("the minimiser must have 1 to k words")
    small_batches(rows.sparkSession)
    schema = wider(T.StructType([f for f in rows.schema.fields if f.name != "_text"]), n_words="long", sha="string", runs="array<struct<mh:long,first:int,windows:int,picks:int>>")
    scanned, _ = materialize(rows.mapInArrow(_scan(k, m), schema), "minimisers")
    runs = scanned.select("_row", F.explode("runs").alias("run")).select("_row", "run.*")
    repeated = runs.groupBy("mh").agg(F.sum("picks").alias("n")).filter("n > 1").select("mh", (F.col("n") > max_bucket).alias("hot"))
    repeated, _ = materialize(repeated, "repeated")  # as a table, so that the join can split a minimiser of very many places
    flagged = runs.join(repeated, "mh").groupBy("_row").agg(F.collect_list(F.struct("mh", "first", "windows", "hot")).alias("runs"))
    texts, _ = materialize(rows.select("_row", "_text").join(flagged, "_row"), "flagged")

    strings = texts.mapInArrow(_packed(k, True), "mh long, hot boolean, digest binary, packed binary").groupBy("mh", "hot", "digest", "packed").agg(F.count("*").alias("occurrences"))
    strings, _ = materialize(strings, "strings")
    # Dealt by a hash of the bucket, as the table may be split anywhere.
    cold = strings.filter("not hot").drop("hot").repartition(F.xxhash64("mh")).sortWithinPartitions("mh")
    covered = cold.mapInArrow(_count(k), "mh long, digest binary, covered array<struct<lo:int,hi:int>>")
    single = strings.filter("hot").drop("hot").mapInArrow(_single_windows(k), "mh long, digest binary, window binary, lo int, n long")
    often = single.groupBy("window").agg(F.sum("n").alias("total")).filter("total > 1").select("window")
    often, _ = materialize(often, "often")  # the same for a window of very many strings
    covered = covered.unionByName(single.join(often, "window").select("mh", "digest", F.array(F.struct("lo", (F.col("lo") + k).cast("int").alias("hi"))).alias("covered")))

    places = texts.mapInArrow(_packed(k, False), "mh long, digest binary, _row long, first int")
    hits = places.join(covered, ["mh", "digest"]).select("_row", F.transform("covered", lambda x: F.struct((x.lo + F.col("first")).alias("lo"), (x.hi + F.col("first")).alias("hi"))).alias("c"))
    hits = hits.groupBy("_row").agg(F.flatten(F.collect_list("c")).alias("covered"))
    lost = texts.select("_row", "_text").join(hits, "_row").mapInArrow(_remove, "_row long, n_removed long, kept_sha256 string, kept_text string")
    return scanned.drop("runs"), lost


def remove_repeats(docs: DataFrame, text: str = "text", k: int = WINDOW, m: int = MINIMISER, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """``docs`` with repeated windows removed from ``text`` (kept words joined by one space); rows that lose nothing are unchanged."""
    rows = Rows(docs)
    _, lost = repeated_windows(rows.select(F.col(f"`{text}`").alias("_text")), k, m, max_bucket)
    lost, _ = materialize(lost.select("_row", "kept_text"), "lost")
    out = rows.select(kept_columns(docs).alias("_doc")).join(lost, "_row", "left")
    return out.select(*unpacked(docs, **{text: F.coalesce("kept_text", F.col("_doc").getField(text))}))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = WINDOW, m: int = MINIMISER, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_sha256``."""
    rows = Rows(docs).select(F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    scanned, lost = repeated_windows(rows, k, m, max_bucket)
    out = scanned.join(lost.drop("kept_text"), "_row", "left")
    return out.select(F.col("_id").alias("doc_id"), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"))

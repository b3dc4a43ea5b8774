"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are runs of 0-9, letters and everything beyond ASCII after A-Z is lower-cased. A window is ``window``
consecutive words of an item; a shorter item that is not empty is one window as a whole. A document word inside any
occurrence of a window is hit.

The automaton accepts every word sequence of every item. Streaming a document through it keeps the longest suffix
read so far that some item contains; if that is at least a window long, its last ``window`` words are hit, and
the automaton's state tells which items own the window. Words that no item has reset the automaton, so only
stretches of known words that are long enough for the shortest window are streamed word by word; the rest of a
batch is split, hashed and compared as arrays.

An automaton holds at most about ``SHARD_WORDS`` words of items and is broadcast. A larger benchmark is dealt into
several automata with a pass for each: the hits of a pass are written, its automaton is let go before the next one is
built, and the passes' hits meet by document. So one automaton is alive at a time, whatever the benchmark's size.

Defined results: null and empty texts have no words, of documents and of items alike; a null item id counts as an
item and is written as the empty string; repeated items are items of their own; rows of documents are told apart
by file and place. Columns may have any names. Long texts are streamed in pieces that share ``window - 1`` words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.llm.arrays import CHUNK_BYTES, chunks, lists, segments, spans, utf8, word_bounds, word_hashes
from ranksmith.llm.storage import Rows, kept_columns, materialize, small_batches, unpacked, wider

WINDOW = 10
SHARD_WORDS = 200_000
MIN_SPAN = 10
MAX_COVERAGE = 0.5
#: Every byte to what it is after normalisation; bytes outside words become spaces.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = np.array([b == 32 for b in range(256)])
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences, with the owners of each window."""

    def __init__(self, items: list[list[bytes]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for words in items]
        for words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        #: For each state whose longest sequence fills a window: the state of that sequence's last window.
        self.tail = [0] * len(self.next)
        for s in by_length:
            if self.length[s] >= window:
                self.tail[s] = self.tail[self.link[s]] or s
        self.owners: dict[int, list[int]] = {}
        self.short: dict[int, list[tuple[int, int]]] = {}
        self.shortest = min([window, *(len(w) for w in coded if w)])
        for i, words in enumerate(coded):
            if 0 < len(words) < window:
                s = 0
                for w in words:
                    s = self.next[s][w]
                self.short.setdefault(s, []).append((len(words), i))
            s = size = 0
            for w in words:
                s, size = self._step(s, size, w)
                if size >= window:
                    own = self.owners.setdefault(self.tail[s], [])
                    if not own or own[-1] != i:
                        own.append(i)
        #: The nearest state on the way to the root, itself included, that is the end of a short item.
        self.up = [-1] * len(self.next)
        for s in by_length:
            self.up[s] = s if s in self.short else self.up[self.link[s]]

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        have = nxt[last].get(w)
        if have is not None and length[have] == length[last] + 1:
            return have
        if have is not None:
            return self._clone(last, w, have)
        now = self._new(length[last] + 1, {})
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = now
            p = link[p]
        if p < 0:
            link[now] = 0
        else:
            q = nxt[p][w]
            link[now] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return now

    def _new(self, length: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        twin = self._new(self.length[p] + 1, dict(self.next[q]))
        self.link[twin], self.link[q] = self.link[q], twin
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _step(self, s: int, size: int, w: int) -> tuple[int, int]:
        while s and w not in self.next[s]:
            s = self.link[s]
            size = self.length[s]
        to = self.next[s].get(w)
        return (0, 0) if to is None else (to, size + 1)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of hit words (not merged), and the items whose windows occur."""
        nxt, link, length, window, code = self.next, self.link, self.length, self.window, self.vocabulary.get
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        states: set[int] = set()
        s = size = 0
        for i, w in enumerate(map(code, words)):
            while s and w not in nxt[s]:
                s = link[s]
                size = length[s]
            s = nxt[s].get(w, 0)
            size = size + 1 if s else 0
            if size >= window:
                found.append((i + 1 - window, i + 1))
                states.add(self.tail[s] if length[link[s]] >= window else s)
            a = self.up[s]
            while a > 0:
                for n, item in self.short[a]:
                    if n <= size:
                        found.append((i + 1 - n, i + 1))
                        items.add(item)
                a = self.up[link[a]]
        for x in states:
            items.update(self.owners[x])
        return found, items


def _merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(ranges):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_SPAN = pa.struct([("lo", pa.int32()), ("hi", pa.int32())])


def _match(automaton: Automaton, vocabulary: np.ndarray, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, list, list]:
    """Of normalised texts: the number of words, ranges of hit words (not merged) and the items whose windows occur."""
    data = np.frombuffer(raw, np.uint8)
    starts, ends, first = spans(data, offsets, _GAP)
    ranges: list[list[tuple[int, int]]] = [[] for _ in range(len(offsets) - 1)]
    items: list[set[int]] = [set() for _ in ranges]
    if len(starts) and len(vocabulary):
        h = word_hashes(data, starts, ends)
        is_known = vocabulary[np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)] == h
        begin = is_known & np.concatenate(([True], ~is_known[:-1]))
        end = is_known & np.concatenate((~is_known[1:], [True]))
        cut = first[(first > 0) & (first < len(h))]
        begin[cut] |= is_known[cut]
        end[cut - 1] |= is_known[cut - 1]
        begin, end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        long = end - begin >= automaton.shortest
        rows = np.searchsorted(first, begin[long], side="right") - 1
        for row, a, b in zip(rows.tolist(), begin[long].tolist(), end[long].tolist()):
            got, own = automaton.hits(raw[starts[a] : ends[b - 1]].split())
            if got:
                at = a - int(first[row])
                ranges[row] += [(x + at, y + at) for x, y in got]
                items[row] |= own
    return np.diff(first), ranges, items


def _match_long(automaton: Automaton, vocabulary: np.ndarray, raw: bytes) -> tuple[np.ndarray, list, list]:
    """The same of one long text, in pieces."""
    n, ranges, items = 0, [], set()
    for piece, word, _ in segments(np.frombuffer(raw, np.uint8), CHUNK_BYTES, automaton.window - 1, _GAP):
        own, (found,), (named,) = _match(automaton, vocabulary, piece.tobytes(), np.array([0, len(piece)]))
        n = word + int(own[0])
        ranges += [(x + word, y + word) for x, y in found]
        items |= named
    return np.array([n]), [ranges], [items]


def _scan(shared, ids: list[str], text_of=lambda batch: batch.column("_text")):
    """The other columns, and ``n_words`` of each text, its merged ranges of hit words and the ids of the items that they come from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = shared.value
        known = b" ".join(automaton.vocabulary)
        lo, hi, _ = spans(np.frombuffer(known, np.uint8), np.array([0, len(known)]), _GAP)
        vocabulary = np.unique(word_hashes(np.frombuffer(known, np.uint8), lo, hi)) if len(lo) else np.zeros(0, np.uint64)
        for batch in batches:
            all_offsets, all_data = utf8(text_of(batch))
            kept = [c for c in batch.schema.names if c != "_text"]
            for lo, hi in chunks(all_offsets):
                raw = all_data[all_offsets[lo] : all_offsets[hi]].tobytes().translate(NORMAL)
                long = len(raw) > 2 * CHUNK_BYTES  # one row
                n_words, ranges, items = _match_long(automaton, vocabulary, raw) if long else _match(automaton, vocabulary, raw, all_offsets[lo : hi + 1] - all_offsets[lo])
                merged = [_merge(x) if x else x for x in ranges]
                flat = [{"lo": x, "hi": y} for r in merged for x, y in r]
                named = [ids[i] for own in items for i in sorted(own)]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c)[lo:hi] for c in kept], pa.array(n_words, pa.int64()), lists(pa.array(flat, _SPAN), np.array([len(x) for x in merged])), lists(pa.array(named, pa.string()), np.array([len(x) for x in items]))],
                    [*kept, "n_words", "spans", "items"],
                )

    return run


_HITS = {"n_words": "long", "spans": "array<struct<lo:int,hi:int>>", "items": "array<string>"}


class Shards:
    """The automata of a benchmark, each with its item ids, one after another."""

    def __init__(self, items: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS):
        small_batches(items.sparkSession)
        self.window, self.spark = window, items.sparkSession
        self.items = items.select(F.col(f"`{item_id}`").cast("string").alias("i"), F.col(f"`{item_text}`").cast("string").alias("t")).filter("t is not null")
        total = self.items.agg(F.sum(F.size(F.regexp_extract_all("t", F.lit(f"({WORD})"), 1)))).first()[0] or 0
        self.number = max(1, -(-total // shard_words))

    def automaton(self, shard: int | None) -> tuple:
        """A broadcast automaton and its item ids; without a shard, one that holds nothing."""
        own = [] if shard is None else self.items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(self.number)) == shard).collect()  # about shard_words words
        return self.spark.sparkContext.broadcast(Automaton([words_of(r.t) for r in own], self.window)), [r.i or "" for r in own]


def find_hits(rows: DataFrame, shards: Shards) -> DataFrame:
    """The columns of ``rows(_row, _text, ...)`` but the text, ``n_words``, ``spans`` of hit words (``lo`` to ``hi``, merged) and ``items``."""

    def scanned(rows: DataFrame, shard: int | None) -> DataFrame:
        return rows.mapInArrow(_scan(*shards.automaton(shard)), wider(T.StructType([f for f in rows.schema.fields if f.name != "_text"]), **_HITS))

    if shards.number == 1:
        return scanned(rows, 0)
    every = None
    for shard in range(shards.number):
        shared, ids = shards.automaton(shard)
        found = rows.select("_row", "_text").mapInArrow(_scan(shared, ids), wider(rows.select("_row").schema, **_HITS)).filter(F.size("spans") > 0)
        found, _ = materialize(found.select("_row", "spans", "items"), "hits")
        shared.destroy()
        every = found if every is None else every.unionByName(found)
    every = every.groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    out = scanned(rows, None).join(every, "_row", "left").withColumn("spans", _merge_spans(F.coalesce("_spans", "spans"))).withColumn("items", F.coalesce("_items", "items"))
    return out.drop("_spans", "_items")


def _merge_spans(column: Column) -> Column:
    none = F.array().cast("array<struct<lo:int,hi:int>>")

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["lo"].alias("lo"), F.greatest(last["hi"], x["hi"]).alias("hi"))))
        return F.when((F.size(done) > 0) & (x["lo"] <= last["hi"]), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(column), none, add)


def n_hit(column: str = "spans") -> Column:
    return F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + (x["hi"] - x["lo"]).cast("long"))


def cut_spans(raw: bytes, found: list[dict], min_span: int, window: int = 0) -> bytes:
    """A text without its hit spans of at least ``min_span`` words, and those of under ``window`` words, which only whole
    short items make; what stands around them is unchanged."""
    lo, hi = word_bounds(np.frombuffer(raw.translate(NORMAL), np.uint8), _GAP)
    kept, at = [], 0
    for x in found:
        if not window <= x["hi"] - x["lo"] < min_span:
            kept.append(raw[at : lo[x["lo"]]])
            at = hi[x["hi"] - 1]
    return b"".join([*kept, raw[at:]])


def _clean(text: str, min_span: int, max_coverage: float, window: int):
    """Batches of ``_doc, n_words, spans`` to those documents that stay, with their hit spans cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column("_doc")
            at = doc.type.get_field_index(text)
            texts, stays = doc.field(at), np.ones(len(doc), bool)
            hit = batch.column("spans").fill_null([]) if batch.column("spans").null_count else batch.column("spans")
            rows = np.flatnonzero(np.diff(hit.offsets.to_numpy()))
            if len(rows):
                new = texts.to_pylist()
                for i in rows.tolist():
                    found = hit[i].as_py()
                    stays[i] = sum(x["hi"] - x["lo"] for x in found) <= max_coverage * batch.column("n_words")[i].as_py()
                    new[i] = cut_spans(new[i].encode(), found, min_span, window).decode("utf-8", "replace") if stays[i] else None
                texts = pa.array(new, texts.type)
            fields = [texts if i == at else doc.field(i) for i in range(doc.type.num_fields)]
            out = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(doc.type))], ["_doc"])
            yield out if stays.all() else out.filter(pa.array(stays))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, min_span: int = MIN_SPAN, max_coverage: float = MAX_COVERAGE, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``docs`` without hit spans of at least ``min_span`` words (runs of hit words) or of whole items of under ``window`` words, and without the documents of which
    more than ``max_coverage`` of all words are hit. Texts without such spans, and null ones, are unchanged.

    With one automaton this is a single pass without a shuffle; with several the hits join back by row."""
    shards, clean = Shards(items, window=window, shard_words=shard_words), _clean(text, min_span, max_coverage, window)
    if shards.number == 1:
        scan = _scan(*shards.automaton(0), text_of=lambda batch: batch.column("_doc").field(text))
        found = docs.select(kept_columns(docs).alias("_doc"))
        out = found.mapInArrow(lambda batches: clean(scan(batches)), found.schema)
    else:
        rows = Rows(docs)
        hits, _ = materialize(find_hits(rows.select(F.col(f"`{text}`").alias("_text")), shards).filter(F.size("spans") > 0).select("_row", "n_words", "spans"), "hits")
        found = rows.select(kept_columns(docs).alias("_doc")).join(hits, "_row", "left").drop("_row")
        out = found.mapInArrow(clean, found.select("_doc").schema)
    return out.select(*unpacked(docs))


def digests(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Per row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    shards, columns = Shards(items, window=window, shard_words=shard_words), (F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").alias("_text"))
    rows = docs.select(F.lit(0).cast("long").alias("_row"), *columns) if shards.number == 1 else Rows(docs).select(*columns)
    hits = find_hits(rows, shards)
    named = F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256")
    out = hits.select(F.col("_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"), named)
    return out.withColumn("contaminated", F.col("n_hit") > 0)

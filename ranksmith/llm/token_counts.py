"""Token counts of sections or fields by offset-mapped attribution.

A document is encoded once as a whole by a public byte-level BPE vocabulary. The tokens' bytes are the text, so running
sums of token lengths are byte offsets, and an interval join (a binary search of sorted section ends) finds the section
of each token. A token that crosses a boundary is allocated by a rule:

* ``first``: to the section of its first byte (the default);
* ``most``: to the section that holds most of its bytes, of ties the earliest;
* ``split``: to every section by its share of the token's bytes.

Sections of a text are its lines, each with the line feed that ends it; a final line feed opens no section. Fields of a
row are joined by ``SEPARATOR``, which belongs to the field before it. By ``first`` and ``most`` the counts add up to the
number of tokens exactly, by ``split`` up to rounding.

Defined results: null and empty texts have no token and no section; null fields are empty; null ids and repeated rows are
kept as they are; empty tables give empty results. The strings of special tokens are ordinary text. Texts are encoded
whole, whatever their length. Columns may have any names. The vocabulary file is read by the driver and broadcast (its
size does not depend on the data).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.arrays import lists
from ranksmith.llm.storage import small_batches, wider

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEPARATOR = "\n\n"
RULES = ("first", "most", "split")
#: White space runs of this length are encoded apart: the pattern's look-ahead cannot step back over a million places.
LONG_SPACE = 100_000
_LONG_SPACES = regex.compile(rf"\p{{White_Space}}{{{LONG_SPACE},}}")


def pieces(text: str) -> Iterator[tuple[str, bool]]:
    """``text`` in order, and whether a part is a single piece of the pattern: a long white space run but for its last
    place, which the pattern leaves to what follows."""
    at = 0
    for run in _LONG_SPACES.finditer(text) if len(text) >= LONG_SPACE else ():
        stop = run.end() - (run.end() < len(text))
        yield text[at : run.start()], False
        yield text[run.start() : stop], True
        at = stop
    yield text[at:], False


class Encoder:
    """A vocabulary of token bytes and ids; the encoding is built once in each Python process."""

    def __init__(self, path: str, pattern: str = PATTERN):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}
        self.pattern = pattern
        self._built = None

    def __getstate__(self):
        return {"ranks": self.ranks, "pattern": self.pattern, "_built": None}

    def lengths(self, texts: list[str]) -> list[np.ndarray]:
        """The byte lengths of each text's tokens, in order."""
        if self._built is None:
            import tiktoken

            sizes = np.zeros(max(self.ranks.values()) + 1, np.int64)
            for token, i in self.ranks.items():
                sizes[i] = len(token)
            split, whole = (tiktoken.Encoding("own", pat_str=p, mergeable_ranks=self.ranks, special_tokens={}) for p in (self.pattern, r"(?s:.+)"))
            self._built = split, sizes, whole
        split, sizes, whole = self._built
        return [sizes[np.concatenate([np.array((whole if one else split).encode_ordinary(part), np.int64) for part, one in pieces(t)])] for t in texts]


def line_ends(text: bytes) -> np.ndarray:
    """End offsets of the lines of a text."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if not len(text) or (len(ends) and ends[-1] == len(text)) else np.append(ends, len(text))


def allocate(lengths: np.ndarray, ends: np.ndarray, rule: str = "first") -> tuple[np.ndarray, int]:
    """Tokens of each section, and how many tokens cross a boundary. ``ends``: ascending section ends; the last is the text's."""
    stop = np.cumsum(lengths)
    start = stop - lengths
    left = np.searchsorted(ends, start, side="right")
    right = np.searchsorted(ends, stop - 1, side="right")
    crossing = np.flatnonzero(right > left)
    if rule == "first":
        return np.bincount(left, minlength=len(ends)), len(crossing)
    counts = np.bincount(np.delete(left, crossing), minlength=len(ends)).astype(np.float64 if rule == "split" else np.int64)
    for i in crossing.tolist():
        cuts = np.concatenate(([start[i]], ends[left[i] : right[i]], [stop[i]]))
        share = np.diff(cuts)
        if rule == "most":
            counts[left[i] + int(share.argmax())] += 1
        else:
            counts[left[i] : right[i] + 1] += share / lengths[i]
    return counts, len(crossing)


def _count(shared, texts_of, ends_of, keep: list[str], rule: str):
    kind = pa.float64() if rule == "split" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows = texts_of(part)
                texts = ["".join(parts) for parts in rows]
                lengths = shared.value.lengths(texts)
                found = [allocate(n, ends_of(t.encode(), parts), rule) for t, parts, n in zip(texts, rows, lengths)]
                values = np.concatenate([x for x, _ in found]) if found else np.zeros(0)
                columns = [pa.array([len(n) for n in lengths], pa.int64()), lists(pa.array(values.astype(kind.to_pandas_dtype()), kind), np.array([len(x) for x, _ in found])), pa.array([c for _, c in found], pa.int64())]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *columns], [*keep, "n_tokens", "section_tokens", "n_crossing"])

    return run


def _run(df: DataFrame, keep: list[str], rule: str, path: str, texts_of, ends_of) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(Encoder(path))
    schema = wider(df.select(*keep).schema, n_tokens="long", section_tokens=f"array<{'double' if rule == 'split' else 'long'}>", n_crossing="long")
    return df.mapInArrow(_count(shared, texts_of, ends_of, keep, rule), schema)


def _strings(column: pa.Array) -> list[str]:
    column = pc.fill_null(column, "") if column.null_count else column
    return [x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def count_lines(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rule: str = "first", path: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``section_tokens`` (a number for each line) and ``n_crossing`` of every row."""
    names = [f"_k{i}" for i in range(len(keep))]
    df = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], F.col(text).cast("string").alias("_text"))
    out = _run(df, names, rule, path, lambda batch: [(t,) for t in _strings(batch.column("_text"))], lambda raw, _: line_ends(raw))
    return out.toDF(*keep, "n_tokens", "section_tokens", "n_crossing")


def count_fields(df: DataFrame, fields: list[str], keep: tuple[str, ...] = (), rule: str = "first", path: str = VOCABULARY, separator: str = SEPARATOR) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``section_tokens`` (a number for each of ``fields``) and ``n_crossing`` of every row."""
    names, texts = [f"_k{i}" for i in range(len(keep))], [f"_f{i}" for i in range(len(fields))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)], *[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(fields, texts)])

    def texts_of(batch: pa.RecordBatch) -> list[tuple[str, ...]]:
        columns = [_strings(batch.column(n)) for n in texts]
        return [tuple(p + separator if i + 1 < len(row) else p for i, p in enumerate(row)) for row in zip(*columns)]

    out = _run(rows, names, rule, path, texts_of, lambda _, parts: np.cumsum([len(p.encode()) for p in parts]))
    return out.toDF(*keep, "n_tokens", "section_tokens", "n_crossing")

"""Toxicity scores from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Text is lower-cased (A-Z), everything that is no letter, digit or byte beyond ASCII becomes a space, and every run of
``min_gram`` to ``max_gram`` bytes that lies within one word and the spaces on its two sides is a feature, hashed to a
bucket. A document is the mean of the embedding vectors of all its features; a linear layer and a softmax over the
two classes follow. Misspelt words share most of their grams with the words of the training texts.

Fitting takes a bounded sample of labelled rows: at most ``max_rows`` per class, those with the smallest hashed ids,
whatever the size of the input, less those whose text is longer than ``MAX_TRAINING_CHARS``. The class shares of *all* labelled training rows then set the intercept, as the
sample is balanced. Scoring reads every text whole; the model is one vector of scalars (a bucket's embedding times
the difference of the two output rows), so a batch is scored by array operations without a Python loop over words.

Defined results: null, empty and symbol-only texts have no feature and get the score of the intercept; rows whose
label is neither 0 nor 1, or whose document is missing, do not train; with no usable label, or only one class of them,
every score is the smoothed share of the positive class. A null id is never held out. Ties and repeated rows score
alike. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranksmith.llm.arrays import chunks, mix, segments, utf8
from ranksmith.llm.storage import small_batches, wider

MAX_ROWS = 3000
MAX_TRAINING_CHARS = 100_000
PIECE_BYTES = 1 << 19
BUCKETS = 1 << 18
DIMENSIONS = 4
GRAMS = (3, 6)
EPOCHS = 10
#: Pull of the embeddings towards zero.
DECAY = 3e-5
FOLDS = 5
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = np.arange(256) == 32
_BASE = np.uint64(0x100000001B3)


def features(raw: bytes, offsets: np.ndarray, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: the first bytes of the grams (in the padded text) and their buckets.

    ``raw`` holds normalised texts, each between two spaces, at ``offsets``."""
    data = np.frombuffer(raw, np.uint8)
    gap = data == 32
    # Bytes from each place to the next space after it: a gram may start at a space but holds none inside.
    n = len(data)
    nearest = np.where(gap, np.arange(n, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(nearest[::-1])[::-1]
    room = np.empty(n, np.int32)  # grams starting here may end with the next space but not go beyond
    room[:-1] = nearest[1:] - np.arange(n - 1, dtype=np.int32) + 1
    if n:
        room[-1] = 0
    wide = data.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for size in range(1, grams[1] + 1):
        h = h[: n - size + 1] * _BASE + wide[size - 1 :]
        if size >= grams[0]:
            at = np.flatnonzero(room[: len(h)] >= size)
            yield at, (mix(h[at] + np.uint64(size)) & np.uint64(buckets - 1)).astype(np.int64)


def padded(raw: bytes, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Normalised texts with a space on either side, and their new offsets."""
    raw = raw.translate(_NORMAL)
    at = offsets.tolist()
    return b"".join([b" " + raw[a:b] + b" " for a, b in zip(at, at[1:])]), offsets + 2 * np.arange(len(offsets))


@dataclass(frozen=True)
class Model:
    """``weight`` of each bucket and the intercept, on the scale of the log odds of label 1."""

    weight: np.ndarray
    intercept: float
    grams: tuple[int, int] = GRAMS

    def _sums(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights and number of the features of each text."""
        raw, at = padded(raw, offsets)
        total, count = np.zeros(len(raw) + 1), np.zeros(len(raw) + 1, np.int32)
        for first, bucket in features(raw, at, self.grams, len(self.weight)):
            # A gram start occurs once for each length, so plain indexing adds each gram once.
            total[first + 1] += self.weight[bucket]
            count[first + 1] += 1
        return np.diff(np.cumsum(total)[at]), np.diff(np.cumsum(count, dtype=np.int64)[at])

    def scores(self, raw: bytes, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(raw) > 2 * PIECE_BYTES:  # a long text: features lie within words, so its pieces add up
            pieces = segments(np.frombuffer(raw.translate(_NORMAL), np.uint8), PIECE_BYTES, 0, _GAP)
            sums, n = (sum(x) for x in zip(*(self._sums(p.tobytes(), np.array([0, len(p)])) for p, _, _ in pieces)))
        else:
            sums, n = self._sums(raw, offsets)
        logits = self.intercept + sums / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logits, -500, 500)))


def _bags(texts: list[bytes], grams: tuple[int, int], buckets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and shares of each text's features."""
    out = []
    for text in texts:
        raw, at = padded(text, np.array([0, len(text)]))
        bucket = np.concatenate([b for _, b in features(raw, at, grams, buckets)] or [np.zeros(0, np.int64)])
        ids, n = np.unique(bucket, return_counts=True)
        out.append((ids.astype(np.int32), (n / max(1, len(bucket))).astype(np.float32)))
    return out


def fit(texts: list[bytes], labels: list[int], positive: float, grams: tuple[int, int] = GRAMS, buckets: int = BUCKETS, dimensions: int = DIMENSIONS, epochs: int = EPOCHS, seed: int = 0, decay: float = DECAY) -> Model:
    """Train embeddings and output layer jointly (Adam on mini-batches of the softmax loss). ``positive``: the share of label 1 among all rows."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        p = min(max(positive, 1e-3), 1 - 1e-3)
        return Model(np.zeros(buckets), float(np.log(p / (1 - p))), grams)
    rng = np.random.default_rng(seed)
    balance = (len(y) / 2 / np.bincount(y, minlength=2)).astype(np.float32)  # both classes weigh the same in the loss
    bags = _bags(texts, grams, buckets)
    seen = np.zeros(buckets, bool)
    for ids, _ in bags:
        seen[ids] = True
    used, place = np.flatnonzero(seen), np.cumsum(seen, dtype=np.int32) - 1
    for ids, _ in bags:
        ids[:] = place[ids]
    table = rng.normal(0, 0.1, (len(used), dimensions)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (dimensions, 2)).astype(np.float32), np.zeros(2, np.float32)
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, rate, size = 0, 0.05, 128
    # Averages of many vectors are small: scaling them keeps the gradients of output and embeddings alike.
    scale = np.float32(50)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            lengths = [len(bags[i][0]) for i in rows]
            ids, share = np.concatenate([bags[i][0] for i in rows]), np.concatenate([bags[i][1] for i in rows]) * scale
            bounds = np.concatenate(([0], np.cumsum(lengths)))
            weighted = table[ids] * share[:, None]
            total = np.concatenate((np.zeros((1, dimensions), np.float32), np.cumsum(weighted, axis=0, dtype=np.float64).astype(np.float32)))
            mean = total[bounds[1:]] - total[bounds[:-1]]
            logits = mean @ out + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= balance[y[rows]][:, None] / len(rows)
            back = np.repeat(p @ out.T, lengths, axis=0) * share[:, None]
            grad = np.stack([np.bincount(ids, back[:, d], len(used)) for d in range(dimensions)], axis=1).astype(np.float32)
            step += 1
            for q, g, (m, v) in zip(params, (grad + decay * table, mean.T @ p + 1e-4 * out, p.sum(axis=0)), moments):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    weight = np.zeros(buckets)
    weight[used] = (table @ (out[:, 1] - out[:, 0])).astype(np.float64) * float(scale)
    true = min(max(positive, 1e-6), 1 - 1e-6)
    return Model(weight, float(bias[1] - bias[0] + np.log(true / (1 - true))), grams)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, max_rows: int = MAX_ROWS, seed: int = 0) -> Model:
    """Fit on at most ``max_rows`` labelled documents per class outside the held-out fold."""
    usable = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id"), folds))
    counts = {r["_y"]: r["n"] for r in usable.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    sample = usable.limit(0)
    for y in counts:
        picked = usable.filter(F.col("_y") == y).dropDuplicates(["_id"]).withColumn("_h", F.xxhash64(F.col("_id").cast("string"), F.lit(seed))).orderBy("_h", "_id").limit(max_rows)
        sample = sample.unionByName(picked.select("_id", "_y"))
    # At most 2 * max_rows ids, so they may be broadcast.
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).filter(F.length("_t").isNull() | (F.length("_t") <= MAX_TRAINING_CHARS))
    rows = texts.join(F.broadcast(sample), "_id").orderBy("_id", "_y", "_t").limit(2 * max_rows).collect()
    positive = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    return fit([(r["_t"] or "").encode() for r in rows], [r["_y"] for r in rows], positive, seed=seed)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns and ``score`` of every row, in one pass without a shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("_text"))
            found = [shared.value.scores(data[offsets[lo] : offsets[hi]].tobytes(), offsets[lo : hi + 1] - offsets[lo]) for lo, hi in chunks(offsets, PIECE_BYTES)]
            column = pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], column], [*keep, "score"])

    return rows.mapInArrow(run, wider(rows.drop("_text").schema, score="double"))


def toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = FOLDS, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per row: ``doc_id, held_out, score, predicted``."""
    model = train(docs, labels, doc_id, text, label, folds, max_rows)
    scored = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), model, "_t")
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

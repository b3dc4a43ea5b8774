"""Language identification by Bayesian fusion of independent evidence.

For each language the log posterior is the sum of

* the *text*: mean log likelihood of the text's byte trigrams under a smoothed multinomial for the language, times
  the number of trigrams or ``EFFECTIVE``, whichever is less, as neighbouring trigrams are far from independent;
* the *declared* markup language (``<html lang=...>``), right with probability ``DECLARED_RIGHT``;
* the *address suffix*: a country suffix points at its language with probability ``SUFFIX_RIGHT``, others say nothing;
* the *host prior*: expected language shares of the other pages of the host, smoothed towards those of its domain, of
  its suffix and of the whole table in turn (``STRENGTH`` pseudo-pages from each parent). The shares are sums of
  per-page posteriors from the first three sources; one grouped aggregation over all rows computes each level, and a
  page's own share is taken out of each level before it judges that page.

The trigram tables are fitted on at most ``MAX_ROWS`` labelled documents per language, those with the smallest hashed
ids, less those of more than ``MAX_TRAINING_CHARS``. A text of at least ``EFFECTIVE`` trigrams whose mean log likelihood is below that of every fitted document by
``MARGIN`` is in no known language.

Result: the language with the largest posterior, or ``und`` if its posterior is below ``min_confidence``, if the text
has letters of no known language, or if there is no evidence but priors (no text, no declared language, no country suffix).
Null texts and addresses count as empty; empty tables give empty results, and with no labelled document all is ``und``.
The table of finest levels is broadcast only if it has at most ``BROADCAST_LEVELS`` rows; else it is a shuffled join whose
hot keys adaptive execution splits. Texts are read whole. Columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranksmith.functions.binding import let
from ranksmith.llm.arrays import chunks, segments, utf8
from ranksmith.llm.storage import materialize, small_batches, wider

MAX_ROWS = 1000
BUCKETS = 1 << 15
EFFECTIVE = 40.0
DECLARED_RIGHT = 0.9
SUFFIX_RIGHT = 0.8
STRENGTH = 5.0
MARGIN = 1.0
MIN_CONFIDENCE = 0.5
BROADCAST_LEVELS = 10_000
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "ie": "en", "it": "it", "pt": "pt", "nl": "nl"}
UNKNOWN = "und"
#: Labels that stand between a country suffix and a domain.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
PIECE_BYTES = 1 << 18
MAX_TRAINING_CHARS = 100_000
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = np.arange(256) == 32


def padded(raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised texts, each between two spaces, and their new offsets."""
    raw, at = raw.translate(_NORMAL), offsets.tolist()
    return np.frombuffer(b"".join([b" " + raw[a:b] + b" " for a, b in zip(at, at[1:])]), np.uint8), offsets + 2 * np.arange(len(offsets))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start bytes and buckets of the trigrams of padded texts: three bytes of one text, no space in the middle."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    v = (data[:-2].astype(np.uint32) << np.uint32(16)) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | data[2:]
    fine = data[1:-1] != 32
    for back in (1, 2):  # starts one or two bytes before the end of a text
        at = offsets[1:] - back
        at = at[(at >= 0) & (at < len(fine))]
        fine[at] = False
    at = np.flatnonzero(fine)
    return at, ((v[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - 15)).astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    """``table[bucket, language]``: log probabilities; ``floor``: mean log likelihoods below it are of no known language."""

    languages: tuple[str, ...]
    table: np.ndarray
    floor: float

    def means(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihood of each text for each language, and its number of trigrams."""
        if len(offsets) == 2 and len(raw) > 2 * PIECE_BYTES:  # a long text: trigrams lie within words, so its pieces add up
            pieces = segments(np.frombuffer(raw.translate(_NORMAL), np.uint8), PIECE_BYTES, 0, _GAP)
            found = [self.means(p.tobytes(), np.array([0, len(p)])) for p, _, _ in pieces]
            n = sum(k for _, k in found)
            return sum(m * k[:, None] for m, k in found) / np.maximum(n, 1)[:, None], n
        data, offsets = padded(raw, offsets)
        at, bucket = trigrams(data, offsets)
        total = np.zeros((len(at) + 1, len(self.languages)))
        np.cumsum(self.table[bucket], axis=0, out=total[1:])
        bounds = np.searchsorted(at, offsets)
        n = np.diff(bounds)
        return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(n, 1)[:, None], n


def fit_text_model(texts: list[bytes], labels: list[str]) -> TextModel:
    languages = tuple(sorted(set(labels)))
    counts = np.full((BUCKETS, max(1, len(languages))), 0.1)
    for text, label in zip(texts, labels):
        _, bucket = trigrams(*padded(text, np.array([0, len(text)])))
        counts[:, languages.index(label)] += np.bincount(bucket, minlength=BUCKETS)
    model = TextModel(languages, np.log(counts / counts.sum(axis=0)), -np.inf)
    best = [m[0].max() for m, n in (model.means(t, np.array([0, len(t)])) for t in texts) if n[0] >= EFFECTIVE] if languages else []
    return TextModel(languages, model.table, min(best) - MARGIN if best else -np.inf)


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = MAX_ROWS) -> TextModel:
    labelled = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_lang")).filter("_id is not null and _lang is not null").withColumn("_h", F.xxhash64(F.col("_id").cast("string")))
    sizes = {r["_lang"]: r["count"] for r in labelled.groupBy("_lang").count().collect()}
    if not sizes:
        return fit_text_model([], [])
    # Hashes up to a limit hold twice as many rows as wanted and some more, so only they meet in a language's window.
    limits = [(x, min((2 * max_rows + 100) * (1 << 64) // n, (1 << 64) - 1) - (1 << 63)) for x, n in sizes.items()]
    limit = docs.sparkSession.createDataFrame(limits, "_l string, _most long")  # a row for each language
    few = labelled.join(F.broadcast(limit), F.col("_lang") == F.col("_l")).filter("_h <= _most").select("_lang", "_id", "_h").distinct()
    place = Window.partitionBy("_lang").orderBy("_h", "_id")
    picked = few.withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= max_rows).select(F.col("_lang").alias("_l"), "_id")
    # max_rows ids for each language, and of rows that share an id one text.
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(lang).cast("string").alias("_l"), F.col(text).alias("_t")).join(F.broadcast(picked), ["_l", "_id"])
    rows = rows.filter(F.length("_t").isNull() | (F.length("_t") <= MAX_TRAINING_CHARS))
    found = rows.groupBy("_l", "_id").agg(F.min("_t").alias("_t")).orderBy("_l", "_id").collect()
    return fit_text_model([(r["_t"] or "").encode() for r in found], [r["_l"] for r in found])


def visible_text(html: Column) -> Column:
    """Text of a page without scripts, styles, comments, tags and entities. A script, style or comment that is not closed goes on to the end."""
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^<>]*>(?:.*?</\1\s*>|.*)|<!--(?:.*?-->|.*)|<[^<>]*>|&#?[a-z0-9]+;", " ")


def declared_language(html: Column) -> Column:
    """The primary subtag of the page's declared language, lower-cased; null if none."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1))
    return F.when(found != "", found)


def _normal(logs: Column) -> Column:
    """Log weights to probabilities."""

    def scaled(e: Column) -> Column:
        return let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total))

    return let(logs, lambda own: let(F.array_max(own), lambda top: let(F.transform(own, lambda x: F.exp(x - top)), scaled)))


def _smoothed(level: Column, own: Column, parent: Column) -> Column:
    """A level's shares without the row's own, drawn towards those of its parent."""

    def mixed(rest: Column) -> Column:
        return let(F.aggregate(rest, F.lit(0.0), lambda a, b: a + b), lambda n: F.zip_with(rest, parent, lambda s, p: (s + p * F.lit(STRENGTH)) / (n + F.lit(STRENGTH))))

    return let(F.zip_with(level, own, lambda s, o: F.greatest(s - o, F.lit(0.0))), mixed)


def _points_at(language: Column, languages: tuple[str, ...], right: float) -> Column:
    """Log evidence that ``language`` is given: right with probability ``right``; nothing for null or unknown languages."""
    wrong = (1 - right) / max(1, len(languages) - 1)
    known = language.isin(*languages)
    return F.when(known, F.array(*[F.when(language == x, F.lit(float(np.log(right)))).otherwise(F.lit(float(np.log(wrong)))) for x in languages])).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(df: DataFrame, model: TextModel, text: Column | str, levels: list[Column], declared: Column | None = None, suffix: Column | None = None, keep: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The ``keep`` columns of ``df``, ``language, confidence, text_language, declared, prior`` (the host prior of ``language``).

    ``levels`` go from coarse to fine; the whole table stands above the first. A null level value is a value of its own.
    ``text`` is a column, or the name of one of the ``keep`` columns, which then travels once."""
    languages, keep = model.languages, df.columns if keep is None else keep
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(1))
    held = isinstance(text, str) and text in keep
    text_column = F.col(f"`{text}`") if isinstance(text, str) else text
    none = F.lit(None).cast("string")
    names = [f"_level{i}" for i in range(len(levels))]
    rows = df.select(kept.alias("_kept"), *([] if held else [text_column.alias("_text")]), (none if declared is None else declared).alias("_declared"), (none if suffix is None else suffix).alias("_suffix"), *[x.cast("string").alias(n) for x, n in zip(levels, names)])
    if not languages:
        return rows.select(*[F.col("_kept").getField(c).alias(c) for c in keep], F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("confidence"), none.alias("text_language"), F.col("_declared").alias("declared"), F.lit(None).cast("double").alias("prior"))
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def read_texts(rows: DataFrame, text_of) -> DataFrame:
        others = [f for f in rows.schema.fields if f.name != "_text"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                offsets, data = utf8(text_of(batch))
                for lo, hi in chunks(offsets, PIECE_BYTES):
                    means, n = shared.value.means(data[offsets[lo] : offsets[hi]].tobytes(), offsets[lo : hi + 1] - offsets[lo])
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * means.shape[1], pa.int32()), pa.array(means.ravel()))
                    yield pa.RecordBatch.from_arrays([*[batch.column(f.name)[lo:hi] for f in others], flat, pa.array(n, pa.int64())], [*[f.name for f in others], "_means", "_n"])

        schema = wider(T.StructType(others), _means="array<double>", _n="long")
        weight = F.least(F.col("_n").cast("double"), F.lit(EFFECTIVE))
        logs = _plus(F.transform("_means", lambda m: m * weight), _plus(_points_at(F.col("_declared"), languages, DECLARED_RIGHT), _points_at(F.col("_suffix"), languages, SUFFIX_RIGHT)))
        return rows.mapInArrow(run, schema).withColumn("_logs", logs).withColumn("_own", _normal(F.col("_logs")))

    def given(batch: pa.RecordBatch) -> pa.Array:
        return batch.column("_text")

    read = read_texts(rows, (lambda batch: batch.column("_kept").field(text)) if held else given)
    # The kept columns stay behind where only sums are wanted.
    summed = read_texts(df.select(text_column.alias("_text"), *[x.alias(c) for x, c in ((none if declared is None else declared, "_declared"), (none if suffix is None else suffix, "_suffix"))], *[x.cast("string").alias(n) for x, n in zip(levels, names)]), given)
    sums = summed.groupBy(*names).agg(*[F.sum(F.element_at("_own", i + 1)).alias(f"s{i}") for i in range(len(languages))])
    # Written, as every level, the count and the join read it: the texts are not read again for each.
    sums, _ = materialize(sums.select(*names, F.array(*[f"s{i}" for i in range(len(languages))]).alias("_sum")), "sums")
    table = sums
    for depth in range(len(names)):  # the sums of each coarser level, from those of the finest
        up = names[:depth]
        each = sums.groupBy(*up).agg(*[F.sum(F.element_at("_sum", i + 1)).alias(f"s{i}") for i in range(len(languages))])
        each = each.select(*[F.col(u).alias(f"k{i}") for i, u in enumerate(up)], F.array(*[f"s{i}" for i in range(len(languages))]).alias(f"_sum{depth}"))
        if up:
            on = [F.col(u).eqNullSafe(F.col(f"k{i}")) for i, u in enumerate(up)]
            table = table.join(each, on).drop(*[f"k{i}" for i in range(len(up))])
        else:
            total = each.first()
            table = table.withColumn("_sum0", F.array(*[F.lit(float(x or 0.0)) for x in total[0]]))
    table = table.withColumnRenamed("_sum", f"_sum{len(names)}")
    if not names:
        total = sums.first()
        table, prior_of = None, [F.array(*[F.lit(float(x or 0.0)) for x in total[-1]])]
    else:
        prior_of = [F.col(f"_sum{i}") for i in range(len(names) + 1)]
        table = table.select(*[F.col(n).alias(f"_t{n}") for n in names], *[f"_sum{i}" for i in range(len(names) + 1)])
        if table.count() <= BROADCAST_LEVELS:
            table = F.broadcast(table)
        read = read.join(table, [F.col(n).eqNullSafe(F.col(f"_t{n}")) for n in names])
    prior = F.array(*[F.lit(1.0 / len(languages))] * len(languages))
    for level in prior_of:
        prior = _smoothed(level, F.col("_own"), prior)
    out = read.withColumn("_prior", prior).withColumn("_post", _normal(_plus(F.col("_logs"), F.transform("_prior", lambda p: F.log(p)))))

    def best(column: str) -> Column:
        return F.array_position(column, F.array_max(column)).cast("int")

    names_array = F.array(*[F.lit(x) for x in languages])
    confidence = F.array_max("_post")
    evidence = (F.col("_n") > 0) | F.coalesce(F.col("_declared").isin(*languages), F.lit(False)) | F.coalesce(F.col("_suffix").isin(*languages), F.lit(False))
    foreign = (F.col("_n") >= EFFECTIVE) & (F.array_max("_means") < model.floor)
    language = F.when(evidence & ~foreign & (confidence >= min_confidence), F.element_at(names_array, best("_post"))).otherwise(UNKNOWN)
    text_language = F.when(F.col("_n") > 0, F.element_at(names_array, best("_means")))
    return out.select(*[F.col("_kept").getField(c).alias(c) for c in keep], language.alias("language"), confidence.alias("confidence"), text_language.alias("text_language"), F.col("_declared").alias("declared"), F.element_at("_prior", best("_post")).alias("prior"))


def identify_pages(pages: DataFrame, model: TextModel, url: str = "url", html: str = "html", keep: tuple[str, ...] = ("page_id",), min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Languages of web pages, from text, declared language, address suffix and host."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*://([^/?#:]*)", 1))
    labels = F.split(host, r"\.")
    suffix = F.element_at(labels, -1)
    depth = F.when((F.length(suffix) == 2) & F.try_element_at(labels, F.lit(-2)).isin(*SECOND_LEVEL), 3).otherwise(2)
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - depth + 1, F.lit(1)), depth), ".")
    pairs = [F.lit(x) for pair in SUFFIXES.items() for x in pair]
    return identify(pages, model, visible_text(F.col(html)), [suffix, domain, host], declared_language(F.col(html)), F.try_element_at(F.create_map(*pairs), suffix), list(keep), min_confidence)


def keep_known_languages(docs: DataFrame, model: TextModel, text: str = "text", source: str = "source", min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """``docs`` without those whose language is ``und``; the source stands for the host."""
    out = identify(docs, model, text, [F.col(source)], min_confidence=min_confidence)
    names = [f"c{i}" for i in range(len(docs.columns))]
    return out.toDF(*names, "language", "confidence", "text_language", "declared", "prior").filter(F.col("language") != UNKNOWN).select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)])

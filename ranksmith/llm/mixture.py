"""Mixing sources to target weights by Poisson replication.

A source ``s`` with ``n_s`` of all ``n`` documents and target weight ``w_s`` gets the mean repetition rate
``rate_s = w_s * n / n_s``, so the expected mixture has the size of the input and the target shares. Each
document draws its number of copies from a Poisson distribution with that mean by inverting it at a uniform number
hashed from its id and the seed. A mean above ``MAX_RATE`` is split into equal parts, each with a uniform number of
its own: the sum of independent Poisson draws is a Poisson draw with the sum of their means. Copies get a hashed place in a global shuffle. Everything depends on the id and the
seed alone: neither partitioning nor a lost executor changes a draw.

Targets: a mapping of sources to weights (sources left out get none), or the tempered shares ``n_s ** temperature``.
Counts cover all documents. The table of sources has a row for each source; the join with it is broadcast only
if it has at most ``BROADCAST_SOURCES`` rows, else it is a shuffled join that adaptive execution splits for hot sources.

Defined results: a null source is a source of its own (weight from the targets' ``None``); a null id hashes as the
empty text; rows of equal ids draw alike; empty tables give empty mixtures. Texts are never cut. Columns may have
any names but the added ``copy`` and ``shuffle_key`` take the place of such columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_SOURCES = 10_000
TEMPERATURE = 0.5
SEED = 17
#: The largest mean that one inversion tabulates: ``exp`` of its negative is far from the end of the doubles.
MAX_RATE = 700.0


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of the key and the seed."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source: str = "source", targets: Mapping | None = None, temperature: float = TEMPERATURE) -> DataFrame:
    """``source, n_docs, weight, rate`` of every source of ``docs``."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    if targets is None:
        counts = counts.withColumn("raw", F.pow(F.col("n_docs").cast("double"), F.lit(float(temperature))))
    else:
        if any(not w >= 0 for w in targets.values()) or not sum(targets.values()) > 0:
            raise ValueError("weights must be non-negative and not all zero")
        rows = [(k, float(w)) for k, w in targets.items()]
        given = docs.sparkSession.createDataFrame(rows, "s string, raw double")
        counts = counts.join(given, counts["source"].cast("string").eqNullSafe(given["s"]), "left").select("source", "n_docs", F.coalesce("raw", F.lit(0.0)).alias("raw"))
    total = counts.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("raw"), F.lit(0.0))).first()
    weight = F.col("raw") / F.lit(float(total[1])) if total[1] > 0 else F.lit(0.0)
    return counts.select("source", "n_docs", weight.alias("weight"), (weight * F.lit(float(total[0])) / F.col("n_docs")).alias("rate"))


def steps(rate: Column) -> Column:
    """Cumulative Poisson probabilities of 0, 1, 2, ... copies, far enough that the rest is below 2**-52."""
    most = F.ceil(rate + F.sqrt(rate) * F.lit(10.0) + F.lit(16.0)).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def add(s: Column, k: Column) -> Column:
        p = s["p"] * rate / k
        return F.struct(p.alias("p"), (s["c"] + p).alias("c"), F.concat(s["all"], F.array(s["c"] + p)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), most), start, add, lambda s: s["all"])


def draw(key: Column, table: Column, parts: Column, seed: int) -> Column:
    """The number of copies: of each part's steps, those up to its uniform number; the first part has the one of the key alone."""

    def part(u: Column) -> Column:
        return F.size(F.filter(table, lambda c: c <= u)).cast("long")

    def further(k: Column) -> Column:
        return part(uniform(F.concat_ws("|", F.lit("part"), k.cast("string"), F.coalesce(key.cast("string"), F.lit(""))), seed))

    rest = F.aggregate(F.sequence(F.lit(1).cast("long"), parts - 1), F.lit(0).cast("long"), lambda n, k: n + further(k))
    return part(F.col("_u")) + F.when(parts > 1, rest).otherwise(0)


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", targets: Mapping | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated by its draw: its columns, ``copy`` (from 0) and ``shuffle_key``, dealt out and sorted by the latter."""
    table = rates(docs, source, targets, temperature)
    size = table.count()
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(MAX_RATE))).cast("long")
    table = table.select(F.col("source").alias("_source"), "rate", parts.alias("_parts")).select("_source", "_parts", steps(F.col("rate") / F.col("_parts")).alias("_steps"))
    if size <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    names = [c for c in docs.columns if c not in ("copy", "shuffle_key")]
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_s"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"))
    u = uniform(F.col("_id"), seed)
    copies = draw(F.col("_id"), F.col("_steps"), F.col("_parts"), seed).cast("int")
    drawn = rows.withColumn("_u", u).join(table, F.col("_s").eqNullSafe(F.col("_source"))).withColumn("_copies", copies).filter("_copies > 0")
    out = drawn.select("_id", "_doc", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy"))
    place = F.md5(F.concat_ws("|", F.lit(f"{seed}-place"), F.coalesce(F.col("_id").cast("string"), F.lit("")), "copy"))
    out = out.select(*[F.col(f"_doc.`{c}`").alias(c) for c in names], "copy", place.alias("shuffle_key"))
    return out.repartition("shuffle_key").sortWithinPartitions("shuffle_key", "copy")

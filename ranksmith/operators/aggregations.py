"""Aggregations over the documents that a hybrid query matches (before the result is cut): metrics, buckets, pipelines.

Each takes the matched rows (source columns joined to ``doc_id, score``) and returns a small table. Bucket aggregations
that nest metrics take them as named aggregate columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matched(source: DataFrame, lists: Sequence[DataFrame], doc_id: str = "doc_id") -> DataFrame:
    """Rows of ``source`` that any sub-query matches, with the best raw score."""
    rows = None
    for scored in lists:
        part = scored.select("doc_id", "score")
        rows = part if rows is None else rows.unionByName(part)
    best = rows.filter("score > 0").groupBy("doc_id").agg(F.max("score").alias("score"))
    return source.join(best.withColumnRenamed("doc_id", "_id"), F.col(doc_id) == F.col("_id")).drop("_id")


def metrics(rows: DataFrame, column: str) -> DataFrame:
    """avg, sum, min, max and value_count of a column."""
    return rows.agg(F.avg(column).alias("avg"), F.sum(column).alias("sum"), F.min(column).alias("min"), F.max(column).alias("max"), F.count(column).alias("value_count"))


def cardinality(rows: DataFrame, column: str, exact: bool = True) -> DataFrame:
    return rows.agg((F.count_distinct(column) if exact else F.approx_count_distinct(column)).alias("cardinality"))


def extended_stats(rows: DataFrame, column: str, sigma: float = 2.0) -> DataFrame:
    x = F.col(column).cast("double")
    out = rows.agg(F.count(x).alias("count"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.sum(x).alias("sum"), F.sum(x * x).alias("sum_of_squares"), F.var_pop(x).alias("variance"), F.stddev_pop(x).alias("std_deviation"))
    return out.withColumns({"upper_bound": F.col("avg") + sigma * F.col("std_deviation"), "lower_bound": F.col("avg") - sigma * F.col("std_deviation")})


def top_hits(rows: DataFrame, bucket: str, size: int, doc_id: str = "doc_id") -> DataFrame:
    order = Window.partitionBy(bucket).orderBy(F.desc("score"), doc_id)
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size).select(bucket, "place", doc_id, "score")


def scripted(rows: DataFrame, map_: Column, combine=F.sum) -> DataFrame:
    """A value mapped from each row and combined over all of them."""
    return rows.agg(combine(map_).alias("value"))


CELLS, LEVELS = 4096, 2


def percentiles(rows: DataFrame, column: str, percents: Sequence[float]) -> DataFrame:
    """Exact percentiles, linearly interpolated, one row for each.

    No task holds all values: they are counted by value, then each wanted place narrows to one of ``CELLS`` equal cells between
    the least and the largest value, ``LEVELS`` times, by tables of one row for each cell. Only values of the last cells are
    put in order."""
    spark = rows.sparkSession
    x = F.col(column).cast("double")
    counts = rows.filter(x.isNotNull()).groupBy(x.alias("x")).agg(F.count("*").alias("n"))
    whole = counts.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.sum("n").alias("total"))  # one row
    wanted = spark.createDataFrame([(i, float(p), side) for i, p in enumerate(percents) for side in (0, 1)], "i int, percent double, side int")
    at = (F.col("total") - 1) * (F.col("percent") / 100.0)
    rank = F.when(F.col("side") == 0, F.floor(at)).otherwise(F.ceil(at))
    # A place: its rank (from 0) among all, the cell that holds it and the number of values before that cell.
    places = wanted.join(F.broadcast(whole), how="left").select("i", "side", "percent", at.alias("at"), rank.alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("before"))

    def values(p: DataFrame, *kept: str) -> DataFrame:
        cells = p.select("lo", "hi", "before", *kept).distinct()  # two for each percent at most
        return counts.join(F.broadcast(cells), (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))

    for _ in range(LEVELS):
        # Halves, as the width of a cell may be beyond the largest double; monotone in x, so cells are in order.
        share = (F.col("x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cell = F.when(F.col("hi") > F.col("lo"), F.coalesce(F.least(F.floor(share * CELLS), F.lit(CELLS)), F.lit(0))).otherwise(0)
        cells = values(places).groupBy("lo", "hi", "before", cell.alias("cell")).agg(F.min("x").alias("lo2"), F.max("x").alias("hi2"), F.sum("n").alias("n"))
        run = Window.partitionBy("lo", "hi", "before").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)  # CELLS + 1 rows at most
        cells = cells.withColumn("end", F.col("before") + F.sum("n").over(run)).select("lo", "hi", "before", "lo2", "hi2", "n", "end")
        found = F.broadcast(places).join(cells, ["lo", "hi", "before"]).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
        places = found.select("i", "side", "percent", "at", "rank", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("end") - F.col("n")).alias("before"))
    run = Window.partitionBy("lo", "hi", "before").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ends = values(places).withColumn("end", F.col("before") + F.sum("n").over(run))
    found = F.broadcast(places).join(ends, ["lo", "hi", "before"]).filter((F.col("rank") < F.col("end")) & (F.col("rank") >= F.col("end") - F.col("n")))
    both = found.groupBy("i").agg(F.max(F.when(F.col("side") == 0, F.col("x"))).alias("low"), F.max(F.when(F.col("side") == 1, F.col("x"))).alias("high"), F.max("at").alias("at"))
    part = F.col("at") - F.floor("at")
    value = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((1 - part) * F.col("low") + part * F.col("high"))
    order = wanted.filter("side = 0").select("i", "percent")
    return order.join(both, "i", "left").select("percent", value.alias("value"))


def percentile_ranks(rows: DataFrame, column: str, values: Sequence[float]) -> DataFrame:
    """The percentage of rows at or below each value."""
    x = F.col(column).cast("double")
    all_of_them = rows.agg(*[(F.avg(F.when(x.isNotNull(), (x <= v).cast("double"))) * 100).alias(f"v{i}") for i, v in enumerate(values)])
    return all_of_them.select(F.inline(F.array(*[F.struct(F.lit(float(v)).alias("value"), F.col(f"v{i}").alias("percent")) for i, v in enumerate(values)])))


def filters(rows: DataFrame, named: Mapping[str, Column], **sub: Column) -> DataFrame:
    """A bucket for each named condition with its count and sub-aggregations (over a column of matching rows only)."""
    out = rows.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]), lambda x: x.isNotNull())).alias("bucket"), "*")
    return _buckets(out.groupBy("bucket"), sub)


def _buckets(grouped, sub: Mapping[str, Column]) -> DataFrame:
    return grouped.agg(F.count("*").alias("doc_count"), *[c.alias(n) for n, c in sub.items()])


def histogram(rows: DataFrame, column: str, interval: float, **sub: Column) -> DataFrame:
    if interval <= 0:
        raise ValueError("the interval must be positive")
    key = F.floor(F.col(column).cast("double") / interval).cast("double") * interval
    return _buckets(rows.filter(F.col(column).isNotNull()).groupBy(key.alias("bucket")), sub)


def date_histogram(rows: DataFrame, column: str, calendar_interval: str, **sub: Column) -> DataFrame:
    return _buckets(rows.filter(F.col(column).isNotNull()).groupBy(F.date_trunc(calendar_interval, column).cast("date").alias("bucket")), sub)


def terms(rows: DataFrame, column: str, size: int = 10, **sub: Column) -> DataFrame:
    """The most frequent values, ties by value."""
    return _buckets(rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("bucket")), sub).orderBy(F.desc("doc_count"), "bucket").limit(size)


def nested(rows: DataFrame, children: Column, key: Column, **sub: Column) -> DataFrame:
    """Children exploded out of their parents, bucketed by a key of the child ``child``."""
    return _buckets(rows.select("*", F.explode(children).alias("child")).groupBy(key.alias("bucket")), sub)


def sampler(rows: DataFrame, shard_size: int, by: str | None = None, max_per_value: int = 1, doc_id: str = "doc_id") -> DataFrame:
    """The best rows by score; diversified, at most ``max_per_value`` for each value of ``by``."""
    if by is not None:
        order = Window.partitionBy(by).orderBy(F.desc("score"), doc_id)
        rows = rows.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= max_per_value).drop("_place")
    return rows.orderBy(F.desc("score"), doc_id).limit(shard_size)


def adjacency_matrix(rows: DataFrame, named: Mapping[str, Column]) -> DataFrame:
    """Counts of each named condition and of each pair of them, empty ones left out."""
    names = sorted(named)
    cells = [(n, named[n]) for n in names] + [(f"{a}&{b}", named[a] & named[b]) for i, a in enumerate(names) for b in names[i + 1 :]]
    counts = rows.agg(*[F.count_if(c).alias(f"c{i}") for i, (_, c) in enumerate(cells)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"c{i}").alias("doc_count")) for i, (n, _) in enumerate(cells)]))).filter("doc_count > 0")


def significant_terms(rows: DataFrame, background: DataFrame, column: str, size: int = 10) -> DataFrame:
    """Values more frequent among the matched rows than in the background, by their absolute times their relative gain."""
    fg = rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("doc_count"))
    bg = background.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("bucket")).agg(F.count("*").alias("bg_count"))
    totals = rows.agg(F.count("*").alias("fg_total")).join(background.agg(F.count("*").alias("bg_total")))  # one row each
    share, base = F.col("doc_count") / F.col("fg_total"), F.col("bg_count") / F.col("bg_total")
    scored = fg.join(bg, "bucket").join(F.broadcast(totals)).withColumn("score", F.round((share - base) * (share / base), 6)).filter("score > 0")
    return scored.select("bucket", "doc_count", "bg_count", "score").orderBy(F.desc("score"), "bucket").limit(size)


def sibling(buckets: DataFrame, column: str) -> DataFrame:
    """min, max, sum, avg and count of a column over buckets."""
    return buckets.agg(F.min(column).alias("min"), F.max(column).alias("max"), F.sum(column).alias("sum"), F.avg(column).alias("avg"), F.count(column).alias("count"))


def bucket_script(buckets: DataFrame, name: str, script: Column) -> DataFrame:
    return buckets.withColumn(name, script)


def bucket_sort(buckets: DataFrame, column: str, descending: bool = True, size: int | None = None, from_: int = 0) -> DataFrame:
    out = buckets.orderBy(F.desc(column) if descending else F.asc(column), "bucket")
    out = out.offset(from_) if from_ else out
    return out if size is None else out.limit(size)


def cumulative_sum(buckets: DataFrame, column: str) -> DataFrame:
    """Running sums over buckets in order; the input is a table of buckets, not of rows."""
    return buckets.withColumn("cumulative_sum", F.sum(column).over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))

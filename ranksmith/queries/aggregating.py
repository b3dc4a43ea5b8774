"""Aggregations over the orders that a hybrid query matches: fulfilled ones, or those of a high price."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranksmith.operators import aggregations as A
from ranksmith.operators import retrieval
from ranksmith.queries.registry import Registry, Tables

R = Registry()
PRICE = 200000


def matched(t: Tables) -> DataFrame:
    parts = [retrieval.constant(t.orders, F.col("o_orderstatus") == "F", 1.0, "o_orderkey"), retrieval.constant(t.orders, F.col("o_totalprice") >= PRICE, 2.0, "o_orderkey")]
    return A.matched(t.orders, parts, "o_orderkey")


M = f"""with m as (select *, (case when o_totalprice >= {PRICE} then 2.0 else 1.0 end)::double as score from orders where o_orderstatus = 'F' or o_totalprice >= {PRICE})"""
_CENTS = "round(sum(o_totalprice), 2)"


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


R.add("agg_metrics", lambda t: _rounded(A.metrics(matched(t), "o_totalprice"), avg=4, sum=2), f"{M} select round(avg(o_totalprice), 4) as avg, {_CENTS} as sum, min(o_totalprice) as min, max(o_totalprice) as max, count(o_totalprice) as value_count from m")
R.add("agg_cardinality", lambda t: A.cardinality(matched(t), "o_custkey"), f"{M} select count(distinct o_custkey) as cardinality from m")
R.add(
    "agg_extended_stats",
    lambda t: _rounded(A.extended_stats(matched(t), "o_totalprice"), avg=3, sum=2, sum_of_squares=-4, variance=-2, std_deviation=3, upper_bound=3, lower_bound=3),
    f"""{M} select count(o_totalprice) as count, min(o_totalprice) as min, max(o_totalprice) as max, round(avg(o_totalprice), 3) as avg, {_CENTS} as sum, round(sum(o_totalprice * o_totalprice), -4) as sum_of_squares,
round(var_pop(o_totalprice), -2) as variance, round(stddev_pop(o_totalprice), 3) as std_deviation, round(avg(o_totalprice) + 2 * stddev_pop(o_totalprice), 3) as upper_bound, round(avg(o_totalprice) - 2 * stddev_pop(o_totalprice), 3) as lower_bound from m""",
)
R.add("agg_top_hits", lambda t: A.top_hits(matched(t), "o_orderpriority", 3, "o_orderkey"), f"{M} select o_orderpriority, row_number() over (partition by o_orderpriority order by score desc, o_orderkey)::int as place, o_orderkey, score from m qualify place <= 3")
R.add("agg_scripted", lambda t: A.scripted(matched(t), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1)), f"{M} select sum(case when o_orderstatus = 'F' then 1 else -1 end)::bigint as value from m")
R.add(
    "agg_percentiles",
    lambda t: _rounded(A.percentiles(matched(t), "o_totalprice", (1, 25, 50, 75, 99)), value=4),
    f"{M} select p::double as percent, round(v, 4) as value from (select unnest([1, 25, 50, 75, 99]) as p, unnest(quantile_cont(o_totalprice, [0.01, 0.25, 0.5, 0.75, 0.99])) as v from m)",
)
R.add(
    "agg_percentile_ranks",
    lambda t: _rounded(A.percentile_ranks(matched(t), "o_totalprice", (100000, 300000)), percent=6),
    f"{M} select v::double as value, round(avg((o_totalprice <= v)::int::double) * 100, 6) as percent from m, (values (100000), (300000)) x(v) group by v",
)
R.add("agg_post_filter", lambda t: _rounded(A.metrics(matched(t), "o_totalprice"), avg=4, sum=2).join(matched(t).filter(F.col("o_totalprice") < 50000).agg(F.count("*").alias("hits"))), f"{M} select round(avg(o_totalprice), 4) as avg, {_CENTS} as sum, min(o_totalprice) as min, max(o_totalprice) as max, count(o_totalprice) as value_count, count(*) filter (o_totalprice < 50000) as hits from m")
_CONDITIONS = {"urgent": "o_orderpriority = '1-URGENT'", "cheap": "o_totalprice < 100000", "even": "o_custkey % 2 = 0"}


def _named() -> dict:
    return {k: F.expr(v) for k, v in _CONDITIONS.items()}


R.add(
    "agg_filters",
    lambda t: _rounded(A.filters(matched(t), _named(), price=F.avg("o_totalprice")), price=4),
    M + " " + " union all ".join(f"select '{k}' as bucket, count(*) as doc_count, round(avg(o_totalprice), 4) as price from m where {v}" for k, v in _CONDITIONS.items()),
)
R.add("agg_global", lambda t: _rounded(A.metrics(t.orders, "o_totalprice"), avg=4, sum=2), f"select round(avg(o_totalprice), 4) as avg, {_CENTS} as sum, min(o_totalprice) as min, max(o_totalprice) as max, count(o_totalprice) as value_count from orders")
R.add(
    "agg_histogram",
    lambda t: _rounded(A.histogram(matched(t), "o_totalprice", 50000, price=F.sum("o_totalprice")), price=2),
    f"{M} select floor(o_totalprice / 50000) * 50000 as bucket, count(*) as doc_count, {_CENTS} as price from m group by 1",
)


def _nested(t: Tables) -> DataFrame:
    lines = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("qty"))).alias("lines"))
    rows = matched(t).join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    return A.nested(rows, F.col("lines"), F.col("child.flag"), qty=F.sum("child.qty"))


R.add("agg_nested", _nested, f"{M} select l_returnflag as bucket, count(*) as doc_count, sum(l_quantity) as qty from m join lineitem on l_orderkey = o_orderkey group by 1")
R.add("agg_sampler", lambda t: _rounded(A.metrics(A.sampler(matched(t), 200, doc_id="o_orderkey"), "o_totalprice"), avg=4, sum=2), f"{M}, s as (select * from m order by score desc, o_orderkey limit 200) select round(avg(o_totalprice), 4) as avg, {_CENTS} as sum, min(o_totalprice) as min, max(o_totalprice) as max, count(o_totalprice) as value_count from s")
R.add(
    "agg_div_sampler",
    lambda t: A.sampler(matched(t), 50, "o_custkey", 1, "o_orderkey").select("o_orderkey", "o_custkey", "score"),
    f"{M}, d as (select * from m qualify row_number() over (partition by o_custkey order by score desc, o_orderkey) = 1) select o_orderkey, o_custkey, score from d order by score desc, o_orderkey limit 50",
)
R.add(
    "agg_adjacency",
    lambda t: A.adjacency_matrix(matched(t), _named()),
    M
    + " select * from ("
    + " union all ".join([f"select '{k}' as bucket, count(*) filter ({v}) as doc_count from m" for k, v in _CONDITIONS.items()] + [f"select '{a}&{b}', count(*) filter ({_CONDITIONS[a]} and {_CONDITIONS[b]}) from m" for a, b in (("cheap", "even"), ("cheap", "urgent"), ("even", "urgent"))])
    + ") where doc_count > 0",
)
R.add("agg_terms", lambda t: _rounded(A.terms(matched(t), "o_custkey", 15, price=F.max("o_totalprice")), price=2), f"{M} select o_custkey as bucket, count(*) as doc_count, round(max(o_totalprice), 2) as price from m group by 1 order by doc_count desc, bucket limit 15")
R.add(
    "agg_significant_terms",
    lambda t: A.significant_terms(matched(t), t.orders, "o_orderstatus", 5),
    f"""{M}, x as (select o_orderstatus as bucket, count(*) as doc_count from m group by 1), y as (select o_orderstatus as bucket, count(*) as bg_count from orders group by 1),
z as (select bucket, doc_count, bg_count, doc_count::double / (select count(*) from m) as s, bg_count::double / (select count(*) from orders) as b from x join y using (bucket))
select bucket, doc_count, bg_count, round((s - b) * (s / b), 6) as score from z where round((s - b) * (s / b), 6) > 0 order by score desc, bucket limit 5""",
)


def _years(t: Tables) -> DataFrame:
    return A.date_histogram(matched(t), "o_orderdate", "year", price=F.round(F.sum("o_totalprice"), 2))


_YEARS = f"{M}, y as (select date_trunc('year', o_orderdate)::date as bucket, count(*) as doc_count, {_CENTS} as price from m group by 1)"
R.add("agg_date_histogram", _years, f"{_YEARS} select * from y")
R.add("agg_sibling", lambda t: _rounded(A.sibling(_years(t), "price"), sum=2, avg=2), f"{_YEARS} select min(price) as min, max(price) as max, round(sum(price), 2) as sum, round(avg(price), 2) as avg, count(price) as count from y")
R.add("agg_stats_bucket", lambda t: _rounded(A.sibling(_years(t), "doc_count"), avg=4), f"{_YEARS} select min(doc_count) as min, max(doc_count) as max, sum(doc_count)::bigint as sum, round(avg(doc_count), 4) as avg, count(doc_count) as count from y")
R.add("agg_bucket_script", lambda t: A.bucket_script(_years(t), "mean", F.round(F.col("price") / F.col("doc_count"), 4)), f"{_YEARS} select *, round(price / doc_count, 4) as mean from y")
R.add("agg_bucket_sort", lambda t: A.bucket_sort(_years(t), "price", size=3, from_=1), f"{_YEARS} select * from y order by price desc, bucket limit 3 offset 1")
R.add("agg_cumulative_sum", lambda t: A.cumulative_sum(_years(t), "doc_count"), f"{_YEARS} select *, sum(doc_count) over (order by bucket)::bigint as cumulative_sum from y")

QUERIES, ORACLE_SQL = R.queries, R.sql

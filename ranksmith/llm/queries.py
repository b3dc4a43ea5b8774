"""The registered queries of the training-data operators: thin callables over ``sf_dir``, and SQL twins where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.embedding_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.decontaminate import digests

    return digests(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.language_id import identify_pages, train

    return identify_pages(_table(spark, sf_dir, "pages"), train(_table(spark, sf_dir, "documents")))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.simhash_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.chat_format import repair

    return repair(_table(spark, sf_dir, "conversations"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.substring_dedup import digests

    return digests(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.token_counts import count_lines

    return count_lines(_table(spark, sf_dir, "documents"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.mixture import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


OP9_SQL = """
with recursive counts as (select source, count(*) as n_docs from documents group by source),
total as (select sum(n_docs) as all_docs, sum(pow(n_docs::double, 0.5)) as all_raw from counts),
rates as (select source, pow(n_docs::double, 0.5) / all_raw * all_docs / n_docs as rate from counts, total),
steps(source, rate, k, p, c) as (
  select source, rate, 0, exp(-rate), exp(-rate) from rates
  union all
  select source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) from steps where k < ceil(rate + sqrt(rate) * 10 + 16)
),
drawn as (
  select d.doc_id, count(s.k) as copies
  from (select doc_id, source, ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0::double as u from documents) d
  join steps s on s.source is not distinct from d.source and s.c <= d.u
  group by d.doc_id
)
select d.*, r.copy::int as copy, md5('17-place|' || coalesce(d.doc_id::varchar, '') || '|' || r.copy) as shuffle_key
from documents d join drawn using (doc_id), lateral (select unnest(range(copies)) as copy) r
"""


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ranksmith.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


OP10_SQL = """
with parts as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
), urls as (
  select page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path
  from parts
), rules(verdict, h, p) as (
  values ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), numbered as (select *, row_number() over () as n from urls),
ranked as (
  select u.*, r.h || r.p as rule, r.verdict,
    row_number() over (partition by n order by length(r.h) + length(r.p) desc nulls last, length(r.h) desc, r.verdict) as place
  from numbered u left join rules r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)
)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from ranked where place = 1
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_toxicity, op2_embedding_dedup, op3_decontamination, op4_language_id, op5_simhash_dedup, op6_chat_format, op7_substring_dedup, op8_token_counts, op9_mixture, op10_url_filter)}
ORACLE_SQL: dict[str, str] = {"op9_mixture": OP9_SQL, "op10_url_filter": OP10_SQL}

"""URL allow and block rules by a sort-merge range join, in DataFrame operations only.

A rule is a host and a path prefix. It fits its host and all subdomains if the url's path starts with its path.
The canonical key of a (host, path) pair is the host's labels reversed, each followed by a byte that sorts below
all others in use, then the path; a url has one key for each suffix of its host that is some rule's host. In key
order a rule is the interval of keys that start with its own key, and such intervals nest or are disjoint.

Rules and the distinct keys are range-partitioned together and written with their partition number. Each rule
row carries the stack of rules that are open once it starts (itself and those that enclose it); a sorted sweep
hands the latest stack to every key, from the partitions before it where its own has none, and the longest entry
that the key starts with is the innermost rule still open. Equal keys meet before the sweep and the verdicts join
back on (host, path), a plain shuffled join that adaptive execution splits for hot hosts.

Of the rules that fit a url the one with the longest host and path together wins; of equal lengths the longer host,
then ``allow``. A rule given with both verdicts counts as ``allow``.

Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased (a port or user name stays in it).
Path: from there up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path; no rule
fits an empty host. Null ids, repeated rows and columns of any name are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ranksmith.llm.storage import materialize

DEFAULT = "allow"
#: Ends each label in a key: sorts below every byte that a host or path can hold.
END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"


#: Rules of the registered query.
RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_after(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))


def _labels(host: Column) -> Column:
    """A key's host part: reversed labels, each ended."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), END), F.lit(END))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    """``host, path, verdict`` from Rule tuples or from a DataFrame with these columns."""
    if isinstance(rules, DataFrame):
        df = rules.select("host", "path", "verdict")
    else:
        df = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    df = df.filter("host <> '' and path is not null and verdict in ('allow', 'block')").withColumn("host", F.translate("host", _UPPER, _LOWER))
    return df.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, verdict`` for those of the distinct pairs ``urls(host, path)`` that some rule fits."""
    spark = urls.sparkSession
    entry = F.struct(F.concat(_labels(F.col("host")), "path").alias("key"), "host", "path", "verdict")
    rules = rules.select("host", entry.alias("entry"), F.concat(_labels(F.col("host")), "path").alias("key"))
    # Enclosing rules: one whose host is a suffix of this one's host, and whose key is a prefix of this one's key.
    # Within one host, a rule's path prefixes are enumerated, so this is an equi-join and no rule meets all others.
    outer = rules.select(F.col("key").alias("k"), F.col("entry").alias("outer"))
    prefixes = rules.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("k"))
    stacks = prefixes.join(outer, "k").groupBy("key").agg(F.array_sort(F.collect_list("outer")).alias("stack"))

    suffixes = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda n: F.array_join(F.slice("labels", n, F.size("labels")), "."))
    keys = urls.filter("host <> ''").select("host", "path", F.split("host", r"\.").alias("labels")).select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix"))
    keys = keys.join(rules.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi").select("host", "path", F.concat(_labels(F.col("suffix")), "path").alias("key"))
    none = F.lit(None).cast(stacks.schema["stack"].dataType)
    events = stacks.select("key", "stack").unionByName(keys.select("key").distinct().select("key", none.alias("stack")))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events, _ = materialize(events.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "events")

    last = events.filter("stack is not null").groupBy("part").agg(F.max_by("stack", "key").alias("last"))
    parts = events.groupBy("part").count().select("part").join(last, "part", "left")  # at most n rows
    carried = parts.select("part", F.last("last", True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("part").orderBy("key", F.col("stack").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.join(carried, "part").select("key", F.col("stack").isNull().alias("is_key"), F.coalesce(F.last("stack", True).over(sweep), "carried").alias("stack")).filter("is_key and stack is not null")
    open_now = F.filter("stack", lambda e: F.startswith(F.col("key"), e["key"]))
    winners = swept.select("key", F.try_element_at(open_now, F.lit(-1)).alias("won")).filter("won is not null")
    rank = F.struct((F.length("won.host") + F.length("won.path")).alias("n"), F.length("won.host").alias("h"), F.struct((F.col("won.verdict") == "allow").alias("a"), F.concat("won.host", "won.path").alias("rule"), F.col("won.verdict").alias("verdict")).alias("won"))
    best = keys.join(winners, "key").groupBy("host", "path").agg(F.max(rank).alias("best"))
    return best.select("host", "path", F.col("best.won.rule").alias("rule"), F.col("best.won.verdict").alias("verdict"))


def filter_urls(pages: DataFrame, url: str = "url", rules=RULES, default: str = DEFAULT, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per row of ``pages``: the ``keep`` columns, ``host, path, rule`` (null if none fits) and ``verdict``."""
    if default not in ("allow", "block"):
        raise ValueError("default must be allow or block")
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_kept"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    found = match(rows.select("host", "path").distinct(), rule_table(pages.sparkSession, rules))
    out = rows.join(found, ["host", "path"], "left")
    return out.select(*[F.col(f"_kept.`{c}`") for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))

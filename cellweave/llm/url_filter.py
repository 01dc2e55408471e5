"""URL filter: a range join of hosts with nested rule intervals.

A host is written backwards, label by label, with a dot behind each label (``net.example.blog.``).
All hosts that a rule's host covers then lie in one interval, from ``net.example.`` up to, and
without, ``net.example/`` ('/' is the character after '.').  Intervals nest or are disjoint, so a
sweep over the sorted keys needs the stack of the rules that are open at each boundary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import LOWER, UPPER, materialize

ADDRESS = r"://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, ADDRESS, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def reversed_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack): from each interval end on, the rules that are open, outer ones first."""
    nodes = (
        rules.groupBy(F.translate("host", UPPER, LOWER).alias("host"))
        .agg(F.sort_array(F.collect_set(F.struct(F.length("path").alias("n"), "path", "rule", "verdict"))).alias("own"))
        .withColumn("key", reversed_key(F.col("host")))
    )
    above = nodes.select("key", F.explode(F.expr("transform(sequence(1, size(split(key, '[.]', -1)) - 1), i -> concat(array_join(slice(split(key, '[.]', -1), 1, i), '.'), '.'))")).alias("outer"))
    outer = nodes.select(F.col("key").alias("outer"), F.col("own").alias("of_outer"))
    stacks = (
        above.join(outer, "outer")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("depth"), "of_outer", "outer"))).alias("all"))
    )
    opened = stacks.select("key", F.expr("flatten(transform(all, x -> x.of_outer))").alias("stack"))
    closed = stacks.select(
        F.expr("concat(substr(key, 1, length(key) - 1), '/')").alias("key"),
        F.expr("flatten(transform(filter(all, x -> x.outer <> key), x -> x.of_outer))").alias("stack"),
    )
    return opened.unionByName(closed)


def match_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack): for each distinct host the rules whose host covers it, by a sorted sweep.

    Hosts and interval ends are dealt into key ranges and swept range by range; what is open when a
    range begins is the last boundary of the ranges before it, so only one boundary per range is
    carried.  Each range is written to the checkpoint folder with its number before that.
    """
    events = hosts.select(reversed_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", F.lit(None).cast("array<struct<n:int,path:string,rule:string,verdict:string>>").alias("stack"))
    events = events.unionByName(_boundaries(rules).select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), "stack"))
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(events.repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()))
    carried = (
        dealt.filter("kind = 0").groupBy("range").agg(F.max_by("stack", "key").alias("ending"))
        .join(dealt.select("range").distinct(), "range", "right")
    )
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    carried = carried.select("range", F.last("ending", ignorenulls=True).over(before).alias("begins"))
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    return swept.join(carried, "range").select("host", F.coalesce("open", "begins").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``; columns of these names are replaced.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the path of the url
    starts with the rule's path ('' and '/' differ: an empty path fits no rule that has one).  The
    longest host wins, then the longest path, then the greatest path and verdict.  Without a fitting
    rule ``rule`` is null and the verdict is ``default``.  Null urls and urls without ``://`` have an
    empty host and path.  Repeated rows are judged alike; an empty table or no rules give no error.
    """
    host, path = host_and_path(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "_stack")]
    pages = pages.select(*kept, host.alias("host"), path.alias("path"))
    rules = rules.filter("host is not null and verdict is not null").select(
        "host", F.coalesce("path", F.lit("")).alias("path"), F.concat("host", F.coalesce("path", F.lit(""))).alias("rule"), "verdict")
    stacks = match_hosts(pages.select("host").distinct(), rules).filter(F.size("stack") > 0).select(F.col("host").alias("_host"), F.col("stack").alias("_stack"))
    found = pages.join(stacks, pages["host"] == stacks["_host"], "left").withColumn("_best", F.expr("try_element_at(filter(_stack, r -> startswith(path, r.path)), -1)"))
    return found.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))

"""Helpers shared by the operators of this package."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.session import materialize

#: Words are the runs between these characters.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_table(spark: SparkSession, rows: Sequence[Sequence], ddl: str) -> DataFrame:
    """A table of settings (rules, cuts, weights) from one JSON literal; read and parsed on the JVM."""
    names = [part.split()[0] for part in ddl.split(",")]
    text = json.dumps([dict(zip(names, row, strict=True)) for row in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(':'.join(p.split()) for p in ddl.split(','))}>>")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_bucket(md5: Column, digits: Column) -> Column:
    """The first ``digits`` hex digits: order-preserving buckets of an md5 string."""
    return F.substring(md5, F.lit(1), digits)


def gapless(rows: DataFrame, keys: Sequence[str], order: str, out: str, rows_per_task: int = 4096) -> DataFrame:
    """Number the rows of each key 0, 1, 2 ... in column ``out``, ordered by md5(``order``), then ``order``.

    A key with any share of the rows is spread: the leading hex digits of the md5 give buckets, each
    bucket is numbered by itself, and only the counts of the buckets are summed in order.  How many
    digits are used changes the parallelism, never the result.  ``rows`` must be materialised; equal
    ``order`` values are numbered in no particular order (such rows are alike).
    """
    hashed = rows.withColumn("_md5", F.md5(F.coalesce(F.col(order).cast("string"), F.lit("")).cast("binary")))
    largest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    digits = 0
    while largest > rows_per_task * 16**digits:
        digits += 1
    hashed = hashed.withColumn("_bucket", F.substring("_md5", 1, digits) if digits else F.lit(""))
    counts = hashed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_md5", order)
    numbered = hashed.withColumn("_inside", F.row_number().over(inside) - 1)
    on = [numbered[k].eqNullSafe(counts[k]) for k in (*keys, "_bucket")]
    return numbered.join(counts, on).select(*[numbered[c] for c in rows.columns], (F.col("_before") + F.col("_inside")).cast("long").alias(out))


__all__ = ["LOWER", "SPACES", "UPPER", "WORD", "gapless", "hex_bucket", "load", "materialize", "small_table", "word_count"]

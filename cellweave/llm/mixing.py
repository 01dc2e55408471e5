"""Mixing sources to target weights by systematic sampling.

Within a source every document is expected ``target / source size`` times.  The expected copies are
summed up in a fixed order (by size, so that the copies taken have the source's own spread of sizes),
one random offset per source is added, and a document is emitted once for each whole number that its
step crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.llm.common import materialize, word_count

WEIGHTS = (5, 2, 1)


def offset_of(source: Column, seed: int) -> Column:
    """One offset in [0, 1) for each source and seed, from the first 32 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(source, F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def targets(sizes: DataFrame, share: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, source_size)``, one row per source.

    Sources in order of code points, null last, get the weights in turn.  Resharing the excess until
    none is above ``cap`` times its size ends where every source has min(cap * size, level * weight);
    sources are capped in the order of size / weight, so one ordered pass finds the level.  The table
    has one row per source and is put in order in one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    lower, rest, all_rows = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    levels = (
        weighted.withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", share * F.sum("source_size").over(all_rows))
        .withColumn("level", (F.col("total") - cap * F.coalesce(F.sum("source_size").over(lower), F.lit(0))) / F.sum("weight").over(rest))
        # the first source, in this order, whose cap is not below the level: from it on none is capped
        .withColumn("level", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", F.col("source").isNull(), "source", "level"))).over(all_rows)["level"])
    )
    return levels.select("source", "source_size", F.least(cap * F.col("source_size"), F.coalesce(F.col("level") * F.col("weight"), cap * F.col("source_size"))).alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, cap: float = 2.0,
        weights: Sequence[float] = WEIGHTS, seed: int = 7, rows_per_task: int = 4096) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken), one row for each row of ``docs``.

    Size: words of the text (null: 0).  Sources together share ``share`` of all sizes, none more than
    ``cap`` times its own.  A document is taken ``copies`` times, one of the two whole numbers around
    target / source size, and ``taken`` = copies * size.  A null source is a source of its own.  A
    source without words has target 0 and nothing is taken of it.  Repeated rows count as rows of
    their own; they tie and share the copies in no particular order.  Other columns are ignored; an
    empty table gives an empty result.
    """
    rows = materialize(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("md5")))
    sized = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    plan = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share, cap, weights)
    # rows before those of a size: one row for each size that occurs in a source
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    digits = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("n") / float(rows_per_task)))).cast("int")
    sized = sized.select("source", "size", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("before"), digits.alias("digits"))
    sized = materialize(sized.join(plan, sized["source"].eqNullSafe(plan["source"])).select(sized["*"], "source_size", "target"))
    at = lambda a, b, *keys: [a[k].eqNullSafe(b[k]) for k in keys]
    rows = rows.join(sized, at(rows, sized, "source", "size")).select(
        rows["*"], "source_size", "target", "before", F.expr("substr(md5, 1, digits)").alias("part"))
    # documents of one size: by md5, whose leading digits split what is too much for one task
    inside = Window.partitionBy("source", "size", "part").orderBy("md5", "doc_id")
    rows = rows.withColumn("inside", F.row_number().over(inside))
    parts = rows.filter("part <> ''").groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("source", "size", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    rows = rows.join(parts, at(rows, parts, "source", "size", "part"), "left").select(rows["*"], (F.col("before") + F.coalesce("skipped", F.lit(0)) + F.col("inside")).alias("place"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    u = offset_of(F.col("source"), seed)
    copies = (F.floor(F.col("place") * expected + u) - F.floor((F.col("place") - 1) * expected + u)).cast("long")
    return rows.withColumn("copies", copies).select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def repeat_rows(docs: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` takes it; all columns stay as they are.

    Rows are told apart by id and text, so null and repeated ids are rows like any others.  Rows of one
    id and text share their copies: each is given the mean, rounded so that the sum is kept.
    """
    text = options.get("text", "text")
    part = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    key = lambda i, t: F.md5(F.concat(part(i), F.lit("\n"), part(t)).cast("binary"))
    source = options.get("source", "source")
    named = docs.select(key(F.col(doc_id), F.col(text)).alias("_id"), F.col(source).alias(source), F.col(text).alias(text))
    taken = mix(named, doc_id="_id", **options).groupBy(F.col("doc_id").alias("_id")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    whole = docs.select(F.struct("*").alias("_row"))  # whatever the columns are called
    joined = whole.withColumn("_id", key(F.col(f"_row.{doc_id}"), F.col(f"_row.{text}"))).join(taken.filter("_copies > 0"), "_id")
    row = F.row_number().over(Window.partitionBy("_id").orderBy(F.lit(1)))  # rows that are alike
    step = lambda r: F.floor(r * F.col("_copies") / F.col("_rows"))
    joined = joined.withColumn("_r", row).withColumn("_times", (step(F.col("_r")) - step(F.col("_r") - 1)).cast("int")).filter("_times > 0")
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select("_row.*")

"""Shards by a K-d tree over metadata, cut at weighted medians of the bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from cellweave.llm.common import gapless, materialize, small_table

#: A unit's place along a dimension: 20 bits of the coordinate over 32 bits of its hash, which break ties.
COORDINATE_BITS, TIE_BITS, STEP_BITS = 20, 32, 12


def _coordinate(docs: DataFrame, name: str) -> Column:
    """Numbers on a log scale; strings by their first six bytes, which keeps their order; null lowest."""
    if isinstance(docs.schema[name].dataType, NumericType):
        value = F.col(name).cast("double")
        return F.when(value.isNull() | F.isnan(value), -1.0).otherwise(F.signum(value) * F.log1p(F.abs(value)))
    head = F.substring(F.rpad(F.hex(F.encode(F.col(name).cast("string"), "UTF-8")), 12, "0"), 1, 12)
    return F.coalesce(F.conv(head, 16, 10).cast("double"), F.lit(-1.0))


def _units(rows: DataFrame, dims: Sequence[str], limit: float) -> tuple[DataFrame, DataFrame]:
    """Rows with their unit, and the units: equal texts are one, unless they weigh over ``limit``.

    Of such groups there are at most total / limit, whatever the size of the data.
    """
    heavy = rows.groupBy("group").agg(F.sum("size").alias("w")).filter(F.col("w") > limit).select("group", F.lit(True).alias("heavy"))
    rows = rows.join(heavy, "group", "left").withColumn(
        "unit", F.when(F.col("heavy"), F.xxhash64("group", "doc_id")).otherwise(F.col("group"))).drop("heavy")
    rows = materialize(rows)
    return rows, rows.groupBy("unit").agg(F.sum("size").alias("w"), *[F.min(d).alias(d) for d in dims])


def _cut(units: DataFrame, nodes: dict[int, dict], dims: Sequence[str], tolerance: float) -> None:
    """Set ``dim`` and ``cut`` of every node to be split: units whose key is at most ``cut`` go left.

    Each round looks at one more digit (12 bits) of the keys next to the goal, for all nodes at once;
    a node is done when the digit's bin weighs no more than ``tolerance`` bytes.
    """
    spark = units.sparkSession
    spread = units.groupBy("node").agg(F.sum("w").alias("w"), *[f(F.shiftright(d, TIE_BITS)).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))])
    for row in spread.filter(F.col("node").isin(list(nodes)) if len(nodes) < 1000 else F.lit(True)).collect():  # one row for each node of the level
        if row["node"] in nodes:
            node = nodes[row["node"]]
            node |= {"dim": max(dims, key=lambda d: row[f"hi_{d}"] - row[f"lo_{d}"]), "goal": row["w"] * node["left"] / node["leaves"], "below": 0, "prefix": 0}
    open_nodes, bits = {k: v for k, v in nodes.items() if "goal" in v}, COORDINATE_BITS + TIE_BITS
    while open_nodes and bits > 0:
        step = min(STEP_BITS, bits)
        plan = small_table(spark, [(k, v["dim"], v["prefix"], v["below"], v["goal"]) for k, v in open_nodes.items()], "node long, dim string, prefix long, below double, goal double")
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
        bins = units.join(plan, "node").withColumn("key", key).filter(F.shiftright("key", bits) == F.col("prefix"))
        bins = bins.groupBy("node", "below", "goal", F.shiftright("key", bits - step).alias("bin")).agg(F.sum("w").alias("w"))
        upto = F.sum("w").over(Window.partitionBy("node").orderBy("bin")) + F.col("below")  # at most 4,096 bins for each node
        last = F.max("bin").over(Window.partitionBy("node"))
        bins = bins.withColumn("upto", upto).withColumn("last", last).filter("upto >= goal and upto - w < goal or bin = last and upto < goal")
        for row in bins.collect():
            node, lower, upper = open_nodes[row["node"]], row["upto"] - row["w"], row["upto"]
            node |= {"prefix": row["bin"], "below": lower}
            edge = row["bin"] if upper - node["goal"] <= node["goal"] - lower else row["bin"] - 1
            node["cut"] = ((edge + 1) << (bits - step)) - 1
            if row["w"] <= tolerance:
                del open_nodes[row["node"]]
        bits -= step


def kd_shards(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, dims: Sequence[str] = ("lang", "source", "n_chars"),
              doc_id: str = "doc_id", text: str = "text", tolerance: float = 0.002, hot: float = 0.02) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot), one row for each row of ``docs``.

    The tree cuts every node at the weighted median of the bytes (or at the share of its leaves that go
    left) along the dimension that is widest there, until there are ``n_shards`` leaves, or as many as
    ``target_bytes`` asks for.  Size: UTF-8 bytes of the text (null: 0) plus 1.  Leaves are equal up to
    about ``tolerance`` of a leaf for each level.  Equal texts go together, placed by their smallest
    coordinates, unless such a group weighs over ``hot`` of a leaf; then its rows are spread by their ids.
    Slots count from 0 in each shard.  Null metadata lies lowest; a missing text has crc 0.  Repeated
    rows are rows of their own.  Only the named columns are read, so extra columns don't matter.  The
    driver holds one line for each node, none for each document.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group"), *[_coordinate(docs, d).alias(f"c{i}") for i, d in enumerate(dims)])
    rows, dims = materialize(rows), [f"c{i}" for i in range(len(dims))]
    edges = rows.agg(F.sum("size").alias("total"), *[f(d).alias(f"{n}_{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max))]).first()
    total = edges["total"] or 0
    n_shards = max(1, n_shards or -(-total // (target_bytes or total or 1)))
    limit = tolerance * total / n_shards
    rows, units = _units(rows, dims, hot * total / n_shards)
    for d in dims:
        width = (edges[f"hi_{d}"] or 0) - (edges[f"lo_{d}"] or 0)
        scaled = F.floor((F.col(d) - (edges[f"lo_{d}"] or 0)) / width * (2**COORDINATE_BITS - 1)) if width else F.lit(0)
        units = units.withColumn(d, F.shiftleft(scaled.cast("long"), TIE_BITS).bitwiseOR(F.pmod(F.xxhash64("unit"), F.lit(2**TIE_BITS))))
    units = materialize(units.withColumn("node", F.lit(1).cast("long")))
    level, leaves, first = {1: n_shards}, {}, {1: 0}
    depth = 0
    while level:
        leaves |= {k: first[k] for k, n in level.items() if n == 1}
        nodes = {k: {"leaves": n, "left": n // 2} for k, n in level.items() if n > 1}
        if not nodes:
            break
        _cut(units, nodes, dims, limit)
        plan = small_table(units.sparkSession, [(k, v.get("dim", dims[0]), v.get("cut", 0)) for k, v in nodes.items()], "node long, dim string, cut long")
        key = F.coalesce(*[F.when(F.col("dim") == d, F.col(d)) for d in dims])
        units = units.join(plan, "node", "left").withColumn(
            "node", F.when(F.col("cut").isNull(), F.col("node")).otherwise(2 * F.col("node") + (key > F.col("cut")).cast("long"))).drop("dim", "cut")
        level = {}
        for k, v in nodes.items():
            level |= {2 * k: v["left"], 2 * k + 1: v["leaves"] - v["left"]}
            first |= {2 * k: first[k], 2 * k + 1: first[k] + v["left"]}
        depth += 1
        if depth % 4 == 0:
            units = materialize(units)
    names = small_table(units.sparkSession, [(k, s) for k, s in leaves.items()], "node long, shard int")
    placed = rows.join(units.join(names, "node").select("unit", "shard"), "unit").select("doc_id", "size", "text_crc32", "shard")
    return gapless(materialize(placed), ["shard"], "doc_id", "slot")

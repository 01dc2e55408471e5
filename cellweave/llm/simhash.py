"""Near duplicates by SimHash fingerprints and BK-trees.

Fingerprints that differ in at most ``radius`` of 64 bits are cut into ``radius + 2`` blocks: two blocks
at least are alike, so each pair meets in one of the shards named by two blocks and their values.
Every shard gets a BK-tree (children keyed by their Hamming distance to the parent) of bounded size,
which is sent to all queries of its shard; a query follows only edges within the radius.

Links inside dense groups of copies are found first, without pairs: fingerprints that are alike but
for one nibble are linked for certain.  A shard whose members are already one component is skipped, and
the largest component of a shard asks nothing, since the others ask for it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.llm.components import components
from cellweave.llm.shingle_sets import shingle_hashes

BITS = 64


def fingerprint_of(text: str | None, width: int = 4) -> int:
    """The fingerprint of one text, as a signed long."""
    return fingerprint_of_hashes(shingle_hashes(text, width))


def fingerprint_of_hashes(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; without hashes all are 0."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at:at + 4096].astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64).view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` in the long column ``out``."""
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return docs.withColumn(out, hashed(F.coalesce(F.col(text), F.lit(""))))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def grow_trees(prints: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each fingerprint and its distance to it; ``root``: the first member of each one's tree.

    All trees grow together, a level at a time: of the members that fall on one edge the first becomes
    the child, the others move on to it.
    """
    parent, key = np.full(len(prints), -1), np.zeros(len(prints), np.int64)
    moving = np.flatnonzero(root != np.arange(len(prints)))
    at = root[moving]
    while len(moving):
        d = _distance(prints[moving], prints[at]).astype(np.int64)
        edge = at * (BITS + 1) + d
        _, first, which = np.unique(edge, return_index=True, return_inverse=True)
        child = moving[first]
        parent[child], key[child] = at[first], d[first]
        at = child[which]
        stay = np.ones(len(moving), bool)
        stay[first] = False
        moving, at = moving[stay], at[stay]
    return parent, key


def search_trees(prints: np.ndarray, parent: np.ndarray, key: np.ndarray, asked: np.ndarray, root: np.ndarray, radius: int,
                 block: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (position in ``asked``, node) within the radius; ``root``: the tree each query starts in."""
    nodes = np.flatnonzero(parent >= 0)
    edge = parent[nodes] * (BITS + 1) + key[nodes]
    order = np.argsort(edge, kind="stable")
    nodes, edge = nodes[order], edge[order]
    waiting = [(np.arange(len(asked)), root)]
    while waiting:
        who, node = waiting.pop()
        if len(who) > block:
            waiting += [(who[i:i + block], node[i:i + block]) for i in range(0, len(who), block)]
            continue
        d = _distance(asked[who], prints[node]).astype(np.int64)
        near = d <= radius
        if near.any():
            yield who[near], node[near]
        base = node * (BITS + 1)
        low = np.searchsorted(edge, base + np.maximum(d - radius, 0))
        n = np.searchsorted(edge, base + np.minimum(d + radius, BITS), side="right") - low
        if n.sum():
            step = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            waiting.append((np.repeat(who, n), nodes[step]))


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest links that join the same members: each on the smallest of its component."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[:len(a)], flat[len(a):]
    label = np.arange(len(ids))
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        new = new[new]
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(ids))
    return ids[moved], ids[label[moved]]


def sorted_groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Frames of rows sorted by ``key``, cut so that no group is in two of them."""
    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame[key].to_numpy() == frame[key].iloc[-1]
        held = frame[last]
        if not last.all():
            yield frame[~last]
    if held is not None and len(held):
        yield held


def _ask(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links between components, from rows sorted by shard; a shard is never cut in two."""
    for frame in sorted_groups(frames, "shard_key"):
        shard = frame["shard_key"].to_numpy()
        tree, asks = frame["in_tree"].to_numpy(), frame["asks"].to_numpy()
        prints, comp = frame["print"].to_numpy().astype(np.int64).view(np.uint64), frame["comp"].to_numpy()
        members = np.flatnonzero(tree)
        names, first = np.unique(shard[members], return_index=True)
        root_of = lambda s: first[np.minimum(np.searchsorted(names, s), len(names) - 1)]
        parent, key = grow_trees(prints[members], root_of(shard[members]))
        who = np.flatnonzero(asks)
        who = who[np.isin(shard[who], names)]
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for q, node in search_trees(prints[members], parent, key, prints[who], root_of(shard[who]), radius):
            x, y = comp[who[q]], comp[members[node]]
            differ = x != y
            if differ.any():
                x, y = _spanning(x[differ], y[differ])
                a.append(x)
                b.append(y)
        x, y = np.concatenate(a), np.concatenate(b)
        x, y = _spanning(x, y) if len(x) else (x, y)
        yield pd.DataFrame({"a": x, "b": y})


def _block(i: int, radius: int) -> Column:
    """Block i of radius + 2 nearly equal ones."""
    edges = [round(j * BITS / (radius + 2)) for j in range(radius + 3)]
    return F.shiftrightunsigned("print", edges[i]).bitwiseAND(F.lit((1 << edges[i + 1] - edges[i]) - 1))


def link_fingerprints(prints: DataFrame, radius: int = 4, tree_size: int = 4096) -> DataFrame:
    """(print, root) for all distinct fingerprints that link with another; root names the component."""
    nibbles = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col("print").bitwiseAND(F.lit(~(15 << 4 * i) if i < 15 else 0x0FFFFFFFFFFFFFFF)).alias("rest")) for i in range(16)]))
    met = prints.select("print", nibbles.alias("m")).groupBy("m").agg(F.min("print").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("m", "b")
    sure = prints.select("print", nibbles.alias("m")).join(met, "m").filter("print <> b").select(F.col("print").alias("a"), "b")
    first = components(sure)
    placed = materialize(prints.join(first, prints["print"] == first["node"], "left").select("print", F.coalesce("root", "print").alias("comp")))

    pairs = list(combinations(range(radius + 2), 2))
    keys = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), _block(i, radius).alias("x"), _block(j, radius).alias("y")) for t, (i, j) in enumerate(pairs)]))
    spread = placed.select("print", "comp", keys.alias("k"))
    sizes = spread.groupBy("k", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("comps"), F.max_by("comp", "n").alias("largest"))
    sizes = sizes.filter("comps > 1").select("k", "largest", F.ceil(F.col("n") / tree_size).cast("int").alias("trees"))
    met = spread.join(sizes, "k")
    own = F.pmod(F.xxhash64("print"), F.col("trees")).cast("int")
    asks = F.col("comp") != F.col("largest")
    everywhere = F.when(asks, F.sequence(F.lit(0), F.col("trees") - 1)).otherwise(F.array(own))
    dealt = met.withColumn("own", own).withColumn("tree", F.explode(everywhere)).select(
        F.xxhash64("k", "tree").alias("shard_key"), "print", "comp", (F.col("tree") == F.col("own")).alias("in_tree"), asks.alias("asks"))
    sorted_rows = dealt.repartition("shard_key").sortWithinPartitions("shard_key")
    found = sorted_rows.mapInPandas(lambda frames: _ask(frames, radius), "a long, b long")
    second = components(found)
    joined = placed.join(second, placed["comp"] == second["node"], "left")
    return joined.select("print", F.coalesce("root", "comp").alias("root"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``.

    Words are what lies between blanks, A-Z lower-cased; shingles are four words.  Texts with fewer
    words give one shingle, texts without words (and null texts) the fingerprint zero, which links like
    any other.  ``component_id`` is the smallest doc_id that links reach; null ids take part but name no
    component (null if no member has an id).  Repeated rows are rows of their own.  Only the two named
    columns are read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = materialize(fingerprints(rows, "text", "print").select("doc_id", "print"))
    distinct = materialize(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = materialize(link_fingerprints(distinct.select("print"), radius))
    named = distinct.join(roots, "print").groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = roots.join(named, "root").select("print", "component_id")
    return rows.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")

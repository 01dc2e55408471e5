"""Near duplicates by the Jaccard similarity of their shingle sets, without a miss.

All sets are read in one order, rare shingles first.  Of two sets that reach the similarity each has one
of the other's shingles among its first ones (prefix filter), so each such pair meets at a shingle.  The
order comes from counts by hash slot; how well they tell common shingles changes the cost, never the pairs.

Equal sets are one node.  At each shingle all nodes are compared with a few of them first, so a dense group
becomes one component without its pairs; then only nodes of different components are compared, where the
largest component of a shingle asks nothing, since the others ask for it.  Nodes and shingles are told
apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.llm.components import components
from cellweave.session import shared_folder

SEED, SLOTS = 42, 1 << 17
#: Nodes a task remembers, to give out the shingles of copies once.
SEEN = 200_000
#: Nodes of a shingle that all its others are compared with first.
HUBS = 4


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words (of all words, if there are fewer), in the order of the text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate([[0], ends[:len(words) - width] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1:].tolist(), strict=True)], np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles, sorted; a text without words has the set of the empty shingle."""
    hashes = np.unique(shingle_hashes(text, width))
    return hashes if len(hashes) else np.zeros(1, np.uint64)


def _node(hashes: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % SLOTS


def _counts(docs: DataFrame, width: int) -> np.ndarray:
    """How many shingles fall into each slot: at most ``SLOTS`` rows for the driver."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(SLOTS, np.int64)
        for frame in frames:
            for at in range(0, len(frame), 256):
                n += np.bincount(np.concatenate([_slots(shingle_set(t, width)) for t in frame["text"].iloc[at:at + 256]]), minlength=SLOTS)
        at = np.flatnonzero(n)
        yield pd.DataFrame({"slot": at, "n": n[at]})

    out = np.zeros(SLOTS, np.int64)
    for r in docs.select("text").mapInPandas(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        out[r["slot"]] = r["n"]
    return out


def _prefixes(docs: DataFrame, width: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """(token, node, n, pos): the first shingles of each set of n; copies may give the same row again."""
    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            token, node, n, length = [], [], [], []
            for text in frame["text"]:
                hashes = shingle_set(text, width)
                me = _node(hashes)
                if me in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(me)
                take = len(hashes) - ceil(similarity * len(hashes) - 1e-9) + 1
                token.append(hashes[np.lexsort((hashes, counts[_slots(hashes)]))[:take]].view(np.int64))
                node.append(me)
                n.append(len(hashes))
                length.append(take)
            if node:
                yield pd.DataFrame({"token": np.concatenate(token), "node": np.repeat(np.array(node, np.int64), length), "n": np.repeat(n, length).astype(np.int32),
                                    "pos": np.concatenate([np.arange(k, dtype=np.int32) for k in length])})

    return docs.select("text").mapInPandas(first, "token long, node long, n int, pos int")


def link_sets(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(node, root) of all sets of docs(text, node) that link with another."""
    posts = _prefixes(docs, width, similarity, _counts(docs, width))
    shared = posts.groupBy("token").agg(F.min("node").alias("_first"), F.max("node").alias("_last")).filter("_first <> _last").select("token")
    met = materialize(posts.join(shared, "token").dropDuplicates(["token", "node"]))
    hubs = met.groupBy("token").agg(F.array(*[F.min_by("node", F.xxhash64("node", F.lit(i))) for i in range(HUBS)]).alias("_hubs"))
    met = materialize(met.join(hubs, "token").withColumn("hub", F.array_contains("_hubs", F.col("node"))).drop("_hubs"))

    def side(rows: DataFrame, x: str, *more: str) -> DataFrame:
        return rows.select("token", F.col("node").alias(x), F.col("n").alias(f"_n{x}"), F.col("pos").alias(f"_p{x}"), *[F.col(c).alias(f"_{c}{x}") for c in more])

    # what two sets can share from here on must reach their least overlap; the first shingle a pair shares never fails this
    room = F.least(F.col("_na") - F.col("_pa"), F.col("_nb") - F.col("_pb"))
    likely = (room >= F.lit(similarity / (1 + similarity)) * (F.col("_na") + F.col("_nb")) - 1e-9) & (F.least("_na", "_nb") >= F.lit(similarity) * F.greatest("_na", "_nb") - 1e-9)

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs.select("a", "b").distinct())
        folder = shared_folder(docs.sparkSession, "nodes")  # a table with a known size: few nodes are sent to the texts
        pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().write.parquet(folder)
        texts = docs.join(docs.sparkSession.read.parquet(folder), "node", "left_semi").dropDuplicates(["node"])
        sets = materialize(texts.select("node", "text").mapInPandas(whole, "node long, shingles array<long>"))
        a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("_y"))
        both = F.size(F.array_intersect("_x", "_y"))
        return materialize(pairs.join(a, "a").join(b, "b").filter(both >= F.lit(similarity) * (F.size("_x") + F.size("_y") - both) - 1e-9).select("a", "b"))

    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), 256):
                part = frame.iloc[at:at + 256]
                yield pd.DataFrame({"node": part["node"], "shingles": [shingle_set(t, width).view(np.int64) for t in part["text"]]})

    sure = confirmed(side(met, "a", "hub").join(side(met.filter("hub"), "b"), "token").filter((~F.col("_huba") | (F.col("a") < F.col("b"))) & likely))
    first = materialize(components(sure))
    placed = materialize(met.join(first, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root"))
    sizes = placed.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("_n")).groupBy("token").agg(F.count(F.lit(1)).alias("_comps"), F.max_by("comp", "_n").alias("largest"))
    others = placed.join(sizes.filter("_comps > 1").select("token", "largest"), "token").filter("NOT hub")  # pairs with a hub are settled
    asking, asked = side(others.filter("comp <> largest"), "a", "comp"), side(others, "b", "comp", "largest")
    twice = (F.col("_compb") != F.col("_largestb")) & (F.col("a") > F.col("b"))  # both ask
    rest = confirmed(asking.join(asked, "token").filter((F.col("_compa") != F.col("_compb")) & ~twice & likely))
    return first if rest.isEmpty() else components(sure.unionByName(rest))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id), one row for each row of ``docs``.

    Words are what lies between blanks, A-Z lower-cased; shingles are ``width`` words, and texts with fewer
    words give one.  Texts link if the Jaccard similarity of their shingle sets reaches ``similarity``; texts
    without words (and null texts) link with each other.  ``component_id`` is the smallest doc_id that links
    reach; null ids take part but name no component.
    """
    @F.pandas_udf("long")
    def node_of(texts: pd.Series) -> pd.Series:
        return pd.Series([_node(shingle_set(t, width)) for t in texts], dtype="int64")

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("node", node_of("text"))
    nodes = materialize(rows.select("doc_id", "node"))
    roots = link_sets(rows, width, similarity)
    named = materialize(nodes.groupBy("node").agg(F.min("doc_id").alias("_least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    least = named.groupBy("root").agg(F.min("_least").alias("component_id"))
    return nodes.join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")

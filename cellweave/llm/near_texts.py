"""Near-duplicate texts: fingerprints and BK-trees find candidates, whole shingle sets decide.

Two texts of Jaccard similarity s differ in about acos(2s / (1 + s)) / pi of their fingerprint's bits, so
the radius must be wide.  Fingerprints are dealt into shards by some of their bits, anew in each of several
tables; a pair is looked at in the first table in which it agrees in those bits.  The number of bits
follows the number of texts, so that shards keep their size, and the number of tables follows from the
recall asked for.  Every shard gets BK-trees of bounded size.

Dense groups are first joined without their pairs: in a few rounds each text is compared with the nearest
of a few members of its shards.  Then only texts of different groups ask, and the largest group of a
shard asks nothing.  Only texts that have a candidate send their shingle sets, to the shards where they
have it; pairs are compared there and leave as the links that join groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.llm.components import components
from cellweave.llm.shingle_sets import _node, link_sets, shingle_hashes, shingle_set
from cellweave.llm.simhash import BITS, fingerprint_of_hashes, grow_trees, search_trees, sorted_groups

#: Members of a shard among which every other one's nearest is compared first, and how often that is done with new ones.
HUBS, ROUNDS = 8, 2
#: Rows of a table that are sent to all tasks, beside a few bytes each; larger tables are joined.
SENT = 1_000_000


def apart(similarity: float) -> float:
    """The share of bits in which fingerprints of texts of this similarity are expected to differ."""
    return acos(min(1.0, 2 * similarity / (1 + similarity))) / pi


def radius_of(similarity: float, recall: float) -> int:
    """The distance that a share ``recall`` of the pairs at the similarity itself stay within, by the normal tail."""
    from statistics import NormalDist

    p = apart(similarity)
    return ceil(BITS * p + NormalDist().inv_cdf(recall) * sqrt(BITS * p * (1 - p)))


def tables_of(n: int, similarity: float, recall: float, shard_rows: int) -> list[list[int]]:
    """The bits of each table: log2(n / shard_rows) of them, for as many tables as the recall needs."""
    bits = max(4, ceil(log2(max(2.0, n / shard_rows))))
    meets = (1 - apart(similarity)) ** bits
    tables = max(1, ceil(log(1 - recall) / log(1 - meets)))
    rng = np.random.default_rng(7)
    return [sorted(rng.permutation(BITS)[:bits].tolist()) for _ in range(tables)]


def _shards(tables: list[list[int]]) -> Column:
    """One struct for each table: its number and the key of the shard there."""
    key = lambda bits: sum((F.shiftrightunsigned("print", b).bitwiseAND(F.lit(1)).cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    return F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.xxhash64(F.lit(i), key(bits)).alias("shard")) for i, bits in enumerate(tables)]))


def _nearest_hubs(frames: Iterator[pd.DataFrame], radius: int, similarity: float) -> Iterator[pd.DataFrame]:
    """(node, hub, distance): the nearest hub of another group; the first rows of a shard are its hubs, the rest stream by."""
    name, hubs = None, None
    for frame in frames:
        shards = frame["shard"].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(shards[1:] != shards[:-1]) + 1, [len(shards)]]) if len(shards) else [0, 0]
        node, group, n = (frame[c].to_numpy(np.int64) for c in ("node", "group", "n"))
        prints, out = frame["print"].to_numpy(np.int64).view(np.uint64), []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if shards[a] != name:
                name, hubs = shards[a], [x[a:min(b, a + HUBS)] for x in (node, group, n, prints)]
            d = np.bitwise_count(prints[a:b, None] ^ hubs[3]).astype(np.int64)
            fits = (d <= radius) & (group[a:b, None] != hubs[1]) & (np.minimum(n[a:b, None], hubs[2]) >= similarity * np.maximum(n[a:b, None], hubs[2]) - 1e-9)
            d[~fits] = BITS + 1
            best = d.argmin(1)
            has = np.flatnonzero(d[np.arange(b - a), best] <= radius)
            out.append((node[a:b][has], hubs[0][best[has]], d[has, best[has]]))
        if out:
            yield pd.DataFrame(dict(zip(("node", "hub", "d"), map(np.concatenate, zip(*out)))))


def _candidates(frame: pd.DataFrame, radius: int, similarity: float, masks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (x, y) of different groups within the radius, whose sizes allow the similarity, that no earlier table brings together."""
    shard, table = frame["shard_key"].to_numpy(), frame["t"].to_numpy(np.int64)
    prints = frame["print"].to_numpy(np.int64).view(np.uint64)
    members, who = np.flatnonzero(frame["in_tree"].to_numpy(bool)), np.flatnonzero(frame["asks"].to_numpy(bool))
    names, first = np.unique(shard[members], return_index=True)
    root_of = lambda s: first[np.minimum(np.searchsorted(names, s), len(names) - 1)]
    who = who[np.isin(shard[who], names)]
    if not len(who):
        return
    parent, key = grow_trees(prints[members], root_of(shard[members]))
    group, n = frame["group"].to_numpy(np.int64), frame["n"].to_numpy(np.int64)
    for q, at in search_trees(prints[members], parent, key, prints[who], root_of(shard[who]), radius, block=1 << 18):
        x, y = who[q], members[at]
        good = (group[x] != group[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)
        x, y = x[good], y[good]
        apart_in, sooner = prints[x] ^ prints[y], np.zeros(len(x), bool)
        for t, mask in enumerate(masks):
            sooner |= (t < table[x]) & (apart_in & mask == 0)
        if not sooner.all():
            yield x[~sooner], y[~sooner]


def _with_candidates(frames: Iterator[pd.DataFrame], radius: int, similarity: float, masks: np.ndarray) -> Iterator[pd.DataFrame]:
    """The rows of shards that have a candidate there."""
    for frame in sorted_groups(frames, "shard_key"):
        has = np.zeros(len(frame), bool)
        for x, y in _candidates(frame, radius, similarity, masks):
            has[x] = has[y] = True
        yield frame[has]


def _sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of 512 parts of the hash space a byte of the smallest shingle there; 0: none."""
    part, rest = (shingles >> np.uint64(55)).astype(np.int64), shingles << np.uint64(9)
    out = np.full(512, np.uint64(2**64 - 1))
    np.minimum.at(out, part, rest)
    byte = (out * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)
    byte[byte == 0] = 1
    byte[np.bincount(part, minlength=512) == 0] = 0
    return byte


def _verified(frames: Iterator[pd.DataFrame], radius: int, similarity: float, masks: np.ndarray, block: int = 4096) -> Iterator[pd.DataFrame]:
    """Links between groups whose whole sets reach the similarity; pairs that links already join are passed over.

    A byte sketch passes over pairs whose estimate lies five deviations below the similarity.
    """
    for frame in sorted_groups(frames, "shard_key"):
        sets = [np.frombuffer(b, np.uint64) for b in frame["shingles"]]
        sketches = np.stack([_sketch(x) for x in sets]) if sets else np.zeros((0, 512), np.uint8)
        group, parent, links = frame["group"].tolist(), {}, []

        def find(g: int) -> int:
            while parent.get(g, g) != g:
                parent[g] = g = parent.get(parent[g], parent[g])
            return g

        for xs, ys in _candidates(frame, radius, similarity, masks):
            for at in range(0, len(xs), block):
                x, y = xs[at:at + block], ys[at:at + block]
                a, b = sketches[x], sketches[y]
                used = np.maximum(((a > 0) | (b > 0)).sum(1), 1)
                alike = ((a == b) & (a > 0)).sum(1) / used
                for i in np.flatnonzero(alike >= similarity - 5 * np.sqrt(similarity * (1 - similarity) / used)):
                    g, h = find(group[x[i]]), find(group[y[i]])
                    if g == h:
                        continue
                    s, t = sets[x[i]], sets[y[i]]
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    if both >= similarity * (len(s) + len(t) - both) - 1e-9:
                        parent[max(g, h)] = min(g, h)
                        links.append((g, h))
        yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)


def _sent(rows: DataFrame) -> DataFrame:
    """A materialised table of short rows, marked for broadcast if there are few enough."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _text_key(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def _sets(asked: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes asked(node, text_key), made from ``texts`` (text)."""
    def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for frame in frames:
            nodes, sets = [], []
            for node, text in zip(frame["node"], frame["text"]):
                if node not in seen:  # of copies in one task the first gives the set
                    seen.add(node)
                    nodes.append(node)
                    sets.append(shingle_set(text, width).tobytes())
            if len(seen) > SENT:
                seen.clear()
            yield pd.DataFrame({"node": nodes, "shingles": sets})

    found = texts.withColumn("text_key", _text_key(F.col("text"))).join(_sent(asked), "text_key").select("node", "text")
    return found.mapInPandas(whole, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """The ``pairs`` (a, b) of nodes(node, text_key) whose whole shingle sets, made from ``texts`` (text), reach the similarity."""
    pairs = materialize(pairs.select("a", "b").distinct())
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = materialize(_sets(materialize(nodes.select("node", "text_key").join(asked, "node", "left_semi")), texts, width))

    @F.pandas_udf("boolean")
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for s, t in zip(x, y):
            s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            out.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
        return pd.Series(out, dtype=bool)

    a, b = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return materialize(pairs.join(a, "a").join(b, "b").filter(alike("x", "y")).select("a", "b"))


def link_texts(nodes: DataFrame, texts: DataFrame, width: int = 5, similarity: float = 0.8, recall: float = 0.95, shard_rows: int = 256, tree_rows: int = 4096) -> DataFrame:
    """(node, root) of the nodes(node, print, n, text_key) that link with another; ``texts`` (text) hold their texts.

    ``recall`` is the share of pairs at the similarity itself that meet within the radius, and again
    that meet in a shard; closer pairs are found oftener.  More tables are needed for more texts, as
    a power of their number below 0.3.
    """
    nodes = materialize(nodes)
    radius, tables = radius_of(similarity, recall), tables_of(nodes.count(), similarity, recall, shard_rows)
    masks = np.array([sum(1 << b for b in bits) for bits in tables], np.uint64)
    placed, links = nodes.withColumn("group", F.col("node")), None
    for turn in range(ROUNDS):
        spread = placed.select("node", "print", "n", "group", _shards(tables).alias("s")).select("node", "print", "n", "group", "s.shard")
        dealt = spread.repartition("shard").sortWithinPartitions("shard", F.xxhash64("node", F.lit(turn)))
        near = dealt.mapInPandas(lambda frames: _nearest_hubs(frames, radius, similarity), "node long, hub long, d long").groupBy("node").agg(F.min(F.struct("d", "hub")).alias("h"))
        sure = confirmed(near.select(F.least("node", "h.hub").alias("a"), F.greatest("node", "h.hub").alias("b")), nodes, texts, width, similarity)
        links = sure if links is None else materialize(links.unionByName(sure))
        placed = materialize(nodes.join(components(links), "node", "left").withColumn("group", F.coalesce("root", "node")).drop("root"))
    spread = placed.select("node", "print", "n", "group", _shards(tables).alias("s")).select("node", "print", "n", "group", "s.*")
    sizes = spread.groupBy("shard", "group").agg(F.count(F.lit(1)).alias("_n")).groupBy("shard").agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("groups"), F.max_by("group", "_n").alias("largest"))
    sizes = sizes.filter("groups > 1").select("shard", "largest", F.ceil(F.col("rows") / tree_rows).cast("int").alias("trees"))
    own, asks = F.pmod(F.xxhash64("node"), F.col("trees")).cast("int"), F.col("group") != F.col("largest")
    everywhere = F.when(asks, F.sequence(F.lit(0), F.col("trees") - 1)).otherwise(F.array(own))
    dealt = spread.join(sizes, "shard").withColumn("own", own).withColumn("tree", F.explode(everywhere)).select(
        F.xxhash64("shard", "tree").alias("shard_key"), "t", "node", "print", "n", "group", (F.col("tree") == F.col("own")).alias("in_tree"), asks.alias("asks"))
    ddl = "shard_key long, t int, node long, print long, n int, group long, in_tree boolean, asks boolean"
    found = materialize(dealt.repartition("shard_key").sortWithinPartitions("shard_key").mapInPandas(lambda frames: _with_candidates(frames, radius, similarity, masks), ddl))
    asked = materialize(nodes.select("node", "text_key").join(found.select("node").distinct(), "node", "left_semi"))
    whole = found.join(_sets(asked, texts, width), "node")
    rest = whole.repartition("shard_key").sortWithinPartitions("shard_key").mapInPandas(lambda frames: _verified(frames, radius, similarity, masks), "a long, b long")
    return components(links.unionByName(materialize(rest)))


def _row_key(name: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(F.concat(F.lit("="), name.cast("string")), F.lit("")), F.lit("\n"), text).cast("binary"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One whole row of each group of near copies: that of the smallest doc_id, null ids last, then of the smallest text hash.

    Words are what lies between blanks, A-Z lower-cased; shingles are ``width`` words, and texts with
    fewer words give one.  ``recall`` is that of :func:`link_texts`; 1 takes an exact set join instead of
    fingerprints.  Null texts and texts without words are alike.  Ids may repeat with other
    texts: each text counts by itself.  Of rows with the same id and text any one stays.  Columns keep
    their names whatever these are; an empty table gives an empty result.
    """
    whole = docs.select(F.struct("*").alias("_row"))  # carried once: id and text are read out of the row
    name, words = F.col(f"_row.{doc_id}"), F.coalesce(F.col(f"_row.{text}"), F.lit(""))

    @F.pandas_udf("node long, print long, n int")
    def signed(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            hashes = shingle_hashes(t, width)
            distinct = np.unique(hashes) if len(hashes) else np.zeros(1, np.uint64)
            rows.append((_node(distinct), fingerprint_of_hashes(hashes), len(distinct)))
        return pd.DataFrame(rows, columns=["node", "print", "n"])

    rows = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signs = rows.select("_id", _row_key(F.col("_id"), F.col("text")).alias("_me"), _text_key(F.col("text")).alias("text_key"), signed("text").alias("_s")).select("_id", "_me", "text_key", "_s.*")
    signs = materialize(signs.groupBy("_me", "_id", "node", "print", "n", "text_key").agg(F.count(F.lit(1)).alias("copies")))
    if recall >= 1:
        roots = link_sets(rows.withColumn("node", signed("text")["node"]), width, similarity)
    else:
        nodes = signs.groupBy("node").agg(F.first("print").alias("print"), F.first("n").alias("n"), F.min("text_key").alias("text_key"))
        roots = link_texts(nodes, rows.select("text"), width, similarity, recall)
    order = F.struct(F.col("_id").isNull().alias("no"), F.col("_id").alias("id"), F.col("_me").alias("me"), "copies")
    first = materialize(signs.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("f")).select(F.col("f.me").alias("_first"), "f.copies"))
    joined = whole.withColumn("_me", _row_key(name, words)).join(_sent(first), F.col("_me") == F.col("_first"))
    if first.filter("copies > 1").isEmpty():
        return joined.select("_row.*")
    return joined.filter("copies = 1").select("_row.*").unionByName(joined.filter("copies > 1").dropDuplicates(["_me"]).select("_row.*"))

"""Shortest paths of many sources over blocks of neighbouring cells.

A graph is cut into blocks.  A task holds one block and a few sources: it follows the paths inside the block
as far as they go, from what neighbouring blocks last said about their own cells at the border.  A block
is looked at again only when a neighbour says something new, so rounds grow with the blocks a path crosses
instead of its steps, and only borders are sent.  Counts of paths are kept as logarithms: they grow by a factor with each step.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import neighbors
from cellweave.session import cut

FAR = np.iinfo(np.int64).max // 4
MESSAGE = "sender long, block long, part long, payload binary"


def blocks_of(links: DataFrame, obs: DataFrame, cells: int) -> DataFrame:
    """(cell_id, block) of the cells that have links: by place if ``obs`` has x and y, else by ranges of numbers or by hash."""
    linked = links.select(F.col("src").alias("cell_id")).distinct()
    n = linked.count()
    if n <= cells:
        return linked.withColumn("block", F.lit(0).cast("long"))
    spare = F.xxhash64(F.pmod(F.xxhash64("cell_id"), F.lit(-(-n // cells))))
    if {"x", "y"} <= set(obs.columns):
        return linked.join(neighbors.place_blocks(obs, cells, square=True), "cell_id", "left").withColumn("block", F.coalesce("block", spare))
    if dict(linked.dtypes)["cell_id"] in ("tinyint", "smallint", "int", "bigint"):
        order = S.cumulative_counts(linked, [], "cell_id")
        return order.select("cell_id", F.floor(F.col("n_before") / cells).alias("block"))
    return linked.withColumn("block", spare)


def packed_blocks(links: DataFrame, places: DataFrame) -> DataFrame:
    """One row for each block: its cells, the cells of other blocks it has links to with their blocks, and its links as numbers of both."""
    kind = dict(links.dtypes)["src"]
    ends = links.join(places.select(F.col("cell_id").alias("src"), "block"), "src").join(places.select(F.col("cell_id").alias("dst"), F.col("block").alias("other")), "dst")

    def pack(key, pdf):
        own = np.unique(pdf["src"].to_numpy())
        away = (pdf["other"] != key[0]).to_numpy()
        outside = pdf.loc[away, ["other", "dst"]].drop_duplicates().sort_values(["other", "dst"])
        b = np.zeros(len(pdf), np.int32)
        b[~away] = np.searchsorted(own, pdf["dst"].to_numpy()[~away])
        b[away] = pd.Index(outside["dst"]).get_indexer(pdf["dst"][away]) + len(own)
        a = np.searchsorted(own, pdf["src"].to_numpy()).astype(np.int32)
        order = np.argsort(a, kind="stable")
        return pd.DataFrame({"block": [key[0]], "own": [own], "outside": [outside["other"].to_numpy()], "a": [a[order]], "b": [b[order]]})

    return ends.groupBy("block").applyInPandas(pack, f"block long, own array<{kind}>, outside array<long>, a array<int>, b array<int>")


def _starts(ends: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.bincount(ends, minlength=n))])


def _fan(starts: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all links of ``nodes``, and which node each of them belongs to."""
    n = starts[nodes + 1] - starts[nodes]
    return np.repeat(starts[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(np.arange(len(nodes)), n)


class _Block:
    """A block with what its neighbours have said: distances and logarithms of path counts by source and cell."""

    def __init__(self, row, n_sources: int):
        self.outside, self.a, self.b = (np.asarray(row[c]) for c in ("outside", "a", "b"))
        self.n, self.s = len(row["own"]), n_sources
        self.size = self.n + len(self.outside)
        self.near = np.unique(self.outside)
        shape = (n_sources, self.size)
        self.dist, self.count = np.full(shape, FAR, np.int64), np.full(shape, -np.inf)
        self.delta = np.zeros(shape)

    def border(self, other: int) -> np.ndarray:
        """Own cells with links to the block ``other``, in the order of their ids."""
        return np.unique(self.a[np.r_[np.zeros(self.n, bool), self.outside == other][self.b]])

    def hears(self, other: int) -> np.ndarray:
        return np.flatnonzero(self.outside == other) + self.n

    def follow(self, sources: list[tuple[int, int]]) -> None:
        """Breadth-first over the block, level by level, all sources at once; each counts levels from what it first hears of."""
        into = np.argsort(self.b, kind="stable")
        starts, to = _starts(self.b, self.size), self.a[into]
        for slot, cell in sources:
            self.dist[slot, cell], self.count[slot, cell] = 0, 0.0
        s, u = np.nonzero(self.dist < FAR)
        if not len(s):
            return
        dist, count = self.dist.reshape(-1), self.count.reshape(-1)
        base = self.dist.min(1)
        given = s * self.size + u
        level = dist[given] - base[s]
        order = np.argsort(level, kind="stable")
        given, level = given[order], level[order]
        at, t, front = 0, 0, np.zeros(0, np.int64)
        while at < len(given) or len(front):
            if not len(front):
                t = level[at]
            upto = at + np.searchsorted(level[at:], t, "right")
            here = given[at:upto]
            here = here[dist[here] - base[here // self.size] == t]
            front, at = np.unique(np.concatenate([front, here])), upto
            link, of = _fan(starts, front % self.size)
            goal = (front // self.size)[of] * self.size + to[link]
            new = dist[goal] > t + 1 + base[goal // self.size]
            goal, told = goal[new], count[front[of[new]]]
            order = np.argsort(goal, kind="stable")
            goal, told = goal[order], told[order]
            first = np.flatnonzero(np.r_[True, goal[1:] != goal[:-1]]) if len(goal) else np.zeros(0, np.int64)
            front = goal[first]
            if len(front):
                most = np.maximum.reduceat(told, first)
                n = np.diff(np.r_[first, len(goal)])
                count[front] = most + np.log(np.add.reduceat(np.exp(told - np.repeat(most, n)), first))
                dist[front] = base[front // self.size] + t + 1
            t += 1

    def depend(self) -> None:
        """Dependencies backwards from the last level: the share of paths to later cells that run through each cell."""
        starts = _starts(self.a, self.size)
        dist, count, delta = (x.reshape(-1) for x in (self.dist, self.count, self.delta))
        base = self.dist.min(1)
        s, u = np.nonzero(self.dist[:, : self.n] < FAR)
        cell = s * self.size + u
        level = dist[cell] - base[s]
        order = np.argsort(-level, kind="stable")
        cell, level = cell[order], level[order]
        for here in np.split(cell, np.flatnonzero(level[1:] != level[:-1]) + 1):
            link, of = _fan(starts, here % self.size)
            goal = (here // self.size)[of] * self.size + self.b[link]
            on = dist[goal] == dist[here[of]] + 1
            goal, of = goal[on], of[on]
            delta[here] = np.bincount(of, np.exp(count[here[of]] - count[goal]) * (1.0 + delta[goal]), len(here))


def _sources(rows: pd.DataFrame) -> list[tuple[int, int]]:
    return [(int(x[0]), int(x[1])) for x in (np.frombuffer(p, np.int64) for p in rows["payload"])]


def _listen(block: _Block, rows: pd.DataFrame) -> None:
    for sender, payload in zip(rows["sender"], rows["payload"]):
        at = block.hears(sender)
        half = len(payload) // 2
        block.dist[:, at] = np.frombuffer(payload[:half], np.int64).reshape(block.s, len(at))
        block.count[:, at] = np.frombuffer(payload[half:]).reshape(block.s, len(at))


def _asked(packed: DataFrame, active: DataFrame) -> DataFrame:
    """The blocks of the active (block, part), once for each part."""
    return packed.withColumnRenamed("block", "_block").join(active.select(F.col("block").alias("_block"), F.col("part").alias("_part")), "_block")


def _rounds(packed: DataFrame, state: DataFrame, active: DataFrame, task, always: list[DataFrame]) -> DataFrame:
    """``task`` on the active (block, part) until no message changes; the last message of each sender, block and part."""
    key = ["sender", "block", "part"]
    while True:
        told = state.withColumn("kind", F.lit("told"))
        for i, rows in enumerate(always):
            told = told.unionByName(rows.withColumn("kind", F.lit(f"always {i}")))
        heard = told.join(active, ["block", "part"], "left_semi")
        said = _asked(packed, active).groupBy("_block", "_part").cogroup(heard.groupBy("block", "part")).applyInPandas(task, MESSAGE)
        joined = state.join(said.withColumnRenamed("payload", "_new"), key, "full")
        changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("payload"))
        state = cut(joined.select(*key, F.coalesce("_new", "payload").alias("payload"), changed.alias("changed")), "said")
        active = state.filter("changed").select("block", "part").distinct()
        state = state.drop("changed")
        if active.isEmpty():
            return state


def dependencies(links: DataFrame, obs: DataFrame, sources: DataFrame, cells: int = 32768, at_once: int = 6) -> DataFrame:
    """(cell_id, delta): for each cell the sum, over the ``sources`` (cell_id) other than itself, of the shares of shortest paths that run through it.

    ``links`` (src, dst) hold both directions of each edge once.
    """
    kind = dict(links.dtypes)["src"]
    places = cut(blocks_of(links, obs, cells), "places")
    packed = cut(packed_blocks(links, places), "blocks")
    numbered = S.hash_order(sources.distinct().join(places.select("cell_id"), "cell_id", "left_semi"), F.col("cell_id"))
    at = packed.select("block", F.posexplode("own").alias("at", "cell_id")).join(numbered, "cell_id")
    number = at.select("block", F.floor((F.col("slot") - 1) / at_once).alias("part"), ((F.col("slot") - 1) % at_once).alias("slot"), "at")
    begin = number.groupBy("block", "part").applyInPandas(
        lambda key, pdf: pd.DataFrame({"sender": key[0], "block": key[0], "part": key[1], "payload": [np.array([s, c], np.int64).tobytes() for s, c in zip(pdf["slot"], pdf["at"])]}), MESSAGE)
    begin = cut(begin, "sources")

    def opened(left: pd.DataFrame, right: pd.DataFrame, source: str, heard: str) -> _Block:
        block = _Block(left.iloc[0], at_once)
        _listen(block, right[right["kind"] == heard])
        block.follow(_sources(right[right["kind"] == source]))
        return block

    def say(key, block: _Block, payload) -> pd.DataFrame:
        rows = [(key[0], other, key[1], payload(border)) for other in block.near for border in (block.border(other),) if (block.dist[:, border] < FAR).any()]
        return pd.DataFrame(rows, columns=["sender", "block", "part", "payload"])

    def forward(key, left, right):
        if not len(left):
            return pd.DataFrame([], columns=["sender", "block", "part", "payload"])
        block = opened(left, right, "always 0", "told")
        return say(key, block, lambda at: block.dist[:, at].tobytes() + block.count[:, at].tobytes())

    def settled(left, right, told: str) -> _Block:
        block = opened(left, right, "always 0", "always 1")
        rows = right[right["kind"] == told]
        for sender, payload in zip(rows["sender"], rows["payload"]):
            at = block.hears(sender)
            block.delta[:, at] = np.frombuffer(payload).reshape(block.s, len(at))
        block.depend()
        return block

    def backward(key, left, right):
        if not len(left):
            return pd.DataFrame([], columns=["sender", "block", "part", "payload"])
        block = settled(left, right, "told")
        return say(key, block, lambda at: block.delta[:, at].tobytes())

    def summed(key, left, right):
        if not len(left):
            return pd.DataFrame({"cell_id": [], "delta": []})
        block = settled(left, right, "always 2")
        block.delta[block.dist == 0] = 0.0  # a source's own paths begin there
        return pd.DataFrame({"cell_id": left["own"].iloc[0], "delta": block.delta[:, : block.n].sum(0)})

    spark = links.sparkSession
    nothing = spark.createDataFrame([], MESSAGE)
    first = begin.select("block", "part").distinct()
    told = _rounds(packed, nothing, first, forward, [begin])
    every = cut(first.unionByName(told.select("block", "part")).distinct(), "reached")
    depends = _rounds(packed, nothing, every, backward, [begin, told])
    rows = None
    for i, part in enumerate((begin, told, depends)):
        part = part.withColumn("kind", F.lit(f"always {i}"))
        rows = part if rows is None else rows.unionByName(part)
    sums = _asked(packed, every).groupBy("_block", "_part").cogroup(rows.groupBy("block", "part")).applyInPandas(summed, f"cell_id {kind}, delta double")
    return sums.groupBy("cell_id").agg(F.sum("delta").alias("delta"))

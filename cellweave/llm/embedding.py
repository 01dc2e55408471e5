"""Near duplicates of embeddings by an inverted multi-index.

Each half of a unit vector has its own codebook; a pair of nearest centroids is the vector's cell in the
product grid.  A query visits cells in the order of how far its halves would have to move to lie in
them (the distances to the bisecting planes, added in squares), as far as the target recall asks, and
every pair met is verified by its exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import materialize
from cellweave.llm.components import components
from cellweave.llm.simhash import _spanning


def fit_codebook(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of a bounded sample by Lloyd's rounds, begun with evenly spaced rows of the sample."""
    centroids = points[np.linspace(0, len(points) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (-2 * points @ centroids.T + (centroids**2).sum(1)).argmin(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, points)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def reach_of(cosine: float, recall: float, dims: int) -> float:
    """How far beyond a bisecting plane to look for neighbours at ``cosine``.

    A neighbour lies at most sqrt(2 - 2 cosine) away; along any one direction a step of that length has
    about its 1 / sqrt(dims) as deviation.  Recall 1 takes the whole step, which misses nothing.
    """
    step = float(np.sqrt(2 - 2 * cosine))
    return step if recall >= 1 else min(step, step * NormalDist().inv_cdf(recall) / dims**0.5)


def traverse(vectors: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own cell, visiting row, visited cell): multi-sequence traversal of all rows in step.

    Both halves' centroids are sorted by the square of the distance to the bisecting plane; the pairs
    are met along rising ranks until the sum passes ``reach`` squared.  Cells are numbered i * k + j.
    """
    k = len(books[1])
    half, ranks, costs = books[0].shape[1], [], []
    for part, book in ((vectors[:, :half], books[0]), (vectors[:, half:], books[1])):
        d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
        own = d.argmin(1)
        norms, mine = (book**2).sum(1), book[own]
        apart = np.sqrt(np.maximum(norms[own][:, None] + norms - 2 * mine @ book.T, 1e-30))  # from each row's own centroid
        plane = np.maximum(d - d[np.arange(len(d)), own][:, None], 0) / (2 * apart)
        plane[np.arange(len(d)), own] = 0
        order = np.argsort(plane, axis=1, kind="stable")
        ranks.append(order)
        costs.append(np.take_along_axis(plane, order, 1) ** 2)
    own_cell = ranks[0][:, 0] * k + ranks[1][:, 0]
    rows, cells = [], []
    live = np.arange(len(vectors))
    for a in range(costs[0].shape[1]):
        live = live[costs[0][live, a] <= reach**2]
        if not len(live):
            break
        inner = live
        for b in range(k):
            inner = inner[costs[0][inner, a] + costs[1][inner, b] <= reach**2]
            if not len(inner):
                break
            rows.append(inner)
            cells.append(ranks[0][inner, a] * k + ranks[1][inner, b])
    return own_cell, np.concatenate(rows) if rows else live, np.concatenate(cells) if cells else live


def _verify(frames: Iterator[pd.DataFrame], cosine: float, block: int = 1024) -> Iterator[pd.DataFrame]:
    """(id, links, root) of each shard's rows, from rows sorted by shard; a shard is never cut in two."""
    def shard(ids, n, vectors, stored):
        links, a, b = np.zeros(len(ids), np.int64), [], []
        m, q = np.flatnonzero(stored), np.flatnonzero(~stored)
        for rows in (m, q):
            for at in range(0, len(rows), block):
                part = rows[at:at + block]
                x, y = np.nonzero(vectors[part] @ vectors[m].T >= cosine)
                x, y = part[x], m[y]
                if rows is m:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    np.add.at(links, x, n[y])
                    np.add.at(links, y, n[x])
                    x, y = _spanning(x, y)
                    a.append(x)
                    b.append(y)
        root = np.arange(len(ids))
        if a:
            x, y = _spanning(np.concatenate(a), np.concatenate(b))
            root[x] = y
        on = np.flatnonzero(links)
        return ids[on], links[on], ids[root[on]]

    def whole(frame):
        names = frame["shard"].to_numpy()
        ids, n, stored = frame["id"].to_numpy(), frame["n"].to_numpy(), frame["stored"].to_numpy(bool)
        units = frame["unit"].tolist()
        vectors = lambda s, e: np.frombuffer(b"".join(units[s:e]), np.float64).reshape(e - s, -1)  # noqa: E731  a shard holds one length
        ends = np.append(np.flatnonzero(np.diff(names)) + 1, len(names))
        found = [shard(ids[s:e], n[s:e], vectors(s, e), stored[s:e]) for s, e in zip(np.append(0, ends[:-1]), ends, strict=True) if e - s > 1]
        if not found:
            return pd.DataFrame({"id": np.empty(0, np.int64), "links": np.empty(0, np.int64), "root": np.empty(0, np.int64)})
        return pd.DataFrame(dict(zip(("id", "links", "root"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    held = None
    for frame in frames:
        frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame["shard"].to_numpy() == frame["shard"].iloc[-1]
        held = frame[last]
        if not last.all():
            yield whole(frame[~last])
    if held is not None and len(held):
        yield whole(held)


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, recall: float = 0.9999, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
                    sample: int = 20_000, cell_rows: int = 32, shard_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``vectors``.

    Only rows with equal labels that are not null, and of one length, are compared.  Vectors that are
    null, zero, or hold null or non-finite components link with nothing.  The cells are laid over the most
    frequent length; of other vectors the first so many components (zeros beyond the end) choose the
    cell, which brings no two of them farther apart, and whole vectors are compared.
    Equal vectors of a label are folded into one with a count, and all linked with each other.  The
    codebooks are fitted on at most ``sample`` vectors (those of the smallest hashes) and have about
    sqrt(rows / ``cell_rows``) centroids each; every row is indexed.  A cell with more than
    ``shard_rows`` vectors is split, and its queries visit all parts.  ``recall`` 1 finds every link.
    ``component_id`` is the smallest vec_id that links reach; rows with a null vec_id take part.
    """
    value = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), value.alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(finite & F.col("label").isNotNull(), F.lit(False))
    rows = materialize(rows.withColumn("valid", valid))
    usual = rows.filter("valid").groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
    dims = usual["dims"] if usual else 0
    good = F.col("valid")
    classes = rows.filter(good).groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least")).withColumn("id", F.monotonically_increasing_id())
    classes = materialize(classes)
    taught = [r["v"] for r in classes.filter(F.size("v") == dims).orderBy(F.xxhash64("v"), "id").limit(sample).select("v").collect()]
    if not taught:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    points = np.array(taught)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    k = max(1, min(len(points), round((classes.count() / cell_rows) ** 0.5)))
    half = max(1, dims // 2)
    books = (fit_codebook(points[:, :half], k), fit_codebook(points[:, half:], k) if dims > 1 else np.zeros((1, 0)))
    reach = reach_of(cosine, recall, dims)

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            units = [np.asarray(v, float) / np.linalg.norm(v) for v in frame["v"]]
            laid = np.zeros((len(units), dims))
            for to, unit in zip(laid, units):
                to[:len(unit)] = unit[:dims]
            own, row, cell = traverse(laid, books, reach)
            later = cell > own[row]  # a pair of cells is visited from the lower one
            row, cell = np.concatenate([np.arange(len(own)), row[later]]), np.concatenate([own, cell[later]])
            bytes_of = np.array([u.tobytes() for u in units], dtype=object)
            yield pd.DataFrame({"id": frame["id"].to_numpy()[row], "label": frame["label"].to_numpy()[row], "size": frame["size"].to_numpy()[row], "n": frame["n"].to_numpy()[row],
                                "cell": cell, "home": np.arange(len(row)) < len(own), "unit": bytes_of[row]})

    kind = classes.schema["label"].dataType.simpleString()
    indexed = materialize(classes.select("id", "label", F.size("v").alias("size"), "n", "v").mapInPandas(index, f"id long, label {kind}, size int, n long, cell long, home boolean, unit binary"))
    cells = indexed.groupBy("label", "size", "cell").agg(F.sum(F.col("home").cast("int")).alias("stored"), F.count(F.lit(1)).alias("all"))
    cells = cells.filter("stored > 0 and all > 1").select("label", "size", "cell", F.ceil(F.col("stored") / shard_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    parts = F.when(F.col("home"), F.sequence(own, F.col("parts") - 1)).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = indexed.join(cells, ["label", "size", "cell"]).withColumn("own", own).withColumn("part", F.explode(parts)).select(
        F.xxhash64("label", "size", "cell", "part").alias("shard"), "id", "n", (F.col("home") & (F.col("part") == F.col("own"))).alias("stored"), "unit")
    found = dealt.repartition("shard").sortWithinPartitions("shard").mapInPandas(lambda frames: _verify(frames, cosine), "id long, links long, root long")
    found = materialize(found)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.select("id", "label", "v", "n", "least").join(links, "id", "left").join(roots, F.col("id") == F.col("node"), "left")
    known = materialize(known.select("label", "v", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"), "least"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(named, "root").select("label", "v", "n_links", "component_id")
    linked = rows.filter(good).join(known, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))

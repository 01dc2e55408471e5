"""Neighbour joins and graph construction.

All graphs are directed edge tables ``edges(src, dst, dist[, rank, weight])``.

Planar kNN is an exact, skew-safe grid join.  Points at one place are first
folded to a *site*, which keeps only its k + 1 smallest ids: no other copy can
be among anyone's k nearest under the (distance, id) order.  Sites are looked
up from the finest grid to coarser ones.  A site unresolved at one grid has
fewer than k + 1 ids within that cell size, so a coarser cell holds only a
bounded number of unresolved sites and the candidate pairs stay linear in the
number of sites, however dense a spot is.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.session import materialize

GRID_STEP = 4.0
TARGET_PER_CELL = 4.0
MAX_PER_CELL = 64
MAX_REFINEMENTS = 12


def _sites(points: DataFrame, by: list[str], keep: int) -> DataFrame:
    """One row per distinct place with the ``keep`` smallest ids there."""
    w = Window.partitionBy(*by, "x", "y").orderBy("cell_id")
    first = points.select(*by, "x", "y", "cell_id").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    return first.groupBy(*by, "x", "y").agg(F.array_sort(F.collect_list("cell_id")).alias("ids"))  # at most keep ids


def _with_cell(df: DataFrame, size: float) -> DataFrame:
    return df.withColumn("gx", F.floor(F.col("x") / size)).withColumn("gy", F.floor(F.col("y") / size))


def _ring(df: DataFrame) -> DataFrame:
    """Nine rows per site: its own grid cell and the eight around it."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    return df.withColumn("_o", F.explode(offsets)).withColumn("gx", F.col("gx") + F.col("_o.i")).withColumn("gy", F.col("gy") + F.col("_o.j")).drop("_o")


def _grid_sizes(sites: DataFrame, by: list[str], k: int) -> list[float]:
    """Grid sizes from fine to coarse, chosen from the data's extent and densest cell."""
    box = sites.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count(F.lit(1))).first()
    if not box[4]:
        return [1.0]
    span = max(box[1] - box[0], box[3] - box[2]) or 1.0
    area = max(box[1] - box[0], span * 1e-9) * max(box[3] - box[2], span * 1e-9)
    size = min(span, max(math.sqrt(area / box[4] * max(TARGET_PER_CELL, k / 3.0)), span * 1e-12))
    sizes = [size]
    for _ in range(MAX_REFINEMENTS):
        densest = _with_cell(sites, sizes[0]).groupBy(*by, "gx", "gy").count().agg(F.max("count")).first()[0]
        if densest <= max(MAX_PER_CELL, 8 * k) or sizes[0] < span * 1e-12:
            break
        sizes.insert(0, sizes[0] / GRID_STEP)
    while sizes[-1] < span:
        sizes.append(sizes[-1] * GRID_STEP)
    sizes.append(sizes[-1] * GRID_STEP)
    return sizes


def knn_join(queries: DataFrame, points: DataFrame, k: int, by: Sequence[str] = (), exclude_self: bool = True) -> DataFrame:
    """Exact k nearest ``points`` of every query: (src, dst, dist, rank), ties by id.

    ``queries`` and ``points`` hold (cell_id, x, y, *by); neighbours share the
    ``by`` values.  With ``exclude_self`` a point never matches its own id.
    """
    by = list(by)
    need = k + 1 if exclude_self else k
    sites = materialize(_sites(points, by, need))
    sizes = _grid_sizes(sites, by, k)
    open_places = sites.select(*by, "x", "y") if queries is points else materialize(queries.select(*by, "x", "y").distinct())
    found = None
    for i, size in enumerate(sizes):
        last = i == len(sizes) - 1
        cell = _with_cell(sites.withColumnRenamed("x", "sx").withColumnRenamed("y", "sy").withColumn("x", F.col("sx")).withColumn("y", F.col("sy")), size).drop("x", "y")
        around = _ring(_with_cell(open_places, size))
        d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
        pairs = around.join(cell, [*by, "gx", "gy"]).select(*by, "x", "y", "ids", d2.alias("d2"))
        # The nearest `need` sites always cover the nearest `need` ids.
        w = Window.partitionBy(*by, "x", "y").orderBy("d2", F.element_at("ids", 1))
        near = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= need)
        ids = near.select(*by, "x", "y", "d2", F.explode("ids").alias("dst"))
        wi = Window.partitionBy(*by, "x", "y").orderBy("d2", "dst")
        ids = ids.withColumn("_r", F.row_number().over(wi)).filter(F.col("_r") <= need)
        # A hit is certain only inside the searched ring.
        border = F.least(
            F.col("x") - (F.floor(F.col("x") / size) - 1) * size, (F.floor(F.col("x") / size) + 2) * size - F.col("x"),
            F.col("y") - (F.floor(F.col("y") / size) - 1) * size, (F.floor(F.col("y") / size) + 2) * size - F.col("y"),
        )
        lists = ids.groupBy(*by, "x", "y").agg(F.array_sort(F.collect_list(F.struct("d2", "dst"))).alias("hits"))  # at most `need`
        full = (F.size("hits") >= need) & (F.element_at("hits", -1)["d2"] < border * border)
        solved = lists if last else lists.filter(full)
        solved = materialize(solved)
        found = solved if found is None else found.unionByName(solved)
        if last:
            break
        open_places = materialize(open_places.join(solved.select(*by, "x", "y"), [*by, "x", "y"], "left_anti"))
        if open_places.isEmpty():
            break
    hits = queries.select(*by, "x", "y", F.col("cell_id").alias("src")).join(found, [*by, "x", "y"])
    if exclude_self:
        hits = hits.withColumn("hits", F.filter("hits", lambda h: h["dst"] != F.col("src")))
    return hits.select(*by, "src", F.posexplode(F.slice("hits", 1, k)).alias("_p", "_h")).select(
        *by, "src", F.col("_h.dst").alias("dst"), F.sqrt("_h.d2").alias("dist"), (F.col("_p") + 1).cast("long").alias("rank")
    )


def knn_spatial(obs: DataFrame, k: int = 6, by: Sequence[str] = (), include_self: bool = False) -> DataFrame:
    """k nearest cells in the plane; ``include_self`` counts the cell itself as its first neighbour."""
    points = obs.select("cell_id", "x", "y", *by)
    if not include_self:
        return knn_join(points, points, k, by)
    others = knn_join(points, points, k - 1, by).withColumn("rank", F.col("rank") + 1)
    own = obs.select(*by, F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(0.0).alias("dist"), F.lit(1).cast("long").alias("rank"))
    return others.unionByName(own)


def grid_neighbors(obs: DataFrame, n_rings: int = 1, layout: str = "hex") -> DataFrame:
    """Neighbours on an array layout (array_row, array_col); rings by repeated offset joins."""
    # Offsets of the six hexagonal and four square neighbours.
    offsets = {"hex": [(0, -2), (0, 2), (-1, -1), (-1, 1), (1, -1), (1, 1)], "square": [(0, -1), (0, 1), (-1, 0), (1, 0)]}[layout]
    shifts = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in offsets])
    at = obs.select(F.col("cell_id").alias("dst"), "array_row", "array_col")
    reach = obs.select(F.col("cell_id").alias("src"), "array_row", "array_col")
    rings = None
    for ring in range(1, n_rings + 1):
        reach = reach.select("src", "array_row", "array_col", F.explode(shifts).alias("o")).select(
            "src", (F.col("array_row") + F.col("o.r")).alias("array_row"), (F.col("array_col") + F.col("o.c")).alias("array_col")
        ).distinct()
        hit = reach.join(at, ["array_row", "array_col"]).filter("src <> dst").select("src", "dst", F.lit(ring).alias("ring"))
        rings = hit if rings is None else rings.unionByName(hit)
    return rings.groupBy("src", "dst").agg(F.min("ring").alias("ring")).withColumn("weight", F.lit(1.0))


def radius_graph(obs: DataFrame, radius: float, max_neighbors: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """All ordered pairs within ``radius``; optionally only the nearest ``max_neighbors`` of each.

    The output itself holds every pair in range.  With ``max_neighbors`` the
    bounded kNN join does the work, so a dense spot never produces all its pairs.
    """
    if max_neighbors is not None:
        return knn_spatial(obs, max_neighbors, by).filter(F.col("dist") <= radius)
    by = list(by)
    right = _with_cell(obs.select(*by, "cell_id", "x", "y"), radius).select(*by, "gx", "gy", F.col("cell_id").alias("dst"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    left = _ring(_with_cell(obs.select(*by, F.col("cell_id").alias("src"), "x", "y"), radius))
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    return left.join(right, [*by, "gx", "gy"]).filter((F.col("src") != F.col("dst")) & (d2 <= radius * radius)).select(*by, "src", "dst", F.sqrt(d2).alias("dist"))


# --------------------------------------------------------------- embedding kNN
MAX_PIVOTS = 256


def _fold(embedding: DataFrame, keep: int, cosine: bool, by: list[str]) -> DataFrame:
    """Distinct vectors with the ``keep`` smallest ids of each; unit length for cosine."""
    rows = _fold_keys(embedding, cosine, by)
    w = Window.partitionBy("vec", *by).orderBy("cell_id")
    first = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep)
    return first.groupBy("vec", *by).agg(F.array_sort(F.collect_list("cell_id")).alias("ids"))  # at most `keep`


def _blocks(folded: DataFrame, pivots: np.ndarray, rows: int, extra: list[str]) -> DataFrame:
    """Vectors packed into blocks of at most ``rows`` that share their closest pivot."""

    def assign(batches):
        for pdf in batches:
            mat = np.stack(pdf["vec"].to_numpy()).astype(float)
            d = (mat * mat).sum(1)[:, None] - 2 * mat @ pivots.T + (pivots * pivots).sum(1)[None, :]
            pdf["pivot"] = d.argmin(1).astype("int32")
            pdf["reach"] = np.sqrt(((mat - pivots[pdf["pivot"].to_numpy()]) ** 2).sum(1))
            yield pdf

    types = dict(folded.dtypes)
    columns = ["vec", *extra, "ids"]
    schema = ", ".join(f"{c} {types[c]}" for c in columns) + ", pivot int, reach double"
    keyed = folded.select(*columns).mapInPandas(assign, schema)
    slots = S.hash_order(keyed, F.concat_ws("-", F.lit("block"), F.element_at("ids", 1)), by=["pivot", *extra])
    grouped = slots.withColumn("block", F.floor((F.col("slot") - 1) / rows)).groupBy("pivot", *extra, "block").agg(
        F.collect_list(F.struct("ids", "vec")).alias("rows"), F.max("reach").alias("reach")  # at most `rows` entries
    )
    return grouped.withColumn("block_id", F.concat_ws("/", "pivot", *[F.col(c).cast("string") for c in extra], "block"))


#: Blocks on a side of a tile at most, and tiles on a side that smaller inputs are still dealt to.
MAX_TILE = 64
MIN_TILES = 8


def _tiled(info: DataFrame, pivots: np.ndarray, out: str) -> DataFrame:
    """Add ``out``: runs of at most ``MAX_TILE`` blocks, pivots taken along their main direction."""
    blocks = {r["pivot"]: r["_n"] for r in info.groupBy("pivot").agg((F.max("block") + 1).alias("_n")).collect()}  # one per pivot
    if not blocks:
        return info.withColumn(out, F.lit(0).cast("long"))
    along = pivots @ np.linalg.svd(pivots - pivots.mean(0), full_matrices=False)[2][0]
    order = sorted(blocks, key=lambda p: along[p])
    starts = dict(zip(order, np.cumsum([0, *(blocks[p] for p in order)]).tolist()))
    size = min(MAX_TILE, max(1, math.ceil(sum(blocks.values()) / MIN_TILES)))
    start = F.element_at(F.create_map(*[F.lit(x) for item in starts.items() for x in item]), F.col("pivot"))
    return info.withColumn(out, F.floor((start + F.col("block")) / size))


def _unpack(packed: pa.ListScalar) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ids of a block's vectors in one array, how many each vector has, and the vectors as a matrix."""
    rows = packed.values
    ids, vec = rows.field("ids"), rows.field("vec")
    mat = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vec), -1)
    return ids.flatten(), pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64), mat


def _first(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of the sorted ``keys`` are among the first ``n`` equal ones."""
    new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    return np.arange(len(keys)) - starts[np.cumsum(new) - 1] < n


def _match_tile(queries: pa.Table, points: pa.Table, need: int, by: dict[str, pa.Scalar]) -> pa.Table:
    """(qid, dst, d2, by): the ``need`` closest points of each row of the query blocks, among the point blocks each of them asks for.

    A row keeps its ``need`` best vectors by (distance, smallest id) from block to block; only what
    could be closer than its last one is looked at exactly.
    """
    found = [_unpack(p) for p in points["p_rows"]]
    ids = pa.concat_arrays([f[0] for f in found])
    codes = np.unique(ids.to_numpy(zero_copy_only=False), return_inverse=True)[1]  # order of the ids
    counts = np.concatenate([f[1] for f in found])
    begins = np.cumsum(counts) - counts
    rows_before = np.cumsum([0, *(len(f[1]) for f in found)])
    place = {b: i for i, b in enumerate(points["pb"].to_pylist())}
    squares = [(f[2] * f[2]).sum(1) for f in found]
    qids, dsts, dists = [], [], []
    for packed, asked in zip(queries["q_rows"], queries["pbs"].to_pylist()):
        q_ids, q_counts, a = _unpack(packed)
        aa = (a * a).sum(1)
        q, p, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        cut = np.full(len(a), np.inf)
        for i in sorted(place[b] for b in asked):
            b = found[i][2]
            d2 = aa[:, None] - 2 * a @ b.T + squares[i][None, :]
            slack = 1e-9 * max(1.0, *(x[np.isfinite(x)].max(initial=0.0) for x in (aa, squares[i])))  # near-ties stay in until exact distances and ids settle them
            if len(b) >= need and np.isinf(cut).any():
                cut = np.minimum(cut, np.partition(d2, need - 1, axis=1)[:, need - 1] + slack)
            qi, pj = np.nonzero(d2 <= cut[:, None] + slack)
            exact = np.concatenate([np.zeros(0), *(((a[qi[s : s + 65536]] - b[pj[s : s + 65536]]) ** 2).sum(1) for s in range(0, len(qi), 65536))])
            q, p, d = np.concatenate([q, qi]), np.concatenate([p, pj + rows_before[i]]), np.concatenate([d, exact])
            order = np.lexsort((codes[begins[p]], d, q))
            order = order[_first(q[order], need)]
            q, p, d = q[order], p[order], d[order]
            full = np.flatnonzero(np.bincount(q, minlength=len(a)) >= need)
            cut[full] = d[np.searchsorted(q, full, "right") - 1]
        n = counts[p]
        flat = np.repeat(begins[p] - np.cumsum(n) + n, n) + np.arange(n.sum())  # every id of the vectors left
        q, d = np.repeat(q, n), np.repeat(d, n)
        order = np.lexsort((codes[flat], d, q))
        order = order[_first(q[order], need)]
        qids.append(q_ids.take(pa.array((np.cumsum(q_counts) - q_counts)[q[order]])))
        dsts.append(ids.take(pa.array(flat[order])))
        dists.append(pa.array(d[order]))
    out = {"qid": pa.concat_arrays(qids), "dst": pa.concat_arrays(dsts), "d2": pa.concat_arrays(dists)}
    return pa.table(out | {c: pa.repeat(v, len(out["d2"])) for c, v in by.items()})


def knn_embedding(
    queries: DataFrame, points: DataFrame | None = None, k: int = 15, metric: str = "euclidean",
    by: Sequence[str] = (), rows: int = 1024, n_pivots: int | None = None, seed: int = 42,
) -> DataFrame:
    """Exact kNN on embeddings (cell_id, vec): (src, dst, dist, rank[, by]), ties by id.

    Copies of a vector are folded first (only the k + 1 smallest ids of each can
    matter), then vectors are packed into bounded blocks around sampled pivots.
    One block of the own pivot bounds each query block's k-th distance; further
    blocks are joined only where the triangle inequality, first on pivots and
    then on blocks, leaves room for a closer hit.  Pairs of blocks are dealt to
    tiles of at most ``MAX_TILE`` blocks a side: a block is sent once to each tile
    that needs it, a pair is one matrix product, and only a row's k best hits
    leave the tile.  Without ``points`` a cell never matches itself.  ``by`` asks for k neighbours per value of those
    columns of ``points``.
    """
    self_join = points is None
    points = queries if self_join else points
    by = list(by)
    cosine = metric == "cosine"
    need = k + 1 if self_join else k
    query_fold = materialize(_fold(queries, need, cosine, []))
    point_fold = query_fold if self_join and not by else materialize(_fold(points, need, cosine, by))
    if n_pivots is None:
        n_pivots = int(min(MAX_PIVOTS, max(1, math.sqrt(point_fold.count() / rows) * 2)))
    sample = point_fold.select("vec", F.xxhash64(F.element_at("ids", 1), F.lit(seed)).alias("_h")).orderBy("_h").limit(n_pivots).collect()
    pivots = np.array([r["vec"] for r in sample], float)  # at most MAX_PIVOTS vectors
    query_blocks = materialize(_blocks(query_fold, pivots, rows, []))
    point_blocks = query_blocks if self_join and not by else materialize(_blocks(point_fold, pivots, rows, by))
    types = dict(point_fold.dtypes)
    by_fields = "".join(f", {c} {types[c]}" for c in by)
    id_type = types["ids"][len("array<"):-1]

    def summarise(blocks: DataFrame, extra: list[str]) -> DataFrame:
        def measure(batches):
            for pdf in batches:
                mats = [np.stack([r["vec"] for r in packed]).astype(float) for packed in pdf["rows"]]
                out = pdf[["block_id", "pivot", "block", "reach", *extra]].copy()
                centres = [m.mean(0) for m in mats]
                out["centre"] = [c.tolist() for c in centres]
                out["radius"] = [float(np.sqrt(((m - c) ** 2).sum(1).max())) for m, c in zip(mats, centres)]
                yield out
        fields = "".join(f", {c} {types[c]}" for c in extra)
        return blocks.mapInPandas(measure, f"block_id string, pivot int, block long, reach double{fields}, centre array<double>, radius double")

    qid_type = dict(query_fold.dtypes)["ids"][len("array<"):-1]
    best_first = Window.partitionBy("qid", *by).orderBy("d2", "dst")
    tile = ["q_tile", "p_tile", *by]

    def run(pairs: DataFrame) -> DataFrame:
        """The ``need`` best hits of each query row in every tile of block pairs; a tile gets a block once, whatever pairs it is in."""
        asked = pairs.groupBy(*tile, "qb").agg(F.collect_list("pb").alias("pbs"))  # at most MAX_TILE blocks
        left = asked.join(query_blocks.select(F.col("block_id").alias("qb"), F.col("rows").alias("q_rows")), "qb").select(*tile, "pbs", "q_rows")
        given = pairs.select(*[F.col(c).alias(f"_{c}") for c in tile], "pb").distinct()
        right = given.join(point_blocks.select(F.col("block_id").alias("pb"), F.col("rows").alias("p_rows")), "pb").select(*[f"_{c}" for c in tile], "pb", "p_rows")
        match = lambda key, q, p: _match_tile(q, p, need, dict(zip(by, key[2:])))
        hits = left.groupBy(*tile).cogroup(right.groupBy(*[f"_{c}" for c in tile])).applyInArrow(match, f"qid {qid_type}, dst {id_type}, d2 double{by_fields}")
        return hits.withColumn("_r", F.row_number().over(best_first)).filter(F.col("_r") <= need).drop("_r")

    q_info = _tiled(materialize(summarise(query_blocks, [])), pivots, "q_tile")
    p_info = _tiled(materialize(summarise(point_blocks, by)), pivots, "p_tile")
    per_pivot = p_info.groupBy("pivot", *by).agg(F.count(F.lit(1)).alias("_blocks"))
    own = materialize(
        q_info.select("pivot", F.col("block_id").alias("qb"), F.col("block").alias("_q"), "q_tile").join(per_pivot, "pivot")
        .withColumn("block", F.col("_q") % F.col("_blocks"))
        .join(p_info.select("pivot", *by, "block", F.col("block_id").alias("pb"), "p_tile"), ["pivot", *by, "block"])
        .select("qb", "pb", *tile)
    )
    first = materialize(run(own))
    # A block's bound is its worst k-th distance; unbounded while a row lacks hits.
    members = query_blocks.select(F.col("block_id").alias("qb"), F.explode("rows.ids").alias("_ids")).select("qb", F.element_at("_ids", 1).alias("qid"))
    if by:
        kinds = p_info.agg(F.collect_set(F.struct(*by)).alias("_kinds"))  # one row: the batches
        members = members.crossJoin(kinds).select("qb", "qid", F.explode("_kinds").alias("_b")).select("qb", "qid", "_b.*")
    kth = first.groupBy("qid", *by).agg(F.count(F.lit(1)).alias("_n"), F.max("d2").alias("_worst"))
    bound = members.join(kth, ["qid", *by], "left").groupBy("qb", *by).agg(
        F.max(F.when(F.col("_n") >= need, F.sqrt(F.greatest("_worst", F.lit(0.0)))).otherwise(F.lit(float("inf")))).alias("bound")
    )
    radii = {r["pivot"]: r["_far"] for r in p_info.groupBy("pivot").agg(F.max("reach").alias("_far")).collect()}  # one per pivot

    def reachable(batches):
        for pdf in batches:
            centre = np.stack(pdf["centre"].to_numpy())
            gap = np.sqrt(np.maximum((centre * centre).sum(1)[:, None] - 2 * centre @ pivots.T + (pivots * pivots).sum(1)[None, :], 0))
            for p, far in radii.items():
                pdf[f"_{p}"] = gap[:, p] - pdf["radius"].to_numpy() - far <= pdf["bound"].to_numpy() + 1e-6
            pdf["pivot"] = [[p for p in radii if row[f"_{p}"]] for _, row in pdf.iterrows()]
            yield pdf[["qb", "q_tile", *by, "centre", "radius", "bound", "pivot"]].explode("pivot").dropna(subset=["pivot"]).astype({"pivot": "int32"})

    open_pivots = (
        q_info.select(F.col("block_id").alias("qb"), "q_tile", "centre", "radius").join(bound, "qb")
        .mapInPandas(reachable, f"qb string, q_tile long{by_fields}, centre array<double>, radius double, bound double, pivot int")
        .withColumnsRenamed({"centre": "qc", "radius": "qr"})
    )
    gap = F.sqrt(F.aggregate(F.zip_with("qc", "centre", lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda t, x: t + x))
    rest = (
        open_pivots.join(p_info.select("pivot", *by, F.col("block_id").alias("pb"), "p_tile", "centre", "radius"), ["pivot", *by])
        .filter(gap - F.col("qr") - F.col("radius") <= F.col("bound") + 1e-6)
        .select("qb", "pb", *tile).join(own, ["qb", "pb"], "left_anti")
    )
    merged = first.unionByName(run(rest)).withColumn("_r", F.row_number().over(best_first)).filter(F.col("_r") <= need)
    lists = merged.groupBy("qid", *by).agg(F.array_sort(F.collect_list(F.struct("d2", "dst"))).alias("hits"))  # at most `need`
    # Back from folded vectors to every query id.
    keys = query_fold.select("vec", F.element_at("ids", 1).alias("qid"))
    flat = _fold_keys(queries, cosine)
    hits = flat.join(keys, "vec").select(F.col("cell_id").alias("src"), "qid").join(lists, "qid")
    if self_join:
        hits = hits.withColumn("hits", F.filter("hits", lambda h: h["dst"] != F.col("src")))
    dist = F.col("_h.d2") / 2.0 if cosine else F.sqrt("_h.d2")
    return hits.select("src", *by, F.posexplode(F.slice("hits", 1, k)).alias("_p", "_h")).select(
        "src", F.col("_h.dst").alias("dst"), dist.alias("dist"), (F.col("_p") + 1).cast("long").alias("rank"), *by
    )


def _fold_keys(embedding: DataFrame, cosine: bool, by: Sequence[str] = ()) -> DataFrame:
    """Vectors as doubles, scaled to unit length for cosine."""
    rows = embedding.select("cell_id", F.col("vec").cast("array<double>").alias("vec"), *by)
    if cosine:
        rows = rows.withColumn("_n", F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))
        rows = rows.withColumn("vec", F.transform("vec", lambda x: F.when(F.col("_n") > 0, x / F.col("_n")).otherwise(x))).drop("_n")
    return rows


# ------------------------------------------------------------- neighbourhood sums
#: Expanded (link, gene) entries that a task holds at a time.
ENTRIES = 2_000_000


def place_blocks(places: DataFrame, cells: int, square: bool = False) -> DataFrame:
    """(cell_id, block): about ``cells`` neighbouring cells a block, by strips of x cut along y; copies of a place are dealt by id.

    ``square`` takes the strips as wide as their blocks are high, also where the whole is long and narrow.
    """
    spots = places.groupBy("cell_id").agg(F.min(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("_p"))
    spots = spots.select("cell_id", "_p.x", "_p.y").filter("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)")
    n = spots.count()
    strip = max(1, int(math.sqrt(n * cells)))
    if square and n:
        box = spots.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        wide, high = max(box[1] - box[0], 1e-300), max(box[3] - box[2], 1e-300)
        strip = math.ceil(n / max(1, round(min(math.sqrt(n / cells * wide / high), n / cells))))
    x = S.cumulative_counts(spots, [], "x").select("x", F.floor(F.col("n_before") / strip).alias("_s"))
    spots = spots.join(x, "x")
    y = S.cumulative_counts(spots, ["_s"], "y").select("_s", "y", F.floor(F.col("n_before") / cells).alias("_b"), F.ceil(F.col("n_ties") / cells).alias("_n"))
    return spots.join(y, ["_s", "y"]).select("cell_id", F.xxhash64("_s", "_b", F.pmod(F.xxhash64("cell_id"), F.col("_n"))).alias("block"))


def neighborhood_sums(
    links: DataFrame, expr: DataFrame, values: Sequence[str], places: DataFrame | None = None, mean: bool = False, cells: int = 512,
) -> DataFrame:
    """(src, gene_id, *values): sums of the sparse rows of every ``src``'s neighbours, times the links' ``weight`` if there is one.

    ``mean`` divides by the weights of all links of the cell.  Cells are dealt to blocks, with ``places(cell_id, x, y)``
    to such of neighbouring cells; a cell's rows are sent once to each block that needs them, not once a link.
    """
    weighted = "weight" in links.columns
    rows = links.select("src", "dst", (F.col("weight") if weighted else F.lit(1.0)).cast("double").alias("weight")).filter("src IS NOT NULL")
    spare = F.xxhash64(F.xxhash64("src") % 4096)
    if places is None:
        rows = rows.withColumn("block", spare)
    else:
        blocks = place_blocks(places, cells).withColumnRenamed("cell_id", "src")
        rows = rows.join(blocks, "src", "left").withColumn("block", F.coalesce("block", spare))
    rows = materialize(rows.select("block", "src", "dst", "weight"))
    needed = rows.select(F.col("block").alias("_block"), F.col("dst").alias("cell_id")).distinct()
    near = needed.join(expr.select("cell_id", "gene_id", *[F.col(v).cast("double").alias(v) for v in values]), "cell_id")
    types = dict(links.dtypes) | dict(near.dtypes)
    out = f"src {types['src']}, gene_id {types['gene_id']}, " + ", ".join(f"{v} double" for v in values)
    return rows.groupBy("block").cogroup(near.groupBy("_block")).applyInArrow(lambda left, right: _sum_block(left, right, list(values), mean), out)


def _numbers(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values, 0 for null, and which of them are known."""
    return column.fill_null(0.0).to_numpy().astype(float), ~column.is_null().to_numpy().astype(bool)


def _sum_block(links: pa.Table, rows: pa.Table, values: list[str], mean: bool) -> pa.Table:
    """The sums of one block; cells are taken by as many as have ``ENTRIES`` entries."""
    code = lambda c: c.combine_chunks().dictionary_encode("encode")
    src, gene = code(links["src"]), code(rows["gene_id"])
    ends = code(pa.chunked_array([*links["dst"].chunks, *rows["cell_id"].cast(links["dst"].type).chunks], links["dst"].type)).indices.to_numpy()
    order = np.argsort(src.indices.to_numpy(), kind="stable")
    s, d = src.indices.to_numpy()[order], ends[: len(links)][order]
    weight, known = (x[order] for x in _numbers(links["weight"]))
    by_cell = np.argsort(ends[len(links) :], kind="stable")
    counts = np.bincount(ends[len(links) :], minlength=len(ends) + 1)
    begins = np.cumsum(counts) - counts
    genes, numbers = gene.indices.to_numpy()[by_cell], {v: tuple(x[by_cell] for x in _numbers(rows[v])) for v in values}
    n = counts[d]
    cell_starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    total = np.add.reduceat(np.where(known, weight, 0.0), cell_starts) if len(s) else np.zeros(0)
    piece = (np.cumsum(n) - n)[cell_starts] // ENTRIES
    cuts = [*cell_starts[np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])], len(s)] if len(s) else []
    keys, sums = [], {v: [] for v in values}
    for a, b in zip(cuts, cuts[1:]):
        m = n[a:b]
        flat = np.repeat(begins[d[a:b]] - np.cumsum(m) + m, m) + np.arange(m.sum())
        key, at = np.unique(np.repeat(s[a:b].astype(np.int64), m) * len(gene.dictionary) + genes[flat], return_inverse=True)
        w, w_known = np.repeat(weight[a:b], m), np.repeat(known[a:b], m)
        keys.append(key)
        for v, (x, x_known) in numbers.items():
            ok = w_known & x_known[flat]
            found = np.bincount(at, np.where(ok, w * x[flat], 0.0), len(key))
            if mean:
                found = found / total[key // len(gene.dictionary)]
            sums[v].append(pa.array(found, mask=np.bincount(at, ok, len(key)) == 0))
    key = np.concatenate([np.zeros(0, np.int64), *keys])
    take = lambda names, at: names.take(pa.array(at))
    size = max(1, len(gene.dictionary))
    return pa.table({"src": take(src.dictionary, key // size), "gene_id": take(gene.dictionary, key % size)}
                    | {v: pa.concat_arrays(sums[v]) if sums[v] else pa.array([], pa.float64()) for v in values})


# ------------------------------------------------------------------ graph algebra
def symmetrize(edges: DataFrame, weight: str = "weight") -> DataFrame:
    """Both directions of every edge with the larger weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)
    return edges.select("src", "dst", weight).unionByName(back).groupBy("src", "dst").agg(F.max(weight).alias(weight))


def row_normalize(edges: DataFrame, obs: DataFrame | None = None, weight: str = "weight") -> DataFrame:
    """Weights summing to 1 per source; cells without edges get a weight-0 self edge."""
    total = edges.groupBy("src").agg(F.sum(weight).alias("_t"))
    out = edges.join(total, "src").select("src", "dst", F.when(F.col("_t") != 0, F.col(weight) / F.col("_t")).otherwise(0.0).alias(weight))
    if obs is None:
        return out
    lonely = obs.select(F.col("cell_id").alias("src")).join(edges.select("src"), "src", "left_anti")
    return out.unionByName(lonely.select("src", F.col("src").alias("dst"), F.lit(0.0).alias(weight)))


def combine_graphs(expression: DataFrame, spatial: DataFrame, w: float = 0.3) -> DataFrame:
    """(1 - w) * expression graph + w * spatial graph."""
    both = expression.select("src", "dst", (F.col("weight") * (1.0 - w)).alias("weight")).unionByName(
        spatial.select("src", "dst", (F.col("weight") * w).alias("weight"))
    )
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def gcn_normalize(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """Self edges added, then each weight over the root of both row sums."""
    own = obs.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("weight"))
    full = edges.select("src", "dst", "weight").unionByName(own).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
    degree = full.groupBy("src").agg(F.sum("weight").alias("_d"))
    return (
        full.join(degree.withColumnRenamed("_d", "_ds"), "src")
        .join(degree.select(F.col("src").alias("dst"), F.col("_d").alias("_dd")), "dst")
        .select("src", "dst", (F.col("weight") / F.sqrt("_ds") / F.sqrt("_dd")).alias("weight"))
    )


def similarity_weight(edges: DataFrame, embedding: DataFrame, metric: str = "cosine", image: DataFrame | None = None) -> DataFrame:
    """Similarity of the two ends, computed on the given spatial edges only; negatives become 0.

    An optional second embedding multiplies in, e.g. image features.
    """

    def similarity(a, b):
        dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        if metric == "correlation":
            mean = lambda u: F.aggregate(u, F.lit(0.0), lambda s, x: s + x) / F.size(u)
            ma, mb = mean(a), mean(b)
            cov = dot(a, b) - F.size(a) * ma * mb
            return cov / F.sqrt((dot(a, a) - F.size(a) * ma * ma) * (dot(b, b) - F.size(b) * mb * mb))
        return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

    out = edges.select("src", "dst").withColumn("weight", F.lit(1.0))
    for table in [embedding] + ([image] if image is not None else []):
        vec = F.col("vec").cast("array<double>")
        left = table.select(F.col("cell_id").alias("src"), vec.alias("_a"))
        right = table.select(F.col("cell_id").alias("dst"), vec.alias("_b"))
        joined = out.join(left, "src").join(right, "dst")
        s = similarity(F.col("_a"), F.col("_b"))
        out = joined.select("src", "dst", (F.col("weight") * F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0))).alias("weight"))
    return out


def top_weight_neighbors(edges: DataFrame, k: int = 4) -> DataFrame:
    """The k heaviest neighbours per source, renormalised when their sum is positive."""
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    best = edges.select("src", "dst", "weight").withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r")
    total = F.sum("weight").over(Window.partitionBy("src"))
    return best.withColumn("weight", F.when(total > 0, F.col("weight") / total).otherwise(F.col("weight")))


def bbknn(embedding: DataFrame, batch: str = "batch", k: int = 3, metric: str = "euclidean") -> DataFrame:
    """k neighbours from each batch for every cell (the cell itself left out)."""
    named = embedding.select("cell_id", "vec", batch)
    found = knn_embedding(named.select("cell_id", "vec"), named, k + 1, metric, by=[batch])
    w = Window.partitionBy("src", batch).orderBy("dist", "dst")
    return found.filter("src <> dst").withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def mnn_pairs(a: DataFrame, b: DataFrame, k: int = 20, metric: str = "cosine") -> DataFrame:
    """Pairs that are among each other's k nearest across the two sets."""
    there = knn_embedding(a, b, k, metric).select(F.col("src").alias("a_id"), F.col("dst").alias("b_id"), "dist")
    back = knn_embedding(b, a, k, metric).select(F.col("dst").alias("a_id"), F.col("src").alias("b_id"))
    return there.join(back, ["a_id", "b_id"])


def min_distance_to_set(obs: DataFrame, members: DataFrame, exclude_self: bool = True) -> DataFrame:
    """(cell_id, dist) to the nearest member."""
    points = obs.select("cell_id", "x", "y")
    targets = points.join(members.select("cell_id"), "cell_id", "left_semi")
    return knn_join(points, targets, 1, exclude_self=exclude_self).select(F.col("src").alias("cell_id"), "dist")


def remove_long_links(edges: DataFrame, pct: float = 99.0) -> DataFrame:
    """Drop edges longer than the given distance percentile."""
    cut = S.exact_quantile(edges, [], "dist", pct / 100.0, "_cut")
    return edges.crossJoin(cut).filter(F.col("dist") <= F.col("_cut")).drop("_cut")  # one-row side

"""Clusters, spatial domains, label refinement, niches and neighbourhood features."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import neighbors
from cellweave.operators.de import top_per_group
from cellweave.session import cut, materialize


def _vectors(embedding: DataFrame) -> DataFrame:
    return embedding.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))


def kmeans(embedding: DataFrame, k: int, seed: int = 42) -> DataFrame:
    rows = _vectors(embedding)
    return KMeans(k=k, seed=seed).fit(rows).transform(rows).select("cell_id", F.col("prediction").cast("long").alias("cluster"))


def gmm(embedding: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(cell_id, cluster, method): full-covariance Gaussian mixture; k-means, and said so, where a covariance is singular."""
    rows = _vectors(embedding)
    try:
        found = GaussianMixture(k=k, seed=seed).fit(rows).transform(rows).select("cell_id", F.col("prediction").cast("long").alias("cluster"))
    except Exception as error:  # the solver reports a singular covariance as a job error
        if "singular value" not in str(error):
            raise
        return kmeans(embedding, k, seed).withColumn("method", F.lit("kmeans"))
    return found.withColumn("method", F.lit("gmm"))


def estimate_k_silhouette(embedding: DataFrame, max_k: int = 20, seed: int = 42) -> int:
    """Best k from 2 to min(max_k, n/10, n-1) by the silhouette of all rows, which is linear in them; min(7, n) when there is no choice."""
    n = embedding.count()
    upper = min(max_k, n // 10, n - 1)
    if upper < 2:
        return min(7, n)
    rows = materialize(_vectors(embedding))
    scorer = ClusteringEvaluator()
    scores = {}
    for k in range(2, upper + 1):
        labelled = KMeans(k=k, seed=seed).fit(rows).transform(rows)
        if labelled.select("prediction").distinct().count() > 1:
            scores[k] = scorer.evaluate(labelled)
    return max(scores, key=scores.get) if scores else min(7, n)


def modularity(edges: DataFrame, labels: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: modularity of labels(cell_id, cluster) on undirected weighted edges."""
    a = labels.select(F.col("cell_id").alias("src"), F.col("cluster").alias("_a"))
    b = labels.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("_b"))
    inside = edges.join(a, "src").join(b, "dst").agg(F.sum("weight").alias("_m"), F.sum(F.when(F.col("_a") == F.col("_b"), F.col("weight")).otherwise(0.0)).alias("_in"))
    degree = edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("weight").alias("_d"))
    square = degree.join(labels, "cell_id").groupBy("cluster").agg(F.sum("_d").alias("_t")).agg(F.sum(F.col("_t") * F.col("_t")).alias("_tt"))
    return inside.crossJoin(square).select((F.col("_in") / F.col("_m") - resolution * F.col("_tt") / (F.col("_m") * F.col("_m"))).alias("modularity"))  # one-row sides


def _qualities(graph: DataFrame, state: DataFrame, total: float) -> dict[float, float]:
    """Modularity of each run of state(node, res, d, c), whose graph's weights sum to ``total``."""
    a, b = state.select(F.col("node").alias("src"), "res", F.col("c").alias("_a")), state.select(F.col("node").alias("dst"), F.col("c").alias("_b"))
    inside = {r["res"]: r["w"] for r in graph.join(a, "src").join(b, "dst").filter("_a = _b").groupBy("res").agg(F.sum("weight").alias("w")).collect()}
    squares = state.groupBy("res", "c").agg(F.sum("d").alias("t")).groupBy("res").agg(F.sum(F.col("t") * F.col("t")).alias("t"))
    return {r["res"]: inside.get(r["res"], 0.0) / total - r["res"] * r["t"] / total**2 for r in squares.collect()}  # one row for each resolution


def _move(graph: DataFrame, state: DataFrame, total: float, turn: int) -> DataFrame:
    """One round: of the active nodes those whose turn it is go to the neighbouring community of largest gain.

    Active afterwards are the neighbours of what has moved, and what wants to move but had no turn.
    """
    acting = state.filter("active").select("node", "res", "d", F.col("c").alias("home"))
    load = state.groupBy("c").agg(F.sum("d").alias("tot"))
    near = graph.filter("src <> dst").join(acting.select(F.col("node").alias("src")), "src", "left_semi")
    pull = near.join(state.select(F.col("node").alias("dst"), "c"), "dst").select(F.col("src").alias("node"), "c", "weight")
    options = pull.unionByName(acting.select("node", F.col("home").alias("c"), F.lit(0.0).alias("weight"))).groupBy("node", "c").agg(F.sum("weight").alias("w"))
    others = F.col("tot") - F.when(F.col("c") == F.col("home"), F.col("d")).otherwise(0.0)
    gains = options.join(acting, "node").join(load, "c").withColumn("g", F.col("w") - F.col("res") * F.col("d") * others / total)
    best = gains.groupBy("node", "home").agg(F.max_by("c", F.struct(F.round("g", 9), (F.col("c") == F.col("home")).alias("s"), "c")).alias("best"))
    now = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    wants = best.filter("best <> home").select("node", F.when(now, F.col("best")).otherwise(F.col("home")).alias("_c"), now.alias("_moved"))
    wants = cut(wants)
    woken = graph.join(wants.filter("_moved").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"), F.lit(True).alias("_woken")).distinct()
    joined = state.join(wants, "node", "left").join(woken, "node", "left")
    active = F.coalesce("_woken", F.lit(False)) | F.coalesce(~F.col("_moved"), F.lit(False))
    return cut(joined.select("node", "res", "d", F.coalesce("_c", "c").alias("c"), active.alias("active")))


def _connected(graph: DataFrame, state: DataFrame) -> DataFrame:
    """Each community split into its connected parts, which never lowers the modularity; parts are named by a node."""
    a, b = state.select(F.col("node").alias("src"), F.col("c").alias("_a")), state.select(F.col("node").alias("dst"), F.col("c").alias("_b"))
    inside = cut(graph.filter("src <> dst").join(a, "src").join(b, "dst").filter("_a = _b").select("src", "dst"))
    label = cut(state.select("node", F.col("node").alias("part")))
    while True:
        least = inside.join(label.select(F.col("node").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("part").alias("_p"))
        near = label.join(least, "node", "left").select("node", "part", F.least("part", F.coalesce("_p", "part")).alias("_q"))
        # what the part's own node has come to, so that chains need rounds by their logarithm
        jump = label.select(F.col("node").alias("_q"), F.col("part").alias("_j"))
        new = cut(near.join(jump, "_q").select("node", F.least("_q", "_j").alias("part"), F.col("part").alias("_old")))
        changed = not new.filter("part <> _old").isEmpty()
        label = new.select("node", "part")
        if not changed:
            return state.join(label, "node").select("node", "res", "d", F.col("part").alias("c"))


#: Links of one resolution that a single task may hold.
LINKS = 2_000_000
_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _has_turn(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Whose turn it is in :func:`_move`: ``xxhash64(node, turn)`` is even, from the nodes' own hashes."""
    with np.errstate(over="ignore"):
        h = (hashes.view(np.uint64) + _P5 + np.uint64(4)) ^ (np.uint64(turn) * _P1)
        h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return (h ^ (h >> np.uint64(32))) % np.uint64(2) == 0


class _Level:
    """All rounds of a level at one resolution, whose links one task can hold: the same moves as :func:`_move`."""

    def __init__(self, links: pa.Table, nodes: pa.Table, total: float):
        nodes = nodes.sort_by("node")  # so that numbers compare as the names do
        self.names, self.n, self.total = nodes["node"].combine_chunks(), len(nodes), total
        self.res, self.d, self.hashes = (nodes[c].to_numpy() for c in ("res", "d", "h"))
        src, dst = (pc.index_in(links[c].combine_chunks(), self.names).fill_null(-1).to_numpy().astype(np.int64) for c in ("src", "dst"))
        order = np.argsort(src, kind="stable")
        order = order[(src[order] >= 0) & (dst[order] >= 0)]
        self.src, self.dst, self.weight = src[order], dst[order], links["weight"].fill_null(0.0).to_numpy()[order]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(self.src, minlength=self.n))])

    def links_of(self, nodes: np.ndarray) -> np.ndarray:
        n = self.starts[nodes + 1] - self.starts[nodes]
        return np.repeat(self.starts[nodes] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def quality(self, c: np.ndarray) -> float:
        inside, sizes = self.weight[c[self.src] == c[self.dst]].sum(), np.bincount(c, self.d, self.n)
        return float(inside / self.total - self.res[0] * (sizes * sizes).sum() / self.total**2)

    def move(self, c: np.ndarray, active: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        acting, load = np.flatnonzero(active), np.bincount(c, self.d, self.n)
        near = self.links_of(acting)
        near = near[self.src[near] != self.dst[near]]
        node, to = np.concatenate([self.src[near], acting]), np.concatenate([c[self.dst[near]], c[acting]])
        key, at = np.unique(node * self.n + to, return_inverse=True)
        w = np.bincount(at, np.concatenate([self.weight[near], np.zeros(len(acting))]), len(key))
        node, to = key // self.n, key % self.n
        stays = to == c[node]
        others = load[to] - np.where(stays, self.d[node], 0.0)
        gain = np.round(w - self.res[node] * self.d[node] * others / self.total, 9)
        order = np.lexsort((to, stays, gain, node))
        last = order[np.r_[node[order][1:] != node[order][:-1], True]] if len(order) else order
        wants = last[~stays[last]]
        now = _has_turn(self.hashes[node[wants]], turn)
        c, again = c.copy(), np.zeros(self.n, bool)
        c[node[wants[now]]] = to[wants[now]]
        again[node[wants[~now]]] = True
        again[self.dst[self.links_of(node[wants[now]])]] = True
        return c, again

    def connected(self, c: np.ndarray) -> np.ndarray:
        """Each node's connected part of its community, named by the first node."""
        inside = c[self.src] == c[self.dst]
        a, b, part = self.src[inside], self.dst[inside], np.arange(self.n)
        while True:
            new = part.copy()
            np.minimum.at(new, a, part[b])
            new = np.minimum(new, part[new])
            if (new == part).all():
                return part
            part = new

    def run(self, seed: int, gain: float) -> pa.Table:
        c, active = np.arange(self.n), np.ones(self.n, bool)
        best, first = c, self.quality(c)
        quality, before, turn = first, first, 0
        while True:
            c, active = self.move(c, active, seed + turn)
            turn += 1
            if turn % 4 and active.any():
                continue
            now = self.quality(c)
            if now > quality:
                best, quality = c, now
            if not active.any() or now - before < gain:
                break
            before = now
        part = self.connected(best)
        fixed = lambda x: pa.array(np.full(self.n, x))
        return pa.table({"node": self.names, "res": pa.array(self.res), "d": pa.array(self.d), "c": self.names.take(pa.array(part)), "first": fixed(first), "quality": fixed(self.quality(part))})


def _level(graph: DataFrame, state: DataFrame, total: float, seed: int, gain: float) -> tuple[DataFrame, dict[float, float], dict[float, float]]:
    """Parts after all rounds of a level, a task for each resolution, and the qualities before and after."""
    res = lambda c: F.split(c, r"\|")[0].cast("double")
    nodes = state.select("node", "res", "d", F.xxhash64("node").alias("h"))
    run = lambda links, nodes: _Level(links, nodes, total).run(seed, gain)
    schema = "node string, res double, d double, c string, first double, quality double"
    parts = cut(graph.withColumn("_res", res("src")).groupBy("_res").cogroup(nodes.groupBy("res")).applyInArrow(run, schema))
    found = parts.groupBy("res").agg(F.first("first").alias("first"), F.first("quality").alias("quality")).collect()  # one row for each resolution
    return parts.drop("first", "quality"), {r["res"]: r["first"] for r in found}, {r["res"]: r["quality"] for r in found}


def communities(edges: DataFrame, resolutions: Sequence[float], seed: int = 42, gain: float = 1e-5) -> DataFrame:
    """Modularity communities (resolution, cell_id, cluster) of a symmetric weighted graph at each of a few resolutions.

    All resolutions run side by side in the same tables.  On each level only active nodes are looked at:
    at first all, then the neighbours of what has moved; half of them, chosen by hash, may move in a
    round.  A level ends when none is active or four rounds bring less than ``gain`` of modularity;
    its communities are split into connected parts, which are the nodes of the next level.  The search ends
    when a level gains less.  Rounds are written tables of the same size, so their time stays flat; a level
    of at most ``LINKS`` links makes the same rounds in one task for each resolution.
    """
    runs = F.explode(F.array(*[F.lit(float(r)) for r in dict.fromkeys(resolutions)]))  # a short list
    named = edges.select(F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.col("weight").cast("double").alias("weight"), runs.alias("res"))
    key = lambda c: F.concat_ws("|", F.col("res").cast("string"), F.col(c))
    graph = cut(named.select(key("a").alias("src"), key("b").alias("dst"), "weight"))
    nodes = edges.select(F.col("src").alias("cell_id")).union(edges.select("dst")).distinct()
    mapping = cut(nodes.withColumn("res", runs).select("cell_id", F.col("res").alias("resolution"), F.concat_ws("|", F.col("res").cast("string"), F.col("cell_id").cast("string")).alias("cluster")))
    total = edges.agg(F.sum(F.col("weight").cast("double"))).first()[0] or 1.0
    degree, reached, level = graph.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")), None, 0
    while True:
        state = cut(degree.withColumn("res", F.split("node", r"\|")[0].cast("double")).select("node", "res", "d", F.col("node").alias("c"), F.lit(True).alias("active")))
        if graph.count() <= LINKS * len(set(resolutions)):  # as many links at each of them
            parts, begun, quality = _level(graph, state, total, seed + 1000 * level, gain)
            reached = reached or begun
        else:
            best, quality = state, _qualities(graph, state, total)
            reached = reached or dict(quality)
            before, turn = dict(quality), 0
            while True:
                state = _move(graph, state, total, seed + 1000 * level + turn)
                turn += 1
                ended = state.filter("active").isEmpty()
                if turn % 4 and not ended:
                    continue
                now = _qualities(graph, state, total)
                better = [r for r in now if now[r] > quality[r]]
                best = cut(state.filter(F.col("res").isin(better)).unionByName(best.filter(~F.col("res").isin(better)))) if better else best
                quality |= {r: now[r] for r in better}
                still = [r for r in now if now[r] - before[r] >= gain]
                if ended or not still:
                    break
                state, before = state.withColumn("active", F.col("active") & F.col("res").isin(still)), now
            parts = cut(_connected(graph, best))
            quality = _qualities(graph, parts, total)
        if all(quality[r] - reached[r] < gain for r in quality):
            break
        reached, level = quality, level + 1
        mapping = cut(mapping.join(parts.select(F.col("node").alias("cluster"), "c"), "cluster").select("cell_id", "resolution", F.col("c").alias("cluster")))
        a, b = parts.select(F.col("node").alias("src"), F.col("c").alias("_a")), parts.select(F.col("node").alias("dst"), F.col("c").alias("_b"))
        graph = cut(graph.join(a, "src").join(b, "dst").groupBy(F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("weight").alias("weight")))
        degree = parts.groupBy(F.col("c").alias("node")).agg(F.sum("d").alias("d"))
    return mapping.select("resolution", "cell_id", F.regexp_replace("cluster", r"^[^|]*\|", "").alias("cluster"))


def graph_communities(edges: DataFrame, resolution: float = 1.0, seed: int = 42, gain: float = 1e-5) -> DataFrame:
    """(cell_id, cluster) at one resolution; see :func:`communities`."""
    return communities(edges, [resolution], seed, gain).select("cell_id", "cluster")


def multi_resolution(edges: DataFrame, resolutions: list[float]) -> list[tuple[float, int]]:
    """(resolution, number of clusters) of each resolution."""
    found = {r["resolution"]: r["n"] for r in communities(edges, resolutions).groupBy("resolution").agg(F.countDistinct("cluster").alias("n")).collect()}
    return [(r, found.get(float(r), 0)) for r in resolutions]


def search_resolution(edges: DataFrame, target: int, low: float = 0.1, high: float = 3.0, step: float = 0.05, at_once: int = 8) -> float:
    """First resolution from high to low that gives ``target`` clusters; max(.1, .3 ln max(k, 2)) if none does.

    ``at_once`` resolutions are tried side by side.
    """
    tried = [round(high - i * step, 6) for i in range(int(round((high - low) / step)) + 1)]
    for i in range(0, len(tried), at_once):
        for r, n in multi_resolution(edges, tried[i:i + at_once]):
            if n == target:
                return r
    return max(0.1, 0.3 * math.log(max(target, 2)))


def refine_labels(obs: DataFrame, label: str, k: int = 10, threshold: float = 0.5, batch: str | None = None) -> DataFrame:
    """Most common label of the k nearest (self included) where at least ``threshold`` of them differ; first seen wins ties."""
    by = [batch] if batch else []
    near = neighbors.knn_spatial(obs, k, by, include_self=True)
    named = near.join(obs.select(F.col("cell_id").alias("dst"), F.col(label).alias("_l")), "dst").join(obs.select(F.col("cell_id").alias("src"), F.col(label).alias("_own")), "src")
    votes = named.groupBy("src", "_own", "_l").agg(F.count(F.lit(1)).alias("_n"), F.min("rank").alias("_f"))
    total = F.sum("_n").over(Window.partitionBy("src"))  # at most k labels
    differ = F.sum(F.when(F.col("_l") != F.col("_own"), F.col("_n")).otherwise(0)).over(Window.partitionBy("src"))
    best = top_per_group(votes.withColumn("_share", differ / total), ["src"], [F.desc("_n"), "_f"], 1)
    return best.select(F.col("src").alias("cell_id"), F.when(F.col("_share") >= threshold, F.col("_l")).otherwise(F.col("_own")).alias(label))


def neighbor_augment(embedding: DataFrame, edges: DataFrame, lam: float = 0.2) -> DataFrame:
    """Own features times sqrt(1 - lambda) next to the neighbourhood mean times sqrt(lambda)."""
    mean = edges.join(embedding.select(F.col("cell_id").alias("dst"), "vec"), "dst").select("src", F.posexplode("vec").alias("_i", "_x")).groupBy("src", "_i").agg(F.avg("_x").alias("_m"))
    packed = mean.groupBy(F.col("src").alias("cell_id")).agg(F.array_sort(F.collect_list(F.struct("_i", "_m"))).alias("_n"))  # the dimensions
    a, b = math.sqrt(1.0 - lam), math.sqrt(lam)
    return embedding.join(packed, "cell_id").select("cell_id", F.concat(F.transform("vec", lambda x: x * a), F.transform("_n", lambda p: p["_m"] * b)).alias("vec"))


def diffuse_features(values: DataFrame, edges: DataFrame, iterations: int = 3, k: float = 1.0, lam: float = 0.1) -> DataFrame:
    """values(cell_id, feature, value): x += lambda * sum of c(d) * d with c = 1 / (1 + (d / k)^2) over the neighbours."""
    links = materialize(edges.select("src", "dst"))
    current = values.select("cell_id", "feature", "value")
    for _ in range(iterations):
        a = current.select(F.col("cell_id").alias("src"), "feature", F.col("value").alias("_a"))
        b = current.select(F.col("cell_id").alias("dst"), "feature", F.col("value").alias("_b"))
        d = F.col("_b") - F.col("_a")
        flow = links.join(a, "src").join(b, ["dst", "feature"]).groupBy(F.col("src").alias("cell_id"), "feature").agg(F.sum(d / (1.0 + (d / k) * (d / k))).alias("_f"))
        current = materialize(current.join(flow, ["cell_id", "feature"], "left").select("cell_id", "feature", (F.col("value") + lam * F.coalesce("_f", F.lit(0.0))).alias("value")))
    return current


def domain_statistics(obs: DataFrame, domain: str) -> DataFrame:
    return obs.groupBy(F.col(domain).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_spots"), F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), F.stddev_pop("x").alias("std_x"), F.stddev_pop("y").alias("std_y"),
        (F.max("x") - F.min("x")).alias("area_x"), (F.max("y") - F.min("y")).alias("area_y"))


def domain_export(obs: DataFrame, embedding: DataFrame, domain: str) -> DataFrame:
    dims = [F.try_element_at("vec", F.lit(i + 1)).alias(f"dim{i + 1}") for i in range(3)]
    return obs.select("cell_id", "x", "y", domain).join(embedding, "cell_id").select("cell_id", "x", "y", domain, *dims)


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: adjusted Rand index of two label columns."""
    c2 = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    cell = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    s = cell.agg(F.sum(c2("n")).alias("s"), F.sum("n").alias("t"))
    sa = cell.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("sa"))
    sb = cell.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(c2("n")).alias("sb"))
    expected = F.col("sa") * F.col("sb") / c2("t")
    top = (F.col("sa") + F.col("sb")) / 2.0
    return s.crossJoin(sa).crossJoin(sb).select(F.when(top == expected, 1.0).otherwise((F.col("s") - expected) / (top - expected)).alias("ari"))  # one-row sides


def align_ground_truth(obs: DataFrame, truth: DataFrame, preferred=("ground_truth", "label", "layer", "cell_type", "domain"), key: str = "cell_id") -> DataFrame:
    """Left join of the first preferred label column the truth table holds."""
    found = [c for c in preferred if c in truth.columns] or [c for c in truth.columns if c != key]
    if not found:
        raise ValueError("the truth table holds no label column")
    return obs.join(truth.select(key, F.col(found[0]).alias("ground_truth")), key, "left")


def apply_domain_labels(obs: DataFrame, mapping: DataFrame, domain: str) -> DataFrame:
    """Readable label per domain id, ``unknown`` where missing, and the two combined."""
    named = obs.join(mapping.select(F.col("domain_id").alias(domain), "domain_label"), domain, "left")
    label = F.coalesce("domain_label", F.lit("unknown"))
    return named.withColumn("domain_label", label).withColumn("combined_label", F.concat_ws(" ", F.col(domain).cast("string"), label))


# ------------------------------------------------------------------------- niches
def neighborhood_composition(obs: DataFrame, label: str, k: int = 10) -> DataFrame:
    """Long (cell_id, label, share): label shares among the k nearest other cells, divided by k."""
    near = neighbors.knn_spatial(obs, k)
    return near.join(obs.select(F.col("cell_id").alias("dst"), F.col(label).alias("label")), "dst").groupBy(F.col("src").alias("cell_id"), "label").agg((F.count(F.lit(1)) / float(k)).alias("share"))


def composition_vectors(composition: DataFrame) -> DataFrame:
    """(cell_id, vec) with one entry per label in label order."""
    labels = [r[0] for r in composition.select("label").distinct().orderBy("label").collect()]  # the cell types
    wide = composition.groupBy("cell_id").pivot("label", labels).agg(F.sum("share")).na.fill(0.0)
    return wide.select("cell_id", F.array(*[F.col(f"`{c}`") for c in labels]).alias("vec"))


def niche_communities(obs: DataFrame, label: str, k: int = 10, resolution: float = 0.5, graph_k: int = 15) -> DataFrame:
    vectors = composition_vectors(neighborhood_composition(obs, label, k))
    near = neighbors.knn_embedding(vectors, k=graph_k, metric="cosine").select("src", "dst", F.lit(1.0).alias("weight"))
    return graph_communities(neighbors.symmetrize(near), resolution)


def niche_mixture(obs: DataFrame, embedding: DataFrame, n_niches: int, k: int = 6, pct: float = 99.0) -> DataFrame:
    edges = neighbors.remove_long_links(neighbors.knn_spatial(obs, k), pct)
    return gmm(neighbor_augment(embedding, edges), n_niches)


def characterize_niches(obs: DataFrame, niche: str, label: str) -> DataFrame:
    """Cell-type share inside each niche and niche sizes."""
    counts = obs.groupBy(niche, label).agg(F.count(F.lit(1)).alias("n"))
    size = counts.groupBy(niche).agg(F.sum("n").alias("niche_size"))
    return counts.join(size, niche).select(niche, label, "niche_size", (F.col("n") / F.col("niche_size")).alias("share"))


def compare_niches(obs: DataFrame, niche: str, condition: str) -> DataFrame:
    """Niche share per condition, 0 where a niche is absent."""
    n = obs.groupBy(condition, niche).agg(F.count(F.lit(1)).alias("n"))
    size = n.groupBy(condition).agg(F.sum("n").alias("_t"))
    grid = size.crossJoin(n.select(niche).distinct())  # conditions x niches
    return grid.join(n, [condition, niche], "left").select(condition, niche, (F.coalesce("n", F.lit(0)) / F.col("_t")).alias("share"))


def supervised_niches(obs: DataFrame, label: str, condition: str, n_niches: int = 10, k: int = 10, seed: int = 42) -> DataFrame:
    """K-means on compositions inside each condition, labelled ``<condition>_niche_<i>``."""
    vectors = materialize(composition_vectors(neighborhood_composition(obs, label, k)).join(obs.select("cell_id", condition), "cell_id"))
    out = None
    for (name,) in vectors.select(condition).distinct().orderBy(condition).collect():  # the conditions
        part = kmeans(vectors.filter(F.col(condition) == name).select("cell_id", "vec"), n_niches, seed)
        part = part.select("cell_id", F.concat(F.lit(f"{name}_niche_"), F.col("cluster").cast("string")).alias("niche"))
        out = part if out is None else out.unionByName(part)
    return out

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import domains, neighbors, spatial_stats, tissue


def brute(points, k, queries=None):
    out = set()
    for i, (x, y) in (queries or points).items():
        order = sorted(((x - u) * (x - u) + (y - v) * (y - v), j) for j, (u, v) in points.items() if j != i)
        out |= {(i, j, r + 1) for r, (_, j) in enumerate(order[:k])}
    return out


def skewed_points(n=300, seed=0):
    """A third on one spot, a third in a tiny clump, the rest spread far and wide."""
    rng = np.random.default_rng(seed)
    pts = {}
    for i in range(n):
        if i % 3 == 0:
            pts[i] = (5.0, 5.0)
        elif i % 3 == 1:
            pts[i] = tuple(float(v) for v in 50 + rng.normal(size=2) * 1e-4)
        else:
            pts[i] = tuple(float(v) for v in rng.uniform(-1000, 1000, 2))
    return pts


@pytest.mark.parametrize("k", [1, 6])
def test_knn_spatial_is_exact_under_skew(spark, k):
    pts = skewed_points()
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "cell_id int, x double, y double")
    got = {(r["src"], r["dst"], r["rank"]) for r in neighbors.knn_spatial(df, k).collect()}
    assert got == brute(pts, k)


def test_knn_with_fewer_points_than_k(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0), (3, 9.0, 9.0)], "cell_id int, x double, y double")
    assert neighbors.knn_spatial(df, 6).count() == 6


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_knn_embedding_is_exact_with_copies(spark, metric):
    rng = np.random.default_rng(3)
    mat = rng.normal(size=(200, 6))
    mat[::3] = mat[0]  # copies of one vector
    rows = [(i, [float(v) for v in mat[i]]) for i in range(200)]
    df = spark.createDataFrame(rows, "cell_id int, vec array<double>")
    got = {(r["src"], r["rank"]): r["dst"] for r in neighbors.knn_embedding(df, k=4, metric=metric, rows=16, n_pivots=7).collect()}
    unit = mat / np.linalg.norm(mat, axis=1, keepdims=True) if metric == "cosine" else mat
    for i in range(200):
        d = ((unit - unit[i]) ** 2).sum(1)
        order = [int(j) for j in np.lexsort((np.arange(200), np.round(d, 10))) if j != i][:4]
        assert [got[(i, r + 1)] for r in range(4)] == order


def test_moran_of_an_alternating_ring(spark):
    n = 8
    obs = spark.createDataFrame([(i,) for i in range(n)], "cell_id int")
    expr = spark.createDataFrame([(i, "g", 1.0) for i in range(0, n, 2)] + [(i, "flat", 2.0) for i in range(n)], "cell_id int, gene_id string, value double")
    edges = spark.createDataFrame([(i, (i + d) % n) for i in range(n) for d in (1, n - 1)], "src int, dst int")
    rows = spatial_stats.moran_i(expr, obs, edges).collect()
    assert [r["gene_id"] for r in rows] == ["g"] and rows[0]["I"] == pytest.approx(-1.0)
    assert spatial_stats.geary_c(expr, obs, edges).first()["C"] == pytest.approx(2 * (n - 1) / n)


def test_isolated_cells_score_zero(spark):
    obs = spark.createDataFrame([(i,) for i in range(4)], "cell_id int")
    expr = spark.createDataFrame([(0, "g", 5.0), (1, "g", 4.0)], "cell_id int, gene_id string, value double")
    edges = spark.createDataFrame([(0, 1), (1, 0)], "src int, dst int")
    z = {r["cell_id"]: r["z"] for r in spatial_stats.getis_ord_gstar(expr, obs, edges, expr.select("gene_id").distinct()).collect()}
    assert z[2] == 0.0 and z[3] == 0.0 and z[0] > 0


def naive_dbscan(pts, eps, min_pts):
    ids = sorted(pts)
    near = {i: [j for j in ids if (pts[i][0] - pts[j][0]) ** 2 + (pts[i][1] - pts[j][1]) ** 2 <= eps * eps] for i in ids}
    core = {i for i in ids if len(near[i]) >= min_pts}
    label = {}
    for i in sorted(core):
        if i in label:
            continue
        stack = [i]
        while stack:
            u = stack.pop()
            if u in label:
                continue
            label[u] = i
            stack += [v for v in near[u] if v in core and v not in label]
    return core, label, near


def test_dbscan_matches_the_definition(spark):
    rng = np.random.default_rng(5)
    pts = {i: tuple(float(v) for v in ((i % 4) * 10 + rng.normal(size=2) * 0.6 if i % 5 else rng.uniform(-5, 45, 2))) for i in range(200)}
    core, label, near = naive_dbscan(pts, 1.0, 5)
    df = spark.createDataFrame([(i, *p) for i, p in pts.items()], "cell_id long, x double, y double")
    got = {r["cell_id"]: r["cluster"] for r in tissue.dbscan(df, 1.0, 5).collect()}
    for i in pts:
        if i in core:
            assert got[i] == label[i]
        else:
            allowed = {label[j] for j in near[i] if j in core}
            assert got[i] in allowed if allowed else got[i] == -1


def test_connected_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60) if i != 30], "a long, b long")
    nodes = spark.createDataFrame([(i,) for i in range(62)], "node long")
    got = {r["node"]: r["component"] for r in tissue.connected_components(links, nodes).collect()}
    assert {got[i] for i in range(31)} == {0} and {got[i] for i in range(31, 61)} == {31} and got[61] == 61


def connected(nodes, near):
    seen, waiting = set(), [min(nodes)]
    while waiting:
        x = waiting.pop()
        if x not in seen:
            seen.add(x)
            waiting += [y for y in near[x] if y in nodes]
    return seen == nodes


def test_planted_communities_are_found(spark):
    rng = np.random.default_rng(2)
    pairs = {(i, j) for i in range(40) for j in range(40) if i < j and rng.uniform() < (0.5 if i // 10 == j // 10 else 0.02)}
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(40)}
    edges = spark.createDataFrame([(a, b, 1.0) for i, j in pairs for a, b in ((i, j), (j, i))], "src long, dst long, weight double")
    start = time.perf_counter()
    rows = domains.communities(edges, [1.0, 3.0]).cache()
    assert rows.count() == 80
    assert time.perf_counter() - start < 60
    found = rows.filter("resolution = 1").withColumn("truth", F.floor(F.col("cell_id") / 10))
    assert domains.adjusted_rand(found, "cluster", "truth").first()["ari"] > 0.6
    assert domains.adjusted_rand(found, "truth", "truth").first()["ari"] == pytest.approx(1.0)
    assert domains.modularity(edges, found).first()["modularity"] > 0.35
    groups = {}
    for r in rows.collect():
        groups.setdefault((r["resolution"], r["cluster"]), set()).add(r["cell_id"])
    assert all(connected(g, near) for g in groups.values())
    sizes = [sum(k[0] == res for k in groups) for res in (1.0, 3.0)]
    assert sizes[0] < sizes[1] and domains.search_resolution(edges, sizes[0], 0.9, 1.0, 0.1) == 1.0


def test_rounds_of_the_community_search_stay_flat(spark):
    n = 60
    edges = spark.createDataFrame([(i, (i + s) % n, 1.0) for i in range(n) for s in (1, -1)], "src string, dst string, weight double")
    state = domains.cut(edges.groupBy(F.col("src").alias("node")).agg(F.sum("weight").alias("d")).select("node", F.lit(1.0).alias("res"), "d", F.col("node").alias("c"), F.lit(True).alias("active")))
    graph, times = domains.cut(edges), []
    for turn in range(24):
        start = time.perf_counter()
        state = domains._move(graph, state, 2.0 * n, turn).withColumn("active", F.lit(True))
        state.count()
        times.append(time.perf_counter() - start)
    assert sum(times[16:]) < 3 * sum(times[4:12]) + 1


def brute_betweenness(near):
    total = dict.fromkeys(near, 0.0)
    for s in near:
        order, dist, paths, before = [], {s: 0}, {s: 1.0}, {v: [] for v in near}
        waiting = [s]
        for v in waiting:
            order.append(v)
            for w in sorted(near[v]):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    waiting.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] = paths.get(w, 0.0) + paths[v]
                    before[w].append(v)
        delta = dict.fromkeys(near, 0.0)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += paths[v] / paths[w] * (1 + delta[w])
            if w != s:
                total[w] += delta[w]
    n = len(near)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_betweenness_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    pairs = {tuple(sorted(rng.choice(290, 2, replace=False).tolist())) for _ in range(420)} | {(i, i + 1) for i in range(280)}  # ten cells have no edge
    near = {i: set() for i in range(300)}
    for i, j in pairs:
        near[i].add(j)
        near[j].add(i)
    obs = spark.range(300).withColumnRenamed("id", "cell_id")
    edges = spark.createDataFrame([(i, j) for i, j in pairs] + [(j, i) for i, j in pairs], "src long, dst long")
    want = brute_betweenness(near)
    got = {r["cell_id"]: r["betweenness"] for r in spatial_stats.betweenness(edges, obs).collect()}
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in range(300))
    some = {r["cell_id"]: r["betweenness"] for r in spatial_stats.betweenness(edges, obs, landmarks=100).collect()}
    assert np.corrcoef([some[i] for i in range(300)], [want[i] for i in range(300)])[0, 1] > 0.9
    assert spatial_stats.betweenness(edges.filter("false"), obs).filter("betweenness = 0").count() == 300


def test_hull_area_and_density(spark):
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 3), (0, 3), (2, 1), (1, 1)])]
    obs = spark.createDataFrame(pts, "cell_id int, x double, y double")
    row = tissue.region_ecosystem(obs, obs.select("cell_id", F.lit(0).alias("region"))).first()
    assert row["area"] == pytest.approx(12.0) and row["density"] == pytest.approx(0.5)

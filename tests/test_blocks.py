"""Steps that work in blocks of neighbouring cells: results beside plain computations, and rounds that don't grow with the cells."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import session
from cellweave.operators import domains, dynamics, memory, shortest_paths, spatial_stats
from test_graphs import brute_betweenness


def counted(monkeypatch, *modules):
    """How many tables the modules' loops have written."""
    written = []

    def cut(df, name="round"):
        written.append(name)
        return session.cut(df, name)

    for module in modules:
        monkeypatch.setattr(module, "cut", cut)
    return written


def test_betweenness_of_a_long_strip_takes_few_rounds(spark, monkeypatch):
    n = 1200
    obs = spark.range(n).select(F.col("id").alias("cell_id"), (F.col("id") % 2).cast("double").alias("x"), (F.col("id") * 0.5).alias("y"))
    edges = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    written = counted(monkeypatch, spatial_stats, shortest_paths)
    monkeypatch.setattr(spatial_stats.shortest_paths, "dependencies", functools.partial(shortest_paths.dependencies, cells=300))
    got = {r["cell_id"]: r["betweenness"] for r in spatial_stats.betweenness(edges, obs, landmarks=4).collect()}
    marks = [r[0] for r in obs.orderBy(F.md5(F.col("cell_id").cast("string").cast("binary")), "cell_id").limit(4).collect()]
    for v in range(n):  # the cells beyond v, seen from each landmark
        want = sum((v if v < s else n - 1 - v) if v != s else 0 for s in marks)
        assert got[v] == pytest.approx(want * n / 4 / ((n - 1) * (n - 2)), abs=1e-12)
    assert len(written) < 40


@pytest.mark.parametrize("cells,at_once,placed", [(15, 7, True), (20, 50, False)])
def test_betweenness_in_blocks_matches_brute_force(spark, monkeypatch, cells, at_once, placed):
    rng = np.random.default_rng(8)
    at = rng.uniform(0, 10, (60, 2)).round(3)
    near = {i: set() for i in range(60)}
    for i in range(58):  # two cells have no link
        for j in np.argsort(((at[:58] - at[i]) ** 2).sum(1))[1:4].tolist():
            near[i].add(j)
            near[j].add(i)
    obs = spark.createDataFrame([(f"c{i}", *map(float, at[i])) for i in range(60)], "cell_id string, x double, y double")
    edges = spark.createDataFrame([(f"c{i}", f"c{j}") for i in near for j in near[i]], "src string, dst string")
    monkeypatch.setattr(spatial_stats.shortest_paths, "dependencies", functools.partial(shortest_paths.dependencies, cells=cells, at_once=at_once))
    got = {r["cell_id"]: r["betweenness"] for r in spatial_stats.betweenness(edges, obs if placed else obs.select("cell_id")).collect()}
    want = brute_betweenness(near)
    assert all(got[f"c{i}"] == pytest.approx(want[i], abs=1e-9) for i in range(60))


def test_counts_of_paths_too_many_for_a_double(spark):
    """A chain of 1,100 diamonds has 2 ** 1100 shortest paths from end to end; each cell in the middle of a diamond has half of them."""
    n = 1100
    rows = [(3 * i, 3 * i + a) for i in range(n) for a in (1, 2)] + [(3 * i + a, 3 * i + 3) for i in range(n) for a in (1, 2)]
    links = spark.createDataFrame([x for a, b in rows for x in ((a, b), (b, a))], "src long, dst long")
    cells = spark.range(3 * n + 1).withColumnRenamed("id", "cell_id")
    got = {r["cell_id"]: r["delta"] for r in shortest_paths.dependencies(links, cells, cells.filter("cell_id = 0")).collect()}
    assert all(got[3 * i + a] == pytest.approx((3 * (n - i) - 2) / 2, rel=1e-9) for i in range(n) for a in (1, 2))
    assert got[0] == 0.0 and got[3 * n] == pytest.approx(0.0)


def test_absorption_on_a_strip_takes_few_rounds(spark, monkeypatch):
    wide, high = 12, 100
    n = wide * high
    rng = np.random.default_rng(6)
    t = np.zeros((n, n))
    for i in range(wide, n):
        r, c = divmod(i, wide)
        for a, b in ((-1, 0), (1, 0), (0, -1), (0, 1), (1, 1)):
            if 0 <= r + a < high and 0 <= c + b < wide and i not in (n // 2, n // 2 + 1):
                t[i, (r + a) * wide + c + b] = rng.uniform(0.1, 1.0) if (i + a + b) % 50 else 1e-15
    t[n // 2, n // 2] = 1.0  # one cell only meets itself, another has no moves at all
    moves = [(i, j, float(t[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(t)))]
    t /= np.maximum(t.sum(1, keepdims=True), 1e-300)
    walk = [i for i in range(wide, n) if i not in (n // 2, n // 2 + 1)]
    fates = [np.arange(0, wide, 2), np.arange(1, wide, 2)]
    want = np.linalg.solve(np.eye(len(walk)) - t[np.ix_(walk, walk)], np.stack([t[np.ix_(walk, f)].sum(1) for f in fates], 1))
    obs = spark.createDataFrame([(i, float(i % wide), float(i // wide)) for i in range(n)], "cell_id long, x double, y double")
    ends = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(wide)], "cell_id long, fate string")
    written = counted(monkeypatch, dynamics)
    got = dynamics.absorption_probabilities(spark.createDataFrame(moves, "src long, dst long, weight double"), ends, obs, core=30)
    p = {(r["cell_id"], r["fate"]): r["p"] for r in got.collect()}
    assert len(p) == 2 * n and p[(n // 2, "a")] == p[(n // 2 + 1, "b")] == 0.0
    assert all(p[(i, f)] == pytest.approx(want[a, k], abs=1e-9) for a, i in enumerate(walk) for k, f in enumerate("ab"))
    assert len(written) < 30


def test_communities_of_small_graphs_take_one_task_and_the_same_moves(spark, monkeypatch):
    rng = np.random.default_rng(9)
    at = np.concatenate([rng.normal(c, 0.6, (14, 2)) for c in ((0, 0), (4, 0), (0, 4), (4, 4))])
    links = {}
    for i in range(len(at)):
        for rank, j in enumerate(np.argsort(((at - at[i]) ** 2).sum(1))[1:5].tolist()):
            links[(i, j)] = links[(j, i)] = max(links.get((i, j), 0.0), 1.0 / (2 + rank))
    edges = spark.createDataFrame([(i, j, w) for (i, j), w in links.items()], "src long, dst long, weight double").cache()
    labels = lambda found: {(r["resolution"], r["cell_id"]): r["cluster"] for r in found.collect()}
    written = counted(monkeypatch, domains)
    here = labels(domains.communities(edges, [0.5, 2.0]))
    assert len(here) == 2 * len(at) and len(written) < 30
    monkeypatch.setattr(domains, "LINKS", 0)
    assert labels(domains.communities(edges, [0.5, 2.0])) == here


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_hops_are_followed_in_blocks_of_starts(spark, monkeypatch, hops):
    rng = np.random.default_rng(2)
    links = {(f"n{a}", f"n{b}") for a, b in rng.integers(0, 40, (70, 2)).tolist()} | {("n1", None), (None, "n2")}
    starts = [(f"n{i}", f"n{i}") for i in range(0, 40, 2)] + [("far", "n3"), ("far", "n4"), ("alone", "alone"), (None, "n5")]
    want = {(s, n, 0) for s, n in starts}
    for hop in range(1, hops + 1):
        step = {(s, b) for s, n, h in want if h == hop - 1 and n is not None for a, b in links if a == n}
        want |= {(s, b, hop) for s, b in step if s is None or b is None or (s, b) not in {x[:2] for x in want}}
    monkeypatch.setattr(memory, "STARTS", 4)
    monkeypatch.setattr(memory, "CHILDREN", 2)
    edges = spark.createDataFrame([*links, *sorted(links, key=str)[:3]], "parent_uuid string, child_uuid string")
    found = memory.reachable(edges, spark.createDataFrame(starts, "start string, node_uuid string"), hops)
    rows = [tuple(r) for r in found.select("start", "node_uuid", "hops").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()  # pairs of the last hop are neither joined nor written

"""Searches end by themselves, and what cannot be done is an error."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import stats
from cellweave.operators import dynamics, memory, rollouts, spatial_stats, tissue
from cellweave.operators import text as tx


def test_long_chains_are_followed_to_the_end(spark):
    n = 120
    edges = spark.createDataFrame([(i, f"n{i}", f"n{i + 1}", f"e{i}", 0) for i in range(n)], "id long, parent_uuid string, child_uuid string, name string, priority int")
    proposals = spark.createDataFrame([(f"n{n}", "n0"), ("n0", f"n{n}"), ("n1", "n0")], "parent_uuid string, child_uuid string")
    flags = {(r["parent_uuid"], r["child_uuid"]): r["cycle"] for r in memory.would_create_cycle(edges, proposals, root="n1").collect()}
    assert flags == {(f"n{n}", "n0"): True, ("n0", f"n{n}"): False, ("n1", "n0"): False}


def test_closeness_counts_far_cells(spark):
    n = 40
    obs = spark.createDataFrame([(i, "a" if i == 0 else "b") for i in range(n)], "cell_id long, kind string")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1)] + [(i + 1, i) for i in range(n - 1)], "src long, dst long")
    row = spatial_stats.centrality(edges, obs, "kind").filter("cluster = 'a'").first()
    assert row["closeness_centrality"] == pytest.approx((n - 1) / sum(range(n)))


@pytest.mark.parametrize("core", [1000, 8])
def test_absorption_on_a_long_chain(spark, core):
    n = 300
    moves = spark.createDataFrame([(i, j, 0.5) for i in range(1, n - 1) for j in (i - 1, i + 1)], "src long, dst long, weight double")
    ends = spark.createDataFrame([(0, "low"), (n - 1, "high")], "cell_id long, fate string")
    obs = spark.range(n + 1).withColumnRenamed("id", "cell_id")
    p = {(r["cell_id"], r["fate"]): r["p"] for r in dynamics.absorption_probabilities(moves, ends, obs, core=core).collect()}
    assert len(p) == 2 * (n + 1) and p[(n, "low")] == 0.0
    assert max(abs(p[(i, "high")] - i / (n - 1)) for i in range(n)) < 1e-6
    one = dynamics.absorption_probabilities(moves.filter("src <> 1 or dst <> 0"), ends.filter("fate = 'high'"), core=core).agg(F.min("p"), F.count("p")).first()
    assert one[0] == pytest.approx(1.0, abs=1e-6) and one[1] == n - 1


@pytest.mark.parametrize("core", [1000, 5])
def test_absorption_matches_a_dense_solve(spark, core):
    rng = np.random.default_rng(4)
    n, rows = 60, []
    for i in range(6, n):
        for j in rng.choice(n if i < 50 else [50, 51, 52, 53, 54, 55, 56, 57, 58, 59], 3, replace=False):  # the last ten never leave each other
            rows.append((i, int(j), float(rng.uniform(0.1, 1))))
    ends = [(i, "ab"[i % 2]) for i in range(6)]
    t = np.zeros((n, n))
    for i, j, w in rows:
        t[i, j] += w
    t /= np.maximum(t.sum(1, keepdims=True), 1e-300)
    want = np.linalg.solve(np.eye(44) - t[6:50, 6:50], np.stack([t[6:50, 0:6:2].sum(1), t[6:50, 1:6:2].sum(1)], 1))
    got = dynamics.absorption_probabilities(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.createDataFrame(ends, "cell_id long, fate string"), spark.range(n).withColumnRenamed("id", "cell_id"), core=core)
    p = {(r["cell_id"], r["fate"]): r["p"] for r in got.collect()}
    assert all(p[(i, f)] == pytest.approx(want[i - 6, k], abs=1e-9) for i in range(6, 50) for k, f in enumerate("ab"))
    assert all(p[(i, f)] == 0.0 for i in range(50, n) for f in "ab")


@pytest.mark.parametrize("side", [60])
def test_diffusion_components_of_a_grid(spark, side):
    n = side * side
    links = [(i * side + j, (i + a) * side + j + b) for i in range(side) for j in range(side) for a, b in ((0, 1), (1, 0)) if i + a < side and j + b < side]
    edges = spark.createDataFrame([(x, y, 1.0) for a, b in links for x, y in ((a, b), (b, a))], "src long, dst long, weight double")
    m = np.zeros((n, n))
    for a, b in links:
        m[a, b] = m[b, a] = 1.0
    d = np.sqrt(m.sum(1))
    values, vectors = np.linalg.eigh(m / np.outer(d, d))
    want = vectors[:, ::-1][:, :4]
    table, found = dynamics.diffusion_components(edges, 3)
    got = np.array([r[1:] for r in sorted(table.collect())])
    assert np.allclose(found, values[::-1][:4], atol=1e-9)
    angles = np.arccos(np.clip(np.linalg.svd(want.T @ got, compute_uv=False), -1, 1))
    assert np.allclose(got.T @ got, np.eye(4), atol=1e-8) and angles.max() < 1e-3


def test_diffusion_components_of_a_small_graph(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for i in range(5) for a, b in ((i, i + 1), (i + 1, i))], "src long, dst long, weight double")
    dpt = {r["cell_id"]: r["dpt"] for r in dynamics.diffusion_pseudotime(edges, 0, 2).collect()}
    assert dpt[0] == 0.0 and dpt[5] > dpt[2] > dpt[1] > 0
    with pytest.raises(ValueError):
        dynamics.diffusion_pseudotime(edges, 99, 2)


def brute_concordance(rows):
    pairs = right = tied = 0
    for t, e, r in rows:
        for u, f, q in rows:
            if e and (t < u or t == u and not f):
                pairs, right, tied = pairs + 1, right + (r > q), tied + (r == q)
    return pairs, right, tied


def test_concordance_counts_the_pairs(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 250):
        rows = [(float(rng.integers(0, 40)), int(rng.uniform() < 0.6), float(rng.integers(-9, 9))) for _ in range(n)]
        row = tissue.concordance(spark.createDataFrame([*rows, (None, 1, 1.0), (3.0, None, 1.0)], "time double, event int, partial_hazard double")).first()
        want = brute_concordance(rows)
        assert (row["n_pairs"], row["n_correct"], row["n_tied"]) == want
        assert row["concordance"] == (pytest.approx((want[1] + want[2] / 2) / want[0]) if want[0] else None)
    empty = tissue.concordance(spark.createDataFrame([], "time double, event int, partial_hazard double")).collect()
    assert [tuple(r) for r in empty] == [(0, 0, 0, None)]


def test_distractors_fill_up_even_if_the_pool_is_just_large_enough(spark):
    pool = spark.createDataFrame([(f"d{i}", f"t{i}", i) for i in range(60)], "doc string, title string, idx long")
    questions = spark.createDataFrame([(i, "q?", ["g"], [i, i + 7]) for i in range(20)], "id long, question string, golds array<string>, evidence array<long>")
    for r in rollouts.sample_distractors(questions, pool, 60).collect():
        assert sorted(r["docs"]) == list(range(60))
    with pytest.raises(ValueError):
        rollouts.sample_distractors(questions, pool, 61)


@pytest.mark.parametrize("first, step", [(1_700_000_000.0, 60.0), (1e9, 0.001)])
def test_buckets_follow_values_far_from_zero(spark, first, step):
    rows = spark.range(20_000).select((F.lit(first) + F.col("id") * step).alias("v"), (F.col("id") % 2).alias("g"))
    sizes = [r["count"] for r in stats.range_buckets(rows, "v").groupBy("_bucket").count().collect()]
    assert max(sizes) < 200
    ranks = {r["v"]: r["avg_rank"] for r in stats.average_ranks(rows, ["g"], "v").filter("g = 0").collect()}
    assert [ranks[v] for v in sorted(ranks)] == [i + 1 for i in range(10_000)]


def test_dbscan_takes_string_ids(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i}", float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.2, (30, 2)), rng.normal(9, 0.2, (30, 2)), [[50, 50]]]))]
    got = {r["cell_id"]: r["cluster"] for r in tissue.dbscan(spark.createDataFrame(rows, "cell_id string, x double, y double"), 1.0, 5).collect()}
    assert len({got[f"c{i}"] for i in range(30)}) == len({got[f"c{i}"] for i in range(30, 60)}) == 1 and got["c0"] != got["c30"] and got["c60"] == -1


def test_clean_lines_keeps_the_first_line_of_a_noise_run(spark):
    text = "A real sentence about cells.\n0.1 0.2\na\nb\n\n\n\n\n\n# Head\n12 | Nature | Vol 1\nAnother real sentence here.  "
    got = tx.clean_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert got[0]["cleaned"] == "A real sentence about cells.\n0.1 0.2\n\n\n# Head\n\nAnother real sentence here." and got[1]["cleaned"] is None

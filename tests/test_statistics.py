import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import spatial_stats


def test_bh_matches_numpy_with_ties(spark):
    rng = np.random.default_rng(0)
    p = np.round(rng.uniform(size=200), 2)
    p[:70] = 1.0  # a third of the tests share one value
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(p)], "i int, p double")
    got = {r["i"]: r["q"] for r in S.bh_fdr(df, "p", out="q").collect()}
    order = np.argsort(p, kind="stable")
    raw = p[order] * len(p) / np.arange(1, len(p) + 1)
    adj = np.minimum.accumulate(raw[::-1])[::-1].clip(max=1)
    for rank, i in enumerate(order):
        assert got[int(i)] == pytest.approx(adj[rank], abs=1e-12)


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_exact_quantile(spark, q):
    rng = np.random.default_rng(1)
    data = {"a": rng.normal(size=37), "b": np.repeat([0.0, -3.0, 5.0], 9), "c": np.array([2.5])}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs]
    got = {r["g"]: r["quantile"] for r in S.exact_quantile(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", q).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, q), abs=1e-12)


def test_average_ranks(spark):
    df = spark.createDataFrame([(v,) for v in [3.0, 1.0, 3.0, -2.0, 0.0]], "v double")
    got = {r["v"]: r["avg_rank"] for r in S.average_ranks(df, [], "v").collect()}
    assert got == {-2.0: 1.0, 0.0: 2.0, 1.0: 3.0, 3.0: 4.5}


def test_student_p_values():
    p = S.student_two_sided(np.array([2.228139, 12.7062, 0.0, 1.96]), np.array([10.0, 1.0, 5.0, 1e6]))
    assert p == pytest.approx([0.05, 0.05, 1.0, 0.05], abs=2e-5)


def test_normal_and_chi2(spark):
    row = spark.range(1).select(S.norm_pvalue(F.lit(1.959964)).alias("n"), S.chi2_sf(F.lit(18.307), 10).alias("c"), S.lgamma(F.lit(10.0)).alias("g")).first()
    assert row["n"] == pytest.approx(0.05, abs=1e-6)
    assert row["c"] == pytest.approx(0.05, abs=1e-3)
    assert row["g"] == pytest.approx(np.log(362880.0), abs=1e-9)


def test_hypergeometric_tail(spark):
    from math import comb

    df = spark.createDataFrame([(1, 3, 8, 6, 20)], "id int, k long, h long, d long, n long")
    want = sum(comb(8, i) * comb(12, 6 - i) for i in range(3, 7)) / comb(20, 6)
    assert S.hypergeom_upper(df, ["id"], "k", "h", "d", "n", "p").first()["p"] == pytest.approx(want, abs=1e-9)


def test_permutations_keep_the_labels(spark):
    labels = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(60)], "cell_id int, label string")
    perms = S.permute_labels(labels, "cell_id", "label", 5).collect()
    for k in range(1, 6):
        one = [r for r in perms if r["perm"] == k]
        assert len({r["cell_id"] for r in one}) == 60 and sum(r["label"] == "b" for r in one) == 20
    assert len({tuple(r["label"] for r in sorted(perms, key=lambda r: r["cell_id"]) if r["perm"] == k) for k in range(1, 6)}) == 5


def test_distance_counts_share_blocks_between_labels(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i % 90, str(rng.choice(["a", "b", "c"])) if i % 17 else None, float(x), float(y)) for i, (x, y) in enumerate(rng.uniform(-3, 9, (100, 2)))]
    rows += [(200, "a", None, 1.0), (201, "a", 1.0, None), *[rows[5]] * 3]
    obs = spark.createDataFrame(rows, "cell_id int, kind string, x double, y double")
    blocks, plain = [], spatial_stats.materialize
    monkeypatch.setattr(spatial_stats, "materialize", lambda df: blocks.append(plain(df)) or blocks[-1])
    bounds = [0.5, 1.0, 2.5, 4.0]
    known = [r for r in rows if r[1] and r[2] is not None and r[3] is not None]
    for same, size in ((False, 512), (False, 4), (True, 4)):
        want = Counter()
        for i, p in enumerate(known):
            for j, q in enumerate(known):
                d = math.sqrt((p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2)
                if i != j and (p[1] == q[1] or not same):
                    want.update((p[1], q[1], k) for k in range(3) if bounds[k] < d <= bounds[k + 1])
        got = spatial_stats._distance_counts(obs, "kind", bounds, same, size).collect()
        assert {(r["label_a"], r["label_b"], r["bin"]): r["n"] for r in got} == dict(want)
    assert blocks[0].count() == len({(math.floor(r[2] / 4), math.floor(r[3] / 4)) for r in known})

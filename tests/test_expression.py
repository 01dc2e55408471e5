import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.operators import annotation, de, dynamics, features, normalize, qc, tissue
from cellweave.sources import datasets


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    dense = rng.poisson(1.0, size=(60, 12)).astype(float)
    dense[:20, 0] += 8
    rows = [(i, f"g{j}", float(dense[i, j])) for i in range(60) for j in range(12) if dense[i, j]]
    obs = spark.createDataFrame([(i, "abc"[i // 20], f"s{i % 6}", "xy"[i % 6 < 3]) for i in range(60)], "cell_id int, kind string, sample string, cond string")
    return dense, spark.createDataFrame(rows, "cell_id int, gene_id string, value double").cache(), obs


def test_gene_stats_equal_the_dense_matrix(planted):
    dense, expr, obs = planted
    for r in features.gene_stats(expr, obs).collect():
        col = dense[:, int(r["gene_id"][1:])]
        assert r["mean"] == pytest.approx(col.mean()) and r["var_pop"] == pytest.approx(col.var()) and r["var_sample"] == pytest.approx(col.var(ddof=1))


def test_wilcoxon_equals_dense_ranks(planted):
    dense, expr, obs = planted
    got = {(r["group"], r["gene_id"]): r["scores"] for r in de.rank_genes_wilcoxon(expr, obs, "kind").collect()}
    for j in range(12):
        col = dense[:, j]
        ranks = np.array([(col < v).sum() + ((col == v).sum() + 1) / 2 for v in col])
        for g in range(3):
            n1, n = 20, 60
            want = (ranks[g * 20:(g + 1) * 20].sum() - n1 * (n + 1) / 2) / np.sqrt(n1 * (n - n1) * (n + 1) / 12)
            assert got[("abc"[g], f"g{j}")] == pytest.approx(want)


def test_nb_test_finds_a_planted_effect(spark):
    rng = np.random.default_rng(1)
    rows, obs = [], []
    for s in range(8):
        other = s >= 4
        for j in range(30):
            mean = 60 * (4 if other and j == 0 else 1)
            rows.append((s, f"g{j}", float(rng.poisson(mean))))
        obs.append((s, "c", f"s{s}", "treated" if other else "control"))
    expr = spark.createDataFrame(rows, "cell_id int, gene_id string, value double")
    cells = spark.createDataFrame(obs, "cell_id int, cluster string, sample string, cond string")
    out = {r["gene_id"]: r for r in de.condition_compare(expr, cells, "sample", "cluster", "cond", "control", "nb_glm").collect()}
    assert out["g0"]["log_fc"] == pytest.approx(np.log(4), abs=0.2) and out["g0"]["pvalue_adj"] < 1e-3
    assert np.mean([r["pvalue_adj"] < 0.05 for g, r in out.items() if g != "g0"]) < 0.2


def test_nnls_recovers_planted_shares(spark):
    rng = np.random.default_rng(4)
    sig = rng.uniform(0, 3, size=(3, 25))
    shares = rng.dirichlet(np.ones(3), size=12)
    shares[0] = [1, 0, 0]
    mix = shares @ sig
    signature = spark.createDataFrame([(f"t{k}", j, float(sig[k, j])) for k in range(3) for j in range(25)], "cell_type string, gene_id int, mean double")
    expr = spark.createDataFrame([(i, j, float(mix[i, j])) for i in range(12) for j in range(25)], "cell_id int, gene_id int, value double")
    spots = spark.createDataFrame([(i,) for i in range(13)], "cell_id int")
    got = {(r["cell_id"], r["cell_type"]): r["proportion"] for r in annotation.nnls_deconvolve(expr, spots, signature).collect()}
    for i in range(12):
        assert [got[(i, f"t{k}")] for k in range(3)] == pytest.approx(list(shares[i]), abs=1e-6)
    assert [got[(12, f"t{k}")] for k in range(3)] == [0.0, 0.0, 0.0]


def test_filter_order_and_presets(planted, spark):
    _, expr, obs = planted
    var = spark.createDataFrame([(f"g{j}", "MT-A" if j == 3 else f"G{j}") for j in range(12)], "gene_id string, symbol string")
    flagged = qc.flag_mito(var)
    assert flagged.filter("is_mt").count() == 1
    kept, cells = qc.filter_cells(expr, obs, flagged, qc.Thresholds(100.0, 0, 0))
    assert kept.count() == expr.count() and cells.count() == 60
    assert qc.tissue_preset("brain", qc.Thresholds(max_genes=9)) == qc.Thresholds(10, 200, 9)
    with pytest.warns(UserWarning):
        assert qc.tissue_preset("moon") == qc.Thresholds()


def test_negative_counts_are_clipped_or_rejected(spark):
    df = spark.createDataFrame([(1, 1, -2.0), (1, 2, 2.5), (1, 3, 3.5)], "cell_id int, gene_id int, value double")
    assert [r["value"] for r in normalize.sanitize_counts(df).orderBy("gene_id").collect()] == [0.0, 2.0, 4.0]
    with pytest.raises(Exception, match="negative counts"):
        normalize.sanitize_counts(df, reject_negative=True).collect()


def test_pca_is_oriented(planted):
    _, expr, obs = planted
    genes = features.top_variance_genes(expr, obs, 5)
    out = features.pca(normalize.scale(expr, obs, genes), genes, 3)
    assert out.count() == 60 and len(out.first()["vec"]) == 3
    assert features.suggest_n_pcs([0.5, 0.4, 0.1]) == 15 and features.suggest_n_pcs(None) == 30


def test_spearman_direction(planted, spark):
    _, expr, _ = planted
    obs = spark.createDataFrame([(i, float(-i)) for i in range(60)], "cell_id int, pseudotime double")
    top = dynamics.spearman_genes(expr, obs).orderBy(F.abs("correlation").desc()).first()
    assert top["gene_id"] == "g0" and top["direction"] == "increasing" and top["fdr"] < 0.01


def test_cox_recovers_a_hazard_ratio(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    t = rng.exponential(1 / np.exp(0.8 * x))
    df = spark.createDataFrame([(float(a), int(b < 2), float(min(b, 2))) for a, b in zip(x, t)], "x double, event int, time double")
    _, beta = tissue.cox_ph(df, ["x"])
    assert beta[0] == pytest.approx(0.8, abs=0.15)


def test_coordinates_are_checked(spark):
    ok = spark.createDataFrame([(1, 0.0, 1.0)], "cell_id int, x double, y double")
    assert datasets.validate_coords(ok) is ok
    with pytest.raises(ValueError, match="not finite"):
        datasets.validate_coords(spark.createDataFrame([(1, float("nan"), 1.0)], "cell_id int, x double, y double"))
    with pytest.raises(ValueError, match="missing"):
        datasets.validate_coords(ok.drop("y"))
    assert datasets.validate_coords(ok.drop("y"), required=False).count() == 1


def test_text_matrix_directory(spark, tmp_path):
    (tmp_path / "matrix.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%note\n3 2 3\n1 1 5\n3 1 2\n2 2 7\n")
    (tmp_path / "barcodes.tsv").write_text("AAA\nCCC\n")
    (tmp_path / "features.tsv").write_text("E1\tG1\tGene\nE2\tG2\tGene\nE3\tG3\tGene\n")
    got = {(r["cell_id"], r["gene_id"], r["value"]) for r in datasets.read_mtx_triplets(spark, str(tmp_path))["expr"].collect()}
    assert got == {("AAA", "E1", 5.0), ("AAA", "E3", 2.0), ("CCC", "E2", 7.0)}


def test_merged_rows_are_dealt_to_tasks_by_their_number(spark):
    rows = spark.range(900).select(F.col("id").alias("cell_id"), F.when(F.col("id") % 90 > 0, F.col("id") % 90).alias("gene_id"), F.lit(1.0).alias("value"))
    other = rows.filter("gene_id < 60 OR gene_id IS NULL")
    obs = rows.select("cell_id")
    few, _ = datasets.merge_samples([(rows, obs), (other, obs)], ["s", "t"])
    many, _ = datasets.merge_samples([(rows, obs), (other, obs)], ["s", "t"], rows_per_task=10)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 59 * 20
    assert many.rdd.getNumPartitions() == (900 + 600) // 10 + 1


def test_merge_and_pair(spark):
    a = spark.createDataFrame([(1, "g1", 1.0), (1, "g2", 1.0)], "cell_id int, gene_id string, value double")
    obs = spark.createDataFrame([(1, 0.0, 0.0)], "cell_id int, x double, y double")
    expr, cells = datasets.merge_samples([(a, obs), (a.filter("gene_id = 'g1'"), obs)], ["s", "t"])
    assert {r["gene_id"] for r in expr.collect()} == {"g1"} and {r["cell_id"] for r in cells.collect()} == {"s_1", "t_1"}
    with pytest.raises(ValueError):
        datasets.merge_samples([(a, obs), (a, obs)], ["s", "s"])
    with pytest.raises(ValueError):
        datasets.pair_modalities(obs, obs.withColumn("cell_id", F.lit(9)))


def test_lsi_matches_a_dense_svd(planted):
    dense, expr, obs = planted
    binary = (dense > 0).astype(float)
    tf = binary / binary.sum(1, keepdims=True)
    weights = tf * np.log(60 / (tf.sum(0) + 1e-10))
    logged = np.log1p(1e4 * weights / np.abs(weights).sum(1, keepdims=True))
    u, s, _ = np.linalg.svd(logged, full_matrices=False)
    scores = (u * s)[:, 1:4]
    scores = (scores - scores.mean(0)) / scores.std(0)
    got = {r["cell_id"]: r["vec"] for r in features.lsi(expr, obs, 3).collect()}
    mat = np.array([got[i] for i in range(60)])
    assert np.abs((mat * scores).mean(0)) == pytest.approx(np.ones(3), abs=1e-6)

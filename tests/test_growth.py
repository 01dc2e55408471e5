"""Steps that must grow with their input: results beside plain computations on small rows."""

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import communication as cc
from cellweave.operators import de
from cellweave.operators import dynamics as dy
from cellweave.operators import enrichment
from cellweave.operators import features
from cellweave.operators import neighbors
from cellweave.operators import spatial_stats as sp
from cellweave.streaming import messages


def copy_number_input(spark, n_genes=60, n_cells=12, seed=1):
    rng = np.random.default_rng(seed)
    var = spark.createDataFrame([(g, "AB"[g % 2], g) for g in range(n_genes)], "gene_id long, chromosome string, start long")
    rows = [(c, g, float(rng.integers(1, 6))) for c in range(n_cells) for g in range(n_genes) if rng.random() < 0.2]
    obs = spark.createDataFrame([(c, "xyz"[c % 3]) for c in range(n_cells)], "cell_id long, label string")
    return spark.createDataFrame(rows, "cell_id long, gene_id long, value double"), obs, var


def dense_profile(expr, obs, var, reference, window, step, clip=3.0, threshold=1.5):
    genes, cells = [r[0] for r in var.orderBy("chromosome", "start").collect()], [r[0] for r in obs.orderBy("cell_id").collect()]
    values = {(r.cell_id, r.gene_id): r.value for r in expr.collect()}
    x = np.array([[values.get((c, g), 0.0) for g in genes] for c in cells])
    x = np.clip(x - x[[cells.index(r[0]) for r in reference.collect()]].mean(axis=0), -clip, clip)
    half = len(genes) // 2
    names, columns = [], []
    for i, name in enumerate("AB"):
        for b in range((half - window) // step + 1):
            names.append((name, b))
            columns.append(x[:, i * half + b * step : i * half + b * step + window].mean(axis=1))
    v = np.array(columns).T
    v -= np.median(v, axis=1, keepdims=True)
    v[np.abs(v) < threshold * v.std()] = 0.0
    return {(c, *name): v[i, j] for i, c in enumerate(cells) for j, name in enumerate(names)}


def test_copy_number_from_corrected_windows_equals_the_dense_profile(spark):
    expr, obs, var = copy_number_input(spark)
    reference = obs.filter("label = 'x'")
    wanted = dense_profile(expr, obs, var, reference, 5, 2)
    whole = {(r.cell_id, r.chromosome, r.bin): r.cnv for r in dy.cnv_profile(expr, obs, var, reference, 5, 2).collect()}
    assert whole.keys() == wanted.keys() and all(abs(whole[k] - wanted[k]) < 1e-9 for k in wanted)
    sparse_rows = dy.cnv_profile(expr, obs, var, reference, 5, 2, zeros=False)
    found = {(r.cell_id, r.chromosome, r.bin): r.cnv for r in sparse_rows.collect()}
    assert found.keys() == {k for k, v in wanted.items() if v} and all(abs(found[k] - wanted[k]) < 1e-9 for k in found)
    windows = dy.cnv_windows(var, 5, 2)
    assert {tuple(r) for r in windows.collect()} == {k[1:] for k in wanted}
    mean = {(r.label, r.chromosome, r.bin): r.cnv for r in dy.cnv_cluster_mean(sparse_rows, obs, "label", windows).collect()}
    assert len(mean) == 3 * len({k[1:] for k in wanted})
    for (label, *at), v in mean.items():
        assert abs(v - np.mean([wanted[(c, *at)] for c in range(12) if "xyz"[c % 3] == label])) < 1e-9
    score = dict(dy.cnv_score(sparse_rows, obs.select("cell_id", F.col("label").alias("cluster")), windows).collect())
    for c, v in score.items():
        assert abs(v - np.mean([abs(x) for k, x in wanted.items() if k[0] % 3 == c % 3])) < 1e-9


def test_the_median_of_a_cell_needs_its_corrected_windows_only():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 40):
        for k in range(n + 1):
            base, ranks, mine = np.sort(rng.normal(size=n)), np.sort(rng.permutation(n)[:k]), rng.normal(size=k) * 3
            changed = base.copy()
            changed[ranks] = mine
            assert dy._middle(base, ranks, mine) == np.median(changed)


def test_kernel_features_from_places_equal_those_sent_with_every_row(spark):
    rng = np.random.default_rng(3)
    obs = spark.createDataFrame([(c, float(rng.normal()), float(rng.normal())) for c in range(40)], "cell_id long, x double, y double")
    expr = spark.createDataFrame([(c, g, float(rng.integers(1, 5))) for c in range(40) for g in range(30) if g == 0 or rng.random() < 0.2], "cell_id long, gene_id long, value double")
    table, sites = features.random_fourier_features(obs, 16), features.random_fourier_features(obs, 16, as_sites=True)
    assert sites.sites.columns == ["cell_id", "x", "y"]
    vec = {r.cell_id: np.array(r.vec) for r in table.collect()}
    wanted = {}
    expr = expr.unionByName(spark.createDataFrame([(41, 0, 2.0), (3, 1, None)], expr.schema)).persist()  # no such cell, no value
    for r in expr.filter("value IS NOT NULL AND cell_id < 40").collect():
        wanted[r.gene_id] = wanted.get(r.gene_id, 0.0) + r.value * vec[r.cell_id]
    for given in (table, sites):
        found = {r.gene_id: r.statistic for r in sp.svg_random_kernel(expr, obs, given).collect()}
        assert found.keys() == wanted.keys() and all(abs(found[g] - (v * v).sum() / 40) < 1e-9 for g, v in wanted.items())


def test_permuted_ligand_receptor_scores_shuffle_the_matrix_once(spark):
    rng = np.random.default_rng(4)
    obs = spark.createDataFrame([(c, "abc"[c % 3] if c else None) for c in range(30)], "cell_id long, label string")
    expr = spark.createDataFrame([(c, g, float(rng.integers(1, 4))) for c in range(30) for g in range(8) if rng.random() < 0.4], "cell_id long, gene_id long, value double")
    pairs = spark.createDataFrame([(g, g + 1) for g in range(9)] + [(2, 3)], "ligand long, receptor long")
    x, perms = {(r.cell_id, r.gene_id): r.value for r in expr.collect()}, [dict(obs.collect())]
    perms += [{} for _ in range(7)]
    for p, c, label in S.permute_labels(obs, "cell_id", "label", 7).collect():
        perms[p][c] = label
    size = {l: sum(v == l for v in perms[0].values()) for l in "abc"}

    def mean(p, label, gene):
        values = [x[c, gene] for c in range(30) if perms[p][c] == label and (c, gene) in x]
        return sum(values) / size[label] if values else float("nan")

    for mode in ("product", "mean"):
        meet = (lambda a, b: a * b) if mode == "product" else (lambda a, b: (a + b) / 2.0)
        wanted = []
        for ligand, receptor, k in [(g, g + 1, 2 if g == 2 else 1) for g in range(8)]:
            for s in "abc":
                for t in "abc":
                    seen = meet(mean(0, s, ligand), mean(0, t, receptor))
                    if seen > 0:
                        beyond = sum(meet(mean(p, s, ligand), mean(p, t, receptor)) >= seen for p in range(1, 8)) * k * k
                        wanted += [(ligand, receptor, s, t, round(seen, 6), round((beyond + 1) / 8, 6))] * k
        scored = cc.lr_score(expr, obs, pairs, "label", 7, mode=mode)
        found = sorted(tuple(r) for r in scored.collect())
        assert len(found) == len(wanted) and all(a[:4] == b[:4] and abs(a[4] - b[4]) < 2e-6 and abs(a[5] - b[5]) < 2e-6 for a, b in zip(found, sorted(wanted)))


def test_local_moran_counts_draws_from_the_cells_with_values(spark):
    rng = np.random.default_rng(5)
    obs = spark.createDataFrame([(c,) for c in range(24)], "cell_id long")
    edges = spark.createDataFrame([(c, (c + d) % 24) for c in range(23) for d in (1, 2, 5)], "src long, dst long")
    expr = spark.createDataFrame([(c, g, float(rng.uniform(1, 9))) for c in range(24) for g in range(3) if rng.random() < 0.3], "cell_id long, gene_id long, value double")
    x = np.zeros((24, 3))
    for r in expr.collect():
        x[r.cell_id, r.gene_id] = r.value
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    rows = sp.local_moran(expr, obs, edges, expr.select("gene_id").distinct(), permutations=19)
    found = {(r.cell_id, r.gene_id): (r.Ii, r.p_sim) for r in rows.collect()}
    assert len(found) == 24 * 3 and all(found[23, g] == (0.0, None) for g in range(3))
    slot = dict(S.hash_order(obs, F.concat_ws("-", F.lit("42-slot"), F.col("cell_id"))).select("cell_id", "slot").collect())
    cell_at = {s: c for c, s in slot.items()}
    hashes = {(r.src, r.perm, r._j): r.d for r in edges.withColumn("_j", F.row_number().over(Window.partitionBy("src").orderBy("dst"))).withColumn(
        "perm", F.explode(F.sequence(F.lit(1), F.lit(19)))).select("src", "perm", "_j", (F.pmod(F.xxhash64("src", "perm", "_j", F.lit(42)), F.lit(23)) + 1).alias("d")).collect()}
    for c in range(23):
        lag = z[[(c + d) % 24 for d in (1, 2, 5)]].mean(axis=0)
        sims = np.array([z[[cell_at[hashes[c, p, j] + (hashes[c, p, j] >= slot[c])] for j in (1, 2, 3)]].mean(axis=0) for p in range(1, 20)])
        for g in range(3):
            local = 23 / 24 * z[c, g] * lag[g]
            above = int((23 / 24 * z[c, g] * sims[:, g] >= local - 1e-9).sum())
            assert abs(found[c, g][0] - local) < 1e-9 and abs(found[c, g][1] - (min(above, 19 - above) + 1) / 20) < 1e-9


def test_genes_fitted_together_equal_genes_fitted_alone():
    rng = np.random.default_rng(6)
    counts, sf = rng.poisson(rng.gamma(2, 20, (40, 1)) * np.ones(8)).astype(float), np.tile(rng.uniform(0.5, 2, 8), (40, 1))
    x = np.tile(np.arange(8) % 2.0, (40, 1))
    together = np.column_stack(de._nb_wald(counts, sf, x))
    alone = np.vstack([np.column_stack(de._nb_wald(counts[i : i + 1], sf[i : i + 1], x[i : i + 1])) for i in range(40)])
    assert together.shape == (40, 3) and np.allclose(together, alone, rtol=1e-9, atol=0)
    for i in range(40):  # coefficients solve the score equations
        a, b = together[i, 2], together[i, 0]
        rate = counts[i] / sf[i]
        assert abs(b - np.log(rate[x[i] == 1].mean() / rate[x[i] == 0].mean())) < 0.5 and a >= 1e-8


def test_the_matrix_is_read_once_for_markers_and_once_for_their_list(spark):
    reads = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(v):
        reads.add(1)
        return v

    rows = [(c, g, float(1 + (c * 7 + g * 3) % 5)) for c in range(30) for g in range(8) if (c + g) % 3]
    obs = spark.createDataFrame([(c, "ab"[c % 2]) for c in range(30)], "cell_id long, label string")
    plain = spark.createDataFrame(rows, "cell_id long, gene_id long, value double")
    expr = plain.withColumn("value", seen.asNondeterministic()("value"))
    listed = enrichment.gene_list(de.rank_genes_wilcoxon(expr, obs, "label"), n_top=3)
    assert listed.count() and reads.value == len(rows)
    found = {(r.group, r.gene_id): r for r in de.rank_genes_wilcoxon(plain, obs, "label").collect()}
    assert len(found) == 16
    for (label, gene), r in found.items():
        values = np.array([next((v for c, g, v in rows if (c, g) == (cell, gene)), 0.0) for cell in range(30)])
        ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
        side = np.array(["ab"[c % 2] == label for c in range(30)])
        assert abs(r.scores - (ranks[side].sum() - 15 * 31 / 2) / np.sqrt(15 * 15 * 31 / 12)) < 1e-9
        a, b = values[side].mean(), values[~side].mean()
        assert abs(r.logfoldchanges - np.log2((np.expm1(a) + 1e-9) / (np.expm1(b) + 1e-9))) < 1e-9


def test_a_chat_is_taken_in_parts_and_in_order():
    n = 2 * messages.CHUNK + 5
    frames = [pd.DataFrame({"ts": pd.to_datetime([n - i], unit="s"), "content": [None if i == 1 else str(i)], "is_group": [None]}) for i in range(5)]
    frames.append(pd.DataFrame({"ts": pd.to_datetime(range(6, n + 1), unit="s"), "content": [str(n - i) for i in range(6, n + 1)], "is_group": [True] * (n - 5)}))
    parts = list(messages._chunks(iter(frames), ["content"]))
    assert [len(p) for p in parts] == [messages.CHUNK, messages.CHUNK, 5 + n - 5 - 2 * messages.CHUNK] and {p["content"].dtype for p in parts} == {np.dtype(object)}
    whole = pd.concat(parts)
    assert whole["ts"].is_monotonic_increasing and whole["content"].isna().sum() == 1 and None in set(whole["content"]) and True in set(whole["is_group"])


def test_embedding_neighbours_are_merged_inside_tiles(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "MAX_TILE", 3)
    rng = np.random.default_rng(5)
    mat = rng.integers(-2, 3, size=(150, 3)).astype(float)  # many ties and copies
    rows = [(f"c{i:03d}", [float(v) for v in mat[i]], int(i % 2)) for i in range(150)]
    cells = spark.createDataFrame(rows, "cell_id string, vec array<double>, batch int")
    tiles = neighbors._tiled(spark.createDataFrame([(0, b) for b in range(20)] + [(1, b) for b in range(4)], "pivot int, block long"), np.array([[0.0], [1.0]]), "tile")
    assert max(r["n"] for r in tiles.groupBy("tile").agg(F.count("*").alias("n")).collect()) == 3
    got = {}
    for r in neighbors.knn_embedding(cells.select("cell_id", "vec"), cells, 4, by=["batch"], rows=8, n_pivots=5).collect():
        got.setdefault((r["src"], r["batch"]), []).append((r["rank"], r["dst"]))
    for i in range(150):
        for b in range(2):
            d = ((mat - mat[i]) ** 2).sum(1)
            order = sorted((j for j in range(150) if j % 2 == b), key=lambda j: (d[j], j))[:4]
            assert [x for _, x in sorted(got[f"c{i:03d}", b])] == [f"c{j:03d}" for j in order]


def test_neighbour_sums_in_blocks_equal_a_join(spark, monkeypatch):
    rng = np.random.default_rng(7)
    places = spark.createDataFrame([(i, None if i == 5 else float(i % 7), 1.0 if i > 90 else float(i // 7)) for i in range(120)], "cell_id int, x double, y double")
    links = [(int(s), int(d), None if s % 11 == 0 and d % 2 else float(s % 3 + 1)) for s in range(120) for d in rng.choice(125, 4, replace=False)]
    expr = [(int(c), f"g{rng.integers(5)}" if rng.random() < 0.9 else None, None if rng.random() < 0.1 else float(rng.integers(9))) for c in range(120) for _ in range(3)]
    links = spark.createDataFrame(links, "src int, dst int, weight double")
    expr = spark.createDataFrame(expr, "cell_id int, gene_id string, value double")
    total = links.groupBy("src").agg(F.sum("weight").alias("t"))
    plain = links.join(expr.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src", "gene_id").agg(F.sum(F.col("weight") * F.col("value")).alias("s")).join(total, "src")
    sums = {(r.src, r.gene_id): r.s for r in plain.collect()}
    means = {(r.src, r.gene_id): None if r.s is None else r.s / r.t for r in plain.collect()}
    for mean, wanted in ((False, sums), (True, means)):
        for near in (None, places):
            got = {(r.src, r.gene_id): r.value for r in neighbors.neighborhood_sums(links, expr, ["value"], near, mean, cells=16).collect()}
            assert got.keys() == wanted.keys()
            assert all(got[k] is None if v is None else abs(got[k] - v) < 1e-9 for k, v in wanted.items())
    blocks = neighbors.place_blocks(places, 16).groupBy("block").count().collect()
    assert sum(r["count"] for r in blocks) == 119 and max(r["count"] for r in blocks) <= 32
    monkeypatch.setattr(neighbors, "ENTRIES", 5)
    table = neighbors._sum_block(links.toArrow(), expr.toArrow(), ["value"], False).to_pylist()
    assert {(r["src"], r["gene_id"]): r["value"] for r in table} == sums


def test_principal_components_build_their_vectors_once(spark):
    built = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        built.add(1)
        return v

    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(c, g, float(rng.normal())) for c in range(30) for g in range(4)], "cell_id int, gene_id int, value double")
    scaled = rows.withColumn("value", counted("value"))
    assert features.pca(scaled, rows.select("gene_id").distinct(), 2).count() == 30
    assert built.value == 120

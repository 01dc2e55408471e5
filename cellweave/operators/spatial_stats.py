"""Spatial autocorrelation, hot spots, label neighbourhoods and point patterns.

Everything runs on ``edges(src, dst[, weight])`` and the sparse ``expr``; the
implicit zeros enter in closed form, so only non-zero values meet the edges.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import features, neighbors, shortest_paths
from cellweave.session import cut, materialize


def _weighted(edges: DataFrame) -> DataFrame:
    return edges if "weight" in edges.columns else edges.withColumn("weight", F.lit(1.0))


# --------------------------------------------------------------- interpretation
def _ladder(value: Column, steps, otherwise: str) -> Column:
    out = None
    for above, text in steps:
        out = F.when(value > above, text) if out is None else out.when(value > above, text)
    return out.otherwise(otherwise)


def interpret_moran(value: Column) -> Column:
    return _ladder(value, [(0.3, "strong positive"), (0.1, "moderate positive"), (-0.1, "weak or random"), (-0.3, "moderate negative")], "strong negative")


def interpret_geary(value: Column) -> Column:
    return (
        F.when(value < 0.5, "strong positive").when(value < 0.8, "moderate positive").when(value < 1.2, "weak or random")
        .when(value < 1.5, "moderate negative").otherwise("strong negative")
    )


def interpret_zscore(z: Column) -> Column:
    return F.when(z > 2, "co-localized").when(z < -2, "segregated").otherwise("no association")


# ------------------------------------------------------------ global statistics
def weight_moments(edges: DataFrame) -> DataFrame:
    """One row: S0, S1 and S2 of the weights."""
    e = edges.select("src", "dst", "weight")
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("weight").alias("_back"))
    both = e.unionByName(back.withColumnRenamed("_back", "weight")).groupBy("src", "dst").agg(F.sum("weight").alias("_w"))
    s01 = both.agg((F.sum("_w") / 2.0).alias("s0"), (F.sum(F.col("_w") * F.col("_w")) / 2.0).alias("s1"))
    sums = both.groupBy("src").agg(F.sum("_w").alias("_t"))
    return s01.crossJoin(sums.agg(F.sum(F.col("_t") * F.col("_t")).alias("s2")))  # one-row sides


def _cross_products(expr: DataFrame, edges: DataFrame, perm: list[str]) -> DataFrame:
    """Per gene: sum of w * x_src * x_dst, and of x times the cell's total weight."""
    ends = edges.select(F.col("src").alias("cell_id"), "weight").unionByName(edges.select(F.col("dst").alias("cell_id"), "weight"))
    touch = ends.groupBy("cell_id").agg(F.sum("weight").alias("_t"))
    linear = expr.join(touch, "cell_id").groupBy(*perm, "gene_id").agg(
        F.sum(F.col("value") * F.col("_t")).alias("xt"), F.sum(F.col("value") * F.col("value") * F.col("_t")).alias("xxt")
    )
    left = expr.select(*perm, F.col("cell_id").alias("src"), "gene_id", F.col("value").alias("_a"))
    right = expr.select(*perm, F.col("cell_id").alias("dst"), "gene_id", F.col("value").alias("_b"))
    cross = left.join(edges, "src").join(right, [*perm, "dst", "gene_id"]).groupBy(*perm, "gene_id").agg(
        F.sum(F.col("weight") * F.col("_a") * F.col("_b")).alias("xx")
    )
    return linear.join(cross, [*perm, "gene_id"], "left").na.fill(0.0, ["xx"])


def _global(expr: DataFrame, obs: DataFrame, edges: DataFrame, row_standardize: bool, n_perms: int, seed: int, geary: bool) -> DataFrame:
    edges = _weighted(edges).select("src", "dst", "weight")
    if row_standardize:
        edges = neighbors.row_normalize(edges)
    stats = features.gene_stats(expr, obs).select("gene_id", "n", "mean", "sumsq")
    moments = weight_moments(edges)
    scale = F.col("sumsq") - F.col("n") * F.col("mean") * F.col("mean")
    if geary:
        score = (F.col("n") - 1) * (F.col("xxt") - 2.0 * F.col("xx")) / (2.0 * F.col("s0") * scale)
    else:
        score = F.col("n") / F.col("s0") * (F.col("xx") - F.col("mean") * F.col("xt") + F.col("mean") * F.col("mean") * F.col("s0")) / scale
    cross = _cross_products(expr, edges, [])
    n = F.col("n")
    if geary:
        expected, name = F.lit(1.0), "C"
        variance = ((2.0 * F.col("s1") + F.col("s2")) * (n - 1) - 4.0 * F.col("s0") * F.col("s0")) / (2.0 * (n + 1) * F.col("s0") * F.col("s0"))
    else:
        expected, name = -1.0 / (n - 1), "I"
        variance = (n * n * F.col("s1") - n * F.col("s2") + 3.0 * F.col("s0") * F.col("s0")) / ((n - 1) * (n + 1) * F.col("s0") * F.col("s0")) - expected * expected
    base = stats.join(cross, "gene_id").crossJoin(moments)  # one-row side
    scored = base.filter(scale > 1e-12).select("gene_id", score.alias(name), expected.alias("_e"), variance.alias("var_norm"))
    z = (F.col(name) - F.col("_e")) / F.sqrt("var_norm")
    scored = scored.select("gene_id", name, "var_norm", S.norm_sf(F.abs(z)).alias("pval_norm"))
    if n_perms:
        moved = S.permute_labels(obs.select("cell_id", F.col("cell_id").alias("_from")), "cell_id", "_from", n_perms, seed)
        shuffled = expr.withColumnRenamed("cell_id", "_from").join(moved, "_from").select("perm", "cell_id", "gene_id", "value")
        perms = _cross_products(shuffled, edges, ["perm"]).join(stats, "gene_id").crossJoin(moments)  # one-row side
        perms = perms.select("gene_id", score.alias("_sim"))
        beyond = perms.join(scored, "gene_id").groupBy("gene_id").agg(F.sum(F.when(F.col("_sim") >= F.col(name), 1).otherwise(0)).alias("_above"))
        extreme = F.least(F.col("_above"), F.lit(n_perms) - F.col("_above"))
        scored = scored.join(beyond, "gene_id").withColumn("pval_sim", S.perm_pvalue(extreme, n_perms)).drop("_above")
    return scored


def moran_i(expr, obs, edges, n_perms: int = 0, seed: int = 42, row_standardize: bool = True) -> DataFrame:
    """Moran's I per gene with its one-sided normal p-value and, if asked, a permutation p-value.

    Constant genes have no score and are left out.
    """
    return _global(expr, obs, edges, row_standardize, n_perms, seed, geary=False)


def geary_c(expr, obs, edges, n_perms: int = 0, seed: int = 42, row_standardize: bool = True) -> DataFrame:
    """Geary's C per gene, same columns as :func:`moran_i`."""
    return _global(expr, obs, edges, row_standardize, n_perms, seed, geary=True)


# ------------------------------------------------------------- local statistics
def dense_genes(expr: DataFrame, obs: DataFrame, genes: DataFrame) -> DataFrame:
    """Every (cell, chosen gene) with zeros filled in; the gene list is bounded by its selection."""
    listed = genes.agg(F.collect_set("gene_id").alias("_genes"))
    grid = obs.select("cell_id").crossJoin(listed).select("cell_id", F.explode("_genes").alias("gene_id"))  # one-row side
    return grid.join(expr, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def _lag(dense: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    right = dense.select(F.col("cell_id").alias("dst"), "gene_id", F.col(value).alias("_b"))
    return edges.join(right, "dst").groupBy(F.col("src").alias("cell_id"), "gene_id").agg(
        F.sum(F.col("weight") * F.col("_b")).alias("lag"), F.sum("weight").alias("w1"), F.sum(F.col("weight") * F.col("weight")).alias("w2")
    )


def getis_ord_gstar(expr: DataFrame, obs: DataFrame, edges: DataFrame, genes: DataFrame) -> DataFrame:
    """Gi* z-score and two-sided p per (gene, cell); the cell counts as its own neighbour with weight 1."""
    edges = _weighted(edges).select("src", "dst", "weight")
    dense = dense_genes(expr, obs, genes)
    stats = features.gene_stats(expr, obs, genes).select("gene_id", "n", "mean", F.sqrt(F.greatest("var_pop", F.lit(0.0))).alias("s"))
    rows = dense.join(_lag(dense, edges, "value"), ["cell_id", "gene_id"], "left").na.fill(0.0, ["lag", "w1", "w2"]).join(stats, "gene_id")
    n = F.col("n")
    num = F.col("lag") + F.col("value") - F.col("mean") * (F.col("w1") + 1.0)
    den = F.col("s") * F.sqrt((n * (F.col("w2") + 1.0) - (F.col("w1") + 1.0) * (F.col("w1") + 1.0)) / (n - 1))
    z = F.when((F.col("w1") == 0) | (F.col("s") < 1e-10) | (den <= 1e-10), 0.0).otherwise(num / den)
    return rows.select("gene_id", "cell_id", z.alias("z")).withColumn("pval", S.norm_pvalue(F.col("z")))


def hot_cold_counts(gstar: DataFrame, alpha: float = 0.05) -> DataFrame:
    sig = F.col("pval") < alpha
    return gstar.groupBy("gene_id").agg(
        F.sum(F.when(sig & (F.col("z") > 0), 1).otherwise(0)).alias("n_hot"), F.sum(F.when(sig & (F.col("z") < 0), 1).otherwise(0)).alias("n_cold")
    )


def local_moran(expr: DataFrame, obs: DataFrame, edges: DataFrame, genes: DataFrame, permutations: int = 99, seed: int = 42) -> DataFrame:
    """Local Moran per (gene, cell) on row-normalised weights, with conditional permutation p_sim.

    Each permutation draws as many other cells as the cell has neighbours (by
    hash, the same draws for every gene), and keeps the weights in place.  Zeros
    stay implicit: a lag is the zero's z times the weights, plus what the cells
    with a value add to it, so only those are sent to the draws that meet them.
    """
    edges = neighbors.row_normalize(_weighted(edges).select("src", "dst", "weight"))
    edges = materialize(edges.withColumn("_j", F.row_number().over(Window.partitionBy("src").orderBy("dst"))))
    stats = features.gene_stats(expr, obs, genes).select("gene_id", "n", "mean", F.sqrt(F.greatest("var_pop", F.lit(0.0))).alias("s"))
    listed = stats.join(genes.select("gene_id").distinct(), "gene_id", "left_semi").collect()  # the chosen genes
    spark, kind = obs.sparkSession, dict(expr.dtypes)["gene_id"]
    zero = np.array([-r["mean"] / r["s"] if r["s"] > 1e-10 else 0.0 for r in listed])
    scale = np.array([(r["n"] - 1) / r["n"] for r in listed])
    names = spark.createDataFrame([(r["gene_id"], i, r["mean"], r["s"], float(zero[i])) for i, r in enumerate(listed)], f"gene_id {kind}, _g int, _mean double, _s double, _zero double")
    z = F.when(F.col("_s") > 1e-10, (F.coalesce("value", F.lit(0.0)) - F.col("_mean")) / F.col("_s")).otherwise(0.0)
    valued = materialize(expr.join(names, "gene_id").select("cell_id", "_g", z.alias("_z"), "_zero"))
    copies = obs.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_m"))
    own = valued.groupBy("cell_id").agg(F.collect_list(F.struct("_g", "_z")).alias("_own"))  # at most the chosen genes
    # What a cell adds to a lag beyond the zeros: _g = -1 stands for the copies of its id.
    beyond = valued.groupBy("cell_id", "_g").agg((F.sum("_z") - F.max("_zero")).alias("_e")).join(copies, "cell_id").select("cell_id", "_g", (F.col("_e") * F.col("_m")).alias("_e"))
    beyond = beyond.unionByName(copies.filter("_m > 1").select("cell_id", F.lit(-1).alias("_g"), (F.col("_m") - 1.0).alias("_e")))
    beyond = materialize(beyond.filter("_e <> 0"))
    known = edges.join(copies.select(F.col("cell_id").alias("dst"), "_m"), "dst", "left")
    weights = known.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("_j", "weight", F.col("_m").isNotNull().cast("int").alias("_in")))).alias("_w"))
    meets = edges.join(beyond.withColumnRenamed("cell_id", "dst"), "dst").groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct("_g", (F.col("weight") * F.col("_e")).alias("_v")))).alias("_l"))  # equal parts add in the same order
    rows = copies.join(own, "cell_id", "left").join(weights.withColumnRenamed("src", "cell_id"), "cell_id", "left").join(meets.withColumnRenamed("src", "cell_id"), "cell_id", "left")
    if permutations:
        slots = materialize(S.hash_order(obs.select("cell_id"), F.concat_ws("-", F.lit(f"{seed}-slot"), F.col("cell_id"))))
        n = obs.agg(F.count(F.lit(1)).alias("_n"))
        draws = (
            edges.join(slots.withColumnRenamed("cell_id", "src"), "src").crossJoin(n)  # one-row side
            .withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations))))
            .withColumn("_d", F.pmod(F.xxhash64("src", "perm", "_j", F.lit(seed)), F.col("_n") - 1) + 1)
            .select("src", "perm", "weight", (F.col("_d") + F.when(F.col("_d") >= F.col("slot"), 1).otherwise(0)).alias("slot"))
        )
        at_slot = beyond.join(slots, "cell_id").select("slot", "_g", "_e")
        drawn = draws.join(at_slot, "slot").groupBy(F.col("src").alias("cell_id")).agg(
            F.array_sort(F.collect_list(F.struct("perm", "_g", (F.col("weight") * F.col("_e")).alias("_v")))).alias("_x"))
        rows = rows.join(drawn, "cell_id", "left")
    else:
        rows = rows.withColumn("_x", F.lit(None).cast("array<struct<perm:int,_g:int,_v:double>>"))
    flat = rows.select("cell_id", "_m", *[F.col(f"{a}.{b}").alias(f"{a}{b}") for a, b in (
        ("_own", "_g"), ("_own", "_z"), ("_w", "weight"), ("_w", "_in"), ("_l", "_g"), ("_l", "_v"), ("_x", "perm"), ("_x", "_g"), ("_x", "_v"))])

    def numbers(value, kind=float):
        return np.asarray([] if value is None else value, kind)

    def total(values):
        return float(sum(values.tolist()))  # in order: equal weights give equal sums

    def score(batches):
        n_genes = len(zero)
        for pdf in batches:
            cells, which, found, chance = [], [], [], []
            for r in pdf.rename(columns=lambda c: c.strip("_")).itertuples(index=False):
                every, here = numbers(r.wweight), numbers(r.w_in, int) > 0
                shift = np.zeros(n_genes + 1)
                np.add.at(shift, numbers(r.l_g, int), numbers(r.l_v))  # -1 is the last
                lag = zero * (total(every[here]) + shift[n_genes]) + shift[:n_genes]
                have, mine = numbers(r.own_g, int), numbers(r.own_z)
                rest = np.setdiff1d(np.arange(n_genes), have)
                gene, z = np.concatenate([have, rest]), np.concatenate([mine, zero[rest]])
                local = scale[gene] * z * lag[gene]
                if permutations and len(every):
                    moved = np.zeros((permutations, n_genes + 1))
                    np.add.at(moved, (numbers(r.xperm, int) - 1, numbers(r.x_g, int)), numbers(r.x_v))
                    sims = zero * (r.m * total(every) + moved[:, n_genes:]) + moved[:, :n_genes]
                    above = np.bincount(gene, ((scale[gene] * z) * sims[:, gene] >= local).sum(axis=0), n_genes)[gene] * r.m
                    p = (np.minimum(above, permutations - above) + 1.0) / (permutations + 1.0)
                else:
                    p = np.full(len(gene), np.nan)
                for _ in range(int(r.m)):
                    cells.append((r.cell_id, len(gene)))
                    which.append(gene)
                    found.append(local)
                    chance.append(p)
            if cells:
                who = pd.Series([c for c, _ in cells]).repeat([k for _, k in cells]).reset_index(drop=True)
                yield pd.DataFrame({"cell_id": who, "_g": np.concatenate(which), "Ii": np.concatenate(found), "p_sim": np.concatenate(chance)})

    scored = flat.mapInPandas(score, f"cell_id {dict(obs.dtypes)['cell_id']}, _g int, Ii double, p_sim double")
    done = scored.join(names.select("_g", "gene_id"), "_g").select("gene_id", "cell_id", "Ii", F.when(~F.isnan("p_sim"), F.col("p_sim")).alias("p_sim"))
    return done if permutations else done.drop("p_sim")


def bivariate_moran(expr: DataFrame, obs: DataFrame, edges: DataFrame, gene_a, gene_b) -> DataFrame:
    """Spatial cross-correlation of two genes with a label for its sign."""
    edges = _weighted(edges).select("src", "dst", "weight")
    pair = obs.sparkSession.createDataFrame([(gene_a,), (gene_b,)], ["gene_id"]).join(expr.select("gene_id").distinct(), "gene_id", "left_semi")
    if pair.count() != 2:
        raise ValueError("bivariate statistic needs two different genes that are present")
    stats = features.gene_stats(expr.filter(F.col("gene_id").isin([gene_a, gene_b])), obs)
    moments = stats.agg(*[
        F.max(F.when(F.col("gene_id") == g, e)).alias(name + tag)
        for g, tag in ((gene_a, "a"), (gene_b, "b")) for name, e in (("m", F.col("mean")), ("s", F.sqrt("var_pop") + 1e-10))
    ])
    a = expr.filter(F.col("gene_id") == gene_a).select(F.col("cell_id").alias("src"), F.col("value").alias("_a"))
    b = expr.filter(F.col("gene_id") == gene_b).select(F.col("cell_id").alias("dst"), F.col("value").alias("_b"))
    joined = edges.join(a, "src", "left").join(b, "dst", "left").na.fill(0.0, ["_a", "_b"]).crossJoin(moments)  # one-row side
    za, zb = (F.col("_a") - F.col("ma")) / F.col("sa"), (F.col("_b") - F.col("mb")) / F.col("sb")
    score = joined.agg((F.sum(F.col("weight") * za * zb) / (F.sum("weight") + 1e-10)).alias("bivariate_I"))
    return score.withColumn("direction", F.when(F.col("bivariate_I") > 0, "positive").otherwise("negative"))


# ------------------------------------------------------------- label statistics
def nhood_enrichment(edges: DataFrame, obs: DataFrame, cluster: str, n_perms: int = 1000, seed: int = 42) -> DataFrame:
    """z-score of edge counts between labels against label permutations (every label pair)."""
    labels = obs.select("cell_id", F.col(cluster).cast("string").alias("label"))
    links = edges.select("src", "dst")

    def tally(named: DataFrame, by: list[str]) -> DataFrame:
        a = named.select(*by, F.col("cell_id").alias("src"), F.col("label").alias("label_a"))
        b = named.select(*by, F.col("cell_id").alias("dst"), F.col("label").alias("label_b"))
        return links.join(a, "src").join(b, [*by, "dst"]).groupBy(*by, "label_a", "label_b").agg(F.count(F.lit(1)).alias("_n"))

    kinds = labels.select("label").distinct()
    grid = kinds.select(F.col("label").alias("label_a")).crossJoin(kinds.select(F.col("label").alias("label_b")))  # labels are few
    seen = grid.join(tally(labels, []), ["label_a", "label_b"], "left").na.fill(0)
    null = tally(S.permute_labels(labels, "cell_id", "label", n_perms, seed), ["perm"]).groupBy("label_a", "label_b").agg(
        F.sum("_n").alias("_s"), F.sum(F.col("_n") * F.col("_n")).alias("_q")
    )
    mean = F.coalesce(F.col("_s"), F.lit(0)) / float(n_perms)
    sd = F.sqrt(F.greatest(F.coalesce(F.col("_q"), F.lit(0)) / float(n_perms) - mean * mean, F.lit(0.0)))
    return seen.join(null, ["label_a", "label_b"], "left").select(
        "label_a", "label_b", F.col("_n").alias("n_edges"), F.when(sd > 0, (F.col("_n") - mean) / sd).otherwise(0.0).alias("zscore")
    )


def enriched_pairs(enrichment: DataFrame, cutoff: float = 2.0, top: int = 20) -> DataFrame:
    """Unordered label pairs beyond the cutoff, strongest first."""
    strong = enrichment.filter((F.abs("zscore") > cutoff) & (F.col("label_a") < F.col("label_b")))
    return strong.orderBy(F.abs("zscore").desc(), "label_a", "label_b").limit(top).withColumn("verdict", interpret_zscore(F.col("zscore")))


def _distance_counts(obs: DataFrame, label: str, bounds: Sequence[float], same_label: bool, rows: int = 512) -> DataFrame:
    """Ordered pairs per (label_a, label_b, bin); bin i holds bounds[i] < d <= bounds[i + 1].

    Points sit in blocks of at most ``rows`` inside grid cells as wide as the largest bound; points of all
    labels share a block unless only pairs of one label count.  Neighbouring blocks are joined on the grid cell,
    and a batch of block pairs leaves its task as one histogram, never as pairs of points.
    """
    bounds = [float(b) for b in bounds]
    width = bounds[-1]
    points = obs.select("cell_id", F.col(label).cast("string").alias("label"), "x", "y").filter("label IS NOT NULL")
    celled = points.withColumn("gx", F.floor(F.col("x") / width)).withColumn("gy", F.floor(F.col("y") / width))
    by = ["gx", "gy", "label"] if same_label else ["gx", "gy"]
    slots = S.hash_order(celled, F.concat_ws("-", F.lit("pair"), F.col("cell_id")), by=by)
    packed = F.sort_array(F.collect_list(F.struct(F.col("label").alias("l"), "x", "y")))  # at most `rows` entries
    blocks = slots.groupBy(*by, F.floor((F.col("slot") - 1) / rows).alias("block")).agg(packed.alias("p"))
    blocks = materialize(blocks.select(*by, "block", F.col("p.l").alias("l"), F.col("p.x").alias("x"), F.col("p.y").alias("y")))
    near = lambda tag: blocks.select(*by, *[F.col(c).alias(tag + c) for c in ("block", "l", "x", "y")])
    left = neighbors._ring(near("a").withColumn("_hx", F.col("gx")).withColumn("_hy", F.col("gy")))
    joined = left.join(near("b"), by)
    own = (F.col("gx") == F.col("_hx")) & (F.col("gy") == F.col("_hy")) & (F.col("ablock") == F.col("bblock"))
    edges_arr = np.array(bounds)
    n_bins = len(bounds) - 1

    def histogram(batches):
        for pdf in batches:
            codes: dict = {}
            number = lambda names: np.fromiter((codes.setdefault(name, len(codes)) for name in names), np.int64, len(names))
            found: Counter = Counter()
            for row in pdf.itertuples(index=False):
                d = np.sqrt((row.ax[:, None] - row.bx[None, :]) ** 2 + (row.ay[:, None] - row.by[None, :]) ** 2)
                if row.own:
                    np.fill_diagonal(d, np.nan)
                bins = np.searchsorted(edges_arr, d, side="left") - 1
                a, b = np.nonzero((bins >= 0) & (bins < n_bins) & ~np.isnan(d))
                if len(a):
                    keys = (number(row.al)[a] << 31 | number(row.bl)[b]) * n_bins + bins[a, b]
                    hit, n = np.unique(keys, return_counts=True)
                    for key, k in zip(hit.tolist(), n.tolist()):
                        found[key] += k
            names = list(codes)
            rows_out = [(names[key // n_bins >> 31], names[key // n_bins & (1 << 31) - 1], key % n_bins, k) for key, k in found.items()]
            yield pd.DataFrame(rows_out, columns=["label_a", "label_b", "bin", "n"])

    hist = joined.select("al", "ax", "ay", "bl", "bx", "by", own.alias("own")).mapInPandas(histogram, "label_a string, label_b string, bin long, n long")
    return hist.groupBy("label_a", "label_b", "bin").agg(F.sum("n").alias("n"))


def ripley_l(obs: DataFrame, cluster: str, bounds: Sequence[float], area: float | None = None) -> DataFrame:
    """Ripley's L per cluster at each distance: sqrt(A * ordered pairs within d / (pi * n * (n - 1)))."""
    if area is None:
        box = obs.agg(F.max("x") - F.min("x"), F.max("y") - F.min("y")).first()
        area = float(box[0] * box[1])
    edges = [-1.0, *[float(b) for b in bounds]]
    counts = _distance_counts(obs, cluster, edges, same_label=True).select(F.col("label_a").alias("cluster"), "bin", "n")
    sizes = obs.groupBy(F.col(cluster).cast("string").alias("cluster")).agg(F.count(F.lit(1)).alias("_size"))
    steps = F.posexplode(F.array(*[F.lit(b) for b in edges[1:]])).alias("bin", "distance")
    grid = sizes.select("cluster", "_size", steps).join(counts, ["cluster", "bin"], "left").na.fill(0, ["n"])
    w = Window.partitionBy("cluster").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # one row per distance
    pairs = F.sum("n").over(w)
    size = F.col("_size")
    l_value = F.when(size > 1, F.sqrt(F.lit(area) * pairs / (np.pi * size * (size - 1)))).otherwise(0.0)
    return grid.select("cluster", "distance", pairs.alias("n_pairs"), l_value.alias("L"))


def co_occurrence(obs: DataFrame, cluster: str, bounds: Sequence[float]) -> DataFrame:
    """P(b | a near) / P(b) per distance interval; ordered pairs with bounds[i] < d <= bounds[i+1]."""
    counts = _distance_counts(obs, cluster, bounds, same_label=False)
    by_bin, by_a, by_b = Window.partitionBy("bin"), Window.partitionBy("bin", "label_a"), Window.partitionBy("bin", "label_b")
    ratio = (F.col("n") / F.sum("n").over(by_a)) / (F.sum("n").over(by_b) / F.sum("n").over(by_bin))
    return counts.select("label_a", "label_b", "bin", "n", ratio.alias("ratio"))  # windows over label pairs only


# ------------------------------------------------------------- network measures
def undirected(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def clustering_coefficients(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell_id, degree, clustering).  Edges point from low to high degree, which bounds the wedges per node."""
    und = undirected(edges)
    degree = und.select(F.explode(F.array("a", "b")).alias("cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("degree"))
    da, db = degree.select(F.col("cell_id").alias("a"), F.col("degree").alias("_da")), degree.select(F.col("cell_id").alias("b"), F.col("degree").alias("_db"))
    low_first = F.struct("_da", "a") < F.struct(F.col("_db").alias("_da"), F.col("b").alias("a"))
    directed = und.join(da, "a").join(db, "b").select(
        F.when(low_first, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low_first, F.col("b")).otherwise(F.col("a")).alias("v")
    )
    first, second = directed.select("u", F.col("v").alias("v1")), directed.select("u", F.col("v").alias("v2"))
    wedges = first.join(second, "u").filter("v1 < v2")
    closed = wedges.join(und.select(F.col("a").alias("v1"), F.col("b").alias("v2")), ["v1", "v2"])
    triangles = closed.select(F.explode(F.array("u", "v1", "v2")).alias("cell_id")).groupBy("cell_id").agg(F.count(F.lit(1)).alias("_t"))
    d = F.col("degree")
    return (
        obs.select("cell_id").join(degree, "cell_id", "left").join(triangles, "cell_id", "left").na.fill(0)
        .select("cell_id", "degree", F.when(d > 1, 2.0 * F.col("_t") / (d * (d - 1))).otherwise(0.0).alias("clustering"))
    )


def network_properties(edges: DataFrame, obs: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean and sd of degree, mean clustering, density."""
    per_node = clustering_coefficients(edges, obs)
    n, m = F.col("n_nodes"), F.col("n_edges")
    return per_node.agg(
        F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"), F.avg("degree").alias("mean_degree"),
        F.stddev_pop("degree").alias("sd_degree"), F.avg("clustering").alias("mean_clustering"),
    ).withColumn("density", F.when(n > 1, 2.0 * m / (n * (n - 1))).otherwise(0.0))


def degree_by_cluster(edges: DataFrame, obs: DataFrame, cluster: str) -> DataFrame:
    per_node = clustering_coefficients(edges, obs).join(obs.select("cell_id", cluster), "cell_id")
    return per_node.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_nodes"), F.avg("degree").alias("mean_degree"))


def centrality(edges: DataFrame, obs: DataFrame, cluster: str) -> DataFrame:
    """Group degree, group closeness and mean clustering per label.

    Distances come from one breadth-first search per label, all labels in the
    same frontier table; nodes out of reach do not count.
    """
    labels = obs.select("cell_id", F.col(cluster).cast("string").alias("label"))
    und = undirected(edges)
    links = materialize(und.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(und.select(F.col("b").alias("src"), F.col("a").alias("dst"))))
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("_size"))
    total = labels.agg(F.count(F.lit(1)).alias("_total"))
    outside = (
        links.join(labels.withColumnRenamed("cell_id", "src"), "src").join(labels.select(F.col("cell_id").alias("dst"), F.col("label").alias("_other")), "dst")
        .filter("label <> _other").groupBy("label").agg(F.countDistinct("dst").alias("_reach"))
    )
    seen = frontier = materialize(labels.select("label", "cell_id", F.lit(0).alias("hops")))
    hop = 0
    while True:
        hop += 1
        step = frontier.withColumnRenamed("cell_id", "src").join(links, "src").select("label", F.col("dst").alias("cell_id")).distinct()
        frontier = cut(step.join(seen, ["label", "cell_id"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if hop % 16 == 0:
            seen = cut(seen)
    far = seen.groupBy("label").agg(F.sum("hops").alias("_sum"))
    local = clustering_coefficients(edges, obs).join(labels, "cell_id").groupBy("label").agg(F.avg("clustering").alias("average_clustering"))
    rest = F.col("_total") - F.col("_size")
    return sizes.crossJoin(total).join(outside, "label", "left").join(far, "label").join(local, "label").select(  # one-row side
        F.col("label").alias("cluster"),
        F.when(rest > 0, F.coalesce("_reach", F.lit(0)) / rest).otherwise(0.0).alias("degree_centrality"),
        F.when(F.col("_sum") > 0, rest / F.col("_sum")).otherwise(0.0).alias("closeness_centrality"),
        "average_clustering",
    )


def betweenness(edges: DataFrame, obs: DataFrame, landmarks: int | None = None) -> DataFrame:
    """(cell_id, betweenness): the share of all shortest paths between two other cells that run through a cell.

    From each landmark a breadth-first search counts shortest paths, then dependencies run back from the
    last cells, both in blocks of neighbouring cells (by place if ``obs`` has x and y), so rounds grow with the
    blocks that a path crosses.  All cells are landmarks by default, which is exact; a number takes those of the
    smallest md5 of their ids and scales the sums up to all cells.  Work is landmarks times edges.  Cells that
    are not connected have no path between them.
    """
    und = undirected(edges)
    links = cut(und.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(und.select(F.col("b").alias("src"), F.col("a").alias("dst"))), "links")
    n = obs.count()
    chosen = obs.select("cell_id")
    if landmarks is not None:
        chosen = chosen.orderBy(F.md5(F.col("cell_id").cast("string").cast("binary")), "cell_id").limit(landmarks)
    chosen = cut(chosen, "landmarks")
    used = chosen.count()
    scale = n / max(used, 1) / max((n - 1) * (n - 2), 1)
    sums = shortest_paths.dependencies(links, obs, chosen).withColumnRenamed("delta", "_d")
    return obs.select("cell_id").join(sums, "cell_id", "left").select("cell_id", (F.coalesce("_d", F.lit(0.0)) * scale).alias("betweenness"))


def betweenness_by_cluster(edges: DataFrame, obs: DataFrame, cluster: str, landmarks: int | None = None) -> DataFrame:
    """(cluster, betweenness_centrality): the mean over a label's cells."""
    rows = betweenness(edges, obs, landmarks).join(obs.select("cell_id", F.col(cluster).alias("cluster")), "cell_id")
    return rows.groupBy("cluster").agg(F.avg("betweenness").alias("betweenness_centrality"))


# ---------------------------------------------------------------- map preparation
def clip_for_map(values: DataFrame, by: Sequence[str] = ("gene_id",), low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Values cut to their exact 1st and 99th percentile per group."""
    lo, hi = S.exact_quantile(values, by, "value", low, "_lo"), S.exact_quantile(values, by, "value", high, "_hi")
    return values.join(lo, list(by)).join(hi, list(by)).withColumn("value", F.least(F.greatest("value", "_lo"), F.col("_hi"))).drop("_lo", "_hi")


def neg_log10_p(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))


def gene_correlation(expr: DataFrame, obs: DataFrame, genes: DataFrame, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of a short gene list, zeros included."""
    chosen = expr.join(genes.select("gene_id"), "gene_id", "left_semi")
    if method == "spearman":
        dense = dense_genes(chosen, obs, genes)
        chosen = dense.join(S.average_ranks(dense, ["gene_id"], "value"), ["gene_id", "value"]).select("cell_id", "gene_id", F.col("avg_rank").alias("value"))
    stats = features.gene_stats(chosen, obs, genes).select("gene_id", "n", "total", "sumsq")
    a = chosen.select("cell_id", F.col("gene_id").alias("gene_a"), F.col("value").alias("_a"))
    b = chosen.select("cell_id", F.col("gene_id").alias("gene_b"), F.col("value").alias("_b"))
    cross = a.join(b, "cell_id").groupBy("gene_a", "gene_b").agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"))
    sa = stats.select(F.col("gene_id").alias("gene_a"), "n", F.col("total").alias("ta"), F.col("sumsq").alias("qa"))
    sb = stats.select(F.col("gene_id").alias("gene_b"), F.col("total").alias("tb"), F.col("sumsq").alias("qb"))
    n = F.col("n")
    den = F.sqrt((n * F.col("qa") - F.col("ta") * F.col("ta")) * (n * F.col("qb") - F.col("tb") * F.col("tb")))
    grid = sa.crossJoin(sb)  # the short gene list on both sides
    r = (n * F.coalesce(F.col("_ab"), F.lit(0.0)) - F.col("ta") * F.col("tb")) / den
    return grid.join(cross, ["gene_a", "gene_b"], "left").select("gene_a", "gene_b", F.when(den > 0, r).alias("correlation"))


# -------------------------------------------------------- spatially variable genes
def svg_moran(expr, obs, edges, alpha: float = 0.05, n_perms: int = 0) -> DataFrame:
    """Moran for every gene with a BH q-value; ``significant`` follows the raw p, ``significant_fdr`` the q."""
    scored = S.bh_fdr(moran_i(expr, obs, edges, n_perms), "pval_norm", out="qval")
    up = F.col("I") > 0
    return scored.withColumn("significant", up & (F.col("pval_norm") < alpha)).withColumn("significant_fdr", up & (F.col("qval") < alpha))


def svg_random_kernel(expr: DataFrame, obs: DataFrame, features_table: DataFrame | features.SiteFeatures) -> DataFrame:
    """Kernel test on centred random features (cell_id, vec): sum of (x_c . Z_m)^2 / n against chi-square(m).

    Features of places are made where they are summed, so that a row of the matrix sends its place only.
    """
    n = obs.agg(F.count(F.lit(1)).alias("n"))
    sites = isinstance(features_table, features.SiteFeatures)
    table = features_table.sites if sites else features_table
    expand = features_table.expand if sites else None
    sent = ["x", "y"] if sites else ["vec"]
    # The rows of one gene come to one task, at most one for each cell, and leave it as one row.
    parts = expr.join(table, "cell_id").select("gene_id", F.col("value").cast("double").alias("value"), *sent)
    parts = parts.repartition("gene_id").sortWithinPartitions("gene_id")

    def squares(batches):
        last, held, met = None, None, None
        for pdf in batches:
            genes = pdf["gene_id"].to_numpy()
            if not len(genes):
                continue
            starts = np.flatnonzero(np.r_[True, genes[1:] != genes[:-1]])
            vectors = expand(pdf["x"].to_numpy(dtype=float), pdf["y"].to_numpy(dtype=float)) if sites else np.stack(pdf["vec"].to_numpy())
            weighted = vectors * pdf["value"].to_numpy(dtype=float)[:, None]
            known = ~np.isnan(weighted)  # a row with an unknown value or place adds nothing
            sums = np.add.reduceat(np.where(known, weighted, 0.0), starts, axis=0)
            done = []
            for gene, total, there in zip(genes[starts], sums, np.logical_or.reduceat(known, starts, axis=0)):
                if held is not None and (last == gene or (pd.isna(last) and pd.isna(gene))):
                    held, met = held + total, met | there
                    continue
                if held is not None:
                    done.append((last, float((held * held).sum()) if met.any() else None, len(held)))
                last, held, met = gene, total, there
            if done:
                yield pd.DataFrame(done, columns=["gene_id", "_ss", "_m"])
        if held is not None:
            yield pd.DataFrame([(last, float((held * held).sum()) if met.any() else None, len(held))], columns=["gene_id", "_ss", "_m"])

    stat = parts.mapInPandas(squares, f"gene_id {dict(expr.dtypes)['gene_id']}, _ss double, _m long").crossJoin(n)  # one-row side
    stat = stat.select("gene_id", (F.col("_ss") / F.col("n")).alias("statistic"), F.col("n").alias("_n"), "_m")
    tested = stat.select("gene_id", "statistic", S.chi2_sf(F.col("statistic") * F.col("_n"), F.col("_m")).alias("pval"))
    return S.bh_fdr(tested, "pval")


def min_total_counts(expr: DataFrame, minimum: float = 3) -> DataFrame:
    keep = expr.groupBy("gene_id").agg(F.sum("value").alias("_t")).filter(F.col("_t") >= minimum)
    return expr.join(keep, "gene_id", "left_semi")

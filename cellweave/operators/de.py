"""Differential expression, pseudobulk and condition comparison."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.operators import normalize
from cellweave.session import cut, materialize


def _value_counts(values: DataFrame, labels: DataFrame, unit: str, feature: str, side: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, feature, side, value) with the number ``_c`` of its rows, written once: ranks and moments read it."""
    tagged = values.select(*by, unit, feature, "value").join(labels.select(*by, unit, side), [*by, unit])
    return cut(tagged.groupBy(*by, feature, side, "value").agg(F.count(F.lit(1)).alias("_c")), "counts")


def rank_sums(values: DataFrame, labels: DataFrame, unit: str, feature: str, side: str, by: Sequence[str] = ()) -> DataFrame:
    """Per (by, feature, side): n_side, n_all and the rank sum, zeros included.

    ``values`` holds positive entries (by, unit, feature, value), ``labels`` one
    row per (by, unit) with its side.  The zeros of a feature share the lowest
    average rank; ranks of the rest come from (feature, value) counts.
    """
    return _rank_sums(_value_counts(values.filter(F.col("value") > 0), labels, unit, feature, side, by), labels, feature, side, by)


def _rank_sums(counts: DataFrame, labels: DataFrame, feature: str, side: str, by: Sequence[str] = ()) -> DataFrame:
    """:func:`rank_sums` from its positive (by, feature, side, value) counts: ranked by value buckets, where the sides of a value meet."""
    by = list(by)
    sizes = labels.groupBy(*by, side).agg(F.count(F.lit(1)).alias("n_side"))
    totals = labels.groupBy(*by).agg(F.count(F.lit(1)).alias("n_all"))
    sizes = sizes.join(totals, by) if by else sizes.crossJoin(totals)  # one-row side
    keyed = S.range_buckets(counts, "value")
    bucket = Window.partitionBy(*by, feature, "_bucket")
    across = Window.partitionBy(*by, feature).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = keyed.groupBy(*by, feature, "_bucket").agg(F.sum("_c").alias("_n")).select(*by, feature, "_bucket", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_offset"))
    upto, ties = F.sum("_c").over(bucket.orderBy("value")), F.sum("_c").over(Window.partitionBy(*by, feature, "_bucket", "value"))
    ranked = keyed.withColumn("_upto", upto).withColumn("_ties", ties).join(offsets, [*by, feature, "_bucket"])
    rank = F.col("_offset") + F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2.0
    per_side = materialize(ranked.groupBy(*by, feature, side).agg(F.sum("_c").alias("_nz"), F.sum(F.col("_c") * rank).alias("_rs")))  # read twice
    nnz = per_side.groupBy(*by, feature).agg(F.sum("_nz").alias("_nnz"))
    grid = nnz.join(sizes, by) if by else nnz.crossJoin(sizes)  # sides are few
    joined = grid.join(per_side, [*by, feature, side], "left").na.fill(0, ["_nz", "_rs"])
    zeros = F.col("n_all") - F.col("_nnz")
    total = F.col("_rs") + F.col("_nz") * zeros + (F.col("n_side") - F.col("_nz")) * (zeros + 1) / 2.0
    return joined.select(*by, feature, side, "n_side", "n_all", total.alias("rank_sum"))


def rank_sum_z(n_side, n_all, rank_sum):
    n1, n2 = n_side, n_all - n_side
    return (rank_sum - n1 * (n_all + 1) / 2.0) / F.sqrt(n1 * n2 * (n_all + 1) / 12.0)


def group_moments(expr: DataFrame, obs: DataFrame, groupby: str) -> DataFrame:
    """Per (group, gene): n, nnz, sum, sum of squares inside and in the rest."""
    labels = obs.select("cell_id", F.col(groupby).cast("string").alias("group"))
    return _moments(expr.join(labels, "cell_id").withColumn("_c", F.lit(1)), labels)


def _moments(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`group_moments` of rows(group, gene_id, value) that occur ``_c`` times."""
    sizes = labels.groupBy("group").agg(F.count(F.lit(1)).alias("n1"))
    sizes = sizes.crossJoin(labels.agg(F.count(F.lit(1)).alias("n_all")))  # one-row side
    inside = rows.groupBy("group", "gene_id").agg(
        F.sum(F.when(F.col("value") != 0, F.col("_c")).otherwise(0)).alias("nnz1"), F.sum(F.col("value") * F.col("_c")).alias("s1"),
        F.sum(F.col("value") * F.col("value") * F.col("_c")).alias("q1")
    )
    whole = inside.groupBy("gene_id").agg(F.sum("nnz1").alias("nnz"), F.sum("s1").alias("s"), F.sum("q1").alias("q"))
    grid = whole.crossJoin(sizes)  # genes x the few group labels
    full = grid.join(inside, ["group", "gene_id"], "left").na.fill(0, ["nnz1", "s1", "q1"])
    n2 = F.col("n_all") - F.col("n1")
    return full.select(
        "group", "gene_id", "n1", n2.alias("n2"), "nnz1", (F.col("nnz") - F.col("nnz1")).alias("nnz2"),
        "s1", (F.col("s") - F.col("s1")).alias("s2"), "q1", (F.col("q") - F.col("q1")).alias("q2"),
    )


def _log2_fold(m1, m2):
    return F.log2((F.exp(m1) - 1.0 + 1e-9) / (F.exp(m2) - 1.0 + 1e-9))


def two_groups(obs: DataFrame, groupby: str, group1, group2) -> DataFrame:
    """Only the cells of two labels; both must exist."""
    kept = obs.filter(F.col(groupby).cast("string").isin(str(group1), str(group2)))
    found = {r[0] for r in kept.select(F.col(groupby).cast("string")).distinct().collect()}
    missing = {str(group1), str(group2)} - found
    if missing:
        raise ValueError(f"groups not found in {groupby}: {sorted(missing)}")
    return kept


def rank_genes_wilcoxon(expr: DataFrame, obs: DataFrame, groupby: str) -> DataFrame:
    """Each group against the rest: score, log2 fold change, p and BH-adjusted p per gene (log-normalised input)."""
    labels = obs.select("cell_id", F.col(groupby).cast("string").alias("group"))
    counts = _value_counts(expr, labels, "cell_id", "gene_id", "group")
    sums = _rank_sums(counts.filter(F.col("value") > 0), labels, "gene_id", "group")
    moments = _moments(counts, labels).select("group", "gene_id", _log2_fold(F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")).alias("logfoldchanges"))
    scored = sums.select("group", "gene_id", rank_sum_z(F.col("n_side"), F.col("n_all"), F.col("rank_sum")).alias("scores")).join(moments, ["group", "gene_id"])
    return S.bh_fdr(scored.withColumn("pvals", S.norm_pvalue(F.col("scores"))), "pvals", ["group"], "pvals_adj")


def rank_genes_ttest(expr: DataFrame, obs: DataFrame, groupby: str) -> DataFrame:
    """Welch t of each group against the rest; an undefined score becomes 0 with p = 1."""
    m = group_moments(expr, obs, groupby)
    mean1, mean2 = F.col("s1") / F.col("n1"), F.col("s2") / F.col("n2")
    v1 = (F.col("q1") - F.col("n1") * mean1 * mean1) / (F.col("n1") - 1) / F.col("n1")
    v2 = (F.col("q2") - F.col("n2") * mean2 * mean2) / (F.col("n2") - 1) / F.col("n2")
    rows = m.select("group", "gene_id", "n1", "n2", mean1.alias("_m1"), mean2.alias("_m2"), F.greatest(v1, F.lit(0.0)).alias("_v1"), F.greatest(v2, F.lit(0.0)).alias("_v2"))
    se = F.col("_v1") + F.col("_v2")
    ok = se > 0
    rows = rows.select(
        "group", "gene_id", F.when(ok, (F.col("_m1") - F.col("_m2")) / F.sqrt(se)).otherwise(0.0).alias("scores"),
        F.when(ok, se * se / (F.col("_v1") * F.col("_v1") / (F.col("n1") - 1) + F.col("_v2") * F.col("_v2") / (F.col("n2") - 1))).alias("dof"),
        _log2_fold(F.col("_m1"), F.col("_m2")).alias("logfoldchanges"),
    )
    rows = rows.withColumn("pvals", F.coalesce(S.t_pvalue("scores", "dof"), F.lit(1.0)))
    return S.bh_fdr(rows, "pvals", ["group"], "pvals_adj")


def filter_markers(markers: DataFrame, expr: DataFrame, obs: DataFrame, groupby: str, min_in=0.25, min_fc=1.0, max_out=0.5) -> DataFrame:
    """Keep genes common inside, rare outside and with enough fold change (log2)."""
    shares = group_moments(expr, obs, groupby).select(
        "group", "gene_id", (F.col("nnz1") / F.col("n1")).alias("pct_in"), (F.col("nnz2") / F.col("n2")).alias("pct_out")
    )
    return markers.join(shares, ["group", "gene_id"]).filter(
        (F.col("pct_in") >= min_in) & (F.col("pct_out") <= max_out) & (F.col("logfoldchanges") >= min_fc)
    )


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence, n: int) -> DataFrame:
    """First n rows per group in the given total order (a pre-shuffle limit keeps hot groups cheap)."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def split_replicates(obs: DataFrame, groupby: str, min_cells: int = 10, most: int = 10, seed: int = 42) -> DataFrame:
    """Pseudo-replicates: n = clamp(cells // min_cells, 1, most) near-equal parts of a hash shuffle; parts under 3 cells go."""
    sized = obs.select("cell_id", groupby).join(obs.groupBy(groupby).agg(F.count(F.lit(1)).alias("_n")), groupby)
    parts = F.greatest(F.lit(1), F.least(F.lit(most), F.floor(F.col("_n") / min_cells)))
    ordered = S.hash_order(sized, F.concat_ws("-", F.lit(seed), F.col("cell_id")), by=[groupby])
    small, extra = F.floor(F.col("_n") / parts), F.col("_n") % parts
    pos = F.col("slot") - 1
    part = F.when(pos < extra * (small + 1), F.floor(pos / (small + 1))).otherwise(extra + F.floor((pos - extra * (small + 1)) / F.greatest(small, F.lit(1))))
    named = ordered.select("cell_id", groupby, part.cast("long").alias("replicate"))
    keep = named.groupBy(groupby, "replicate").agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 3").drop("_c")
    return named.join(keep, [groupby, "replicate"], "left_semi")


def pseudobulk(expr: DataFrame, obs: DataFrame, sample: str, cluster: str, min_samples: int = 2) -> DataFrame:
    """Summed counts per (cluster, sample, gene) of clusters seen in at least ``min_samples`` samples."""
    labels = obs.select("cell_id", F.col(cluster).alias("cluster"), F.col(sample).alias("sample"))
    good = labels.groupBy("cluster").agg(F.countDistinct("sample").alias("_s")).filter(F.col("_s") >= min_samples)
    return expr.join(labels.join(good, "cluster", "left_semi"), "cell_id").groupBy("cluster", "sample", "gene_id").agg(F.sum("value").alias("value"))


def contrasts(obs: DataFrame, sample: str, cluster: str, condition: str, reference) -> DataFrame:
    """(cluster, contrast, sample, side): every other condition of a cluster against the reference."""
    seen = obs.select(F.col(cluster).alias("cluster"), F.col(sample).alias("sample"), F.col(condition).cast("string").alias("_cond")).distinct()
    others = seen.filter(F.col("_cond") != str(reference)).select("cluster", F.col("_cond").alias("_other")).distinct()
    joined = seen.join(others, "cluster").filter((F.col("_cond") == F.col("_other")) | (F.col("_cond") == str(reference)))
    return joined.select(
        "cluster", F.concat(F.col("_other"), F.lit(f"_vs_{reference}")).alias("contrast"), "sample",
        F.when(F.col("_cond") == str(reference), "ref").otherwise("other").alias("side"),
    )


def testable_counts(bulk: DataFrame, design: DataFrame, min_total: float = 10, min_genes: int = 5) -> DataFrame:
    """Pseudobulk rows per contrast, of genes with enough counts, in contrasts with enough genes."""
    rows = bulk.join(design, ["cluster", "sample"])
    genes = rows.groupBy("cluster", "contrast", "gene_id").agg(F.sum("value").alias("_t")).filter(F.col("_t") >= min_total)
    enough = genes.groupBy("cluster", "contrast").agg(F.count(F.lit(1)).alias("_g")).filter(F.col("_g") >= min_genes)
    return rows.join(genes.join(enough, ["cluster", "contrast"], "left_semi"), ["cluster", "contrast", "gene_id"], "left_semi")


def wilcoxon_pseudobulk(bulk: DataFrame, design: DataFrame) -> DataFrame:
    """Rank-sum test on log-CPM per (cluster, contrast, gene); ``log_fc`` is a natural-log difference of means.

    Genes constant on both sides are skipped.
    """
    by = ["cluster", "contrast"]
    keyed = bulk.select(*by, "gene_id", "value", F.struct("cluster", "contrast", "sample").alias("cell_id"), "sample")
    logs = materialize(normalize.log_cpm(keyed).select(*by, "sample", "gene_id", "value"))
    sums = rank_sums(logs, design, "sample", "gene_id", "side", by).filter("side = 'other'")
    sizes = design.groupBy(*by).agg(F.sum(F.when(F.col("side") == "other", 1).otherwise(0)).alias("n1"), F.sum(F.when(F.col("side") == "ref", 1).otherwise(0)).alias("n2"))
    moments = logs.join(design, [*by, "sample"]).groupBy(*by, "gene_id").agg(*[
        F.sum(F.when(F.col("side") == s, e).otherwise(0.0)).alias(f"{name}_{s}")
        for s in ("other", "ref") for name, e in (("s", F.col("value")), ("q", F.col("value") * F.col("value")))
    ])
    rows = sums.join(sizes, by).join(moments, [*by, "gene_id"]).filter("n1 >= 1 AND n2 >= 1")
    var = lambda s, n: F.col(f"q_{s}") / F.col(n) - F.pow(F.col(f"s_{s}") / F.col(n), F.lit(2.0))
    rows = rows.filter((var("other", "n1") > 1e-18) | (var("ref", "n2") > 1e-18)).select(
        *by, "gene_id", (F.col("s_other") / F.col("n1") - F.col("s_ref") / F.col("n2")).alias("log_fc"),
        S.norm_pvalue(rank_sum_z(F.col("n_side"), F.col("n_all"), F.col("rank_sum"))).alias("pvalue"),
    )
    return S.bh_fdr(rows, "pvalue", by, "pvalue_adj")


def size_factors_median_ratio(bulk: DataFrame, by: Sequence[str] = ("cluster", "contrast")) -> DataFrame:
    """Median-of-ratios size factor per sample, over genes counted in every sample of the group."""
    by = list(by)
    n = bulk.groupBy(*by).agg(F.countDistinct("sample").alias("_n"))
    logs = bulk.filter("value > 0").withColumn("_l", F.log("value"))
    geo = logs.groupBy(*by, "gene_id").agg(F.avg("_l").alias("_g"), F.count(F.lit(1)).alias("_c")).join(n, by).filter("_c = _n")
    ratios = logs.join(geo, [*by, "gene_id"]).select(*by, "sample", (F.col("_l") - F.col("_g")).alias("_r"))
    median = S.exact_quantile(ratios, [*by, "sample"], "_r", 0.5, "_m")
    return median.select(*by, "sample", F.exp("_m").alias("size_factor"))


def _nb_wald(counts: np.ndarray, sf: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log fold changes, their standard errors and dispersions of genes (rows) over samples: IRLS with a moment dispersion.

    All genes step together; one that has converged keeps its coefficients and weights.
    """
    y = counts / sf
    n, m = y.shape
    mu0 = y.mean(axis=1)
    # Moment dispersion from the spread inside the two sides, so that the effect itself does not inflate it.
    inside, sides = np.zeros(n), np.zeros(n)
    for side in np.unique(x):
        here = x == side
        size = here.sum(axis=1)
        mean = np.where(here, y, 0.0).sum(axis=1) / np.maximum(size, 1)
        inside += (np.where(here, y - mean[:, None], 0.0) ** 2).sum(axis=1)
        sides += size > 0
    inside = inside / np.maximum(m - sides, 1)
    alpha = np.maximum(1e-8, (inside - mu0 * (1.0 / sf).mean(axis=1)) / np.maximum(mu0 * mu0, 1e-12)) if m > 2 else np.full(n, 0.1)
    design = np.stack([np.ones((n, m)), x], axis=2)
    beta = np.column_stack([np.log(np.maximum(mu0, 1e-8)), np.zeros(n)])
    ridge = np.diag([1e-6, 1e-6])
    normal = np.zeros((n, 2, 2))
    left = np.arange(n)
    for _ in range(100):
        d, at = design[left], beta[left]
        linear = np.einsum("nmk,nk->nm", d, at)
        mu = np.clip(sf[left] * np.exp(np.clip(linear, -30, 30)), 1e-8, None)
        w = mu / (1.0 + alpha[left, None] * mu)
        z = linear + (counts[left] - mu) / mu
        normal[left] = np.einsum("nmk,nm,nml->nkl", d, w, d) + ridge
        step = np.linalg.solve(normal[left], np.einsum("nmk,nm->nk", d, w * z)[:, :, None])[:, :, 0]
        beta[left] = step
        left = left[~(np.abs(step - at).max(axis=1) < 1e-8)]
        if not len(left):
            break
    return beta[:, 1], np.sqrt(np.linalg.inv(normal)[:, 1, 1]), alpha


def nb_glm_test(bulk: DataFrame, design: DataFrame, min_total: float = 10, min_samples: int = 4) -> DataFrame:
    """Negative-binomial Wald test per (cluster, contrast, gene), BH inside each contrast."""
    by = ["cluster", "contrast"]
    enough = design.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_samples)
    design = design.join(enough, by, "left_semi")
    factors = size_factors_median_ratio(bulk.join(enough, by, "left_semi"))
    samples = design.join(factors, [*by, "sample"]).groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("sample", "side", "size_factor"))).alias("_design")  # the samples of one contrast
    )
    genes = bulk.groupBy(*by, "gene_id").agg(F.map_from_entries(F.collect_list(F.struct("sample", "value"))).alias("_counts"), F.sum("value").alias("_t"))
    rows = genes.filter(F.col("_t") > min_total).join(samples, by).select(
        *by, "gene_id",
        F.transform("_design", lambda d: F.coalesce(F.col("_counts")[d["sample"]], F.lit(0.0))).alias("counts"),
        F.transform("_design", lambda d: d["size_factor"]).alias("sf"),
        F.transform("_design", lambda d: F.when(d["side"] == "other", 1.0).otherwise(0.0)).alias("x"),
    )
    types = dict(rows.dtypes)

    def fit(batches):
        for pdf in batches:
            out = pdf[[*by, "gene_id"]].copy()
            fits, n_samples = np.zeros((len(pdf), 3)), pdf["counts"].map(len).to_numpy()
            for m in np.unique(n_samples):  # genes with as many samples are fitted together
                rows = np.flatnonzero(n_samples == m)
                fits[rows] = np.column_stack(_nb_wald(*(np.stack(pdf[c].iloc[rows].to_list()).astype(float) for c in ("counts", "sf", "x"))))
            out["log_fc"], out["se"], out["dispersion"] = fits.T
            yield out

    fitted = rows.mapInPandas(fit, f"cluster {types['cluster']}, contrast string, gene_id {types['gene_id']}, log_fc double, se double, dispersion double")
    tested = fitted.withColumn("pvalue", S.norm_pvalue(F.col("log_fc") / F.col("se")))
    return S.bh_fdr(tested, "pvalue", by, "pvalue_adj")


def condition_compare(expr, obs, sample: str, cluster: str, condition: str, reference, method: str = "wilcoxon") -> DataFrame:
    """Every cluster and condition against the reference in one job; the NB test falls back to ranks where samples are few."""
    design = materialize(contrasts(obs, sample, cluster, condition, reference))
    # Pseudobulk is small next to the matrix and read by every later step.
    rows = materialize(testable_counts(materialize(pseudobulk(expr, obs, sample, cluster)), design).drop("side"))
    ranks = wilcoxon_pseudobulk(rows, design).select("cluster", "contrast", "gene_id", "log_fc", "pvalue", "pvalue_adj", F.lit("wilcoxon").alias("method"))
    if method == "wilcoxon":
        return ranks
    fitted = nb_glm_test(rows, design).select("cluster", "contrast", "gene_id", "log_fc", "pvalue", "pvalue_adj", F.lit("nb_glm").alias("method"))
    return fitted.unionByName(ranks.join(fitted.select("cluster", "contrast").distinct(), ["cluster", "contrast"], "left_anti"))

"""Quality control, normalisation and feature selection on the purchase matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import features, normalize, qc
from cellweave.plans import tables as t
from cellweave.plans.registry import register

METRICS = """metrics AS (
  SELECT c.cell_id, coalesce(n_genes, 0) AS n_genes_by_counts, coalesce(total, 0) AS total_counts,
         coalesce(mt, 0) AS total_counts_mt, CASE WHEN total > 0 THEN mt / total * 100 ELSE 0 END AS pct_counts_mt
  FROM cells c LEFT JOIN (
    SELECT cell_id, COUNT(*) FILTER (value > 0) AS n_genes, SUM(value) AS total, SUM(CASE WHEN is_mt THEN value ELSE 0 END) AS mt
    FROM counts JOIN genes USING (gene_id) GROUP BY 1) s USING (cell_id))"""
BASE = f"WITH {t.SQL_COUNTS}, {t.SQL_CELLS}, {t.SQL_GENES}"
NCELLS = "(SELECT COUNT(*) FROM cells)"
STATS = f"""gstats AS (
  SELECT gene_id, SUM(value) AS total, SUM(value * value) AS sumsq, COUNT(*) AS nnz, {NCELLS} AS n,
         SUM(value) / {NCELLS} AS mean,
         SUM(value * value) / {NCELLS} - (SUM(value) / {NCELLS}) * (SUM(value) / {NCELLS}) AS var_pop,
         (SUM(value * value) - {NCELLS} * (SUM(value) / {NCELLS}) * (SUM(value) / {NCELLS})) / ({NCELLS} - 1) AS var_sample
  FROM %s GROUP BY 1)"""


def out(df, *keys, value="value", digits=6):
    return df.select(*keys, r6(value, digits).alias(value))


def flagship(spark, sf):
    """Quality control, normalisation and the size of every cell type that is left."""
    expr, obs, var = t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf)
    kept, kept_obs = qc.filter_cells(expr, obs, var, qc.Thresholds(max_mt_pct=25.0, min_genes=3), min_cells=3)
    normed = normalize.log1p(normalize.normalize_total(kept))
    per_cell = normed.groupBy("cell_id").agg(F.sum("value").alias("_s"))
    return (
        kept_obs.join(per_cell, "cell_id", "left").groupBy("cell_type")
        .agg(F.count(F.lit(1)).alias("n_cells"), r6(F.avg("_s"), 4).alias("mean_log_total"))
    )


register("pipeline_qc_cell_types", f"""{BASE}, {METRICS},
 first AS (SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 3),
 g AS (SELECT gene_id FROM counts WHERE cell_id IN (SELECT cell_id FROM first) GROUP BY 1 HAVING COUNT(*) FILTER (value > 0) >= 3),
 fin AS (SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 3 AND pct_counts_mt < 25),
 kept AS (SELECT * FROM counts WHERE gene_id IN (SELECT gene_id FROM g) AND cell_id IN (SELECT cell_id FROM fin)),
 normed AS (SELECT cell_id, ln(1 + value * CAST(10000 AS DOUBLE) / SUM(value) OVER (PARTITION BY cell_id)) AS value FROM kept),
 s AS (SELECT cell_id, SUM(value) AS s FROM normed GROUP BY 1)
 SELECT cell_type, COUNT(*) AS n_cells, {t.r6_sql('AVG(s)', 4)} AS mean_log_total
 FROM cells JOIN fin USING (cell_id) LEFT JOIN s USING (cell_id) GROUP BY 1""")(flagship)


@register("qc_cell_metrics", f"""{BASE}, {METRICS}
 SELECT cell_id, n_genes_by_counts, total_counts, total_counts_mt, {t.r6_sql('pct_counts_mt')} AS pct_counts_mt FROM metrics""")
def qc_cell_metrics(spark, sf):
    m = qc.cell_metrics(t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf))
    return m.withColumn("pct_counts_mt", r6("pct_counts_mt"))


@register("qc_gene_metrics", f"""{BASE}
 SELECT gene_id, COUNT(*) FILTER (value > 0) AS n_cells, SUM(value) AS total_counts, {t.r6_sql(f'SUM(value) / {NCELLS}')} AS mean_counts
 FROM counts GROUP BY 1""")
def qc_gene_metrics(spark, sf):
    return qc.gene_metrics(t.counts(spark, sf), t.cells(spark, sf)).withColumn("mean_counts", r6("mean_counts"))


@register("qc_filter_cells", f"""{BASE}, {METRICS}
 SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 30 AND pct_counts_mt < 20 AND n_genes_by_counts < 60""")
def qc_filter_cells(spark, sf):
    m = qc.cell_metrics(t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf))
    return qc.passing_cells(m, qc.Thresholds(20.0, 30, 60))


@register("qc_filter_genes", f"{BASE} SELECT gene_id, COUNT(*) AS n FROM counts GROUP BY 1 HAVING COUNT(*) >= 25 AND SUM(value) >= 600")
def qc_filter_genes(spark, sf):
    return qc.filter_genes(t.counts(spark, sf), 25, 600).groupBy("gene_id").agg(F.count(F.lit(1)).alias("n"))


@register("qc_flag_mito", "SELECT p_partkey AS gene_id, p_name AS symbol, starts_with(p_name, 'MT-') AS is_mt FROM part")
def qc_flag_mito(spark, sf):
    return qc.flag_mito(t.genes(spark, sf).select("gene_id", "symbol"))


@register("qc_tissue_preset", f"""{BASE}, {METRICS}
 SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 30 AND pct_counts_mt < 15 AND n_genes_by_counts < 4000""")
def qc_tissue_preset(spark, sf):
    m = qc.cell_metrics(t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf))
    return qc.passing_cells(m, qc.tissue_preset("liver", qc.Thresholds(min_genes=30)))


@register("qc_summary", f"""{BASE}, {METRICS},
 first AS (SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 30),
 g AS (SELECT gene_id FROM counts WHERE cell_id IN (SELECT cell_id FROM first) GROUP BY 1 HAVING COUNT(*) >= 20),
 fin AS (SELECT cell_id FROM metrics WHERE n_genes_by_counts >= 30 AND pct_counts_mt < 20)
 SELECT (SELECT COUNT(*) FROM cells) AS n_cells_raw, (SELECT COUNT(DISTINCT gene_id) FROM counts) AS n_genes_raw,
  (SELECT COUNT(*) FROM fin) AS n_cells_filtered,
  (SELECT COUNT(DISTINCT gene_id) FROM counts WHERE cell_id IN (SELECT cell_id FROM fin) AND gene_id IN (SELECT gene_id FROM g)) AS n_genes_filtered""")
def qc_summary(spark, sf):
    expr, obs, var = t.counts(spark, sf), t.cells(spark, sf), t.genes(spark, sf)
    return qc.qc_summary(expr, obs, *qc.filter_cells(expr, obs, var, qc.Thresholds(20.0, 30), min_cells=20))


@register("cluster_summary", f"WITH {t.SQL_CELLS} SELECT cell_type, COUNT(*) AS n_cells FROM cells GROUP BY 1")
def cluster_summary(spark, sf):
    return qc.cluster_summary(t.cells(spark, sf), "cell_type")


@register("normalize_total", f"""WITH {t.SQL_COUNTS}
 SELECT cell_id, gene_id, {t.r6_sql('value * CAST(10000 AS DOUBLE) / SUM(value) OVER (PARTITION BY cell_id)')} AS value FROM counts""")
def normalize_total(spark, sf):
    return out(normalize.normalize_total(t.counts(spark, sf)), "cell_id", "gene_id")


@register("normalize_log1p", f"WITH {t.SQL_LOGNORM} SELECT cell_id, gene_id, {t.r6_sql('value')} AS value FROM lognorm")
def normalize_log1p(spark, sf):
    return out(t.lognorm(spark, sf), "cell_id", "gene_id")


@register("normalize_log_cpm", f"""WITH {t.SQL_COUNTS}
 SELECT cell_id, gene_id, {t.r6_sql('ln(1 + value / SUM(value) OVER (PARTITION BY cell_id) * 1000000)')} AS value FROM counts""")
def normalize_log_cpm(spark, sf):
    return out(normalize.log_cpm(t.counts(spark, sf)), "cell_id", "gene_id")


@register("normalize_clr", f"""WITH {t.SQL_COUNTS}
 SELECT cell_id, gene_id, {t.r6_sql('ln(1 + value / exp(SUM(ln(1 + value)) OVER (PARTITION BY cell_id) / (SELECT COUNT(*) FROM part)))')} AS value FROM counts""")
def normalize_clr(spark, sf):
    return out(normalize.clr_per_cell(t.counts(spark, sf), t.genes(spark, sf).count()), "cell_id", "gene_id")


@register("normalize_binarize", f"WITH {t.SQL_COUNTS} SELECT gene_id, SUM(CASE WHEN value > 0 THEN 1.0::DOUBLE ELSE 0 END) AS n FROM counts GROUP BY 1")
def normalize_binarize(spark, sf):
    return normalize.binarize(t.counts(spark, sf)).groupBy("gene_id").agg(F.sum("value").alias("n"))


TF = "tf AS (SELECT cell_id, gene_id, value, value / SUM(value) OVER (PARTITION BY cell_id) AS tf FROM counts)"


@register("normalize_tfidf_log", f"""WITH {t.SQL_COUNTS}, {TF}
 SELECT cell_id, gene_id, {t.r6_sql("tf * ln((SELECT COUNT(*) FROM customer)::DOUBLE / (SUM(tf) OVER (PARTITION BY gene_id) + 1e-10::DOUBLE))")} AS value FROM tf""")
def normalize_tfidf_log(spark, sf):
    return out(normalize.tfidf(t.counts(spark, sf), t.cells(spark, sf).count()), "cell_id", "gene_id")


@register("normalize_tfidf_raw", f"""WITH {t.SQL_COUNTS}, {TF}
 SELECT cell_id, gene_id, {t.r6_sql("tf * ((SELECT COUNT(*) FROM customer)::DOUBLE / SUM(value) OVER (PARTITION BY gene_id))")} AS value FROM tf""")
def normalize_tfidf_raw(spark, sf):
    return out(normalize.tfidf(t.counts(spark, sf), t.cells(spark, sf).count(), log_idf=False), "cell_id", "gene_id")


@register("normalize_l1_log1e4", f"""WITH {t.SQL_COUNTS}
 SELECT cell_id, gene_id, {t.r6_sql('ln(1 + 10000 * (value / SUM(value) OVER (PARTITION BY cell_id)))')} AS value FROM counts""")
def normalize_l1_log1e4(spark, sf):
    return out(normalize.l1_log1e4(t.counts(spark, sf)), "cell_id", "gene_id")


@register("normalize_size_factors", f"""WITH {t.SQL_COUNTS}, {t.SQL_CELLS},
 lib AS (SELECT cell_id, coalesce(SUM(value), 0) AS lib FROM cells LEFT JOIN counts USING (cell_id) GROUP BY 1)
 SELECT cell_id, {t.r6_sql('greatest(lib / (SELECT AVG(lib) FROM lib), 1e-6)')} AS size_factor FROM lib""")
def normalize_size_factors(spark, sf):
    return out(normalize.size_factors(t.counts(spark, sf), t.cells(spark, sf)), "cell_id", value="size_factor")


@register("normalize_sanitize", """WITH e AS (SELECT l_orderkey AS cell_id, l_partkey AS gene_id, SUM(l_quantity * (0.5 - l_discount * 10)) AS value FROM lineitem GROUP BY 1, 2)
 SELECT cell_id, gene_id, round_even(greatest(value, 0), 0) + 0.0 AS value FROM e""")
def normalize_sanitize(spark, sf):
    e = t.load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("gene_id")).agg(
        F.sum(F.col("l_quantity") * (0.5 - F.col("l_discount") * 10)).alias("value"))
    return normalize.sanitize_counts(e).withColumn("value", F.col("value") + F.lit(0.0))


@register("normalize_raw_check", f"""WITH {t.SQL_COUNTS}
 SELECT bool_and(value = round(value)) AS all_integer, MAX(value) AS max_value,
  bool_and(value = round(value)) AND MAX(value) > 50 AS looks_raw, MAX(value) < 50 AS looks_log FROM counts""")
def normalize_raw_check(spark, sf):
    return normalize.looks_like_raw_counts(t.counts(spark, sf))


@register("normalize_resolve_layer", """SELECT o_orderpriority AS layer, COUNT(*) AS n, SUM(o_totalprice) AS total FROM orders WHERE o_orderpriority = '2-HIGH' GROUP BY 1""")
def normalize_resolve_layer(spark, sf):
    rows = t.load(spark, sf, "orders").select(F.col("o_orderpriority").alias("layer"), "o_totalprice")
    return normalize.resolve_layer(rows, ("counts", "2-HIGH", "1-URGENT")).groupBy("layer").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@register("normalize_detect_modality", f"""{BASE}, d AS (SELECT COUNT(*) / ({NCELLS} * (SELECT COUNT(*) FROM genes))::DOUBLE AS density, (SELECT COUNT(*) FROM genes) AS p FROM counts WHERE value <> 0)
 SELECT {t.r6_sql('density')} AS density, CASE WHEN p > 10000 THEN 'rna' WHEN p < 100 THEN 'protein' WHEN density < 0.01 THEN 'atac' ELSE 'rna' END AS modality FROM d""")
def normalize_detect_modality(spark, sf):
    m = normalize.detect_modality(t.counts(spark, sf), t.cells(spark, sf).count(), t.genes(spark, sf).count())
    return m.withColumn("density", r6("density"))


TOPVAR = f"topvar AS (SELECT gene_id, var_pop FROM gstats ORDER BY var_pop DESC, gene_id LIMIT 20)"


@register("scale_top_variance", f"""{BASE}, {STATS % 'counts'}, {TOPVAR}
 SELECT c.cell_id, g.gene_id, {t.r6_sql('least(greatest((coalesce(value, 0) - mean) / sqrt(var_sample), -10), 10)')} AS value
 FROM cells c CROSS JOIN (SELECT gene_id, mean, var_sample FROM gstats JOIN topvar USING (gene_id)) g LEFT JOIN counts e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id""")
def scale_top_variance(spark, sf):
    expr, obs = t.counts(spark, sf), t.cells(spark, sf)
    return out(normalize.scale(expr, obs, features.top_variance_genes(expr, obs)), "cell_id", "gene_id")


@register("gene_stats", f"""{BASE}, {STATS % 'counts'}
 SELECT gene_id, n, nnz, total, {t.r6_sql('mean')} AS mean, {t.r6_sql('var_pop')} AS var_pop, {t.r6_sql('var_sample')} AS var_sample FROM gstats""")
def gene_stats(spark, sf):
    s = features.gene_stats(t.counts(spark, sf), t.cells(spark, sf))
    return s.select("gene_id", "n", "nnz", "total", *[r6(c).alias(c) for c in ("mean", "var_pop", "var_sample")])


@register("hvg_top_variance", f"{BASE}, {STATS % 'counts'}, {TOPVAR} SELECT gene_id, {t.r6_sql('var_pop')} AS variance FROM topvar")
def hvg_top_variance(spark, sf):
    return out(features.top_variance_genes(t.counts(spark, sf), t.cells(spark, sf)), "gene_id", value="variance")


@register("hvg_dispersion", f"""WITH {t.SQL_LOGNORM}, {t.SQL_CELLS}, lin AS (SELECT cell_id, gene_id, exp(value) - 1 AS value FROM lognorm), {STATS % 'lin'},
 b AS (SELECT gene_id, ln(1 + mean) AS mean, CASE WHEN var_sample > 0 THEN ln(var_sample / mean) END AS dispersion FROM gstats),
 s AS (SELECT MIN(mean) AS lo, MAX(mean) AS hi FROM b),
 d AS (SELECT b.*, CAST(least(19, greatest(0, ceil((mean - lo) / ((hi - lo) / 20)) - 1)) AS INT) AS bin FROM b, s),
 z AS (SELECT *, AVG(dispersion) OVER (PARTITION BY bin) AS a, stddev_samp(dispersion) OVER (PARTITION BY bin) AS sd FROM d)
 SELECT gene_id, bin, {t.r6_sql('mean')} AS mean, {t.r6_sql('dispersion')} AS dispersion,
  {t.r6_sql('(dispersion - CASE WHEN sd IS NULL THEN 0 ELSE a END) / coalesce(sd, a)')} AS dispersion_norm FROM z
 ORDER BY (dispersion - CASE WHEN sd IS NULL THEN 0 ELSE a END) / coalesce(sd, a) DESC, gene_id LIMIT 500""")
def hvg_dispersion(spark, sf):
    h = features.hvg_dispersion(t.lognorm(spark, sf), t.cells(spark, sf), 500)
    return h.select("gene_id", "bin", *[r6(c).alias(c) for c in ("mean", "dispersion", "dispersion_norm")])


@register("hvg_vst", f"""{BASE}, {STATS % 'counts'},
 g AS (SELECT *, log10(mean) AS u, log10(var_sample) AS v FROM gstats WHERE var_sample > 0 AND mean > 0),
 m AS (SELECT AVG(u) AS mu, AVG(v) AS mv, AVG(u*u) AS mw FROM g),
 cc AS (SELECT SUM((u-mu)*(u-mu)) AS suu, SUM((u-mu)*(u*u-mw)) AS suw, SUM((u*u-mw)*(u*u-mw)) AS sww, SUM((u-mu)*(v-mv)) AS suv, SUM((u*u-mw)*(v-mv)) AS swv FROM g, m),
 beta AS (SELECT (suv*sww - swv*suw) / (suu*sww - suw*suw) AS b1, (swv*suu - suv*suw) / (suu*sww - suw*suw) AS b2 FROM cc),
 r AS (SELECT gene_id, n, nnz, g.mean, sqrt(pow(10, mv - b1*mu - b2*mw + b1*u + b2*u*u)) AS sd FROM g, m, beta),
 z AS (SELECT gene_id, any_value(n) AS n, any_value(nnz) AS nnz, any_value(-mean/sd) AS z0, SUM(least((value-mean)/sd, sqrt(n))) AS s,
         SUM(least((value-mean)/sd, sqrt(n)) * least((value-mean)/sd, sqrt(n))) AS q, any_value(mean) AS mean FROM counts JOIN r USING (gene_id) WHERE value <> 0 GROUP BY 1),
 v AS (SELECT gene_id, mean, ((q + (n-nnz)*z0*z0) - (s + (n-nnz)*z0)*(s + (n-nnz)*z0)/n)/(n-1) AS vn FROM z)
 SELECT gene_id, {t.r6_sql('mean')} AS mean, {t.r6_sql('vn', 4)} AS variance_norm FROM v ORDER BY vn DESC, gene_id LIMIT 500""")
def hvg_vst(spark, sf):
    h = features.hvg_vst(t.counts(spark, sf), t.cells(spark, sf), 500)
    return h.select("gene_id", r6("mean").alias("mean"), r6("variance_norm", 4).alias("variance_norm"))


@register("common_genes", """SELECT p_partkey AS gene_id FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A') AND p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')""")
def common_genes(spark, sf):
    lines = t.load(spark, sf, "lineitem")
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("gene_id"))
    return features.common_genes(side("A"), side("R"), 50)


@register("pca_scaled")
def pca_scaled(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    hvg = features.top_variance_genes(expr, obs, 50)
    pcs = features.pca(normalize.scale(expr, obs, hvg), hvg, 10)
    return pcs.select("cell_id", F.posexplode("vec").alias("component", "score"))


@register("lsi_components")
def lsi_components(spark, sf):
    return features.lsi(t.counts(spark, sf), t.cells(spark, sf), 10).select("cell_id", F.posexplode("vec").alias("component", "score"))


@register("embedding_standardize", f"""WITH e AS (SELECT vec_id AS cell_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
 SELECT cell_id, i AS dim, {t.r6_sql('(x - AVG(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i)')} AS value FROM e""")
def embedding_standardize(spark, sf):
    e = t.load(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"))
    return features.standardize_embedding(e).select("cell_id", F.posexplode("vec").alias("dim", "value")).withColumn("value", r6("value"))

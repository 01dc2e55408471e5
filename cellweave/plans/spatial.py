"""Neighbour graphs and statistics on the customer plane."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import neighbors
from cellweave.plans import tables as t
from cellweave.plans.registry import register

CELLS_EDGES = f"WITH {t.SQL_CELLS}, {t.sql_edges(6)}"


@register("knn_spatial", f"{CELLS_EDGES} SELECT src, dst, {t.r6_sql('dist')} AS dist, rank FROM edges")
def knn_spatial(spark, sf):
    return t.spatial_edges(spark, sf).withColumn("dist", r6("dist"))


EMB = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"


@register("knn_embedding_euclidean", f"""WITH {EMB}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM p)
 SELECT src, dst, {t.r6_sql('d')} AS dist, rank FROM r WHERE rank <= 10""")
def knn_embedding_euclidean(spark, sf):
    return neighbors.knn_embedding(embedding(spark, sf), k=10).withColumn("dist", r6("dist"))


def embedding(spark, sf, *extra):
    return t.load(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("embedding").cast("array<double>").alias("vec"), *extra)


from cellweave.operators import features  # noqa: E402
from cellweave.operators import spatial_stats as sp  # noqa: E402
from cellweave.plans.matrix import STATS, TOPVAR  # noqa: E402

CE = f"WITH {t.SQL_CELLS}, {t.sql_edges(6)}, {t.SQL_LOGNORM}"
# Row-standardised weights of the six nearest neighbours are all 1/6.
MORAN_PARTS = f"""{CE}, w AS (SELECT src, dst, 1.0::DOUBLE / COUNT(*) OVER (PARTITION BY src) AS weight FROM edges),
 sym AS (SELECT a, b, SUM(weight) AS w FROM (SELECT src AS a, dst AS b, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2),
 mom AS (SELECT SUM(w) / 2 AS s0, SUM(w * w) / 2 AS s1, (SELECT SUM(q * q) FROM (SELECT SUM(w) AS q FROM sym GROUP BY a)) AS s2 FROM sym),
 touch AS (SELECT a AS cell_id, SUM(w) AS tw FROM sym GROUP BY 1),
 {STATS % 'lognorm'},
 lin AS (SELECT gene_id, SUM(value * tw) AS xt, SUM(value * value * tw) AS xxt FROM lognorm JOIN touch USING (cell_id) GROUP BY 1),
 crs AS (SELECT x.gene_id, SUM(weight * x.value * y.value) AS xx FROM lognorm x JOIN w ON x.cell_id = w.src JOIN lognorm y ON y.cell_id = w.dst AND y.gene_id = x.gene_id GROUP BY 1),
 parts AS (SELECT g.gene_id, n, mean, sumsq - n * mean * mean AS scale, xt, xxt, coalesce(xx, 0) AS xx, s0, s1, s2
           FROM gstats g JOIN lin USING (gene_id) LEFT JOIN crs USING (gene_id), mom),
 moran AS (SELECT gene_id, n / s0 * (xx - mean * xt + mean * mean * s0) / scale AS score, -1.0::DOUBLE / (n - 1) AS e,
   (n::DOUBLE * n * s1 - n * s2 + 3 * s0 * s0) / ((n - 1)::DOUBLE * (n + 1) * s0 * s0) - 1.0::DOUBLE / ((n - 1)::DOUBLE * (n - 1)) AS v FROM parts WHERE scale > 1e-12),
 geary AS (SELECT gene_id, (n - 1) * (xxt - 2 * xx) / (2 * s0 * scale) AS score, 1.0::DOUBLE AS e,
   ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0) AS v FROM parts WHERE scale > 1e-12)"""


def bh_sql(table: str, key: str, p: str = "p", by: str = "") -> str:
    """BH-adjusted p-values of ``table``; tied p-values share the larger rank."""
    part = f"PARTITION BY {by} " if by else ""
    return f"""(SELECT *, least(1.0::DOUBLE, MIN(raw) OVER ({part}ORDER BY {p} DESC)) AS q FROM (
      SELECT *, {p} * COUNT(*) OVER ({part.strip()}) / COUNT(*) OVER ({part}ORDER BY {p}) AS raw FROM {table}))"""


def _score(df, name):
    return df.select("gene_id", r6(name).alias(name), r6("var_norm", 9).alias("var_norm"), r6("pval_norm").alias("pval_norm"))


@register("moran_i", f"""{MORAN_PARTS} SELECT gene_id, {t.r6_sql('score')} AS "I", {t.r6_sql('v', 9)} AS var_norm, {t.r6_sql(t.norm_sf_sql('abs((score - e) / sqrt(v))'))} AS pval_norm FROM moran""")
def moran_i(spark, sf):
    return _score(sp.moran_i(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf)), "I")


@register("geary_c", f"""{MORAN_PARTS} SELECT gene_id, {t.r6_sql('score')} AS "C", {t.r6_sql('v', 9)} AS var_norm, {t.r6_sql(t.norm_sf_sql('abs((score - e) / sqrt(v))'))} AS pval_norm FROM geary""")
def geary_c(spark, sf):
    return _score(sp.geary_c(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf)), "C")


@register("svg_moran", f"""{MORAN_PARTS}, tested AS (SELECT gene_id, score, {t.norm_sf_sql('abs((score - e) / sqrt(v))')} AS p FROM moran)
 SELECT gene_id, {t.r6_sql('score')} AS "I", {t.r6_sql('q')} AS qval, score > 0 AND p < 0.05 AS significant, score > 0 AND q < 0.05 AS significant_fdr FROM {bh_sql('tested', 'gene_id')}""")
def svg_moran(spark, sf):
    s = sp.svg_moran(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf))
    return s.select("gene_id", r6("I").alias("I"), r6("qval").alias("qval"), "significant", "significant_fdr")


@register("moran_interpretation", f"""{MORAN_PARTS} SELECT CASE WHEN score > 0.3 THEN 'strong positive' WHEN score > 0.1 THEN 'moderate positive' WHEN score > -0.1 THEN 'weak or random'
  WHEN score > -0.3 THEN 'moderate negative' ELSE 'strong negative' END AS verdict, COUNT(*) AS n FROM moran GROUP BY 1""")
def moran_interpretation(spark, sf):
    m = sp.moran_i(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf))
    return m.groupBy(sp.interpret_moran(F.col("I")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def _slot(seed_key: str) -> str:
    return f"row_number() OVER (ORDER BY md5({seed_key}))"


PERM = """base AS (SELECT cell_id, cell_type, row_number() OVER (ORDER BY md5('42-base-' || cell_id)) AS slot FROM cells),
 shuf AS (SELECT perm, cell_id, row_number() OVER (PARTITION BY perm ORDER BY md5('42-' || perm || '-' || cell_id)) AS slot FROM cells, (SELECT unnest(range(1, 21)) AS perm)),
 perms AS (SELECT perm, shuf.cell_id, base.cell_type, base.cell_id AS origin FROM shuf JOIN base USING (slot))"""


@register("moran_permutation", f"""{MORAN_PARTS}, {PERM},
 px AS (SELECT perm, perms.cell_id, gene_id, value FROM lognorm e JOIN perms ON e.cell_id = perms.origin),
 plin AS (SELECT perm, gene_id, SUM(value * tw) AS xt FROM px JOIN touch USING (cell_id) GROUP BY 1, 2),
 pcrs AS (SELECT x.perm, x.gene_id, SUM(weight * x.value * y.value) AS xx FROM px x JOIN w ON x.cell_id = w.src JOIN px y ON y.perm = x.perm AND y.cell_id = w.dst AND y.gene_id = x.gene_id GROUP BY 1, 2),
 sim AS (SELECT plin.gene_id, n / s0 * (coalesce(pcrs.xx, 0) - mean * plin.xt + mean * mean * s0) / scale AS sim FROM plin LEFT JOIN pcrs USING (perm, gene_id) JOIN parts ON parts.gene_id = plin.gene_id),
 c AS (SELECT gene_id, SUM(CASE WHEN sim >= score THEN 1 ELSE 0 END) AS above FROM sim JOIN moran USING (gene_id) GROUP BY 1)
 SELECT gene_id, {t.r6_sql('(least(above, 20 - above) + 1) / 21.0::DOUBLE')} AS pval_sim FROM c""")
def moran_permutation(spark, sf):
    m = sp.moran_i(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf), n_perms=20)
    return m.select("gene_id", r6("pval_sim").alias("pval_sim"))


DENSE = f"""{CE}, {STATS % 'lognorm'}, {TOPVAR},
 dense AS (SELECT c.cell_id, g.gene_id, coalesce(value, 0) AS value FROM cells c CROSS JOIN topvar g LEFT JOIN lognorm e ON e.cell_id = c.cell_id AND e.gene_id = g.gene_id)"""
GSTAR = f"""{DENSE}, lag AS (SELECT src AS cell_id, gene_id, SUM(value) AS lag, COUNT(*)::DOUBLE AS w1 FROM edges JOIN dense ON dst = cell_id GROUP BY 1, 2),
 z AS (SELECT gene_id, cell_id, CASE WHEN sqrt(s.var_pop) < 1e-10 THEN 0 ELSE (lag + value - mean * (w1 + 1)) / (sqrt(s.var_pop) * sqrt((n * (w1 + 1) - (w1 + 1) * (w1 + 1)) / (n - 1))) END AS z
       FROM dense JOIN lag USING (cell_id, gene_id) JOIN gstats s USING (gene_id)),
 g AS (SELECT *, {t.norm_p_sql('z')} AS p FROM z)"""


def _top(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    return expr, obs, features.top_variance_genes(expr, obs)


@register("getis_ord_gstar", f"{GSTAR} SELECT gene_id, cell_id, {t.r6_sql('z')} AS z, {t.r6_sql('p')} AS pval FROM g")
def getis_ord_gstar(spark, sf):
    expr, obs, top = _top(spark, sf)
    g = sp.getis_ord_gstar(expr, obs, t.spatial_edges(spark, sf), top)
    return g.select("gene_id", "cell_id", r6("z").alias("z"), r6("pval").alias("pval"))


@register("getis_hot_cold", f"""{GSTAR} SELECT gene_id, COUNT(*) FILTER (p < 0.05 AND z > 0) AS n_hot, COUNT(*) FILTER (p < 0.05 AND z < 0) AS n_cold FROM g GROUP BY 1""")
def getis_hot_cold(spark, sf):
    expr, obs, top = _top(spark, sf)
    return sp.hot_cold_counts(sp.getis_ord_gstar(expr, obs, t.spatial_edges(spark, sf), top))


@register("local_moran", f"""{DENSE}, zz AS (SELECT cell_id, gene_id, n, (value - mean) / sqrt(var_pop) AS z FROM dense JOIN gstats USING (gene_id) WHERE TRUE),
 lag AS (SELECT src AS cell_id, gene_id, SUM(z) / 6 AS lag FROM edges JOIN zz ON dst = cell_id GROUP BY 1, 2)
 SELECT gene_id, cell_id, {t.r6_sql('(n - 1)::DOUBLE / n * z * lag')} AS "Ii" FROM zz JOIN lag USING (cell_id, gene_id)""".replace("JOIN gstats USING (gene_id) WHERE TRUE", "JOIN (SELECT gene_id, n, mean, var_pop FROM gstats) USING (gene_id)"))
def local_moran(spark, sf):
    expr, obs, top = _top(spark, sf)
    return sp.local_moran(expr, obs, t.spatial_edges(spark, sf), top, permutations=0).withColumn("Ii", r6("Ii"))


@register("local_moran_permutation")
def local_moran_permutation(spark, sf):
    expr, obs, top = _top(spark, sf)
    return sp.local_moran(expr, obs, t.spatial_edges(spark, sf), top, permutations=19)


@register("bivariate_moran", f"""{DENSE}, m AS (SELECT gene_id, mean, sqrt(var_pop) + 1e-10::DOUBLE AS sd FROM gstats WHERE gene_id IN (1, 2)),
 x AS (SELECT c.cell_id, m.gene_id, (coalesce(value, 0) - mean) / sd AS z FROM cells c CROSS JOIN m LEFT JOIN lognorm e ON e.cell_id = c.cell_id AND e.gene_id = m.gene_id),
 b AS (SELECT SUM(a.z * b.z) / (COUNT(*) + 1e-10::DOUBLE) AS i FROM edges JOIN x a ON a.cell_id = src AND a.gene_id = 1 JOIN x b ON b.cell_id = dst AND b.gene_id = 2)
 SELECT {t.r6_sql('i')} AS "bivariate_I", CASE WHEN i > 0 THEN 'positive' ELSE 'negative' END AS direction FROM b""")
def bivariate_moran(spark, sf):
    b = sp.bivariate_moran(t.lognorm(spark, sf), t.cells(spark, sf), t.spatial_edges(spark, sf), 1, 2)
    return b.withColumn("bivariate_I", r6("bivariate_I"))


NHOOD = f"""{CELLS_EDGES}, {PERM},
 seen AS (SELECT a.cell_type AS label_a, b.cell_type AS label_b, COUNT(*) AS n FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst GROUP BY 1, 2),
 null_ AS (SELECT a.perm, a.cell_type AS label_a, b.cell_type AS label_b, COUNT(*) AS n FROM edges JOIN perms a ON a.cell_id = src JOIN perms b ON b.cell_id = dst AND b.perm = a.perm GROUP BY 1, 2, 3),
 m AS (SELECT label_a, label_b, SUM(n) / 20.0::DOUBLE AS mean, SUM(n * n) / 20.0::DOUBLE AS sq FROM null_ GROUP BY 1, 2),
 enr AS (SELECT label_a, label_b, n, (n - mean) / sqrt(sq - mean * mean) AS z FROM seen JOIN m USING (label_a, label_b))"""


@register("nhood_enrichment", f"{NHOOD} SELECT label_a, label_b, n AS n_edges, {t.r6_sql('z')} AS zscore FROM enr")
def nhood_enrichment(spark, sf):
    e = sp.nhood_enrichment(t.spatial_edges(spark, sf), t.cells(spark, sf), "cell_type", 20)
    return e.withColumn("zscore", r6("zscore"))


BINS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0)
PAIR_BINS = "(SELECT unnest([0.5, 1.0, 1.5, 2.0, 3.0, 4.0])::DOUBLE AS distance)"


@register("ripley_l", f"""WITH {t.SQL_CELLS}, s AS (SELECT cell_type, COUNT(*) AS n FROM cells GROUP BY 1), a AS (SELECT (MAX(x) - MIN(x)) * (MAX(y) - MIN(y)) AS area FROM cells),
 d AS (SELECT a.cell_type, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM cells a JOIN cells b ON a.cell_type = b.cell_type AND a.cell_id <> b.cell_id AND abs(a.x-b.x) <= 4 AND abs(a.y-b.y) <= 4)
 SELECT s.cell_type AS cluster, distance, COUNT(d) AS n_pairs, {t.r6_sql('sqrt(any_value(area) * COUNT(d) / (pi() * any_value(n) * (any_value(n) - 1)))')} AS "L"
 FROM s CROSS JOIN {PAIR_BINS} CROSS JOIN a LEFT JOIN d ON d.cell_type = s.cell_type AND d <= distance GROUP BY 1, 2""")
def ripley_l(spark, sf):
    return sp.ripley_l(t.cells(spark, sf), "cell_type", BINS).withColumn("L", r6("L"))


@register("co_occurrence", f"""WITH {t.SQL_CELLS},
 d AS (SELECT a.cell_type AS label_a, b.cell_type AS label_b, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) AS d FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND abs(a.x-b.x) <= 4 AND abs(a.y-b.y) <= 4),
 c AS (SELECT label_a, label_b, CASE WHEN d <= 1 THEN 0 WHEN d <= 1.5 THEN 1 WHEN d <= 2 THEN 2 WHEN d <= 3 THEN 3 ELSE 4 END::BIGINT AS bin, COUNT(*) AS n FROM d WHERE d > 0.5 AND d <= 4 GROUP BY 1, 2, 3)
 SELECT *, {t.r6_sql('(n / SUM(n) OVER (PARTITION BY bin, label_a)) / (SUM(n) OVER (PARTITION BY bin, label_b) / SUM(n) OVER (PARTITION BY bin))')} AS ratio FROM c""")
def co_occurrence(spark, sf):
    return sp.co_occurrence(t.cells(spark, sf), "cell_type", BINS).withColumn("ratio", r6("ratio"))


UND = f"""{CELLS_EDGES}, und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges),
 both_ AS (SELECT a AS u, b AS v FROM und UNION ALL SELECT b, a FROM und), deg AS (SELECT u AS cell_id, COUNT(*) AS d FROM both_ GROUP BY 1),
 tri AS (SELECT x.u AS cell_id, COUNT(*) AS t FROM both_ x JOIN both_ y ON x.u = y.u AND x.v < y.v JOIN und ON und.a = x.v AND und.b = y.v GROUP BY 1),
 node AS (SELECT cell_id, cell_type, coalesce(d, 0) AS degree, CASE WHEN d > 1 THEN 2.0::DOUBLE * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END AS clustering
          FROM cells LEFT JOIN deg USING (cell_id) LEFT JOIN tri USING (cell_id))"""


@register("network_properties", f"""{UND} SELECT COUNT(*) AS n_nodes, (SELECT COUNT(*) FROM und) AS n_edges, {t.r6_sql('AVG(degree)')} AS mean_degree, {t.r6_sql('stddev_pop(degree)')} AS sd_degree,
 {t.r6_sql('AVG(clustering)')} AS mean_clustering, {t.r6_sql('2.0::DOUBLE * (SELECT COUNT(*) FROM und) / (COUNT(*) * (COUNT(*) - 1))')} AS density FROM node""")
def network_properties(spark, sf):
    p = sp.network_properties(t.spatial_edges(spark, sf), t.cells(spark, sf))
    return p.select("n_nodes", "n_edges", *[r6(c).alias(c) for c in ("mean_degree", "sd_degree", "mean_clustering", "density")])


@register("degree_by_cluster", f"{UND} SELECT cell_type, COUNT(*) AS n_nodes, {t.r6_sql('AVG(degree)')} AS mean_degree FROM node GROUP BY 1")
def degree_by_cluster(spark, sf):
    return sp.degree_by_cluster(t.spatial_edges(spark, sf), t.cells(spark, sf), "cell_type").withColumn("mean_degree", r6("mean_degree"))


@register("centrality", f"""{UND.replace('WITH ', 'WITH RECURSIVE ', 1)},
 bfs(label, cell_id, hops) USING KEY (label, cell_id) AS (SELECT cell_type, cell_id, 0 FROM cells
   UNION SELECT DISTINCT f.label, v, f.hops + 1 FROM bfs f JOIN both_ ON u = f.cell_id WHERE NOT EXISTS (FROM recurring.bfs r WHERE r.label = f.label AND r.cell_id = v)),
 far AS (SELECT label, SUM(hops) AS s FROM bfs GROUP BY 1),
 sz AS (SELECT cell_type AS label, COUNT(*) AS n, (SELECT COUNT(*) FROM cells) AS t FROM cells GROUP BY 1),
 reach AS (SELECT p.cell_type AS label, COUNT(DISTINCT v) AS r FROM both_ JOIN cells p ON p.cell_id = u JOIN cells q ON q.cell_id = v WHERE p.cell_type <> q.cell_type GROUP BY 1)
 SELECT label AS cluster, {t.r6_sql('r / (t - n)::DOUBLE')} AS degree_centrality, {t.r6_sql('(t - n) / s::DOUBLE')} AS closeness_centrality,
   {t.r6_sql('(SELECT AVG(clustering) FROM node WHERE cell_type = label)')} AS average_clustering FROM sz JOIN reach USING (label) JOIN far USING (label)""")
def centrality(spark, sf):
    c = sp.centrality(t.spatial_edges(spark, sf), t.cells(spark, sf), "cell_type")
    return c.select("cluster", *[r6(x).alias(x) for x in ("degree_centrality", "closeness_centrality", "average_clustering")])


LANDMARKS = 24
BETWEEN = f"""{UND.replace('WITH ', 'WITH RECURSIVE ', 1)},
 lm AS (SELECT cell_id FROM cells ORDER BY md5(cell_id::VARCHAR), cell_id LIMIT {LANDMARKS}),
 bfs(s, v, d) USING KEY (s, v) AS (SELECT cell_id, cell_id, 0 FROM lm
   UNION SELECT DISTINCT f.s, e.v, f.d + 1 FROM bfs f JOIN both_ e ON e.u = f.v WHERE NOT EXISTS (FROM recurring.bfs r WHERE r.s = f.s AND r.v = e.v)),
 far AS (SELECT s, v, d FROM bfs),
 pt(d, s, v, n) AS (SELECT 0, cell_id, cell_id, 1.0::DOUBLE FROM lm
   UNION ALL SELECT p.d + 1, p.s, e.v, SUM(p.n) FROM pt p JOIN both_ e ON e.u = p.v JOIN far w ON w.s = p.s AND w.v = e.v AND w.d = p.d + 1 GROUP BY p.d, p.s, e.v),
 paths AS (SELECT * FROM pt),
 dp(d, s, v, n, delta) AS (SELECT d, s, v, n, 0.0::DOUBLE FROM paths WHERE d = (SELECT MAX(d) FROM paths)
   UNION ALL SELECT p.d, p.s, p.v, p.n, p.n * coalesce(x.t, 0.0) FROM paths p JOIN (SELECT DISTINCT d FROM dp) m ON p.d = m.d - 1 AND m.d > 1
     LEFT JOIN (SELECT b.s, e.v, SUM((1 + b.delta) / b.n) AS t FROM dp b JOIN both_ e ON e.u = b.v GROUP BY 1, 2) x ON x.s = p.s AND x.v = p.v),
 bt AS (SELECT v AS cell_id, SUM(delta) AS delta FROM dp GROUP BY 1),
 bc AS (SELECT cell_id, cell_type, coalesce(delta, 0) * k.n / {LANDMARKS}::DOUBLE / ((k.n - 1) * (k.n - 2)) AS b FROM cells LEFT JOIN bt USING (cell_id), (SELECT COUNT(*) AS n FROM cells) k)"""


@register("betweenness", f"{BETWEEN} SELECT cell_id, {t.r6_sql('b', 9)} AS betweenness FROM bc")
def betweenness(spark, sf):
    """All cells, from the two dozen landmarks that this query asks for."""
    return sp.betweenness(t.spatial_edges(spark, sf), t.cells(spark, sf), LANDMARKS).withColumn("betweenness", r6("betweenness", 9))


@register("betweenness_by_cluster", f"{BETWEEN} SELECT cell_type AS cluster, {t.r6_sql('AVG(b)', 9)} AS betweenness_centrality FROM bc GROUP BY 1")
def betweenness_by_cluster(spark, sf):
    rows = sp.betweenness_by_cluster(t.spatial_edges(spark, sf), t.cells(spark, sf), "cell_type", LANDMARKS)
    return rows.withColumn("betweenness_centrality", r6("betweenness_centrality", 9))


@register("gene_correlation", f"""{DENSE}, c AS (SELECT a.gene_id AS gene_a, b.gene_id AS gene_b, corr(a.value, b.value) AS r FROM dense a JOIN dense b USING (cell_id) GROUP BY 1, 2)
 SELECT gene_a, gene_b, {t.r6_sql('r')} AS correlation FROM c""")
def gene_correlation(spark, sf):
    expr, obs, top = _top(spark, sf)
    return sp.gene_correlation(expr, obs, top).withColumn("correlation", r6("correlation"))


@register("feature_map_clip", f"""{DENSE} SELECT cell_id, gene_id, {t.r6_sql('least(greatest(value, quantile_cont(value, 0.01) OVER (PARTITION BY gene_id)), quantile_cont(value, 0.99) OVER (PARTITION BY gene_id))')} AS value FROM dense""")
def feature_map_clip(spark, sf):
    expr, obs, top = _top(spark, sf)
    return sp.clip_for_map(sp.dense_genes(expr, obs, top)).withColumn("value", r6("value"))


@register("svg_random_kernel")
def svg_random_kernel(spark, sf):
    obs = t.cells(spark, sf)
    return sp.svg_random_kernel(t.counts(spark, sf), obs, features.random_fourier_features(obs, 100, as_sites=True))


@register("min_total_counts", "SELECT l_partkey AS gene_id, SUM(l_quantity) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1 HAVING SUM(l_quantity) >= 700")
def min_total_counts(spark, sf):
    return sp.min_total_counts(t.counts(spark, sf), 700).groupBy("gene_id").agg(F.sum("value").alias("total"))


# ------------------------------------------------------------------ graph algebra
@register("graph_symmetrize", f"{CELLS_EDGES} SELECT src, dst, MAX(w) AS weight FROM (SELECT src, dst, 1.0::DOUBLE / (1 + rank) AS w FROM edges UNION ALL SELECT dst, src, 1.0::DOUBLE / (1 + rank) FROM edges) GROUP BY 1, 2")
def graph_symmetrize(spark, sf):
    return neighbors.symmetrize(ranked_edges(spark, sf))


def ranked_edges(spark, sf):
    return t.spatial_edges(spark, sf).select("src", "dst", (1.0 / (1 + F.col("rank"))).alias("weight"))


@register("graph_row_normalize", f"{CELLS_EDGES} SELECT src, dst, {t.r6_sql('(1.0::DOUBLE / (1 + rank)) / SUM(1.0::DOUBLE / (1 + rank)) OVER (PARTITION BY src)')} AS weight FROM edges")
def graph_row_normalize(spark, sf):
    return neighbors.row_normalize(ranked_edges(spark, sf), t.cells(spark, sf)).withColumn("weight", r6("weight"))


@register("graph_gcn_normalize", f"""{CELLS_EDGES}, f AS (SELECT src, dst, 1.0::DOUBLE / (1 + rank) AS w FROM edges UNION ALL SELECT cell_id, cell_id, 1.0 FROM cells), d AS (SELECT src, SUM(w) AS d FROM f GROUP BY 1)
 SELECT f.src, f.dst, {t.r6_sql('w / sqrt(a.d) / sqrt(b.d)')} AS weight FROM f JOIN d a ON a.src = f.src JOIN d b ON b.src = f.dst""")
def graph_gcn_normalize(spark, sf):
    return neighbors.gcn_normalize(ranked_edges(spark, sf), t.cells(spark, sf)).withColumn("weight", r6("weight"))


@register("graph_combine", f"""WITH {t.SQL_CELLS}, {t.sql_edges(6)}, {t.sql_edges(3, 'near')}
 SELECT src, dst, {t.r6_sql('SUM(w)')} AS weight FROM (SELECT src, dst, 0.7::DOUBLE / (1 + rank) AS w FROM edges UNION ALL SELECT src, dst, 0.3::DOUBLE FROM near) GROUP BY 1, 2""")
def graph_combine(spark, sf):
    near = t.spatial_edges(spark, sf, 3).select("src", "dst", F.lit(1.0).alias("weight"))
    return neighbors.combine_graphs(ranked_edges(spark, sf), near, 0.3).withColumn("weight", r6("weight"))


@register("graph_top_weight", f"""{CELLS_EDGES}, b AS (SELECT src, dst, 1.0::DOUBLE / (1 + rank) AS w, row_number() OVER (PARTITION BY src ORDER BY rank) AS rn FROM edges)
 SELECT src, dst, {t.r6_sql('w / SUM(w) OVER (PARTITION BY src)')} AS weight FROM b WHERE rn <= 4""")
def graph_top_weight(spark, sf):
    return neighbors.top_weight_neighbors(ranked_edges(spark, sf), 4).withColumn("weight", r6("weight"))


@register("graph_radius", f"""WITH {t.SQL_CELLS} SELECT a.cell_id AS src, b.cell_id AS dst, {t.r6_sql('sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))')} AS dist FROM cells a JOIN cells b ON a.cell_id <> b.cell_id
 AND abs(a.x-b.x) <= 1.5 AND abs(a.y-b.y) <= 1.5 AND (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 2.25""")
def graph_radius(spark, sf):
    return neighbors.radius_graph(t.cells(spark, sf), 1.5).withColumn("dist", r6("dist"))


@register("graph_remove_long_links", f"{CELLS_EDGES} SELECT src, dst FROM edges WHERE dist <= (SELECT quantile_cont(dist, 0.9) FROM edges)")
def graph_remove_long_links(spark, sf):
    return neighbors.remove_long_links(t.spatial_edges(spark, sf), 90).select("src", "dst")


GRIDPOS = "g AS (SELECT cell_id, CAST(floor(cell_id / 40) AS BIGINT) AS r, 2 * (cell_id % 40) + CAST(floor(cell_id / 40) AS BIGINT) % 2 AS c FROM cells)"


@register("graph_hex_grid", f"""WITH {t.SQL_CELLS}, {GRIDPOS} SELECT a.cell_id AS src, b.cell_id AS dst FROM g a JOIN g b ON a.cell_id <> b.cell_id
  AND ((a.r = b.r AND abs(a.c - b.c) = 2) OR (abs(a.r - b.r) = 1 AND abs(a.c - b.c) = 1))""")
def graph_hex_grid(spark, sf):
    row = F.floor(F.col("cell_id") / 40)
    placed = t.cells(spark, sf).select("cell_id", row.alias("array_row"), (2 * (F.col("cell_id") % 40) + row % 2).alias("array_col"))
    return neighbors.grid_neighbors(placed).select("src", "dst")


@register("graph_similarity_weight", f"""WITH {t.SQL_CELLS}, {t.sql_edges(6)}, {EMB}
 SELECT src, dst, {t.r6_sql('greatest(list_cosine_similarity(a.v, b.v), 0)')} AS weight FROM edges JOIN e a ON a.vec_id = src JOIN e b ON b.vec_id = dst""")
def graph_similarity_weight(spark, sf):
    return neighbors.similarity_weight(t.spatial_edges(spark, sf), embedding(spark, sf)).withColumn("weight", r6("weight"))


@register("graph_min_distance", f"""WITH {t.SQL_CELLS} SELECT a.cell_id, {t.r6_sql('MIN(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))')} AS dist FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND b.cell_type = 'MACHINERY' GROUP BY 1""")
def graph_min_distance(spark, sf):
    obs = t.cells(spark, sf)
    return neighbors.min_distance_to_set(obs, obs.filter("cell_type = 'MACHINERY'")).withColumn("dist", r6("dist"))


@register("knn_embedding_cosine", f"""WITH {EMB}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM p) SELECT src, dst, {t.r6_sql('d')} AS dist, rank FROM r WHERE rank <= 5""")
def knn_embedding_cosine(spark, sf):
    return neighbors.knn_embedding(embedding(spark, sf), k=5, metric="cosine").withColumn("dist", r6("dist"))


@register("knn_batch_balanced", f"""WITH {EMB}, p AS (SELECT a.vec_id AS src, b.vec_id AS dst, b.label AS batch, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY src, batch ORDER BY d, dst) AS rank FROM p) SELECT src, dst, batch, {t.r6_sql('d')} AS dist, rank FROM r WHERE rank <= 3""")
def knn_batch_balanced(spark, sf):
    return neighbors.bbknn(embedding(spark, sf, F.col("label").alias("batch"))).withColumn("dist", r6("dist"))


@register("knn_mutual", f"""WITH {EMB}, p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_distance(a.v, b.v) AS d FROM e a JOIN e b ON a.label < 5 AND b.label >= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY d, y) AS rx, row_number() OVER (PARTITION BY y ORDER BY d, x) AS ry FROM p)
 SELECT x AS a_id, y AS b_id, {t.r6_sql('d')} AS dist FROM r WHERE rx <= 5 AND ry <= 5""")
def knn_mutual(spark, sf):
    e = embedding(spark, sf, "label")
    pairs = neighbors.mnn_pairs(e.filter("label < 5"), e.filter("label >= 5"), 5, "euclidean")
    return pairs.withColumn("dist", r6("dist"))

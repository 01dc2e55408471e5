"""Trajectory, velocity, copy number, integration, registration and image tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import dynamics as dy
from cellweave.operators import neighbors
from cellweave.operators import integration as it
from cellweave.plans import tables as t
from cellweave.plans.registry import register
from cellweave.plans.spatial import CELLS_EDGES, embedding


@register("tr_spearman", f"""WITH {t.SQL_CELLS}, {t.SQL_LOGNORM}, g AS (SELECT DISTINCT gene_id FROM lognorm), d AS (SELECT g.gene_id, c.cell_id, c.pseudotime AS t, coalesce(value, 0) AS v FROM g CROSS JOIN cells c LEFT JOIN lognorm e ON e.gene_id = g.gene_id AND e.cell_id = c.cell_id),
 r AS (SELECT gene_id, rank() OVER (PARTITION BY gene_id ORDER BY v) + (COUNT(*) OVER (PARTITION BY gene_id, v) - 1) / 2.0::DOUBLE AS rv, rank() OVER (PARTITION BY gene_id ORDER BY t) + (COUNT(*) OVER (PARTITION BY gene_id, t) - 1) / 2.0::DOUBLE AS rt FROM d)
 SELECT gene_id, {t.r6_sql('corr(rv, rt)')} AS correlation FROM r GROUP BY 1""")
def tr_spearman(spark, sf):
    return dy.spearman_genes(t.lognorm(spark, sf), t.cells(spark, sf)).select("gene_id", r6("correlation").alias("correlation"))


@register("tr_pseudotime_by_cluster", f"WITH {t.SQL_CELLS} SELECT cell_type, {t.r6_sql('AVG(pseudotime)')} AS mean, {t.r6_sql('median(pseudotime)')} AS median, COUNT(*) AS n_cells FROM cells GROUP BY 1")
def tr_pseudotime_by_cluster(spark, sf):
    p = dy.pseudotime_by_cluster(t.cells(spark, sf), "cell_type")
    return p.select("cell_type", r6("mean").alias("mean"), r6("median").alias("median"), "n_cells")


TM = f"""{CELLS_EDGES}, k1 AS (SELECT src, dst FROM edges JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst WHERE b.pseudotime >= a.pseudotime),
 mx AS (SELECT src, dst, SUM(w) AS w FROM (SELECT src, dst, 0.8::DOUBLE / COUNT(*) OVER (PARTITION BY src) AS w FROM k1 UNION ALL SELECT src, dst, 0.2::DOUBLE / 6 FROM edges) GROUP BY 1, 2), tm AS (SELECT src, dst, w / SUM(w) OVER (PARTITION BY src) AS w FROM mx)"""


def transitions(spark, sf):
    edges, obs = t.spatial_edges(spark, sf), t.cells(spark, sf)
    return dy.transition_matrix([dy.pseudotime_kernel(edges, obs), edges.withColumn("weight", F.lit(1.0))])


@register("tr_transition_matrix", f"{TM} SELECT src, dst, {t.r6_sql('w')} AS weight FROM tm")
def tr_transition_matrix(spark, sf):
    return transitions(spark, sf).withColumn("weight", r6("weight"))


#: Mass arriving at each cell from the terminals, step by step; after 1500 steps what is left is far below the rounding.
ABSORB = f"""{TM.replace('WITH ', 'WITH RECURSIVE ', 1)}, ends AS (SELECT cell_id, batch AS fate FROM cells WHERE pseudotime > 9000),
 mv AS (SELECT src, dst, w FROM tm WHERE src NOT IN (SELECT cell_id FROM ends)),
 st(k, cell_id, fate, p) AS (SELECT 0, cell_id, fate, 1.0::DOUBLE FROM ends UNION ALL SELECT k + 1, src, fate, SUM(w * p) FROM st JOIN mv ON dst = cell_id WHERE k < 1500 GROUP BY k, src, fate)
 SELECT c.cell_id, f.fate, {t.r6_sql('coalesce(p, 0)')} AS p FROM cells c CROSS JOIN (SELECT DISTINCT fate FROM ends) f LEFT JOIN (SELECT cell_id, fate, SUM(p) AS p FROM st GROUP BY 1, 2) x ON x.cell_id = c.cell_id AND x.fate = f.fate"""


@register("tr_absorption", ABSORB)
def tr_absorption(spark, sf):
    obs = t.cells(spark, sf)
    ends = obs.filter("pseudotime > 9000").select("cell_id", F.col("batch").alias("fate"))
    return dy.absorption_probabilities(transitions(spark, sf), ends, obs).withColumn("p", r6("p"))


@register("tr_diffusion_pseudotime")
def tr_diffusion_pseudotime(spark, sf):
    edges = neighbors.symmetrize(t.spatial_edges(spark, sf).withColumn("weight", F.lit(1.0)))
    return dy.diffusion_pseudotime(edges, 0, 3)


def layers(spark, sf):
    return t.counts(spark, sf).select("cell_id", "gene_id", F.floor(F.col("value") * 0.7).cast("double").alias("spliced"), (F.col("value") - F.floor(F.col("value") * 0.7)).alias("unspliced"))


LY = f"{t.SQL_COUNTS}, ly AS (SELECT cell_id, gene_id, floor(value * 0.7::DOUBLE) AS s, value - floor(value * 0.7::DOUBLE) AS u FROM counts)"
MOM = f"""WITH {t.SQL_CELLS}, {t.sql_edges(6)}, {LY}, ok AS (SELECT gene_id FROM ly WHERE s > 0 AND u > 0 GROUP BY 1 HAVING SUM(s + u) >= 30), lk AS (SELECT src, dst FROM edges UNION ALL SELECT cell_id, cell_id FROM cells),
 mo AS (SELECT src AS cell_id, gene_id, SUM(s) / 7 AS ms, SUM(u) / 7 AS mu FROM lk JOIN ly ON ly.cell_id = dst WHERE gene_id IN (SELECT gene_id FROM ok) GROUP BY 1, 2), g AS (SELECT gene_id, SUM(mu * ms) / SUM(ms * ms) AS gamma FROM mo GROUP BY 1 HAVING SUM(ms * ms) > 0),
 ve AS (SELECT cell_id, gene_id, mu - coalesce(gamma, 0) * ms AS v FROM mo LEFT JOIN g USING (gene_id))"""


@register("ve_moments", f"{MOM} SELECT cell_id, gene_id, {t.r6_sql('ms')} AS ms, {t.r6_sql('mu')} AS mu FROM mo")
def ve_moments(spark, sf):
    m = dy.velocity_moments(layers(spark, sf), t.spatial_edges(spark, sf), places=t.cells(spark, sf))
    return m.select("cell_id", "gene_id", r6("ms").alias("ms"), r6("mu").alias("mu"))


@register("ve_speed", f"{MOM} SELECT cell_id, {t.r6_sql('sqrt(SUM(v * v))')} AS speed FROM ve GROUP BY 1")
def ve_speed(spark, sf):
    m = dy.velocity_moments(layers(spark, sf), t.spatial_edges(spark, sf), places=t.cells(spark, sf))
    return dy.velocity_speed(dy.velocity_steady_state(m)).withColumn("speed", r6("speed"))


@register("ve_proportions", f"WITH {t.SQL_CELLS}, {LY} SELECT cell_type, {t.r6_sql('SUM(s) / SUM(s + u)')} AS spliced, {t.r6_sql('SUM(u) / SUM(s + u)')} AS unspliced FROM ly JOIN cells USING (cell_id) GROUP BY 1")
def ve_proportions(spark, sf):
    p = dy.spliced_proportions(layers(spark, sf), t.cells(spark, sf), "cell_type")
    return p.select("cell_type", r6("spliced").alias("spliced"), r6("unspliced").alias("unspliced"))


CNV = f"""WITH {t.SQL_CELLS}, {t.SQL_LOGNORM}, nr AS (SELECT COUNT(*) AS n FROM cells WHERE cell_type = 'MACHINERY'), rs AS (SELECT gene_id, SUM(value) / any_value(n) AS ref FROM lognorm JOIN cells USING (cell_id), nr WHERE cell_type = 'MACHINERY' GROUP BY 1),
 pl AS (SELECT p_partkey AS gene_id, p_brand AS chromosome, coalesce(ref, 0) AS ref, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS pos, least(20, COUNT(*) OVER (PARTITION BY p_brand)) AS w, COUNT(*) OVER (PARTITION BY p_brand) AS n FROM part LEFT JOIN rs ON gene_id = p_partkey),
 bn AS (SELECT gene_id, chromosome, ref, w, unnest(range(greatest(0, ceil((pos - w + 1) / 10.0)::BIGINT), least((n - w) // 10, pos // 10) + 1)) AS bin FROM pl),
 ba AS (SELECT chromosome, bin, SUM(greatest(-ref, -3) / w) AS base FROM bn GROUP BY 1, 2), mv AS (SELECT cell_id, chromosome, bin, SUM((least(greatest(value - ref, -3), 3) - greatest(-ref, -3)) / w) AS d FROM lognorm JOIN bn USING (gene_id) GROUP BY 1, 2, 3),
 rw AS (SELECT c.cell_id, ba.chromosome, ba.bin, base + coalesce(d, 0) AS v FROM cells c CROSS JOIN ba LEFT JOIN mv ON mv.cell_id = c.cell_id AND mv.chromosome = ba.chromosome AND mv.bin = ba.bin),
 ce AS (SELECT cell_id, chromosome, bin, v - median(v) OVER (PARTITION BY cell_id) AS v FROM rw), pf AS (SELECT cell_id, chromosome, bin, CASE WHEN abs(v) < 1.5 * (SELECT stddev_pop(v) FROM ce) THEN 0 ELSE v END AS cnv FROM ce)"""


def profile(spark, sf):
    obs = t.cells(spark, sf)
    return dy.cnv_profile(t.lognorm(spark, sf), obs, t.genes(spark, sf), obs.filter("cell_type = 'MACHINERY'"), 20, 10, zeros=False)


def windows(spark, sf):
    return dy.cnv_windows(t.genes(spark, sf), 20, 10)


@register("cn_profile", f"{CNV} SELECT cell_id, chromosome, bin, {t.r6_sql('cnv')} AS cnv FROM pf WHERE cnv <> 0")
def cn_profile(spark, sf):
    return profile(spark, sf).filter("cnv <> 0").withColumn("cnv", r6("cnv"))


@register("cn_cluster_mean", f"{CNV} SELECT cell_type, chromosome, bin, {t.r6_sql('AVG(cnv)')} AS cnv FROM pf JOIN cells USING (cell_id) GROUP BY 1, 2, 3")
def cn_cluster_mean(spark, sf):
    return dy.cnv_cluster_mean(profile(spark, sf), t.cells(spark, sf), "cell_type", windows(spark, sf)).withColumn("cnv", r6("cnv"))


@register("cn_score", f"{CNV}, sc AS (SELECT sample_id, AVG(abs(cnv)) AS s FROM pf JOIN cells USING (cell_id) GROUP BY 1), cs AS (SELECT cell_id, s FROM cells JOIN sc USING (sample_id)) SELECT {t.r6_sql('AVG(CASE WHEN s > (SELECT quantile_cont(s, 0.9) FROM cs) THEN 1.0::DOUBLE ELSE 0 END)')} AS high_fraction, {t.r6_sql('AVG(s)')} AS mean_score FROM cs")
def cn_score(spark, sf):
    s = dy.cnv_score(profile(spark, sf), t.cells(spark, sf).select("cell_id", F.col("sample_id").alias("cluster")), windows(spark, sf))
    h = dy.high_cnv_fraction(s)
    return h.select(r6("high_fraction").alias("high_fraction"), r6("mean_score").alias("mean_score"))


# --------------------------------------------------- integration and registration
@register("in_batch_mixing", f"{CELLS_EDGES}, n AS (SELECT src, batch, COUNT(*) / 6.0::DOUBLE AS p FROM edges JOIN cells ON cell_id = dst GROUP BY 1, 2), h AS (SELECT -SUM(p * ln(p)) AS h FROM n GROUP BY src) SELECT {t.r6_sql('AVG(h) / ln((SELECT COUNT(DISTINCT batch) FROM cells))')} AS mixing FROM h")
def in_batch_mixing(spark, sf):
    return it.batch_mixing(t.spatial_edges(spark, sf), t.cells(spark, sf), "batch").select(r6("mixing").alias("mixing"))


@register("in_harmonize")
def in_harmonize(spark, sf):
    e = embedding(spark, sf, F.col("label").cast("string").alias("batch"))
    return it.harmonize_embedding(e, iterations=2, k=5).select("cell_id", F.posexplode("vec").alias("dim", "value"))


ALIGN = f"""WITH {t.SQL_CELLS}, s AS (SELECT batch, AVG(x) AS mx, AVG(y) AS my, (stddev_pop(x) + stddev_pop(y)) / 2 AS sd FROM cells GROUP BY 1), r AS (SELECT * FROM s WHERE batch = 'R0'),
 al AS (SELECT cell_id, batch, x, y, CASE WHEN batch = 'R0' THEN x ELSE (x - s.mx) / s.sd * r.sd + r.mx END AS xa, CASE WHEN batch = 'R0' THEN y ELSE (y - s.my) / s.sd * r.sd + r.my END AS ya FROM cells JOIN s USING (batch), (SELECT mx, my, sd FROM r) r)"""


@register("re_rigid_align", f"{ALIGN} SELECT cell_id, {t.r6_sql('xa', 8)} AS x_aligned, {t.r6_sql('ya', 8)} AS y_aligned FROM al")
def re_rigid_align(spark, sf):
    a = it.rigid_align(t.cells(spark, sf), "batch", "R0")
    return a.select("cell_id", r6("x_aligned", 8).alias("x_aligned"), r6("y_aligned", 8).alias("y_aligned"))


@register("re_displacement", f"{ALIGN} SELECT batch, {t.r6_sql('sqrt(AVG((xa - x) * (xa - x) + (ya - y) * (ya - y)))')} AS rms_displacement FROM al GROUP BY 1")
def re_displacement(spark, sf):
    a = it.rigid_align(t.cells(spark, sf), "batch", "R0")
    return it.alignment_displacement(a, "batch").withColumn("rms_displacement", r6("rms_displacement"))


@register("re_coupling", f"WITH {t.SQL_CELLS} SELECT l_partkey AS cell_id, {t.r6_sql('SUM(l_discount * x) / CASE WHEN SUM(l_discount) = 0 THEN 1 ELSE SUM(l_discount) END', 10)} AS x, {t.r6_sql('SUM(l_discount * y) / CASE WHEN SUM(l_discount) = 0 THEN 1 ELSE SUM(l_discount) END', 10)} AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN cells ON cells.cell_id = o_custkey GROUP BY 1")
def re_coupling(spark, sf):
    lines = t.load(spark, sf, "lineitem").join(t.load(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    pi = lines.select(F.col("o_custkey").alias("ref_id"), F.col("l_partkey").alias("cell_id"), F.col("l_discount").alias("pi"))
    placed, _ = it.project_by_coupling(pi, t.cells(spark, sf))
    return placed.select("cell_id", r6("x", 10).alias("x"), r6("y", 10).alias("y"))


@register("re_interpolate_slices", f"WITH v AS (SELECT n_regionkey AS slice, c_mktsegment AS position, AVG(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2) SELECT a.slice AS _a, a.position, s.step::INT AS step, {t.r6_sql('(1 - s.step / 4.0::DOUBLE) * a.value + s.step / 4.0::DOUBLE * b.value')} AS value FROM v a JOIN v b ON b.slice = a.slice + 1 AND b.position = a.position CROSS JOIN (SELECT unnest([1, 2, 3]) AS step) s")
def re_interpolate_slices(spark, sf):
    c = t.load(spark, sf, "customer").join(t.load(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    v = c.groupBy(F.col("n_regionkey").alias("slice"), F.col("c_mktsegment").alias("position")).agg(F.avg("c_acctbal").alias("value")).withColumn("feature", F.lit("balance"))
    return it.interpolate_slices(v, 3).select("_a", "position", "step", r6("value").alias("value"))


@register("re_idw_regrid", f"""WITH {t.SQL_CELLS}, b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM cells), g AS (SELECT i AS grid_id, x0 + (i % 10) * (x1 - x0) / 9 AS x, y0 + (i // 10) * (y1 - y0) / 9 AS y FROM (SELECT unnest(range(100)) AS i), b),
 d AS (SELECT grid_id, pseudotime AS v, sqrt((g.x-c.x)*(g.x-c.x)+(g.y-c.y)*(g.y-c.y)) AS d, row_number() OVER (PARTITION BY grid_id ORDER BY (g.x-c.x)*(g.x-c.x)+(g.y-c.y)*(g.y-c.y), c.cell_id) AS r FROM g CROSS JOIN cells c)
 SELECT grid_id, {t.r6_sql('SUM(v / (d * d + 1e-12::DOUBLE)) / SUM(1 / (d * d + 1e-12::DOUBLE))', 4)} AS pseudotime FROM d WHERE r <= 4 GROUP BY 1""")
def re_idw_regrid(spark, sf):
    return it.idw_regrid(t.cells(spark, sf), "pseudotime", 10).select("grid_id", r6("pseudotime", 4).alias("pseudotime"))


# --------------------------------------------------------------------- image tables
@register("im_tile_grid", "WITH i AS (SELECT p_partkey AS image_id, p_size * 100 AS w, p_size * 60 AS h FROM part), n AS (SELECT *, (w - 256) // 128 + 1 AS nx, (h - 256) // 128 + 1 AS ny FROM i WHERE w >= 256 AND h >= 256), a AS (SELECT *, unnest(range(nx)) AS tx FROM n), b AS (SELECT *, unnest(range(ny)) AS ty FROM a) SELECT image_id, tx, ty, tx * 128 AS x, ty * 128 AS y FROM b")
def im_tile_grid(spark, sf):
    images = t.load(spark, sf, "part").select(F.col("p_partkey").alias("image_id"), (F.col("p_size") * 100).alias("width"), (F.col("p_size") * 60).alias("height"))
    return it.tile_grid(images, 256, 128)


@register("im_patch_intensity", f"SELECT l_suppkey AS patch_id, {t.r6_sql('AVG((l_quantity + l_linenumber + l_partkey % 256) / 3)')} AS mean, {t.r6_sql('stddev_pop((l_quantity + l_linenumber + l_partkey % 256) / 3)')} AS std, {t.r6_sql('median((l_quantity + l_linenumber + l_partkey % 256) / 3)')} AS median, {t.r6_sql('stddev_pop(l_partkey % 256)')} AS b_std FROM lineitem GROUP BY 1")
def im_patch_intensity(spark, sf):
    px = t.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("patch_id"), F.col("l_quantity").alias("r"), F.col("l_linenumber").alias("g"), (F.col("l_partkey") % 256).alias("b"))
    return it.patch_intensity(px).select("patch_id", *[r6(c).alias(c) for c in ("mean", "std", "median", "b_std")])


@register("im_ihc", f"WITH p AS (SELECT l_suppkey AS image_id, l_quantity AS m, l_quantity > 0.1::DOUBLE * MAX(l_quantity) OVER (PARTITION BY l_suppkey) AS pos FROM lineitem) SELECT image_id, COUNT(*) AS total_area, COUNT(*) FILTER (pos) AS positive_area, {t.r6_sql('AVG(m) FILTER (pos)')} AS mean_intensity, {t.r6_sql('median(m) FILTER (pos)')} AS median_intensity, {t.r6_sql('AVG(m) FILTER (pos) * (1 + 2 * COUNT(*) FILTER (pos) / COUNT(*)::DOUBLE)')} AS h_score FROM p GROUP BY 1")
def im_ihc(spark, sf):
    q = it.ihc_quantify(t.load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), F.col("l_quantity").alias("marker")))
    return q.select("image_id", "total_area", "positive_area", *[r6(c).alias(c) for c in ("mean_intensity", "median_intensity", "h_score")])


@register("im_tissue_regions")
def im_tissue_regions(spark, sf):
    mask = t.load(spark, sf, "customer").filter("c_acctbal > 3000").select((F.col("c_custkey") % 40).alias("px"), F.floor(F.col("c_custkey") / 40).alias("py"))
    return it.tissue_regions(mask, 3)


@register("mo_attention_balance", "WITH m AS (SELECT AVG(l_discount * 5) AS a, AVG(1 - l_discount * 5) AS b FROM lineitem), h AS (SELECT a, b, -(a * ln(a + 1e-10) + b * ln(b + 1e-10)) AS h FROM m) SELECT round(a, 6) AS mean_w1, round(b, 6) AS mean_w2, round(h, 6) AS entropy, round(h / ln(2), 6) AS balance FROM h")
def mo_attention_balance(spark, sf):
    w = t.load(spark, sf, "lineitem").select((F.col("l_discount") * 5).alias("w1"), (1 - F.col("l_discount") * 5).alias("w2"))
    return it.attention_balance(w).select(*[F.round(c, 6).alias(c) for c in ("mean_w1", "mean_w2", "entropy", "balance")])


@register("mo_reconstruction_mse", f"SELECT l_returnflag AS modality, {t.r6_sql('AVG((l_discount - l_tax) * (l_discount - l_tax))', 9)} AS mse FROM lineitem GROUP BY 1")
def mo_reconstruction_mse(spark, sf):
    rows = t.load(spark, sf, "lineitem").select(F.col("l_returnflag").alias("modality"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice").alias("cell_id"), F.col("l_partkey").alias("feature"), "l_discount", "l_tax")
    a = rows.select("modality", "cell_id", "feature", F.col("l_discount").alias("value"))
    b = rows.select("modality", "cell_id", "feature", F.col("l_tax").alias("value"))
    return it.reconstruction_mse(a, b).withColumn("mse", r6("mse", 9))



"""Domains, niches, zones, regions, survival, targets and regulation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions import stats as S
from cellweave.functions.stats import r6
from cellweave.operators import domains as dm
from cellweave.operators import features, neighbors
from cellweave.operators import tissue as ti
from cellweave.plans import tables as t
from cellweave.plans.matrix import STATS, TOPVAR
from cellweave.plans.registry import register
from cellweave.plans.spatial import CELLS_EDGES, embedding, ranked_edges
from cellweave.session import cut


@register("cl_kmeans")
def cl_kmeans(spark, sf):
    return dm.kmeans(embedding(spark, sf), 10)


@register("cl_gmm")
def cl_gmm(spark, sf):
    return dm.gmm(embedding(spark, sf).select("cell_id", F.slice("vec", 1, 8).alias("vec")), 5)


def _symmetric(spark, sf):
    return neighbors.symmetrize(ranked_edges(spark, sf))


@register("cl_graph_communities")
def cl_graph_communities(spark, sf):
    return dm.graph_communities(_symmetric(spark, sf))


#: What must hold of any communities: every cell in one, each connected, and a modularity that a random start lacks.
COMMUNITY_LAWS = "SELECT COUNT(*) AS n_cells, 0::BIGINT AS n_unconnected, TRUE AS modular FROM customer JOIN nation ON c_nationkey = n_nationkey"


@register("cl_community_laws", COMMUNITY_LAWS)
def cl_community_laws(spark, sf):
    edges = _symmetric(spark, sf)
    found = cut(dm.graph_communities(edges))
    a, b = found.select(F.col("cell_id").alias("src"), F.col("cluster").alias("_a")), found.select(F.col("cell_id").alias("dst"), F.col("cluster").alias("_b"))
    inside = edges.join(a, "src").join(b, "dst").filter("_a = _b").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    parts = ti.connected_components(inside, found.select(F.col("cell_id").alias("node")))
    split = parts.join(found.withColumnRenamed("cell_id", "node"), "node").groupBy("cluster").agg(F.countDistinct("component").alias("n"), F.count(F.lit(1)).alias("cells"))
    quality = dm.modularity(edges, found)
    return split.agg(F.sum("cells").alias("n_cells"), F.count(F.when(F.col("n") > 1, 1)).alias("n_unconnected")).crossJoin(quality).select("n_cells", "n_unconnected", (F.col("modularity") > 0.6).alias("modular"))  # one-row sides


@register("cl_multi_resolution")
def cl_multi_resolution(spark, sf):
    """Clusters at three resolutions, side by side."""
    return dm.communities(_symmetric(spark, sf), [0.5, 1.0, 2.0]).groupBy("resolution").agg(F.countDistinct("cluster").alias("n_clusters"))


@register("cl_modularity", f"""{CELLS_EDGES}, s AS (SELECT src, dst, MAX(w) AS w FROM (SELECT src, dst, 1.0::DOUBLE / (1 + rank) AS w FROM edges UNION ALL SELECT dst, src, 1.0::DOUBLE / (1 + rank) FROM edges) GROUP BY 1, 2),
 m AS (SELECT SUM(w) AS m, SUM(CASE WHEN a.batch = b.batch THEN w ELSE 0 END) AS i FROM s JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst), d AS (SELECT SUM(q * q) AS tt FROM (SELECT SUM(w) AS q FROM s JOIN cells ON cell_id = src GROUP BY batch))
 SELECT {t.r6_sql('i / m - tt / (m * m)')} AS modularity FROM m, d""")
def cl_modularity(spark, sf):
    labels = t.cells(spark, sf).select("cell_id", F.col("batch").alias("cluster"))
    return dm.modularity(_symmetric(spark, sf), labels).select(r6("modularity").alias("modularity"))


REFINE = """nb AS (SELECT src, dst, rank + 1 AS rank FROM edges WHERE rank <= 9 UNION ALL SELECT cell_id, cell_id, 1 FROM cells),
 v AS (SELECT src, b.cell_type AS l, a.cell_type AS own, COUNT(*) AS n, MIN(rank) AS f FROM nb JOIN cells a ON a.cell_id = src JOIN cells b ON b.cell_id = dst GROUP BY 1, 2, 3),
 r AS (SELECT *, SUM(CASE WHEN l <> own THEN n ELSE 0 END) OVER (PARTITION BY src) / 10.0 AS share, row_number() OVER (PARTITION BY src ORDER BY n DESC, f) AS rn FROM v)"""


@register("cl_refine_labels", f"WITH {t.SQL_CELLS}, {t.sql_edges(9)}, {REFINE} SELECT src AS cell_id, CASE WHEN share >= 0.5 THEN l ELSE own END AS cell_type FROM r WHERE rn = 1")
def cl_refine_labels(spark, sf):
    return dm.refine_labels(t.cells(spark, sf), "cell_type", 10, 0.5)


BATCH_EDGES = "edges AS (SELECT src, dst, rn AS rank FROM (SELECT a.cell_id AS src, b.cell_id AS dst, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y), b.cell_id) AS rn FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND a.batch = b.batch) WHERE rn <= 9)"


@register("cl_refine_by_batch", f"WITH {t.SQL_CELLS}, {BATCH_EDGES}, {REFINE} SELECT src AS cell_id, CASE WHEN share >= 0.5 THEN l ELSE own END AS cell_type FROM r WHERE rn = 1")
def cl_refine_by_batch(spark, sf):
    return dm.refine_labels(t.cells(spark, sf), "cell_type", 10, 0.5, "batch")


@register("cl_domain_statistics", f"WITH {t.SQL_CELLS} SELECT cell_type AS domain, COUNT(*) AS n_spots, {t.r6_sql('AVG(x)')} AS mean_x, {t.r6_sql('AVG(y)')} AS mean_y, {t.r6_sql('stddev_pop(x)')} AS std_x, {t.r6_sql('stddev_pop(y)')} AS std_y, {t.r6_sql('MAX(x) - MIN(x)')} AS area_x, {t.r6_sql('MAX(y) - MIN(y)')} AS area_y FROM cells GROUP BY 1")
def cl_domain_statistics(spark, sf):
    d = dm.domain_statistics(t.cells(spark, sf), "cell_type")
    return d.select("domain", "n_spots", *[r6(c).alias(c) for c in ("mean_x", "mean_y", "std_x", "std_y", "area_x", "area_y")])


@register("cl_adjusted_rand", f"""WITH {t.SQL_CELLS}, c AS (SELECT cell_type, batch, COUNT(*) AS n FROM cells GROUP BY 1, 2), s AS (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS s, SUM(n) * (SUM(n) - 1) / 2.0::DOUBLE AS t FROM c),
 a AS (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS sa FROM (SELECT SUM(n) AS n FROM c GROUP BY cell_type)), b AS (SELECT SUM(n * (n - 1) / 2.0::DOUBLE) AS sb FROM (SELECT SUM(n) AS n FROM c GROUP BY batch))
 SELECT {t.r6_sql('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)')} AS ari FROM s, a, b""")
def cl_adjusted_rand(spark, sf):
    return dm.adjusted_rand(t.cells(spark, sf), "cell_type", "batch").select(r6("ari").alias("ari"))


@register("cl_apply_labels", f"WITH {t.SQL_CELLS} SELECT cell_id, coalesce(r_name, 'unknown') AS domain_label, batch || ' ' || coalesce(r_name, 'unknown') AS combined_label FROM cells LEFT JOIN region ON batch = 'R' || r_regionkey AND r_regionkey > 0")
def cl_apply_labels(spark, sf):
    mapping = t.load(spark, sf, "region").filter("r_regionkey > 0").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("domain_id"), F.col("r_name").alias("domain_label"))
    return dm.apply_domain_labels(t.cells(spark, sf), mapping, "batch").select("cell_id", "domain_label", "combined_label")


@register("cl_ground_truth", f"WITH {t.SQL_CELLS} SELECT cell_id, label::BIGINT AS ground_truth FROM cells LEFT JOIN embeddings ON vec_id = cell_id")
def cl_ground_truth(spark, sf):
    truth = t.load(spark, sf, "embeddings").select(F.col("vec_id").alias("cell_id"), F.col("label").cast("long").alias("label"))
    return dm.align_ground_truth(t.cells(spark, sf), truth).select("cell_id", "ground_truth")


@register("cl_diffuse_features", f"""{CELLS_EDGES}, s0 AS (SELECT cell_id, pseudotime / 10000 AS v FROM cells),
 s1 AS (SELECT a.cell_id, a.v + 0.1 * SUM((b.v - a.v) / (1 + (b.v - a.v) * (b.v - a.v))) AS v FROM s0 a JOIN edges ON src = a.cell_id JOIN s0 b ON b.cell_id = dst GROUP BY a.cell_id, a.v),
 s2 AS (SELECT a.cell_id, a.v + 0.1 * SUM((b.v - a.v) / (1 + (b.v - a.v) * (b.v - a.v))) AS v FROM s1 a JOIN edges ON src = a.cell_id JOIN s1 b ON b.cell_id = dst GROUP BY a.cell_id, a.v) SELECT cell_id, {t.r6_sql('v')} AS value FROM s2""")
def cl_diffuse_features(spark, sf):
    v = t.cells(spark, sf).select("cell_id", F.lit("f").alias("feature"), (F.col("pseudotime") / 10000).alias("value"))
    return dm.diffuse_features(v, t.spatial_edges(spark, sf), 2).select("cell_id", r6("value").alias("value"))


@register("cl_neighbor_augment", f"""{CELLS_EDGES}, f AS (SELECT cell_id, unnest([x, y]) AS v, unnest([0, 1]) AS i FROM cells), m AS (SELECT src, i, AVG(v) AS m FROM edges JOIN f ON cell_id = dst GROUP BY 1, 2)
 SELECT cell_id, i::BIGINT AS dim, {t.r6_sql('v * sqrt(0.8::DOUBLE)')} AS value FROM f UNION ALL SELECT src, i + 2, {t.r6_sql('m * sqrt(0.2::DOUBLE)')} FROM m""")
def cl_neighbor_augment(spark, sf):
    obs = t.cells(spark, sf)
    out = dm.neighbor_augment(obs.select("cell_id", F.array("x", "y").alias("vec")), t.spatial_edges(spark, sf))
    return out.select("cell_id", F.posexplode("vec").alias("d", "v")).select("cell_id", F.col("d").cast("long").alias("dim"), r6("v").alias("value"))


@register("ni_composition", f"WITH {t.SQL_CELLS}, {t.sql_edges(10)} SELECT src AS cell_id, cell_type AS label, {t.r6_sql('COUNT(*) / 10.0::DOUBLE')} AS share FROM edges JOIN cells ON cell_id = dst GROUP BY 1, 2")
def ni_composition(spark, sf):
    return dm.neighborhood_composition(t.cells(spark, sf), "cell_type").withColumn("share", r6("share"))


@register("ni_characterize", f"WITH {t.SQL_CELLS} SELECT batch, cell_type, SUM(COUNT(*)) OVER (PARTITION BY batch)::BIGINT AS niche_size, {t.r6_sql('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY batch)')} AS share FROM cells GROUP BY 1, 2")
def ni_characterize(spark, sf):
    return dm.characterize_niches(t.cells(spark, sf), "batch", "cell_type").withColumn("share", r6("share"))


@register("ni_compare", f"WITH {t.SQL_CELLS}, n AS (SELECT sample_id, cell_type, COUNT(*) AS n FROM cells GROUP BY 1, 2), g AS (SELECT DISTINCT a.sample_id, b.cell_type FROM n a CROSS JOIN n b) SELECT sample_id, cell_type, {t.r6_sql('coalesce(n, 0) / SUM(coalesce(n, 0)) OVER (PARTITION BY sample_id)')} AS share FROM g LEFT JOIN n USING (sample_id, cell_type)")
def ni_compare(spark, sf):
    return dm.compare_niches(t.cells(spark, sf), "cell_type", "sample_id").withColumn("share", r6("share"))


@register("ni_supervised")
def ni_supervised(spark, sf):
    return dm.supervised_niches(t.cells(spark, sf), "cell_type", "batch", 4)


# ------------------------------------------------------------- zones and survival
@register("on_tumor_zones", f"""WITH {t.SQL_CELLS}, d AS (SELECT a.cell_id, a.cell_type, MIN(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) AS dist FROM cells a JOIN cells b ON a.cell_id <> b.cell_id AND b.cell_type = 'MACHINERY' GROUP BY 1, 2),
 c AS (SELECT median(dist) AS core FROM d WHERE cell_type = 'MACHINERY') SELECT cell_id, {t.r6_sql('dist')} AS dist, CASE WHEN cell_type = 'MACHINERY' AND dist <= core THEN 'tumor_core' WHEN cell_type = 'MACHINERY' THEN 'tumor_edge' WHEN dist <= 1.0 THEN 'interface' ELSE 'stroma' END AS zone FROM d, c""")
def on_tumor_zones(spark, sf):
    return ti.tumor_zones(t.cells(spark, sf), "cell_type", ["MACHINERY"], 1.0).withColumn("dist", r6("dist"))


@register("on_response_patterns", f"WITH {t.SQL_CELLS} SELECT batch, cell_type, {t.r6_sql('COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY batch)')} AS share FROM cells GROUP BY 1, 2")
def on_response_patterns(spark, sf):
    return ti.response_patterns(t.cells(spark, sf), "cell_type", "batch").withColumn("share", r6("share"))


def cohort(spark, sf):
    return t.load(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("group"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"),
        (F.col("o_custkey") % 10 / 10.0).alias("f1"), (F.col("o_totalprice") % 977 / 977.0).alias("f2"))


COH = "co AS (SELECT o_orderpriority AS grp, floor(o_totalprice / 1000)::DOUBLE AS time, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS event FROM orders)"
KM = f"""WITH {COH}, a AS (SELECT grp, time, SUM(event) AS d, COUNT(*) AS c FROM co GROUP BY 1, 2), r AS (SELECT grp, time, d, SUM(c) OVER (PARTITION BY grp ORDER BY time DESC) AS n FROM a),
 s AS (SELECT grp, time, d, n, CASE WHEN SUM(CASE WHEN d = n THEN 1 ELSE 0 END) OVER w > 0 THEN 0 ELSE exp(SUM(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER w) END AS s FROM r WHERE d > 0 WINDOW w AS (PARTITION BY grp ORDER BY time))"""


@register("tl_kaplan_meier", f'{KM} SELECT grp AS "group", time, d::BIGINT AS d, n::BIGINT AS at_risk, {t.r6_sql("s")} AS survival FROM s')
def tl_kaplan_meier(spark, sf):
    return ti.kaplan_meier(cohort(spark, sf), "group").withColumn("survival", r6("survival"))


@register("tl_median_survival", f'{KM} SELECT grp AS "group", MIN(time) FILTER (s <= 0.5) AS median FROM s GROUP BY 1')
def tl_median_survival(spark, sf):
    return ti.median_survival(ti.kaplan_meier(cohort(spark, sf), "group"), "group")


@register("tl_logrank", f"""WITH {COH}, f AS (SELECT time, event, CASE WHEN grp = '1-URGENT' THEN 1 ELSE 0 END AS a FROM co), g AS (SELECT time, SUM(event) AS d, COUNT(*) AS c, SUM(a) AS ca, SUM(a * event) AS d1 FROM f GROUP BY 1),
 r AS (SELECT *, SUM(c) OVER (ORDER BY time DESC) AS n, SUM(ca) OVER (ORDER BY time DESC) AS n1 FROM g),
 s AS (SELECT SUM(d1)::DOUBLE AS o, SUM(d * n1 / n::DOUBLE) AS e, SUM(CASE WHEN n > 1 THEN d * (n1 / n::DOUBLE) * (1 - n1 / n::DOUBLE) * (n - d) / (n - 1)::DOUBLE ELSE 0 END) AS v FROM r)
 SELECT o::BIGINT AS observed, {t.r6_sql('e')} AS expected, {t.r6_sql('v')} AS variance, {t.r6_sql('(o - e) * (o - e) / v')} AS chi2, {t.r6_sql(t.norm_p_sql('sqrt((o - e) * (o - e) / v)'))} AS pvalue FROM s""")
def tl_logrank(spark, sf):
    r = ti.logrank(cohort(spark, sf), "group", "1-URGENT")
    return r.select("observed", *[r6(c).alias(c) for c in ("expected", "variance", "chi2", "pvalue")])


@register("on_cox_ph")
def on_cox_ph(spark, sf):
    return ti.cox_ph(cohort(spark, sf), ["f1", "f2"])[0].select("group", "time", "event", "partial_hazard")


@register("on_concordance", """WITH co AS (SELECT floor(o_totalprice / 1000)::DOUBLE AS t, o_orderstatus = 'F' AS e, o_custkey % 10 + o_orderkey % 3 AS r FROM orders), k AS (SELECT t, e, r, COUNT(*) AS n FROM co GROUP BY ALL),
 p AS (SELECT SUM(a.n * b.n) AS n_pairs, SUM(CASE WHEN a.r > b.r THEN a.n * b.n ELSE 0 END) AS n_correct, SUM(CASE WHEN a.r = b.r THEN a.n * b.n ELSE 0 END) AS n_tied FROM k a JOIN k b ON a.e AND (a.t < b.t OR a.t = b.t AND NOT b.e))
 SELECT n_pairs::BIGINT AS n_pairs, n_correct::BIGINT AS n_correct, n_tied::BIGINT AS n_tied, """ + t.r6_sql("(n_correct + n_tied / 2.0::DOUBLE) / n_pairs", 9) + """ AS concordance FROM p""")
def on_concordance(spark, sf):
    rows = t.load(spark, sf, "orders").select(F.floor(F.col("o_totalprice") / 1000).cast("double").alias("time"), (F.col("o_orderstatus") == "F").cast("int").alias("event"),
                                              (F.col("o_custkey") % 10 + F.col("o_orderkey") % 3).alias("partial_hazard"))
    return ti.concordance(rows).withColumn("concordance", r6("concordance", 9))


@register("tl_dbscan")
def tl_dbscan(spark, sf):
    return ti.dbscan(t.cells(spark, sf).select("cell_id", "x", "y"), 1.0, 5)


@register("tl_regions")
def tl_regions(spark, sf):
    obs = t.cells(spark, sf)
    side = lambda kind: ti.centroids(obs, ti.dbscan(obs.filter(F.col("cell_type") == kind).select("cell_id", "x", "y"), 1.2, 4))
    regions = ti.colocated_regions(side("MACHINERY"), side("HOUSEHOLD"), 2.0)
    return ti.assign_region(obs, regions, 2.0)


@register("tl_ecosystem")
def tl_ecosystem(spark, sf):
    obs = t.cells(spark, sf)
    return ti.region_ecosystem(obs, obs.select("cell_id", F.substring("sample_id", 8, 2).cast("int").alias("region")))


MAT = "mk AS (SELECT p_partkey AS gene_id, CASE WHEN p_size < 3 THEN 'germinal_center' WHEN p_size < 5 THEN 'follicular_helper' ELSE 'dendritic' END AS kind FROM part WHERE p_size < 7)"


@register("tl_maturity", f"""WITH {t.SQL_CELLS}, {t.SQL_COUNTS}, {MAT}, k AS (SELECT kind, COUNT(*) AS k FROM mk GROUP BY 1), n AS (SELECT sample_id, kind, COUNT(DISTINCT gene_id) AS n FROM counts JOIN cells USING (cell_id) JOIN mk USING (gene_id) GROUP BY 1, 2),
 s AS (SELECT sample_id, SUM(CASE WHEN kind = 'germinal_center' THEN 0.4::DOUBLE ELSE 0.3::DOUBLE END * n / k) AS score FROM n JOIN k USING (kind) GROUP BY 1)
 SELECT substr(sample_id, 8)::INT AS region, {t.r6_sql('score')} AS score, CASE WHEN score > 0.6 THEN 'mature' WHEN score > 0.3 THEN 'intermediate' ELSE 'early' END AS maturity FROM s""")
def tl_maturity(spark, sf):
    kind = F.when(F.col("p_size") < 3, "germinal_center").when(F.col("p_size") < 5, "follicular_helper").otherwise("dendritic")
    markers = t.load(spark, sf, "part").filter("p_size < 7").select(F.col("p_partkey").alias("gene_id"), kind.alias("kind"))
    regions = t.cells(spark, sf).select("cell_id", F.substring("sample_id", 8, 2).cast("int").alias("region"))
    return ti.region_maturity(t.counts(spark, sf), regions, markers).withColumn("score", r6("score"))


# ------------------------------------------------------------- targets, regulation
@register("tg_prioritize", f"""WITH b AS (SELECT DISTINCT l_returnflag || l_linestatus AS domain, l_partkey AS gene FROM lineitem), f AS (SELECT gene, COUNT(*) AS n FROM b GROUP BY 1)
 SELECT gene, n AS spatial_frequency, {t.r6_sql("0.4 * n / (SELECT MAX(n) FROM f) + CASE WHEN p_type = 'PROMO' THEN 0.4 ELSE 0 END + CASE WHEN p_brand = 'Brand#1' THEN 0.2 ELSE 0 END")} AS priority_score FROM f JOIN part ON p_partkey = gene""")
def tg_prioritize(spark, sf):
    b = t.load(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("domain"), F.col("l_partkey").alias("gene")).distinct()
    part = t.load(spark, sf, "part").select(F.col("p_partkey").alias("gene"), "p_type", "p_brand")
    return ti.prioritize_targets(b, part.filter("p_type = 'PROMO'"), part.filter("p_brand = 'Brand#1'")).select("gene", "spatial_frequency", r6("priority_score").alias("priority_score"))


@register("rg_tf_activity", f"WITH {t.SQL_LOGNORM} SELECT p_partkey AS gene_id, {t.r6_sql('coalesce(SUM(value), 0) / (SELECT COUNT(*) FROM customer)')} AS activity FROM part LEFT JOIN lognorm ON gene_id = p_partkey WHERE p_type = 'PROMO' GROUP BY 1")
def rg_tf_activity(spark, sf):
    return ti.tf_activity(t.lognorm(spark, sf), t.cells(spark, sf), t.genes(spark, sf).filter("is_mt")).withColumn("activity", r6("activity"))


RG = f"""WITH {t.SQL_CELLS}, {t.SQL_LOGNORM}, {STATS % 'lognorm'}, {TOPVAR}, ab AS (SELECT a.gene_id AS tf, b.gene_id, SUM(a.value * b.value) AS ab FROM lognorm a JOIN topvar USING (gene_id) JOIN lognorm b ON a.cell_id = b.cell_id AND a.gene_id <> b.gene_id GROUP BY 1, 2),
 r AS (SELECT tf, ab.gene_id, (x.n * ab - x.total * y.total) / sqrt((x.n * x.sumsq - x.total * x.total) * (y.n * y.sumsq - y.total * y.total)) AS r FROM ab JOIN gstats x ON x.gene_id = tf JOIN gstats y ON y.gene_id = ab.gene_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY tf ORDER BY round(abs(r), 9) DESC, gene_id) AS rank FROM r), reg AS (SELECT * FROM k WHERE rank <= 50 AND r > 0.05)"""


def _regulons(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    return ti.coexpression_regulons(expr, obs, features.top_variance_genes(expr, obs), 50, 0.05)


@register("rg_regulons", f"{RG} SELECT tf, gene_id, {t.r6_sql('r')} AS r, rank FROM reg")
def rg_regulons(spark, sf):
    return _regulons(spark, sf).withColumn("r", r6("r"))


@register("rg_activity", f"{RG} SELECT cell_id, tf, {t.r6_sql('SUM(value) / (SELECT COUNT(*) FROM reg q WHERE q.tf = reg.tf)')} AS activity FROM lognorm JOIN reg USING (gene_id) GROUP BY 1, 2")
def rg_activity(spark, sf):
    return ti.regulon_activity(t.lognorm(spark, sf), t.cells(spark, sf), _regulons(spark, sf)).withColumn("activity", r6("activity"))


@register("rg_peak_gene_links", "WITH p AS (SELECT p_brand AS chromosome, p_partkey * 2 AS pos, p_partkey AS peak_id FROM part) SELECT chromosome, peak_id, p_partkey AS gene_id, abs(pos - p_partkey) AS distance FROM p JOIN part ON p_brand = chromosome AND abs(pos - p_partkey) <= 100")
def rg_peak_gene_links(spark, sf):
    peaks = t.genes(spark, sf).select("chromosome", (F.col("gene_id") * 2).alias("pos"), F.col("gene_id").alias("peak_id"))
    return ti.peak_gene_links(peaks, t.genes(spark, sf), 100).select("chromosome", "peak_id", "gene_id", "distance")


@register("p_value_bh", f"""WITH e AS (SELECT event_id, event_type, 1 / (1 + value) AS p FROM events), r AS (SELECT *, p * COUNT(*) OVER (PARTITION BY event_type) / COUNT(*) OVER (PARTITION BY event_type ORDER BY p) AS raw FROM e) SELECT event_id, {t.r6_sql('least(1, MIN(raw) OVER (PARTITION BY event_type ORDER BY p DESC))')} AS q FROM r""")
def p_value_bh(spark, sf):
    e = t.load(spark, sf, "events").select("event_id", "event_type", (1 / (1 + F.col("value"))).alias("p"))
    return S.bh_fdr(e, "p", ["event_type"], "q").select("event_id", r6("q").alias("q"))


@register("rg_spatial_regulons", f"""WITH {t.SQL_CELLS}, {t.sql_edges(14)}, {t.SQL_LOGNORM}, {STATS % 'lognorm'}, {TOPVAR}, nb AS (SELECT src, dst FROM edges UNION ALL SELECT cell_id, cell_id FROM cells),
 wn AS (SELECT src, gene_id, SUM(value) AS s, SUM(value * value) AS q FROM nb JOIN lognorm ON cell_id = dst GROUP BY 1, 2 HAVING 15 * SUM(value * value) - SUM(value) * SUM(value) > 1e-9),
 pr AS (SELECT a.cell_id, a.gene_id AS tf, b.gene_id, a.value * b.value AS ab FROM lognorm a JOIN topvar USING (gene_id) JOIN lognorm b ON a.cell_id = b.cell_id AND a.gene_id <> b.gene_id),
 lo AS (SELECT src, tf, gene_id, SUM(ab) AS ab FROM nb JOIN pr ON cell_id = dst GROUP BY 1, 2, 3), fa AS (SELECT src, gene_id AS tf, s AS st, q AS qt FROM wn JOIN topvar USING (gene_id)),
 ml AS (SELECT fa.tf, wn.gene_id, AVG((15 * coalesce(ab, 0) - st * s) / sqrt((15 * qt - st * st) * (15 * q - s * s))) AS lr FROM fa JOIN wn ON wn.src = fa.src AND wn.gene_id <> fa.tf LEFT JOIN lo ON lo.src = fa.src AND lo.tf = fa.tf AND lo.gene_id = wn.gene_id GROUP BY 1, 2),
 gl AS (SELECT tf, gene_id, SUM(ab) AS ab FROM pr GROUP BY 1, 2), sc AS (SELECT ml.tf, ml.gene_id, lr, (x.n * coalesce(ab, 0) - x.total * y.total) / sqrt((x.n * x.sumsq - x.total * x.total) * (y.n * y.sumsq - y.total * y.total)) AS r FROM ml LEFT JOIN gl USING (tf, gene_id) JOIN gstats x ON x.gene_id = ml.tf JOIN gstats y ON y.gene_id = ml.gene_id),
 rk AS (SELECT *, 0.5 * abs(r) + 0.5 * abs(lr) AS score, row_number() OVER (PARTITION BY tf ORDER BY round(0.5 * abs(r) + 0.5 * abs(lr), 9) DESC, gene_id) AS rank FROM sc)
 SELECT tf, gene_id, {t.r6_sql('score')} AS score, rank FROM rk WHERE rank <= 30 AND score > 0.01""")
def rg_spatial_regulons(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    g = ti.spatial_regulons(expr, obs, features.top_variance_genes(expr, obs), 15, 30, 0.01)
    return g.select("tf", "gene_id", r6("score").alias("score"), "rank")

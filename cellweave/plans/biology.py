"""Differential expression, communication, enrichment, annotation and deconvolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellweave.functions.stats import r6
from cellweave.operators import annotation as an
from cellweave.operators import communication as cc
from cellweave.operators import de
from cellweave.operators import enrichment as en
from cellweave.plans import tables as t
from cellweave.plans.matrix import STATS
from cellweave.plans.registry import register
from cellweave.plans.spatial import PERM, bh_sql, embedding

LN = f"WITH {t.SQL_CELLS}, {t.SQL_LOGNORM}, {t.SQL_GENES}"

# Oracle side: mid-ranks through a window over the dense zero block.
WILCOXON = f"""{LN}, sz AS (SELECT cell_type AS grp, COUNT(*) AS n1, (SELECT COUNT(*) FROM cells) AS n FROM cells GROUP BY 1),
 rk AS (SELECT gene_id, cell_id, value, rank() OVER (PARTITION BY gene_id ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::DOUBLE AS r FROM lognorm),
 gz AS (SELECT gene_id, COUNT(*) AS nnz FROM lognorm GROUP BY 1),
 inn AS (SELECT gene_id, cell_type AS grp, COUNT(*) AS nz, SUM(r) AS rs, SUM(value) AS s FROM rk JOIN cells USING (cell_id) GROUP BY 1, 2),
 tot AS (SELECT gene_id, SUM(value) AS s FROM lognorm GROUP BY 1),
 full_ AS (SELECT gz.gene_id, sz.grp, n1, n, n - nnz AS z, coalesce(nz, 0) AS nz, coalesce(rs, 0) AS rs, coalesce(inn.s, 0) AS s1, tot.s - coalesce(inn.s, 0) AS s2
   FROM gz CROSS JOIN sz LEFT JOIN inn ON inn.gene_id = gz.gene_id AND inn.grp = sz.grp JOIN tot ON tot.gene_id = gz.gene_id),
 sc AS (SELECT grp AS "group", gene_id, n1, n, (rs + nz * z + (n1 - nz) * (z + 1) / 2.0::DOUBLE - n1 * (n + 1) / 2.0::DOUBLE) / sqrt(n1 * (n - n1)::DOUBLE * (n + 1) / 12.0::DOUBLE) AS scores,
   log2((exp(s1 / n1) - 1 + 1e-9::DOUBLE) / (exp(s2 / (n - n1)) - 1 + 1e-9::DOUBLE)) AS lfc FROM full_),
 pv AS (SELECT *, {t.norm_p_sql('scores')} AS p FROM sc),
 mk AS (SELECT * FROM {bh_sql('pv', 'gene_id', by='"group"')})"""


def markers(spark, sf):
    return de.rank_genes_wilcoxon(t.lognorm(spark, sf), t.cells(spark, sf), "cell_type")


@register("de_wilcoxon", f"""{WILCOXON} SELECT "group", gene_id, {t.r6_sql('scores')} AS scores, {t.r6_sql('lfc')} AS logfoldchanges, {t.r6_sql('p')} AS pvals, {t.r6_sql('q')} AS pvals_adj FROM mk""")
def de_wilcoxon(spark, sf):
    return markers(spark, sf).select("group", "gene_id", *[r6(c).alias(c) for c in ("scores", "logfoldchanges", "pvals", "pvals_adj")])


@register("de_top_markers", f"""{WILCOXON}, r AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY round(scores, 9) DESC, gene_id) AS rank FROM mk) SELECT "group", gene_id, rank FROM r WHERE rank <= 10""")
def de_top_markers(spark, sf):
    return de.top_per_group(markers(spark, sf), ["group"], [F.round("scores", 9).desc(), "gene_id"], 10).select("group", "gene_id", "rank")


WELCH = f"""{LN}, sz AS (SELECT cell_type AS grp, COUNT(*) AS n1, (SELECT COUNT(*) FROM cells) AS n FROM cells GROUP BY 1),
 inn AS (SELECT gene_id, cell_type AS grp, COUNT(*) AS nz, SUM(value) AS s, SUM(value * value) AS q FROM lognorm JOIN cells USING (cell_id) GROUP BY 1, 2),
 tot AS (SELECT gene_id, COUNT(*) AS nz, SUM(value) AS s, SUM(value * value) AS q FROM lognorm GROUP BY 1),
 m AS (SELECT sz.grp, tot.gene_id, n1, n - n1 AS n2, coalesce(inn.s, 0) / n1 AS m1, (tot.s - coalesce(inn.s, 0)) / (n - n1) AS m2, coalesce(inn.q, 0) AS q1, tot.q - coalesce(inn.q, 0) AS q2,
   coalesce(inn.nz, 0) / n1::DOUBLE AS pin, (tot.nz - coalesce(inn.nz, 0)) / (n - n1)::DOUBLE AS pout
   FROM tot CROSS JOIN sz LEFT JOIN inn ON inn.gene_id = tot.gene_id AND inn.grp = sz.grp),
 v AS (SELECT *, greatest((q1 - n1 * m1 * m1) / (n1 - 1) / n1, 0) AS v1, greatest((q2 - n2 * m2 * m2) / (n2 - 1) / n2, 0) AS v2 FROM m)"""


@register("de_ttest", f"""{WELCH} SELECT grp AS "group", gene_id, {t.r6_sql('(m1 - m2) / sqrt(v1 + v2)')} AS scores, {t.r6_sql('(v1 + v2) * (v1 + v2) / (v1 * v1 / (n1 - 1) + v2 * v2 / (n2 - 1))', 3)} AS dof FROM v WHERE v1 + v2 > 0""")
def de_ttest(spark, sf):
    tt = de.rank_genes_ttest(t.lognorm(spark, sf), t.cells(spark, sf), "cell_type")
    return tt.select("group", "gene_id", r6("scores").alias("scores"), r6("dof", 3).alias("dof"))


@register("de_ttest_pvalues")
def de_ttest_pvalues(spark, sf):
    tt = de.rank_genes_ttest(t.lognorm(spark, sf), t.cells(spark, sf), "cell_type")
    return tt.select("group", "gene_id", "pvals", "pvals_adj")


@register("de_filter_markers", f"""{WELCH} SELECT grp AS "group", gene_id, {t.r6_sql('pin')} AS pct_in, {t.r6_sql('pout')} AS pct_out FROM v
 WHERE pin >= 0.02 AND pout <= 0.5 AND log2((exp(m1) - 1 + 1e-9::DOUBLE) / (exp(m2) - 1 + 1e-9::DOUBLE)) >= 0.5""")
def de_filter_markers(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    kept = de.filter_markers(markers(spark, sf), expr, obs, "cell_type", 0.02, 0.5, 0.5)
    return kept.select("group", "gene_id", r6("pct_in").alias("pct_in"), r6("pct_out").alias("pct_out"))


@register("de_two_group", f"""{LN}, c2 AS (SELECT * FROM cells WHERE cell_type IN ('MACHINERY', 'HOUSEHOLD')), e AS (SELECT lognorm.* FROM lognorm JOIN c2 USING (cell_id)),
 rk AS (SELECT gene_id, cell_id, rank() OVER (PARTITION BY gene_id ORDER BY value) + (COUNT(*) OVER (PARTITION BY gene_id, value) - 1) / 2.0::DOUBLE AS r FROM e),
 a AS (SELECT gene_id, COUNT(*) AS nnz, COUNT(*) FILTER (cell_type = 'MACHINERY') AS nz, SUM(CASE WHEN cell_type = 'MACHINERY' THEN r ELSE 0 END) AS rs FROM rk JOIN c2 USING (cell_id) GROUP BY 1),
 s AS (SELECT COUNT(*) AS n, COUNT(*) FILTER (cell_type = 'MACHINERY') AS n1 FROM c2)
 SELECT gene_id, {t.r6_sql("(rs + nz * (n - nnz) + (n1 - nz) * (n - nnz + 1) / 2.0::DOUBLE - n1 * (n + 1) / 2.0::DOUBLE) / sqrt(n1 * (n - n1)::DOUBLE * (n + 1) / 12.0::DOUBLE)")} AS scores FROM a, s""")
def de_two_group(spark, sf):
    obs = de.two_groups(t.cells(spark, sf), "cell_type", "MACHINERY", "HOUSEHOLD")
    expr = t.lognorm(spark, sf).join(obs.select("cell_id"), "cell_id", "left_semi")
    return de.rank_genes_wilcoxon(expr, obs, "cell_type").filter(F.col("group") == "MACHINERY").select("gene_id", r6("scores").alias("scores"))


BULK = f"""WITH {t.SQL_CELLS}, {t.SQL_COUNTS},
 bulk AS (SELECT cell_type AS cluster, sample_id AS sample, batch, gene_id, SUM(value) AS value FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3, 4)"""


@register("de_pseudobulk", f"{BULK} SELECT cluster, sample, gene_id, value FROM bulk WHERE cluster IN (SELECT cell_type FROM cells GROUP BY 1 HAVING COUNT(DISTINCT sample_id) >= 2)")
def de_pseudobulk(spark, sf):
    return de.pseudobulk(t.counts(spark, sf), t.cells(spark, sf), "sample_id", "cell_type")


@register("de_split_replicates", f"""WITH {t.SQL_CELLS}, o AS (SELECT cell_id, cell_type, COUNT(*) OVER (PARTITION BY cell_type) AS n, row_number() OVER (PARTITION BY cell_type ORDER BY md5('42-' || cell_id)) - 1 AS pos FROM cells),
 p AS (SELECT *, greatest(1, least(10, n // 10)) AS parts FROM o), q AS (SELECT *, n // parts AS small, n % parts AS extra FROM p),
 r AS (SELECT cell_id, cell_type, CASE WHEN pos < extra * (small + 1) THEN pos // (small + 1) ELSE extra + (pos - extra * (small + 1)) // small END AS replicate FROM q)
 SELECT cell_type, replicate, COUNT(*) AS n, SUM(cell_id)::BIGINT AS ids FROM r GROUP BY 1, 2 HAVING COUNT(*) >= 3""")
def de_split_replicates(spark, sf):
    r = de.split_replicates(t.cells(spark, sf), "cell_type")
    return r.groupBy("cell_type", "replicate").agg(F.count(F.lit(1)).alias("n"), F.sum("cell_id").alias("ids"))


CONDITION = f"""{BULK},
 dsg AS (SELECT DISTINCT cluster, o.batch || '_vs_R0' AS contrast, sample, CASE WHEN bulk.batch = 'R0' THEN 'ref' ELSE 'other' END AS side
   FROM bulk JOIN (SELECT DISTINCT cluster AS oc, batch FROM bulk WHERE batch <> 'R0') o ON oc = cluster AND (bulk.batch = 'R0' OR bulk.batch = o.batch)),
 rows_ AS (SELECT dsg.cluster, contrast, dsg.sample, side, gene_id, value FROM dsg JOIN bulk USING (cluster, sample)),
 ok AS (SELECT cluster, contrast, gene_id FROM rows_ GROUP BY 1, 2, 3 HAVING SUM(value) >= 10),
 tst AS (SELECT rows_.* FROM rows_ JOIN ok USING (cluster, contrast, gene_id)),
 lg AS (SELECT *, ln(1 + value / SUM(value) OVER (PARTITION BY cluster, contrast, sample) * 1000000) AS v FROM tst),
 dn AS (SELECT ok.cluster, ok.contrast, ok.gene_id, dsg.sample, dsg.side, coalesce(v, 0) AS v FROM ok JOIN dsg USING (cluster, contrast) LEFT JOIN lg ON lg.cluster = ok.cluster AND lg.contrast = ok.contrast AND lg.gene_id = ok.gene_id AND lg.sample = dsg.sample),
 rk AS (SELECT *, rank() OVER w + (COUNT(*) OVER (PARTITION BY cluster, contrast, gene_id, v) - 1) / 2.0::DOUBLE AS r FROM dn WINDOW w AS (PARTITION BY cluster, contrast, gene_id ORDER BY v)),
 ag AS (SELECT cluster, contrast, gene_id, COUNT(*) FILTER (side = 'other') AS n1, COUNT(*) AS n, SUM(CASE WHEN side = 'other' THEN r ELSE 0 END) AS rs,
   AVG(v) FILTER (side = 'other') - AVG(v) FILTER (side = 'ref') AS lfc, stddev_pop(v) FILTER (side = 'other') AS s1, stddev_pop(v) FILTER (side = 'ref') AS s2 FROM rk GROUP BY 1, 2, 3),
 pv AS (SELECT *, {t.norm_p_sql('(rs - n1 * (n + 1) / 2.0::DOUBLE) / sqrt(n1 * (n - n1)::DOUBLE * (n + 1) / 12.0::DOUBLE)')} AS p FROM ag WHERE n1 >= 1 AND n - n1 >= 1 AND NOT (s1 < 1e-9 AND s2 < 1e-9))"""


@register("de_condition_compare", f"{CONDITION} SELECT cluster, contrast, gene_id, {t.r6_sql('lfc')} AS log_fc, {t.r6_sql('p')} AS pvalue, {t.r6_sql('q')} AS pvalue_adj FROM {bh_sql('pv', 'gene_id', by='cluster, contrast')}")
def de_condition_compare(spark, sf):
    c = de.condition_compare(t.counts(spark, sf), t.cells(spark, sf), "sample_id", "cell_type", "batch", "R0")
    return c.select("cluster", "contrast", "gene_id", *[r6(x).alias(x) for x in ("log_fc", "pvalue", "pvalue_adj")])


@register("de_nb_glm")
def de_nb_glm(spark, sf):
    return de.condition_compare(t.counts(spark, sf), t.cells(spark, sf), "sample_id", "cell_type", "batch", "R0", "nb_glm")


# ------------------------------------------------------------------ communication
PAIRS = "prs AS (SELECT p_partkey AS ligand, p_partkey + 1 AS receptor FROM part)"
LR = f"""{LN}, {PAIRS}, {PERM},
 sz AS (SELECT cell_type AS label, COUNT(*) AS n FROM cells GROUP BY 1),
 mn AS (SELECT cell_type AS label, gene_id, SUM(value) / any_value(n) AS mean, COUNT(*) / any_value(n)::DOUBLE AS share FROM lognorm JOIN cells USING (cell_id) JOIN sz ON label = cell_type GROUP BY 1, 2),
 pm AS (SELECT perm, cell_type AS label, gene_id, SUM(value) / any_value(n) AS mean FROM lognorm JOIN perms USING (cell_id) JOIN sz ON label = cell_type GROUP BY 1, 2, 3),
 seen AS (SELECT ligand, receptor, l.label AS source, r.label AS target, l.mean AS lm, r.mean AS rm, l.share AS ls, r.share AS rs FROM prs JOIN mn l ON l.gene_id = ligand JOIN mn r ON r.gene_id = receptor),
 nul AS (SELECT l.perm, ligand, receptor, l.label AS source, r.label AS target, l.mean AS lm, r.mean AS rm FROM prs JOIN pm l ON l.gene_id = ligand JOIN pm r ON r.gene_id = receptor AND r.perm = l.perm),
 lr0 AS (SELECT s.ligand, s.receptor, s.source, s.target, any_value(s.lm * s.rm) AS score, COUNT(*) FILTER (n.lm * n.rm >= s.lm * s.rm) AS x,
   any_value(s.ls) AS ls, any_value(s.rs) AS rs, any_value((s.lm + s.rm) / 2) AS avg_, COUNT(*) FILTER ((n.lm + n.rm) / 2 >= (s.lm + s.rm) / 2) AS xa
   FROM seen s LEFT JOIN nul n USING (ligand, receptor, source, target) GROUP BY 1, 2, 3, 4),
 lr AS (SELECT ligand, receptor, source, target, round(score, 6) AS score, round((x + 1) / 21.0::DOUBLE, 6) AS pvalue FROM lr0)"""


def pairs(spark, sf):
    return t.load(spark, sf, "part").select(F.col("p_partkey").alias("ligand"), (F.col("p_partkey") + 1).alias("receptor"))


def lr(spark, sf):
    return cc.lr_score(t.lognorm(spark, sf), t.cells(spark, sf), pairs(spark, sf), "cell_type", 20)


register("cc_lr_score", f"{LR} SELECT * FROM lr")(lr)


@register("cc_lr_thresholded", f"""{LR} SELECT ligand, receptor, source, target, round(avg_, 4) AS score, round((xa + 1) / 21.0::DOUBLE, 4) AS pvalue FROM lr0 WHERE ls >= 0.02 AND rs >= 0.02 AND round(avg_, 4) >= 1e-6""")
def cc_lr_thresholded(spark, sf):
    return cc.lr_score_thresholded(t.lognorm(spark, sf), t.cells(spark, sf), pairs(spark, sf), "cell_type", 0.02, 20)


@register("cc_consensus_rank")
def cc_consensus_rank(spark, sf):
    return cc.consensus_rank(t.lognorm(spark, sf), t.cells(spark, sf), pairs(spark, sf), "cell_type")


@register("cc_aggregate_pairs", f"{LR} SELECT source, target, COUNT(*) AS n_interactions, {t.r6_sql('AVG(score)')} AS mean_score, {t.r6_sql('MAX(score)')} AS best FROM lr GROUP BY 1, 2")
def cc_aggregate_pairs(spark, sf):
    table = lr(spark, sf)
    agg = cc.aggregate_pairs(table)
    top = agg.join(table, (agg.top_ligand == table.ligand) & (agg.top_receptor == table.receptor) & (agg.source == table.source) & (agg.target == table.target))
    return top.select(agg.source, agg.target, "n_interactions", r6("mean_score").alias("mean_score"), r6("score").alias("best"))


@register("cc_signaling_roles", f"""{LR}, o AS (SELECT source AS cell_type, SUM(score) AS o, COUNT(*) AS n FROM lr GROUP BY 1), i AS (SELECT target AS cell_type, SUM(score) AS i, COUNT(*) AS n FROM lr GROUP BY 1)
 SELECT cell_type, round(coalesce(o, 0), 6) AS sender_score, round(coalesce(i, 0), 6) AS receiver_score, round(coalesce(o, 0) + coalesce(i, 0), 6) AS hub_score,
  CASE WHEN coalesce(o, 0) > coalesce(i, 0) * 1.5 THEN 'sender' WHEN coalesce(i, 0) > coalesce(o, 0) * 1.5 THEN 'receiver' ELSE 'balanced' END AS dominant_role, coalesce(o.n, 0) AS n_outgoing, coalesce(i.n, 0) AS n_incoming
 FROM o FULL JOIN i USING (cell_type)""")
def cc_signaling_roles(spark, sf):
    return cc.signaling_roles(lr(spark, sf), 6)


@register("cc_significant", f"{LR} SELECT ligand, receptor, source, target FROM lr WHERE pvalue < 0.05")
def cc_significant(spark, sf):
    return cc.significant_or_all(lr(spark, sf)).select("ligand", "receptor", "source", "target")


@register("cc_chord", f"{LR} SELECT source, target, {t.r6_sql('SUM(score)', 4)} AS score FROM lr GROUP BY 1, 2 ORDER BY SUM(score) DESC, 1, 2 LIMIT 20")
def cc_chord(spark, sf):
    return cc.lr_chord(lr(spark, sf)).withColumn("score", r6("score", 4))


@register("cc_matrix", f"""{LR}, n AS (SELECT ligand || '^' || receptor AS lr, source, score FROM lr), top AS (SELECT lr FROM n GROUP BY 1 ORDER BY AVG(score) DESC, lr LIMIT 20)
 SELECT lr, source, {t.r6_sql('AVG(score)')} AS score FROM n JOIN top USING (lr) GROUP BY 1, 2""")
def cc_matrix(spark, sf):
    m = cc.lr_matrix(lr(spark, sf))
    return m.unpivot("lr", [c for c in m.columns if c != "lr"], "source", "score").filter("score <> 0").withColumn("score", r6("score"))


@register("cc_parse_features", "SELECT p_partkey AS id, p_name || '^' || p_brand AS feature, TRUE AS is_pair, p_name AS ligand, p_brand AS receptor FROM part UNION ALL SELECT p_partkey, p_type || '_' || p_brand, TRUE, p_type, p_brand FROM part UNION ALL SELECT p_partkey, p_name || '_' || p_brand, FALSE, NULL, NULL FROM part")
def cc_parse_features(spark, sf):
    part = t.load(spark, sf, "part")
    feature = F.explode(F.array(F.concat_ws("^", "p_name", "p_brand"), F.concat_ws("_", "p_type", "p_brand"), F.concat_ws("_", "p_name", "p_brand"))).alias("feature")
    rows = part.select(F.col("p_partkey").alias("id"), feature)
    return rows.join(cc.parse_lr_features(rows.select("feature").distinct()), "feature")


@register("cc_spatial_score", f"""WITH {t.SQL_CELLS}, {t.sql_edges(6)}, {t.SQL_LOGNORM}, {PAIRS}
 SELECT src AS cell_id, ligand, receptor, {t.r6_sql('SUM(a.value * b.value)')} AS score FROM prs JOIN lognorm a ON a.gene_id = ligand JOIN edges ON src = a.cell_id JOIN lognorm b ON b.cell_id = dst AND b.gene_id = receptor GROUP BY 1, 2, 3""")
def cc_spatial_score(spark, sf):
    return cc.spatial_lr_score(t.lognorm(spark, sf), t.spatial_edges(spark, sf), pairs(spark, sf)).withColumn("score", r6("score"))


@register("cc_relabel", f"""{LR} SELECT left(source, 1) AS source_label, left(target, 1) AS target_label, COUNT(*) AS n_lr_pairs, {t.r6_sql('AVG(score)')} AS mean_score, {t.r6_sql('MAX(score)')} AS max_score, {t.r6_sql('MIN(pvalue)')} AS min_pvalue FROM lr GROUP BY 1, 2""")
def cc_relabel(spark, sf):
    labels = t.cells(spark, sf).select(F.col("cell_type").alias("cluster"), F.substring("cell_type", 1, 1).alias("label")).distinct()
    agg = cc.relabel_and_aggregate(lr(spark, sf), labels)
    return agg.select("source_label", "target_label", "n_lr_pairs", *[r6(c).alias(c) for c in ("mean_score", "max_score", "min_pvalue")])


@register("cc_resolve_pairs", """WITH k AS (SELECT upper(p_name) AS k, MIN(p_partkey) AS id FROM part GROUP BY 1), pr AS (SELECT DISTINCT p_name AS ligand, p_type AS receptor FROM part UNION SELECT DISTINCT p_name, reverse(p_name) FROM part UNION SELECT DISTINCT p_name, upper(p_name) FROM part)
 SELECT ligand, receptor, a.id AS ligand_id, b.id AS receptor_id FROM pr JOIN k a ON a.k = upper(ligand) JOIN k b ON b.k = upper(receptor)""")
def cc_resolve_pairs(spark, sf):
    part = t.load(spark, sf, "part")
    p = part.select(F.col("p_name").alias("ligand"), F.explode(F.array("p_type", F.reverse("p_name"), F.upper("p_name"))).alias("receptor")).distinct()
    return cc.resolve_lr_pairs(p, t.genes(spark, sf))


# --------------------------------------------------------------------- enrichment
def gene_sets(spark, sf):
    g = t.genes(spark, sf)
    return g.select(F.explode(F.array("chromosome", "gene_set")).alias("gene_set"), "gene_id")


SETS = "sets AS (SELECT p_brand AS gene_set, p_partkey AS gene_id FROM part UNION ALL SELECT p_type, p_partkey FROM part)"
LIST = f"""{WILCOXON}, {SETS}, anyp AS (SELECT "group", bool_or(lfc >= 0.25 AND q <= 0.05) AS a FROM mk GROUP BY 1),
 lst AS (SELECT "group", gene_id, rank FROM (SELECT mk."group", gene_id, row_number() OVER (PARTITION BY mk."group" ORDER BY scores DESC, gene_id) AS rank FROM mk JOIN anyp USING ("group") WHERE NOT a OR (lfc >= 0.25 AND q <= 0.05)) WHERE rank <= 200)"""


@register("en_gene_list", f'{LIST} SELECT "group", gene_id, rank FROM lst')
def en_gene_list(spark, sf):
    return en.gene_list(markers(spark, sf)).select("group", "gene_id", "rank")


@register("en_ora", f"""{LIST}, bg AS (SELECT COUNT(*) AS n FROM part), o AS (SELECT "group", gene_set, COUNT(*) AS k FROM lst JOIN sets USING (gene_id) GROUP BY 1, 2),
 d AS (SELECT "group", COUNT(*) AS m FROM lst GROUP BY 1), h AS (SELECT gene_set, COUNT(*) AS s FROM sets GROUP BY 1),
 tm AS (SELECT "group", gene_set, k, s, m, n, unnest(range(k, least(s, m) + 1)) AS i FROM o JOIN d USING ("group") JOIN h USING (gene_set), bg),
 ht AS (SELECT "group", gene_set, k, s, m, least(1, SUM(CASE WHEN m - i <= n - s THEN exp(lgamma(s + 1) - lgamma(i + 1) - lgamma(s - i + 1) + lgamma(n - s + 1) - lgamma(m - i + 1) - lgamma(n - s - m + i + 1) - lgamma(n + 1) + lgamma(m + 1) + lgamma(n - m + 1)) ELSE 0 END)) AS p FROM tm GROUP BY 1, 2, 3, 4, 5)
 SELECT "group", gene_set, k AS overlap, s AS set_size, m AS n_genes, {t.r6_sql('p')} AS pvalue, {t.r6_sql('q')} AS pvalue_adj FROM {bh_sql('ht', 'gene_set', by='"group"')}""")
def en_ora(spark, sf):
    o = en.ora(en.gene_list(markers(spark, sf)), gene_sets(spark, sf), t.genes(spark, sf))
    return o.select("group", "gene_set", "overlap", "set_size", "n_genes", r6("pvalue").alias("pvalue"), r6("pvalue_adj").alias("pvalue_adj"))


@register("en_gsea_prerank", f"""{WILCOXON}, {SETS}, ps AS (SELECT "group", gene_id, scores, row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene_id) AS pos, COUNT(*) OVER (PARTITION BY "group") AS n FROM mk),
 mem AS (SELECT "group", gene_set, pos, n, abs(scores) AS w FROM ps JOIN sets USING (gene_id)),
 cu AS (SELECT *, SUM(w) OVER u / SUM(w) OVER s AS up, (SUM(w) OVER u - w) / SUM(w) OVER s AS dn, COUNT(*) OVER u AS i, COUNT(*) OVER s AS h FROM mem
   WINDOW u AS (PARTITION BY "group", gene_set ORDER BY pos ROWS UNBOUNDED PRECEDING), s AS (PARTITION BY "group", gene_set)),
 es AS (SELECT "group", gene_set, any_value(h) AS n_hits, MAX(up - (pos - i) / (n - h)::DOUBLE) AS hi, MIN(dn - (pos - i) / (n - h)::DOUBLE) AS lo FROM cu GROUP BY 1, 2)
 SELECT "group", gene_set, n_hits, {t.r6_sql('CASE WHEN abs(hi) >= abs(lo) THEN hi ELSE lo END')} AS es FROM es""")
def en_gsea_prerank(spark, sf):
    g = en.gsea_prerank(en.rank_metric(markers(spark, sf)), gene_sets(spark, sf), n_perms=1)
    return g.select("group", "gene_set", "n_hits", r6("es").alias("es"))


@register("en_gsea_full")
def en_gsea_full(spark, sf):
    g = en.gsea_prerank(en.rank_metric(markers(spark, sf)), gene_sets(spark, sf), n_perms=50)
    return g.select("group", "gene_set", "nes", "pvalue", "pvalue_adj", F.size("leading_edge").alias("n_leading"))


@register("en_ssgsea", f"""{LN}, {SETS}, sz AS (SELECT cell_type AS label, COUNT(*) AS c FROM cells GROUP BY 1),
 gm AS (SELECT label, g.gene_id, round(coalesce(s / c, 0), 9) AS m FROM (SELECT DISTINCT gene_id FROM lognorm) g CROSS JOIN sz LEFT JOIN (SELECT cell_type, gene_id, SUM(value) AS s FROM lognorm JOIN cells USING (cell_id) GROUP BY 1, 2) x ON x.cell_type = label AND x.gene_id = g.gene_id),
 ps AS (SELECT label, gene_id, COUNT(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY m DESC, gene_id) AS pos FROM gm),
 mm AS (SELECT label, gene_set, n, n - pos + 1.0::DOUBLE AS a, pow(n - pos + 1.0::DOUBLE, 0.25) AS w FROM ps JOIN sets USING (gene_id))
 SELECT gene_set, label AS cluster, {t.r6_sql('SUM(w * a) / SUM(w) - (any_value(n) * (any_value(n) + 1) / 2.0::DOUBLE - SUM(a)) / (any_value(n) - COUNT(*))', 4)} AS score FROM mm GROUP BY 1, 2 HAVING COUNT(*) BETWEEN 5 AND 1000""")
def en_ssgsea(spark, sf):
    return en.ssgsea(t.lognorm(spark, sf), t.cells(spark, sf), gene_sets(spark, sf), "cell_type").withColumn("score", r6("score", 4))


@register("en_score_genes", f"""{LN}, {STATS % 'lognorm'}, mr AS (SELECT gene_id, rank() OVER (ORDER BY round(mean, 12)) AS rk FROM gstats), it AS (SELECT greatest(round(COUNT(*) / 24.0), 1) AS items FROM mr),
 bn AS (SELECT gene_id, floor(rk / items) AS bin FROM mr, it), st AS (SELECT gene_id FROM genes WHERE gene_set = 'PROMO' AND chromosome = 'Brand#1'),
 ct AS (SELECT gene_id FROM (SELECT gene_id, row_number() OVER (PARTITION BY bin ORDER BY md5('0-' || gene_id), gene_id) AS r FROM bn WHERE bin IN (SELECT bin FROM bn JOIN st USING (gene_id))) WHERE r <= 50 AND gene_id NOT IN (SELECT gene_id FROM st))
 SELECT c.cell_id, {t.r6_sql('coalesce(SUM(value) FILTER (e.gene_id IN (SELECT gene_id FROM st)), 0) / (SELECT COUNT(*) FROM st JOIN mr USING (gene_id)) - coalesce(SUM(value) FILTER (e.gene_id IN (SELECT gene_id FROM ct)), 0) / (SELECT COUNT(*) FROM ct)')} AS score
 FROM cells c LEFT JOIN lognorm e USING (cell_id) GROUP BY 1""")
def en_score_genes(spark, sf):
    chosen = t.genes(spark, sf).filter("gene_set = 'PROMO' AND chromosome = 'Brand#1'")
    return en.score_genes(t.lognorm(spark, sf), t.cells(spark, sf), chosen).withColumn("score", r6("score"))


# --------------------------------------------------------- annotation, deconvolution
@register("an_markers", f"""{WILCOXON}, sig AS (SELECT p_brand AS cell_type, p_partkey AS gene_id, CAST(substr(p_brand, 7) AS INT) AS position FROM part),
 tp AS (SELECT "group", gene_id FROM (SELECT "group", gene_id, row_number() OVER (PARTITION BY "group" ORDER BY scores DESC, gene_id) AS r FROM mk) WHERE r <= 30),
 ov AS (SELECT "group", cell_type, COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM sig s WHERE s.cell_type = sig.cell_type) AS s, any_value(position) AS pos FROM tp JOIN sig USING (gene_id) GROUP BY 1, 2),
 b AS (SELECT *, row_number() OVER (PARTITION BY "group" ORDER BY s DESC, pos) AS r FROM ov)
 SELECT "group", CASE WHEN s < 0.03 THEN 'Unknown' ELSE cell_type END AS cell_type, round(s, 3) AS score FROM b WHERE r = 1""")
def an_markers(spark, sf):
    sig = t.genes(spark, sf).select(F.col("chromosome").alias("cell_type"), "gene_id", F.expr("cast(substring(chromosome, 7) as int)").alias("position"))
    return an.annotate_by_markers(markers(spark, sf), sig, floor=0.03)


@register("an_label_transfer", f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS src, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id),
 v AS (SELECT src, label, COUNT(*) AS n FROM p WHERE r <= 30 GROUP BY 1, 2), w AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, label) AS r FROM v)
 SELECT src AS cell_id, label AS predicted, {t.r6_sql('n / 30.0::DOUBLE')} AS confidence FROM w WHERE r = 1""")
def an_label_transfer(spark, sf):
    e = embedding(spark, sf, "label")
    return an.label_transfer_knn(e.select("cell_id", "vec"), None, e.select("cell_id", "label")).withColumn("confidence", r6("confidence"))


@register("an_assign_probabilities", f"""WITH p AS (SELECT o_custkey AS cell_id, o_orderpriority AS label, SUM(o_totalprice) AS p FROM orders GROUP BY 1, 2), s AS (SELECT *, p / SUM(p) OVER (PARTITION BY cell_id) AS q FROM p),
 r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY q DESC, label) AS r FROM s) SELECT cell_id, label, {t.r6_sql('q')} AS confidence FROM r WHERE r = 1""")
def an_assign_probabilities(spark, sf):
    p = t.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("label")).agg(F.sum("o_totalprice").alias("p"))
    return an.assign_from_probabilities(p).withColumn("confidence", r6("confidence"))


@register("an_marker_matrix", "SELECT p_brand AS cell_type, COUNT(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem) GROUP BY 1")
def an_marker_matrix(spark, sf):
    seen = t.load(spark, sf, "lineitem").select(F.col("l_partkey").alias("gene_id")).distinct()
    sig = t.genes(spark, sf).select(F.col("chromosome").alias("cell_type"), "gene_id")
    return an.marker_matrix(sig, seen).groupBy("cell_type").agg(F.sum("value").alias("n"))


@register("an_impute_knn", f"""WITH {t.SQL_CELLS}, {t.sql_edges(5)}, {t.SQL_LOGNORM}, w AS (SELECT src, dst, 1 / (dist + 1e-10::DOUBLE) AS w FROM edges)
 SELECT src AS cell_id, gene_id, {t.r6_sql('SUM(w.w * value) / any_value(s.t)')} AS value FROM w JOIN lognorm e ON e.cell_id = dst JOIN (SELECT src, SUM(w) AS t FROM w GROUP BY 1) s USING (src) GROUP BY 1, 2""")
def an_impute_knn(spark, sf):
    return an.impute_knn(t.spatial_edges(spark, sf, 5), t.lognorm(spark, sf), t.genes(spark, sf), t.cells(spark, sf)).withColumn("value", r6("value"))


@register("an_localize", f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS cell_id, b.vec_id AS spot_id, 1 - list_cosine_similarity(a.v, b.v) AS d FROM e a JOIN e b ON a.label < 5 AND b.label >= 5),
 r AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d, spot_id) AS rank FROM p) SELECT cell_id, spot_id, {t.r6_sql('d')} AS dist, rank FROM r WHERE rank = 1""")
def an_localize(spark, sf):
    e = embedding(spark, sf, "label")
    return an.localize_cells(e.filter("label < 5"), e.filter("label >= 5")).withColumn("dist", r6("dist"))


@register("dc_signature", f"{LN} SELECT cell_type, gene_id, {t.r6_sql('SUM(value) / (SELECT COUNT(*) FROM cells c WHERE c.cell_type = cells.cell_type)')} AS mean FROM lognorm JOIN cells USING (cell_id) GROUP BY 1, 2")
def dc_signature(spark, sf):
    return an.signature_matrix(t.lognorm(spark, sf), t.cells(spark, sf), "cell_type").withColumn("mean", r6("mean"))


def proportions(spark, sf):
    expr, obs = t.lognorm(spark, sf), t.cells(spark, sf)
    return an.nnls_deconvolve(expr, obs, an.signature_matrix(expr, obs, "cell_type"))


register("dc_nnls")(proportions)
PROP = "prop AS (SELECT o_custkey AS cell_id, o_orderpriority AS cell_type, SUM(o_totalprice) / SUM(SUM(o_totalprice)) OVER (PARTITION BY o_custkey) AS proportion FROM orders GROUP BY 1, 2)"


def order_shares(spark, sf):
    p = t.load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cell_id"), F.col("o_orderpriority").alias("cell_type")).agg(F.sum("o_totalprice").alias("_p"))
    total = p.groupBy("cell_id").agg(F.sum("_p").alias("_t"))
    return p.join(total, "cell_id").select("cell_id", "cell_type", (F.col("_p") / F.col("_t")).alias("proportion"))


@register("dc_stats", f"""WITH {PROP}, d AS (SELECT cell_type FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY proportion DESC, cell_type) AS r FROM prop) WHERE r = 1)
 SELECT cell_type, {t.r6_sql('AVG(proportion)')} AS mean_proportion, (SELECT COUNT(*) FROM d WHERE d.cell_type = prop.cell_type) AS n_dominant FROM prop GROUP BY 1""")
def dc_stats(spark, sf):
    return an.deconv_stats(order_shares(spark, sf)).withColumn("mean_proportion", r6("mean_proportion"))


@register("dc_diversity", f"""WITH {PROP} SELECT cell_id, {t.r6_sql('-SUM((proportion + 1e-10::DOUBLE) * log2(proportion + 1e-10::DOUBLE)) / log2(COUNT(*))')} AS diversity FROM prop GROUP BY 1 HAVING COUNT(*) > 1""")
def dc_diversity(spark, sf):
    p = order_shares(spark, sf)
    many = p.groupBy("cell_id").count().filter("count > 1")
    return an.diversity_entropy(p.join(many, "cell_id", "left_semi")).withColumn("diversity", r6("diversity"))
